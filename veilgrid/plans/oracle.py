"""DuckDB SQL of the queries, written on its own: RE2 patterns with spelled-out boundaries, windows, and recursion."""

from __future__ import annotations

from ..functions import patterns as P
from .invoices import HEIGHT, WIDTH, duck_lines

# Fixed values, down to DETAIL: the patterns of functions/patterns.py as RE2 writes them. A word's edges, which RE2 knows for ASCII only, are spelled out.
B = r"(?:^|[^\p{L}\p{N}_])"
E = r"(?:$|[^\p{L}\p{N}_])"
NP = r"[A-ZÄÖÜ][A-ZÄÖÜa-zäöüß]+(?:-[A-ZÄÖÜ][A-ZÄÖÜa-zäöüß]+)?"
NPO = r"[A-ZÄÖÜa-zäöüß][A-ZÄÖÜa-zäöüß]{2,}(?:-[A-ZÄÖÜa-zäöüß][A-ZÄÖÜa-zäöüß]+)?"
PL = r"(?:Pat(?:ient(?:in|en)?)?|Versicherte[rn]?|Mitglied|Person|Name|Rechnungsempfänger(?:in)?|Zahlungspflichtige[rn]?)"
SEP = r"(?:\s*,\s*|\s+)"
CITY = r"(?:[A-ZÄÖÜ][a-zäöüß]{2,}|[A-ZÄÖÜ]{4,})"
D = r"\d{1,2}\.\s?\d{1,2}\.\s?\d{2,4}"
DATE = rf"{B}{D}{E}"
HOST = r"[a-z0-9][a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:de|com|net|org|eu|at|ch)"
PLZ_EDGE = r"(?:^|[^\p{L}\p{N}_/-]|(?:^|[^0-9])-)"
HOST_EDGE = r"(?:$|[^\p{L}\p{N}_.-])"
NUMBER_REST = r"[0-9\s()/+-]{5,}"
TEL = r"(?:[Tt][Ee][Ll](?:[Ee][Ff][Oo][Nn])?|[Tt][Ee][Ll][Ee][Ff][Aa][Xx]|[Ff][Aa][Xx]|[Mm][Oo][Bb][Ii][Ll])"
RULES = [
    ("SALUT", rf"{B}(?:Herrn?|Frau|Fräulein|Frl|Familie|Fam|Eheleute){E}"),
    ("PATIENT_NAME", rf"{B}{PL}(?:\.|\s|:)+(?:[A-ZÄÖÜ]\.\s*)*{NP}"),
    ("TITLE_NAME", rf"{B}(?:(?:Prof|Priv\.-Doz|Dr(?:es)?|med|dent|vet|univ|habil|Dipl\.-?Med)\.\s*)+(?:[A-ZÄÖÜ]\.\s*)*[A-ZÄÖÜ][a-zäöüß]+"),
    ("NAME_DATE", rf"{NP}\s*,\s*{NP}\s+{D}{E}"),
    ("DE_STREET", rf"{B}[A-ZÄÖÜ][A-ZÄÖÜa-zäöüß.\-]+(?i:stra(?:ße|sse)|str|weg|platz|gasse|allee|ring|damm)\.?\s*\d+[a-zA-Z]?{E}"),
    ("DE_PLZ_CITY", rf"(?:^|[^\p{{L}}\p{{N}}_/-]|(?:^|[^0-9])-)[0-9]{{5}}\s*{CITY}(?:[ -]{CITY})?{E}"),
    ("ORG_LEGAL", rf"{B}(?:g?GmbH|mbH|UG|AG|KG|OHG|GbR|PartG(?:mbB)?|Ltd|Inc){E}|{B}e\.\s?[KV]\."),
    ("CONTACT", rf"(?i){B}https?://\S+|{B}www\.[\w\-]+(?:\.[\w\-]+)+|[\w.\-+]+@[\w\-]+(?:\.[\w\-]+)+"),
    ("IMPRINT", rf"(?i){B}HR[AB]\s*\d|{B}(?:USt|Umsatzsteuer)[\-.\s]?Id|{B}Steuer[\-\s]?(?:nummer|Nr)|{B}IK[\-\s.]?(?:Nr\.?)?\s*:?\s*\d|{B}(?:LANR|LAN\-Nr|BSNR|IBAN|BIC|BLZ){E}|{B}Bankverbindung{E}|{B}Konto(?:\-?Nr)?{E}|{B}Postfach{E}"),
]
MORE_CONTACT = [rf"{B}{HOST}(?:$|[^\p{{L}}\p{{N}}_.-])", rf"{B}{TEL}(?:\.?\s*:?\s*[(+]|(?:\.\s*:?\s*|\s+:?\s*|:\s*)[0-9(+]){NUMBER_REST}"]
ORG_MEDICAL = rf"(?i){B}(?:MVZ|[\p{{L}}\p{{N}}_]*praxis|Praxisgemeinschaft|[\p{{L}}\p{{N}}_]*klinik(?:um)?|[\p{{L}}\p{{N}}_]*krankenhaus|[\p{{L}}\p{{N}}_]*ärztehaus|[\p{{L}}\p{{N}}_]*zentrum|Institut|[\p{{L}}\p{{N}}_]*labor|Laborgemeinschaft|Apotheke|Sanitätshaus|Krankenkasse|[\p{{L}}\p{{N}}_]*versicherung|[\p{{L}}\p{{N}}_]*verrechnungsstelle|Abrechnungsstelle|Abrechnungsgesellschaft|Berufsausübungsgemeinschaft){E}|{B}Behandl\w*\s+durch{E}"
MONEY = rf"{B}\d{{1,3}}(?:\.\d{{3}})*,\d{{2}}{E}"
BIRTH_LABEL = r"(?i)geburt|geboren|geb[.\s-]*dat"
BIRTH_CELL = r"(?i)^\s*(?:geburts(?:datum|tag)|geb[.\s-]*dat(?:um)?)\.?\s*:?\s*$"
BIRTH_MARK = rf"(?i){B}geb\.?\s*(?:am\s+)?{D}{E}|\*\s*{D}{E}"
ID_LABEL = rf"(?i){B}(?:Versicherten|Versicherungs(?:schein)?|Patienten|Pat\.?|Fall|Aufnahme|Mitglieds?|Vertrags)[-\s.]*(?:Nr|Nummer){E}"
IDV = r"[A-Z]?\d(?:[ ./-]?\d){3,}"
ID_VALUE = rf"{B}{IDV}{E}"
PERSON_CELL = rf"^\s*(?:[A-ZÄÖÜ][a-zäöüß]+e[rnsm]?\s+)?{PL}\s*\.?\s*:?\s*$"
NAME_VALUE = rf"^\s*(?:{NP}{SEP}{NPO}|{NPO}{SEP}{NP})\s*$"
DETAIL = rf"{NAME_VALUE}|^\s*{D}\s*$|^\s*{IDV}\s*$"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def m(pattern: str, column: str = "text") -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


def rule_test(name: str, pattern: str) -> str:
    return " OR ".join(m(p) for p in [pattern, *(MORE_CONTACT if name == "CONTACT" else [])])


RULE = "CASE " + " ".join(f"WHEN {rule_test(n, p)} THEN '{n}'" for n, p in RULES) + " END"
ANY_RULE = f"({RULE}) IS NOT NULL"
SENDER = f"({ANY_RULE} OR {m(ORG_MEDICAL)})"
RECIPIENT = f"({m(RULES[4][1])} OR {m(RULES[5][1])})"
NOT_BLANK = m(r"\S")


def _core(pattern: str) -> list[str]:
    """A pattern's alternatives, each with what lies between its edges in a group."""
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    out = []
    for part in pattern.removeprefix("(?i)").replace("|" + B, "\0" + B).replace(r"|[\w.\-+]+@", "\0" + r"[\w.\-+]+@").split("\0"):
        lead = next((x for x in (B, PLZ_EDGE) if part.startswith(x)), "")
        tail = next((x for x in (E, HOST_EDGE, NUMBER_REST) if part.endswith(x)), "")
        body = part[len(lead) : len(part) - len(tail)]
        out.append(f"{lead}({flag}{body}){tail}")
    return out


def _matched(name: str, pattern: str) -> str:
    """SQL: the text of a rule's first match, without the edges around it."""
    parts = [c for p in [pattern, *(MORE_CONTACT if name == "CONTACT" else [])] for c in _core(p)]
    whole = "|".join(f"(?:{p})" for p in parts)
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {_q(whole)}, {i + 1}), '')" for i in range(len(parts))) + ")"


MATCHED = "CASE " + " ".join(f"WHEN {rule_test(n, p)} THEN {_matched(n, p)}" for n, p in RULES) + " END"


def quoted(x: str) -> str:
    """SQL: a text in quotes as dumps have it."""
    slash, one, two = "chr(92)", "chr(39)", "chr(34)"
    body = f"replace({x}, {slash}, {slash} || {slash})"
    for code, letter in ((10, "n"), (13, "r"), (9, "t")):
        body = f"replace({body}, chr({code}), {slash} || '{letter}')"
    return f"CASE WHEN contains({x}, {one}) AND NOT contains({x}, {two}) THEN {two} || {body} || {two} ELSE {one} || replace({body}, {one}, {slash} || {one}) || {one} END"
LINES = f"l AS MATERIALIZED ({duck_lines()})"

BANDS = f"""
  med AS (SELECT doc_id, page, quantile_cont(height, 0.5) AS mh FROM l GROUP BY ALL),
  mon AS (SELECT doc_id, page, top, top + height AS bottom FROM l WHERE {m(MONEY)}),
  f1 AS (SELECT *, max(bottom) OVER (PARTITION BY doc_id, page ORDER BY top, bottom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM mon),
  f2 AS (SELECT *, sum(CASE WHEN top <= so_far THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY top, bottom ROWS UNBOUNDED PRECEDING) AS rw FROM f1),
  r1 AS (SELECT doc_id, page, rw, min(top) AS top, max(bottom) AS bottom FROM f2 GROUP BY ALL),
  r2 AS (SELECT r1.*, mh, lag(bottom) OVER (PARTITION BY doc_id, page ORDER BY rw) AS pb FROM r1 JOIN med USING (doc_id, page)),
  r3 AS (SELECT *, sum(CASE WHEN top - pb <= 3.0 * mh THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY rw ROWS UNBOUNDED PRECEDING) AS cl FROM r2),
  bands AS (SELECT doc_id, page, min(top) AS band_top, max(bottom) AS band_bottom FROM r3 GROUP BY doc_id, page, cl HAVING count(*) >= 2)"""
TABLE = "tl AS (SELECT DISTINCT l.doc_id, l.page, l.line_no FROM l JOIN bands b ON l.doc_id = b.doc_id AND l.page = b.page AND l.top + l.height / 2 BETWEEN b.band_top AND b.band_bottom)"
FLAGS = f"""
  fl AS MATERIALIZED (SELECT l.*, r.rule, r.is_label, r.is_value, r.is_merged, r.is_header FROM l, LATERAL (VALUES
    ('birth', {m(BIRTH_LABEL)}, {m(DATE)}, {m(BIRTH_MARK)}, {m(BIRTH_CELL)}),
    ('id', {m(ID_LABEL)}, {m(ID_VALUE)}, false, false),
    ('name', {m(PERSON_CELL)}, {m(NAME_VALUE)}, false, {m(PERSON_CELL)})) r(rule, is_label, is_value, is_merged, is_header)),
  mv AS (SELECT doc_id, page, line_no, rule FROM fl WHERE is_value AND NOT is_header AND (is_label OR is_merged)),
  sr AS (SELECT * FROM fl v WHERE is_value AND NOT is_header AND NOT is_label AND NOT is_merged AND EXISTS (
    SELECT 1 FROM fl b WHERE b.doc_id = v.doc_id AND b.page = v.page AND b.rule = v.rule AND b.is_label
      AND v.top + v.height / 2 BETWEEN b.top - v.height / 2 AND b.top + b.height + v.height / 2))"""
# The walk down a column: from every start, the next line by (top, line_no) that isn't skipped, as long as it is a value.
WALK = f"""
  ln AS MATERIALIZED (SELECT l.*, mh, tl.line_no IS NOT NULL AS in_table, {m(DETAIL)} AS d_ok, {m(DATE)} AS b_ok, {m(NAME_VALUE)} AS n_ok
    FROM l JOIN med USING (doc_id, page) LEFT JOIN tl USING (doc_id, page, line_no)),
  st AS (SELECT doc_id, page, line_no AS s, "left" AS x0, "left" + width AS x1, top + height AS bottom, 'detail' AS want FROM sr WHERE rule <> 'id'
    UNION SELECT doc_id, page, line_no, "left", "left" + width, top + height, rule FROM fl WHERE is_header),
  walk AS (SELECT doc_id, page, s, x0, x1, bottom, want, -1 AS line_no FROM st
    UNION ALL SELECT * FROM (SELECT w.doc_id, w.page, w.s, w.x0, w.x1, n.top + n.height, w.want, n.line_no FROM walk w, LATERAL (
      SELECT ln.* FROM ln WHERE ln.doc_id = w.doc_id AND ln.page = w.page AND ln.top >= w.bottom AND ln."left" + ln.width / 2 BETWEEN w.x0 AND w.x1
      ORDER BY ln.top, ln.line_no LIMIT 1) n
      WHERE NOT n.in_table AND n.top - w.bottom <= 3.0 * n.mh AND CASE w.want WHEN 'detail' THEN n.d_ok WHEN 'birth' THEN n.b_ok ELSE n.n_ok END)),
  cb AS (SELECT DISTINCT doc_id, page, line_no FROM walk WHERE line_no >= 0),
  lv AS (SELECT doc_id, page, line_no FROM mv UNION SELECT doc_id, page, line_no FROM sr UNION SELECT doc_id, page, line_no FROM cb)"""
STOP = "[" + ", ".join(f"'{w.lower()}'" for w in P.STOPWORDS) + "]"
NAMES = f"""
  ev AS (SELECT doc_id, page, text FROM l WHERE {m(RULES[1][1])} OR {m(RULES[2][1])} OR {m(RULES[0][1])} OR {m(BIRTH_MARK)} OR {m(RULES[3][1])} OR ({m(BIRTH_LABEL)} AND {m(DATE)})),
  wd AS (SELECT doc_id, page, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM ev),
  nm AS (SELECT DISTINCT doc_id, page, name FROM wd WHERE {m('^[A-ZÄÖÜ][A-ZÄÖÜa-zäöüß]{3,}$', 'name')} AND NOT list_contains({STOP}, lower(name))),
  fs AS (SELECT doc_id, lower(name) AS word, min(page) AS seen FROM nm GROUP BY ALL),
  lw AS (SELECT doc_id, page, line_no, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w FROM l),
  nh AS (SELECT DISTINCT lw.doc_id, lw.page, lw.line_no FROM lw JOIN fs ON lw.doc_id = fs.doc_id AND lower(lw.w) = fs.word AND fs.seen <= lw.page WHERE {m('^[A-ZÄÖÜ]', 'w')})"""
PAIRS = f"""
  nb AS MATERIALIZED (SELECT * FROM l WHERE {NOT_BLANK}),
  ap AS (SELECT x.doc_id, x.page, x.line_no AS a, y.line_no AS b FROM nb x JOIN nb y ON x.doc_id = y.doc_id AND x.page = y.page AND x.line_no < y.line_no
    AND abs(x."left" - y."left") <= 0.4::DOUBLE * least(x.height, y.height)
    AND greatest(x.top, y.top) - least(x.top + x.height, y.top + y.height) <= 1.2::DOUBLE * least(x.height, y.height))"""
COMPONENTS = f"""{PAIRS},
  bi AS MATERIALIZED (SELECT doc_id, page, a, b FROM ap UNION ALL SELECT doc_id, page, b, a FROM ap),
  reach AS (SELECT doc_id, page, line_no AS s, line_no AS t FROM nb UNION SELECT r.doc_id, r.page, r.s, bi.b FROM reach r JOIN bi ON bi.doc_id = r.doc_id AND bi.page = r.page AND bi.a = r.t),
  cc AS (SELECT doc_id, page, s AS line_no, min(t) AS block FROM reach GROUP BY ALL)"""
REGIONS = f"""{COMPONENTS},
  bl AS (SELECT nb.*, block, {SENDER} AS snd, {RECIPIENT} AS rcp FROM nb JOIN cc USING (doc_id, page, line_no)),
  bk AS (SELECT doc_id, page, block, min("left") AS x0, min(top) AS y0, max("left" + width) AS x1, max(top + height) AS y1,
      bool_or(snd AND top < 0.12 * {HEIGHT}) AS is_h, bool_or(snd AND top + height > {HEIGHT} - 0.10 * {HEIGHT}) AS is_f,
      bool_or(snd AND "left" >= 0.5 * {WIDTH} AND top <= 0.5 * {HEIGHT}) AS is_s, bool_or(rcp AND "left" < 0.5 * {WIDTH} AND top BETWEEN 0.05 * {HEIGHT} AND 0.45 * {HEIGHT}) AS is_r FROM bl GROUP BY ALL),
  rb AS (
    SELECT doc_id, page, 'header' AS kind, 0 AS x0, 0 AS y0, {WIDTH} AS x1, CAST(round_even(least(max(y1)::DOUBLE, 0.12::DOUBLE * {HEIGHT} * 1.5), 0) AS INT) + 2 AS y1 FROM bk WHERE is_h GROUP BY doc_id, page
    UNION ALL SELECT doc_id, page, 'footer', 0, CAST(round_even(greatest(min(y0)::DOUBLE, {HEIGHT} - ({HEIGHT} - ({HEIGHT} - 0.10::DOUBLE * {HEIGHT})) * 1.5), 0) AS INT) - 2, {WIDTH}, {HEIGHT} FROM bk WHERE is_f GROUP BY doc_id, page
    UNION ALL SELECT doc_id, page, 'sender', x0 - 2, y0 - 2, x1 + 2, y1 + 2 FROM bk WHERE is_s
    UNION ALL SELECT doc_id, page, 'recipient', x0 - 2, y0 - 2, x1 + 2, y1 + 2 FROM bk WHERE is_r)"""
BIC = rf"{B}[A-Z]{{6}}[A-Z0-9]{{2}}(?:[A-Z0-9]{{3}})?{E}"
KONTO = rf"{B}(?:Kto|Konto(?:nummer|[ \-]?Nr)?|BLZ|Bankleitzahl)\.?\s*:?\s*\d(?:[ .]?\d){{3,}}{E}"
SUFFIX = r"(?i:stra(?:ße|sse)|str|weg|platz|gasse|allee|ring|damm)"
STREET2 = rf"{B}[A-ZÄÖÜ][A-ZÄÖÜa-zäöüß.\-]+(?:{SUFFIX}|\s+{SUFFIX})\.?\s*\d+[a-zA-Z]?{E}"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b"
CARD = r"\b[0-9](?:[ \-]?[0-9]){12,18}\b"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:^|[^0-9.,/])((?:\+49[ \-/]?|0)\d{2,4}[ /\-]{1,3}\d[\d \-]{3,12}\d|0\d{6,12})\b"
PHONE_OK = r"(NOT regexp_matches(trim(x), '^[0-9]+$') AND NOT regexp_matches(trim(x), '^\d{1,2}\.\d{1,2}\.\d{2,4}[\s\d.\-/]*$'))"


def iban_ok(x: str) -> str:
    bare = f"replace({x}, ' ', '')"
    chars = f"string_split(substring({bare}, 5) || substring({bare}, 1, 4), '')"
    return f"list_reduce(list_prepend(0, list_transform({chars}, lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, c: (a * CASE WHEN c >= 10 THEN 100 ELSE 10 END + c) % 97) = 1"


def luhn_ok(x: str) -> str:
    bare = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"(list_sum(list_transform(string_split(reverse({bare}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN ascii(c) - 48 WHEN (ascii(c) - 48) * 2 > 9 THEN (ascii(c) - 48) * 2 - 9 ELSE (ascii(c) - 48) * 2 END)) % 10 = 0 AND length({bare}) >= 13)"


PII = f"""(len(list_filter(regexp_extract_all(text, {_q(IBAN)}), lambda x: {iban_ok('x')})) > 0 OR {m(EMAIL)} OR len(list_filter(regexp_extract_all(text, {_q(CARD)}), lambda x: {luhn_ok('x')})) > 0
  OR len(list_filter(regexp_extract_all(text, {_q(PHONE)}, 1), lambda x: NOT regexp_matches(trim(x), '^[0-9]+$') AND NOT regexp_matches(trim(x), '^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{2,4}}[\\s\\d.\\-/]*$'))) > 0
  OR ({m(BIC)} AND {m(rf'(?i){B}(?:bic|swift){E}')}) OR {m(KONTO)} OR {m(STREET2)} OR {m(RULES[5][1])})"""
REASONS = f"""
  rs AS MATERIALIZED (SELECT l.*, tl.line_no IS NOT NULL AS in_table, CASE WHEN lv.line_no IS NOT NULL THEN 'labeled-value' WHEN {ANY_RULE} THEN 'static-rule' WHEN nh.line_no IS NOT NULL THEN 'name-memory'
      WHEN tl.line_no IS NULL AND {PII} THEN 'classifier' END AS reason
    FROM l LEFT JOIN lv USING (doc_id, page, line_no) LEFT JOIN nh USING (doc_id, page, line_no) LEFT JOIN tl USING (doc_id, page, line_no) WHERE {NOT_BLANK}),
  lb AS (SELECT doc_id, page, line_no, reason, "left" - 2 AS x0, top - 2 AS y0, "left" + width + 2 AS x1, top + height + 2 AS y1 FROM rs WHERE reason IS NOT NULL)"""


def coverage_sql(name: str, boxes: str) -> str:
    """Shares of lines covered, on the grid of all cuts through the boxes that meet a line."""
    return f"""
  {name}m AS MATERIALIZED (SELECT rs.doc_id, rs.page, rs.line_no, rs.width * rs.height AS area, greatest(b.x0, rs."left") AS x0, least(b.x1, rs."left" + rs.width) AS x1, greatest(b.y0, rs.top) AS y0, least(b.y1, rs.top + rs.height) AS y1
    FROM rs JOIN {boxes} b ON b.doc_id = rs.doc_id AND b.page = rs.page AND b.x0 < rs."left" + rs.width AND b.x1 > rs."left" AND b.y0 < rs.top + rs.height AND b.y1 > rs.top),
  {name}x AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, page, line_no ORDER BY x) AS xn FROM (SELECT doc_id, page, line_no, x0 AS x FROM {name}m UNION SELECT doc_id, page, line_no, x1 FROM {name}m)),
  {name}y AS (SELECT *, lead(y) OVER (PARTITION BY doc_id, page, line_no ORDER BY y) AS yn FROM (SELECT doc_id, page, line_no, y0 AS y FROM {name}m UNION SELECT doc_id, page, line_no, y1 FROM {name}m)),
  {name} AS (SELECT doc_id, page, line_no, sum((xn - x) * (yn - y))::DOUBLE AS covered FROM {name}x JOIN {name}y USING (doc_id, page, line_no) WHERE xn IS NOT NULL AND yn IS NOT NULL
    AND EXISTS (SELECT 1 FROM {name}m m WHERE m.doc_id = {name}x.doc_id AND m.page = {name}x.page AND m.line_no = {name}x.line_no AND m.x0 <= x AND m.x1 >= xn AND m.y0 <= y AND m.y1 >= yn) GROUP BY ALL)"""


OUTCOMES = f"""
  ab AS (SELECT doc_id, page, x0, y0, x1, y1 FROM lb UNION ALL SELECT doc_id, page, x0, y0, x1, y1 FROM rb),
  {coverage_sql('ca', 'ab')}, {coverage_sql('cr', 'rb')},
  oc AS (SELECT rs.doc_id, rs.page, rs.line_no, rs.reason AS r, in_table, CASE WHEN width * height > 0 THEN coalesce(ca.covered, 0) / (width * height) ELSE 0 END AS coverage,
      CASE WHEN width * height > 0 THEN coalesce(cr.covered, 0) / (width * height) ELSE 0 END AS by_region
    FROM rs LEFT JOIN ca USING (doc_id, page, line_no) LEFT JOIN cr USING (doc_id, page, line_no)),
  vd AS (SELECT doc_id, page, line_no, CASE WHEN coverage <= 0.1 THEN 'keep' WHEN coverage >= 0.9 THEN 'REDACT' ELSE 'PARTIAL' END AS kind,
      CASE WHEN coverage <= 0.1 THEN CASE WHEN in_table AND r IS NULL THEN 'item table' END ELSE coalesce(r, CASE WHEN by_region > 0.1 THEN 'region' ELSE 'overlap' END) END AS reason, coverage FROM oc)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([LINES, *parts])


def trace_sql(rules: str) -> str:
    """The whole commentary; `rules` is the relation qt of rules and the texts that they matched."""
    id_ = "doc_id, page, line_no"
    each = lambda p: f"regexp_extract_all(text, {_q(_core(p)[0])}, 1)"
    numbers = f"regexp_extract_all(text, {_q(PHONE)}, 1)"
    finds = [
        ("IBAN_CODE", f"list_filter(regexp_extract_all(text, {_q(IBAN)}), lambda x: {iban_ok('x')})", None), ("EMAIL_ADDRESS", f"regexp_extract_all(text, {_q(EMAIL)})", None),
        ("CREDIT_CARD", f"list_filter(regexp_extract_all(text, {_q(CARD)}), lambda x: {luhn_ok('x')})", None), ("PHONE_NUMBER", f"list_filter({numbers}, lambda x: {PHONE_OK})", None),
        ("BIC_CODE", f"CASE WHEN {m(rf'(?i){B}(?:bic|swift){E}')} THEN {each(BIC)} ELSE [] END", None), ("KONTO", each(KONTO), None), ("DE_ADDRESS", each(STREET2), None), ("DE_ADDRESS", each(RULES[5][1]), 0.6),
    ]
    told = [f"list_transform({found}, lambda x: '    match {kind} {P.SCORES[kind] if score is None else score:.2f} ' || {quoted('x')} || ' [pattern]')" for kind, found, score in finds]
    told.append(f"list_transform(list_filter({numbers}, lambda x: NOT {PHONE_OK}), lambda x: '      Ignoring PHONE_NUMBER ' || {quoted('trim(x)')} || ': a date or an identifier')")
    ms = told[0]
    for x in told[1:]:
        ms = f"list_concat({ms}, {x})"
    return f"""{with_(BANDS, TABLE, FLAGS, WALK, NAMES, REASONS, REGIONS, rules)},
      mt AS MATERIALIZED (SELECT {id_}, {ms} AS ms FROM rs WHERE reason = 'classifier' OR (reason IS NULL AND NOT in_table)),
      hd AS (SELECT l.doc_id, l.page, count(tl.line_no) AS n FROM l LEFT JOIN tl USING (doc_id, page, line_no) GROUP BY ALL)
      SELECT {id_}, 0 AS seq, 'line @(' || "left" || ',' || top || ' ' || width || 'x' || height || ' conf=' || coalesce(CAST(conf AS VARCHAR), 'None') || '): ' || {quoted('text')} AS message FROM rs
      UNION ALL SELECT {id_}, 1, '    rule ' || rule || ' matched ' || {quoted('matched')} FROM rs JOIN qt USING (doc_id, page, line_no) WHERE reason = 'static-rule'
      UNION ALL SELECT {id_}, i, ms[i] FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM mt)
      UNION ALL SELECT {id_}, 1 + CASE WHEN reason = 'static-rule' THEN 1 ELSE 0 END + coalesce(len(ms), 0), CASE WHEN reason IS NOT NULL THEN '    -> REDACT (' || reason || ')' ELSE '    -> keep (item table)' END
        FROM rs LEFT JOIN mt USING (doc_id, page, line_no) WHERE reason IS NOT NULL OR in_table
      UNION ALL SELECT doc_id, page, -1, 0, '=== page ' || page || ' ===' FROM hd
      UNION ALL SELECT doc_id, page, -1, 1, 'item table: classifier off for ' || n || ' line(s)' FROM hd WHERE n > 0
      UNION ALL SELECT doc_id, page, 2147483647, row_number() OVER (PARTITION BY doc_id, page ORDER BY list_position(['header', 'footer', 'sender', 'recipient'], kind), y0, x0, y1, x1) - 1, 'region -> REDACT [' || x0 || ', ' || y0 || ', ' || x1 || ', ' || y1 || ']' FROM rb"""
