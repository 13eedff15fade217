"""Invoice lines rendered from the order tables: the same SQL for Spark and for DuckDB.

The data folders hold no scanned invoices, so the engine's core relation is made from them: for every order two pages of
lines with pixel boxes, letterhead, address, patient block, one row for each item, body and footer, all by integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table

WIDTH, HEIGHT = 1654, 2339
#: Stored bytes of the tables for each partition of lines: some 800,000 lines.
PART_BYTES = 2 << 20
_SURNAMES = ["Mustermann", "Müller", "Groß", "Schäfer", "Müller-Lüdenscheidt", "MUSTER", "Weber", "Ärmel", "Klein", "Öztürk"]
_FORENAMES = ["Max", "Erika", "Andrea", "Jürgen", "Ioanna", "Uwe", "Änne"]
_SERVICES = ["Beratung, auch telefonisch", "Eingehende Untersuchung", "Orientierende Testuntersuchg.", "44/20101 Massage", "Folgerezept", "15118 MID", "Naturmoor, Teilpackung", "Mikroskopie,Kultur"]
_MONTHS = ["13.03.1975", "1.2.80", "24.12.1968", "05.11.2003"]


def _pick(names: list[str], index: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE ({index}) % {len(names)} {whens} END"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def lines_sql(duck: bool) -> str:
    """(doc_id, page, line_no, text, left, top, width, height, conf) of all invoices."""
    div = (lambda a, b: f"(({a}) // {b})") if duck else (lambda a, b: f"(({a}) div {b})")
    blocks = "CROSS JOIN (SELECT unnest(range(26)) AS b) t" if duck else "LATERAL VIEW explode(sequence(0, 25)) t AS b"
    sn, fn, ps = _pick(_SURNAMES, "k"), _pick(_FORENAMES, div("k", 10)), _pick(_SURNAMES, "k + 3")
    day = _pick(_MONTHS, div("k", 3))
    plz = f"lpad({_s('10000 + k % 89999')}, 5, '0')"
    text = f"""CASE b
      WHEN 0 THEN concat(ps, 'praxis GmbH')
      WHEN 1 THEN concat('www.', lower({_pick(['mustermann', 'mueller', 'gross'], 'k')}), '-praxis.de')
      WHEN 2 THEN concat('Tel. 0231 / ', {_s('100000 + k % 899999')})
      WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'Herrn' ELSE 'Frau' END
      WHEN 4 THEN concat(fn, ' ', sn)
      WHEN 5 THEN CASE WHEN k % 5 = 0 THEN 'c/o Nachbarn im Hof' ELSE '   ' END
      WHEN 6 THEN concat(sn, CASE WHEN k % 3 = 0 THEN 'straße ' WHEN k % 3 = 1 THEN 'weg ' ELSE 'STR.' END, {_s('k % 90 + 1')})
      WHEN 7 THEN concat({plz}, CASE WHEN k % 4 = 0 THEN '' ELSE ' ' END, 'Musterstadt')
      WHEN 8 THEN CASE k % 4 WHEN 0 THEN concat('Patient ', sn, ', ', fn, ' geb. ', dy) WHEN 1 THEN 'Behandelte Person:' WHEN 2 THEN 'Geburtsdatum' ELSE concat(sn, ',', fn, ' ', dy) END
      WHEN 9 THEN CASE k % 4 WHEN 0 THEN concat('Versicherten-Nr. A', {_s('123456 + k')}) WHEN 1 THEN concat(fn, ' ', sn) WHEN 2 THEN dy ELSE 'Diagnosen' END
      WHEN 10 THEN CASE k % 4 WHEN 0 THEN 'Fall-Nr.' WHEN 1 THEN dy WHEN 2 THEN '24.12.1999' ELSE 'klein gedruckt' END
      WHEN 11 THEN CASE k % 4 WHEN 0 THEN {_s('4399267 + k')} WHEN 1 THEN concat('A', {_s('123456789 + k')}) WHEN 2 THEN 'Rechnung' ELSE 'Summe,Betrag' END
      WHEN 12 THEN concat('Rechnungsdatum ', dy)
      WHEN 13 THEN CASE WHEN k % 7 = 0 THEN concat('Dr. med. ', sn) ELSE 'Behandlungszeitraum vom 15.04.2026 bis 28.04.2026' END
      WHEN 14 THEN concat('Diagnose ', sn)
      WHEN 15 THEN concat(lower(sn), ' gedruckt')
      WHEN 16 THEN concat('Rechnungs-Nr. ', {_s('k')})
      WHEN 17 THEN concat('Bitte zahlen an ', upper(replace(sn, 'ß', 'ss')), ' oder ', fn)
      WHEN 18 THEN concat('HRB ', {_s('k % 9000 + 1')}, ' Musterstadt')
      WHEN 19 THEN concat('IBAN DE', lpad({_s('k % 98 + 1')}, 2, '0'), ' 5001 0517 5407 3249 31 / BIC INGDDEFFXXX')
      WHEN 20 THEN CASE WHEN k % 3 = 0 THEN 'Vielen Dank' ELSE concat('HRA ', {_s('k % 900 + 1')}) END
      WHEN 21 THEN concat('Konto-Nr.: 4 399 ', {_s('100 + k % 900')}, ' 00')
      WHEN 22 THEN concat('info@', 'praxis', {_s('k % 50')}, '.de')
      WHEN 23 THEN concat('0231 ', {_s('100000 + k % 899999')}, ' - 0')
      WHEN 24 THEN concat('Karte 4111 1111 1111 ', lpad({_s('k % 10000')}, 4, '0'))
      ELSE 'Vergleiche einschl.der Kosten'
    END"""
    left = """CASE WHEN b <= 2 THEN 1000 WHEN b <= 8 THEN 150 WHEN b IN (9, 11) AND k % 4 = 1 THEN 600 WHEN b = 10 AND k % 4 = 1 THEN 600
      WHEN b BETWEEN 9 AND 11 THEN 150 + (k % 3) * 6 WHEN b = 24 THEN 700 ELSE 150 END"""
    top = """CASE WHEN b <= 2 THEN 100 + 30 * b WHEN b <= 7 THEN 400 + 30 * (b - 3) WHEN b = 8 THEN 800 WHEN b = 9 AND k % 4 = 1 THEN 801
      WHEN b <= 11 THEN 800 + 30 * (b - 8) WHEN b = 12 THEN 700 WHEN b = 13 THEN 940 WHEN b <= 17 THEN 300 + 45 * (b - 14)
      WHEN b <= 19 THEN 2200 + 30 * (b - 18) WHEN b <= 21 THEN 2220 + 30 * (b - 20) ELSE 800 + 60 * (b - 22) END"""
    page = "CASE WHEN b BETWEEN 14 AND 17 OR b >= 20 THEN 1 ELSE 0 END"
    cents = "CAST(round(l_extendedprice * 100) AS BIGINT)"
    euros = div(cents, 100)
    money = f"concat(CASE WHEN {euros} >= 1000 THEN concat({_s(div(euros, 1000))}, '.', lpad({_s(f'{euros} % 1000')}, 3, '0')) ELSE {_s(euros)} END, ',', lpad({_s(f'{cents} % 100')}, 2, '0'))"
    return f"""
    WITH o AS (
      SELECT k, {sn} AS sn, {fn} AS fn, {ps} AS ps, {day} AS dy FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders WHERE o_orderkey IS NOT NULL) x
    ), i AS (
      SELECT CAST(l_orderkey AS BIGINT) AS k, l_partkey, l_extendedprice,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS n
      FROM lineitem
    ), made AS (
      SELECT k, {page} AS page, b AS seq, {text} AS text, {left} AS lft, {top} AS tp, CASE WHEN b = 0 THEN 40 ELSE 24 END AS height FROM o {blocks}
      UNION ALL
      SELECT k, 0, 100 + 2 * n, {_pick(_SERVICES, 'l_partkey')}, 150, 1000 + 40 * n, 24 FROM i
      UNION ALL
      SELECT k, 0, 101 + 2 * n, concat({money}, ' €'), 1300, 1000 + 40 * n, 24 FROM i
    )
    SELECT k AS doc_id, CAST(page AS INT) AS page,
      CAST(row_number() OVER (PARTITION BY k, page ORDER BY seq) - 1 AS INT) AS line_no,
      text, CAST(lft AS INT) AS `left`, CAST(tp AS INT) AS `top`, CAST(12 * length(text) AS INT) AS width, CAST(height AS INT) AS height,
      CAST(99.0 AS DOUBLE) AS conf
    FROM made"""


def duck_lines() -> str:
    return lines_sql(True).replace("`left`", '"left"').replace("`top`", '"top"')


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered lines of all orders; pages are WIDTH by HEIGHT.

    Orders and items are dealt by their key before they become lines, some 40 bytes instead of 34 lines each: the numbering of lines and
    everything by document or page finds them together already, and a file of one row group isn't one task."""
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
    tables = {name: table(spark, sf_dir, name) for name in keys}
    stored = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables.values())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored // PART_BYTES)
    for name, t in tables.items():
        t.repartition(n, keys[name]).createOrReplaceTempView(name)
    return spark.sql(lines_sql(False)).withMetadata("doc_id", {"dealt": n})
