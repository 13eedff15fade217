"""All queries of the redaction engine over the rendered invoices, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import entities, is_recipient_anchor, is_sender_anchor, matches, may_be_phone, not_blank, only, phone_candidates, static_rule, static_rule_name
from ..operators import codes, labels, names, regions, tables, verdicts
from ..schema import LINE, PAGE
from ..session import table
from ..sources import dumps
from . import exchange
from . import oracle as O
from .invoices import HEIGHT, WIDTH, lines

Query = Callable[[SparkSession, str], DataFrame]


def _text():
    return F.col("text")  # not at import: columns need a session


def _over(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(lines(spark, sf_dir))


def _rule_hits(ls: DataFrame) -> DataFrame:
    """Counts by page of all rules at once: an array of a line's rules would be evaluated node by node, not compiled."""
    rules = [*P.STATIC_RULES, ("ORG_MEDICAL", P.ORG_MEDICAL)]
    counted = ls.groupBy("page").agg(*(F.count_if(matches(_text(), p)).alias(n) for n, p in rules))
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_lines")) for n, _ in rules))
    return counted.select("page", F.explode(each).alias("r")).select("r.rule", "page", "r.n_lines").where("n_lines > 0")


def _columns_below(ls: DataFrame) -> DataFrame:
    return labels.labeled_by(ls, "below").select(*LINE).distinct()


def _components(ls: DataFrame) -> DataFrame:
    return regions.blocks(ls).select(*LINE, "block")


def _kind(kind: str) -> Query:
    return _over(lambda ls: regions.region_boxes(ls, WIDTH, HEIGHT).where(F.col("kind") == kind).drop("kind"))


def _summary(ls: DataFrame) -> DataFrame:
    return verdicts.outcomes(ls, WIDTH, HEIGHT).groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def _outcomes(ls: DataFrame) -> DataFrame:
    return verdicts.outcomes(ls, WIDTH, HEIGHT).select(*LINE, "kind", "reason", F.round("coverage", 9).alias("coverage"))


def _snapshot_diff(ls: DataFrame) -> DataFrame:
    """Region boxes against those of narrower bands: what either has beyond the other."""
    return dumps.compare_regions(regions.region_boxes(ls, WIDTH, HEIGHT), regions.region_boxes(ls, WIDTH, HEIGHT, regions.RegionParams(header_frac=0.04)))


def code_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads made from events: place by the event's number, side by the user's, undecoded where the event is an error. Every fourth is
    of the enlarged pass, sign-ups of the first are linear."""
    e = table(spark, sf_dir, "events").where("event_id IS NOT NULL AND user_id IS NOT NULL")
    x, y, side = F.expr("CAST((event_id * 37) % 1500 AS DOUBLE)"), F.expr("CAST((event_id * 53) % 2200 AS DOUBLE)"), F.expr("CAST(user_id % 60 + 5 AS DOUBLE)")
    return e.select(
        F.expr("CAST(event_id div 12 AS BIGINT)").alias("doc_id"), F.lit(0).alias("page"), F.col("event_id").cast("long").alias("read_no"), F.expr("IF(event_id % 4 = 3, 2, 1)").alias("pass"), F.expr("event_type = 'signup' AND event_id % 4 <> 3").alias("linear"),
        (F.col("event_type") != "error").alias("decoded"), x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side * F.expr("CAST(event_id % 4 + 1 AS DOUBLE)") / 2).alias("y1"),
    )


_READS = """cr AS MATERIALIZED (SELECT CAST(event_id // 12 AS BIGINT) AS doc_id, 0 AS page, CAST(event_id AS BIGINT) AS read_no, CASE WHEN event_id % 4 = 3 THEN 2 ELSE 1 END AS pass, event_type = 'signup' AND event_id % 4 <> 3 AS linear, event_type <> 'error' AS decoded, x AS x0, y AS y0, x + s AS x1, y + s * CAST(event_id % 4 + 1 AS DOUBLE) / 2 AS y1
  FROM (SELECT *, CAST((event_id * 37) % 1500 AS DOUBLE) AS x, CAST((event_id * 53) % 2200 AS DOUBLE) AS y, CAST(user_id % 60 + 5 AS DOUBLE) AS s FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL))"""
_FUSED = """fp AS (SELECT a.doc_id, a.read_no AS a, b.read_no AS b FROM cr a JOIN cr b ON a.doc_id = b.doc_id AND NOT a.decoded AND NOT b.decoded AND
    greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1), greatest(a.y0, b.y0) - least(a.y1, b.y1)) <= 1.5::DOUBLE * greatest(a.x1 - a.x0, a.y1 - a.y0, b.x1 - b.x0, b.y1 - b.y0)),
  fr AS (SELECT doc_id, read_no AS s, read_no AS t FROM cr WHERE NOT decoded UNION SELECT fr.doc_id, fr.s, fp.b FROM fr JOIN fp ON fp.doc_id = fr.doc_id AND fp.a = fr.t),
  fg AS (SELECT doc_id, s AS read_no, min(t) AS g FROM fr GROUP BY ALL)"""


_SIDES = "least(x1 - x0, y1 - y0) >= 12 AND greatest(x1 - x0, y1 - y0) <= 3.0 * least(x1 - x0, y1 - y0)"
_GATE = f"""pl AS MATERIALIZED (SELECT * FROM cr WHERE NOT linear AND {_SIDES}),
  gt AS MATERIALIZED (SELECT p.doc_id FROM (SELECT DISTINCT doc_id FROM cr) p LEFT JOIN (SELECT doc_id, bool_or(decoded) AS any_, count(*) AS n FROM pl WHERE pass = 1 GROUP BY doc_id) s ON s.doc_id = p.doc_id
    WHERE NOT coalesce(any_, false) AND (coalesce(n, 0) > 0 OR p.doc_id % 5 = 0))"""
_BOX = "{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}"
_MEET = "acc.cur.x0 < x.cur.x1 AND x.cur.x0 < acc.cur.x1 AND acc.cur.y0 < x.cur.y1 AND x.cur.y0 < acc.cur.y1"
_WIDE = "{'x0': least(acc.cur.x0, x.cur.x0), 'y0': least(acc.cur.y0, x.cur.y0), 'x1': greatest(acc.cur.x1, x.cur.x1), 'y1': greatest(acc.cur.y1, x.cur.y1)}"
_SWEPT = f"""ow AS MATERIALIZED (SELECT doc_id, read_no, decoded, x0, y0, x1, y1 FROM pl WHERE pass = 1 UNION ALL SELECT doc_id, read_no, true, x0, y0, x1, y1 FROM cr WHERE linear
    UNION ALL SELECT doc_id, read_no, decoded, x0 / 2, y0 / 2, x1 / 2, y1 / 2 FROM pl WHERE pass = 2 AND doc_id IN (SELECT doc_id FROM gt)),
  fa AS MATERIALIZED (SELECT * FROM ow a WHERE NOT decoded AND NOT EXISTS (SELECT 1 FROM ow b WHERE b.decoded AND a.doc_id = b.doc_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)),
  {_FUSED.replace("cr ", "fa ")},
  sq AS (SELECT fg.doc_id, g, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM fg JOIN fa ON fg.doc_id = fa.doc_id AND fg.read_no = fa.read_no GROUP BY fg.doc_id, g),
  bx AS (SELECT doc_id, 0 AS late, read_no, x0, y0, x1, y1 FROM ow WHERE decoded UNION ALL SELECT doc_id, 1, g, x0, y0, x0 + greatest(x1 - x0, y1 - y0), y0 + greatest(x1 - x0, y1 - y0) FROM sq),
  gw AS (SELECT *, CAST(round_even(0.08::DOUBLE * greatest(x1 - x0, y1 - y0), 0) AS INT) + 2 AS w FROM bx),
  gb AS (SELECT doc_id, late, read_no, greatest(0, CAST(round_even(x0, 0) AS INT) - w) AS x0, greatest(0, CAST(round_even(y0, 0) AS INT) - w) AS y0, least({WIDTH}, CAST(round_even(x1, 0) AS INT) + w) AS x1, least({HEIGHT}, CAST(round_even(y1, 0) AS INT) + w) AS y1 FROM gw),
  nu AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY late, read_no) AS i, {_BOX} AS b FROM gb WHERE x1 > x0 AND y1 > y0),
  sw AS (SELECT doc_id, i, [b] AS bs FROM nu WHERE i = 1 UNION ALL SELECT doc_id, i, list_append(r.rest, r.cur) FROM (SELECT sw.doc_id, nu.i, list_reduce(list_prepend({{'cur': nu.b, 'rest': ([nu.b])[1:0]}}, list_transform(sw.bs, lambda o: {{'cur': o, 'rest': ([nu.b])[1:0]}})),
    lambda acc, x: CASE WHEN {_MEET} THEN {{'cur': {_WIDE}, 'rest': acc.rest}} ELSE {{'cur': acc.cur, 'rest': list_append(acc.rest, x.cur)}} END) AS r FROM sw JOIN nu ON nu.doc_id = sw.doc_id AND nu.i = sw.i + 1)),
  la AS (SELECT doc_id, arg_max(bs, i) AS bs FROM sw GROUP BY doc_id)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.fuse_fragments(code_reads(spark, sf_dir).where("NOT decoded"))


def _anti_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = code_reads(spark, sf_dir)
    return codes.apart_from(reads.where("NOT decoded"), reads.where("decoded")).select(*PAGE, "read_no")


def code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of code_reads; every fifth is small enough for a blind second pass."""
    docs = code_reads(spark, sf_dir).select(*PAGE).distinct()
    return docs.select(*PAGE, F.when(F.col("doc_id") % 5 == 0, 1000).otherwise(WIDTH).alias("width"), F.when(F.col("doc_id") % 5 == 0, 1500).otherwise(HEIGHT).alias("height"))


def _retry_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.retry_pages(code_pages(spark, sf_dir), codes.plausible(code_reads(spark, sf_dir).where("pass = 1 AND NOT linear"))).select(*PAGE)


def _code_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_boxes(codes.admitted(code_reads(spark, sf_dir), code_pages(spark, sf_dir)), width=WIDTH, height=HEIGHT)


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.grown(code_reads(spark, sf_dir), width=WIDTH, height=HEIGHT).select(*PAGE, "read_no", "x0", "y0", "x1", "y1")


def _dump_round_trip(ls: DataFrame) -> DataFrame:
    """Every line's text after quoting and parsing of its dump line, and whether that is the text it began as."""
    raw = ls.select(F.col("doc_id").cast("string").alias("path"), F.col("line_no").alias("pos"), "page", "text", dumps.line_header().alias("raw"))
    back = dumps._literal(F.regexp_extract("raw", dumps.DUMP_LINE, 6))
    return raw.withColumn("back", back).select("path", "page", "pos", "back", F.expr("back <=> text").alias("same"))


def _phone_guard(ls: DataFrame) -> DataFrame:
    """Candidates for phone numbers on lines that are none: dates and bare digit runs."""
    return ls.where(matches(_text(), r"^\d[\d\s./\-]{5,}$")).select(*LINE, (~matches(F.trim(_text()), P.DOTTED_DATE) & ~matches(F.trim(_text()), P.BARE_DIGITS)).alias("kept"))


def _phone_guard_candidates(ls: DataFrame) -> DataFrame:
    """Candidates for phone numbers anywhere on lines, and whether the guard keeps them."""
    found = ls.select(*LINE, F.explode(phone_candidates(_text())).alias("candidate"))
    return found.select("*", may_be_phone(F.col("candidate")).alias("kept"))


def _entities(ls: DataFrame) -> DataFrame:
    """All kinds that the deterministic recognisers find, counted for each line."""
    return _counted(ls, entities(_text()))


def _counted(ls: DataFrame, found: Column) -> DataFrame:
    """Counts by kind within each line's own array: no shuffle."""
    each = lambda k: F.struct(k.alias("entity"), F.size(F.filter(F.col("found"), lambda e: e["entity"] == k)).cast("long").alias("n"))
    names = F.array_distinct(F.transform("found", lambda e: e["entity"]))
    return ls.select(*LINE, found.alias("found")).select(*LINE, F.inline(F.transform(names, each)))


QUERIES: dict[str, Query] = {
    "rendered_lines": lines,
    "static_rule_match": _over(lambda ls: ls.select(*LINE, only(static_rule_name(_text())).alias("rule"))),
    "static_rule_quoted": _over(lambda ls: ls.select(*LINE, only(static_rule(_text())).alias("r")).select(*LINE, "r.rule", "r.matched")),
    "static_rule_boxes": _over(verdicts.static_rule_boxes),
    "rule_hit_counts": _over(_rule_hits),
    "anchors": _over(lambda ls: ls.where(not_blank(_text())).select(*LINE, is_sender_anchor(_text()).alias("sender"), is_recipient_anchor(_text()).alias("recipient"))),
    "median_heights": _over(tables.median_heights),
    "item_table_bands": _over(tables.item_table_bands),
    "item_table_lines": _over(lambda ls: tables.with_item_table(ls).where("in_table").select(LINE)),
    "labeled_merged": _over(lambda ls: labels.labeled_by(ls, "merged")),
    "labeled_same_row": _over(lambda ls: labels.labeled_by(ls, "beside")),
    "column_below": _over(_columns_below),
    "labeled_values": _over(labels.labeled_values),
    "harvested_names": _over(names.harvested_names),
    "name_memory_hits": _over(names.name_memory_hits),
    "adjacent_pairs": _over(regions.adjacent_pairs),
    "components": _over(_components),
    "header_band": _kind("header"),
    "footer_band": _kind("footer"),
    "sender_blocks": _kind("sender"),
    "recipient_blocks": _kind("recipient"),
    "region_boxes": _over(lambda ls: regions.region_boxes(ls, WIDTH, HEIGHT)),
    "entities_regex": _over(_entities),
    "entities_threshold": _over(lambda ls: _counted(ls, entities(_text(), least=0.65))),
    "classifier_lines": _over(lambda ls: ls.select(*LINE, (F.size(entities(_text())) > 0).alias("pii")).where("pii")),
    "phone_guard": _over(_phone_guard),
    "phone_guard_candidates": _over(_phone_guard_candidates),
    "verdict_reasons": _over(lambda ls: verdicts.reasons(ls).select(*LINE, "in_table", "reason")),
    "line_boxes": _over(lambda ls: verdicts.line_boxes(verdicts.reasons(ls))),
    "all_boxes": _over(lambda ls: verdicts.all_boxes(ls, WIDTH, HEIGHT)),
    "verdicts": _over(_outcomes),
    "verdict_summary": _over(_summary),
    "snapshot_diff": _over(_snapshot_diff),
    "dump_round_trip": _over(_dump_round_trip),
    "trace": _over(lambda ls: verdicts.trace(ls, size=(WIDTH, HEIGHT))),
    "code_shape_guard": lambda spark, sf_dir: codes.plausible(code_reads(spark, sf_dir)).select(*PAGE, "read_no"),
    "code_growth": _grown,
    "code_anti_exact": _anti_exact,
    "code_fragments_fused": _fused,
    "retry_gate": _retry_gate,
    "code_boxes": _code_boxes,
}


def queries() -> dict[str, Query]:
    return QUERIES | exchange.QUERIES


def oracle_sql() -> dict[str, str]:
    w, id_ = O.with_, "doc_id, page, line_no"
    pick = f"SELECT {id_}"
    regions_ = w(O.REGIONS)
    full = w(O.BANDS, O.TABLE, O.FLAGS, O.WALK, O.NAMES, O.REASONS)
    region = lambda k: f"{regions_} SELECT doc_id, page, x0, y0, x1, y1 FROM rb WHERE kind = '{k}'"
    narrow = O.REGIONS.replace(f"0.12 * {HEIGHT}", f"0.04 * {HEIGHT}").replace(f"0.12::DOUBLE * {HEIGHT}", f"0.04::DOUBLE * {HEIGHT}")
    narrow = narrow[narrow.index("bk AS (") :].replace("bk AS (", "bk2 AS (").replace("FROM bk ", "FROM bk2 ").replace("rb AS (", "rb2 AS (")
    hits = " UNION ALL ".join(f"SELECT page, '{n}' AS rule FROM l WHERE {O.rule_test(n, p)}" for n, p in [*O.RULES, ("ORG_MEDICAL", O.ORG_MEDICAL)])
    kinds = [
        ("IBAN_CODE", f"len(list_filter(regexp_extract_all(text, {O._q(O.IBAN)}), lambda x: {O.iban_ok('x')}))"), ("EMAIL_ADDRESS", f"len(regexp_extract_all(text, {O._q(O.EMAIL)}))"),
        ("CREDIT_CARD", f"len(list_filter(regexp_extract_all(text, {O._q(O.CARD)}), lambda x: {O.luhn_ok('x')}))"), ("KONTO", f"len(regexp_extract_all(text, {O._q(O.KONTO)}))"),
        ("BIC_CODE", f"CASE WHEN {O.m(rf'(?i){O.B}(?:bic|swift){O.E}')} THEN len(regexp_extract_all(text, {O._q(O.BIC)})) ELSE 0 END"),
    ]
    streets, places = f"len(regexp_extract_all(text, {O._q(O.STREET2)}))", f"len(regexp_extract_all(text, {O._q(O.RULES[5][1])}))"
    numbers = f"regexp_extract_all(text, {O._q(O.PHONE)}, 1)"
    told = lambda kinds: " UNION ALL ".join(f"SELECT {id_}, '{k}' AS entity, {e} AS n FROM l" for k, e in kinds)
    found = told([*kinds, ("PHONE_NUMBER", f"len(list_filter({numbers}, lambda x: {O.PHONE_OK}))"), ("DE_ADDRESS", f"{streets} + {places}")])
    sure = told([x for x in kinds if x[0] != "BIC_CODE"] + [("DE_ADDRESS", streets)])
    traded = exchange.oracle_sql()
    quoted = f"qt AS (SELECT {id_}, {O.RULE} AS rule, {O.MATCHED} AS matched FROM l WHERE {O.ANY_RULE})"
    return {
        "rendered_lines": f"{w()} SELECT * FROM l",
        "static_rule_match": f"{w()} SELECT {id_}, {O.RULE} AS rule FROM l WHERE {O.ANY_RULE}",
        "static_rule_quoted": f"{w(quoted)} SELECT * FROM qt",
        "static_rule_boxes": f'{w()} SELECT {id_}, {O.RULE} AS rule, "left" - 2 AS x0, top - 2 AS y0, "left" + width + 2 AS x1, top + height + 2 AS y1 FROM l WHERE {O.ANY_RULE}',
        "rule_hit_counts": f"{w()} SELECT rule, page, count(*) AS n_lines FROM ({hits}) GROUP BY ALL",
        "anchors": f"{w()} SELECT {id_}, {O.SENDER} AS sender, {O.RECIPIENT} AS recipient FROM l WHERE {O.NOT_BLANK}",
        "median_heights": f"{w()} SELECT doc_id, page, quantile_cont(height, 0.5) AS median_height FROM l GROUP BY ALL",
        "item_table_bands": f"{w(O.BANDS)} SELECT doc_id, page, band_top, band_bottom FROM bands",
        "item_table_lines": f"{w(O.BANDS, O.TABLE)} {pick} FROM tl",
        "labeled_merged": f"{w(O.FLAGS)} {pick}, rule FROM mv",
        "labeled_same_row": f"{w(O.FLAGS)} {pick}, rule FROM sr",
        "column_below": f"{w(O.BANDS, O.TABLE, O.FLAGS, O.WALK)} {pick} FROM cb",
        "labeled_values": f"{w(O.BANDS, O.TABLE, O.FLAGS, O.WALK)} {pick} FROM lv",
        "harvested_names": f"{w(O.NAMES)} SELECT doc_id, page, name FROM nm",
        "name_memory_hits": f"{w(O.NAMES)} {pick} FROM nh",
        "adjacent_pairs": f"{w(O.PAIRS)} SELECT doc_id, page, a, b FROM ap",
        "components": f"{w(O.COMPONENTS)} {pick}, block FROM cc",
        "header_band": region("header"), "footer_band": region("footer"), "sender_blocks": region("sender"), "recipient_blocks": region("recipient"),
        "region_boxes": f"{regions_} SELECT * FROM rb",
        "entities_regex": f"{w()} SELECT * FROM ({found}) WHERE n > 0",
        "entities_threshold": f"{w()} SELECT * FROM ({sure}) WHERE n > 0",
        "phone_guard_candidates": f"{w()} SELECT {id_}, x AS candidate, {O.PHONE_OK} AS kept FROM (SELECT {id_}, unnest({numbers}) AS x FROM l)",
        "trace": O.trace_sql(quoted),
        "classifier_lines": f"{w()} {pick}, true AS pii FROM l WHERE {O.PII}",
        "phone_guard": f"{w()} {pick}, NOT regexp_matches(trim(text), '^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{2,4}}[\\s\\d.\\-/]*$') AND NOT regexp_matches(trim(text), '^\\d+$') AS kept FROM l WHERE regexp_matches(text, '^\\d[\\d\\s./\\-]{{5,}}$')",
        "verdict_reasons": f"{full} {pick}, in_table, reason FROM rs",
        "line_boxes": f"{full} SELECT * FROM lb",
        "all_boxes": f"{w(O.BANDS, O.TABLE, O.FLAGS, O.WALK, O.NAMES, O.REASONS, O.REGIONS)} SELECT doc_id, page, 'line' AS source, x0, y0, x1, y1 FROM lb UNION ALL SELECT doc_id, page, 'region-' || kind, x0, y0, x1, y1 FROM rb",
        "verdicts": f"{w(O.BANDS, O.TABLE, O.FLAGS, O.WALK, O.NAMES, O.REASONS, O.REGIONS, O.OUTCOMES)} {pick}, kind, reason, round(coverage, 9) AS coverage FROM vd",
        "verdict_summary": f"{w(O.BANDS, O.TABLE, O.FLAGS, O.WALK, O.NAMES, O.REASONS, O.REGIONS, O.OUTCOMES)} SELECT kind, reason, count(*) AS n_lines FROM vd GROUP BY ALL",
        "snapshot_diff": f"{w(O.REGIONS, narrow)} SELECT *, 'unexpected region' AS failure FROM (SELECT doc_id, page, x0, y0, x1, y1 FROM rb EXCEPT ALL SELECT doc_id, page, x0, y0, x1, y1 FROM rb2) UNION ALL SELECT *, 'missing region' FROM (SELECT doc_id, page, x0, y0, x1, y1 FROM rb2 EXCEPT ALL SELECT doc_id, page, x0, y0, x1, y1 FROM rb)",
        "dump_round_trip": f"{w()} SELECT CAST(doc_id AS STRING) AS path, page, line_no AS pos, text AS back, true AS same FROM l",
        "code_shape_guard": f"WITH {_READS} SELECT doc_id, page, read_no FROM cr WHERE least(x1 - x0, y1 - y0) >= 12 AND greatest(x1 - x0, y1 - y0) <= 3.0 * least(x1 - x0, y1 - y0)",
        "retry_gate": f"WITH {_READS}, {_GATE} SELECT doc_id, 0 AS page FROM gt",
        "code_boxes": f"WITH RECURSIVE {_READS}, {_GATE}, {_SWEPT} SELECT doc_id, 0 AS page, i AS box_no, bs[i + 1].x0 AS x0, bs[i + 1].y0 AS y0, bs[i + 1].x1 AS x1, bs[i + 1].y1 AS y1 FROM (SELECT doc_id, bs, unnest(range(len(bs)))::INT AS i FROM la)",
        "code_growth": f"WITH {_READS}, g AS (SELECT *, CAST(round_even(0.08::DOUBLE * greatest(x1 - x0, y1 - y0), 0) AS INT) + 2 AS w FROM cr) SELECT doc_id, page, read_no, greatest(0, CAST(round_even(x0, 0) AS INT) - w) AS x0, greatest(0, CAST(round_even(y0, 0) AS INT) - w) AS y0, least({WIDTH}, CAST(round_even(x1, 0) AS INT) + w) AS x1, least({HEIGHT}, CAST(round_even(y1, 0) AS INT) + w) AS y1 FROM g",
        "code_anti_exact": f"WITH {_READS} SELECT doc_id, page, read_no FROM cr a WHERE NOT decoded AND NOT EXISTS (SELECT 1 FROM cr b WHERE b.decoded AND a.doc_id = b.doc_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)",
        "code_fragments_fused": f"WITH RECURSIVE {_READS}, {_FUSED} SELECT doc_id, 0 AS page, g AS read_no, x0, y0, x0 + greatest(x1 - x0, y1 - y0) AS x1, y0 + greatest(x1 - x0, y1 - y0) AS y1 FROM (SELECT fg.doc_id, g, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM fg JOIN cr ON fg.doc_id = cr.doc_id AND fg.read_no = cr.read_no GROUP BY fg.doc_id, g)",
    } | traded
