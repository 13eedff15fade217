"""Snapshots are made and read without a shuffle of lines."""

import pytest
from pyspark.sql import functions as F

from tests.test_needs import SF, exchanges
from veilgrid.plans import registry
from veilgrid.sources import dumps


@pytest.mark.parametrize("name", ["snapshot_regions", "snapshot_verdicts"])
def test_snapshots_shuffle_no_lines(spark, name):
    assert all("_orderkey" in x for x in exchanges(registry.queries()[name](spark, SF)))


def test_lines_of_read_texts_are_numbered(spark, tmp_path):
    (tmp_path / "a_ocr.txt").write_bytes(b"x\r\ny\rz")
    assert [(r.pos, r.raw) for r in dumps.read_texts(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, "x"), (1, "y"), (2, "z")]


TEXT = """line @(0,0 1x1 conf=1): 'before any header'
=== page 1 ===
line @(0,1 1x1 conf=1): 'a'
    -> REDACT (x)
    -> keep
=== page 2 (10x20) ===
line @(0,2 1x1 conf=1): 'b'
region -> REDACT [1, 2, 3, -4]
=== page 1 ===
    -> PARTIAL 40% (late)
line @(0,3 1x1 conf=1): 'c'
=== page 1 === not a header
region -> REDACT [5, 6, 7, 8]
"""


def test_pages_of_one_number_are_one(spark):
    whole = spark.createDataFrame([("a", TEXT), ("b", TEXT.replace("\n", "\r\n"))], "path string, value string")
    for texts in (whole, dumps.split_texts(whole)):
        v, r = dumps.parse_snapshot(texts)
        got = [tuple(x)[1:] for x in v.where("path = 'b'").select("path", "page", "line_no", F.substring_index("line", ": ", -1), "kind", "reason").orderBy("page", "line_no").collect()]
        assert got == [(0, 0, "'before any header'", "keep", None), (1, 0, "'a'", "PARTIAL", "late"), (1, 1, "'c'", "keep", None), (2, 0, "'b'", "keep", None)]
        assert sorted(tuple(x)[1:] for x in r.where("path = 'a'").collect()) == [(1, 5, 6, 7, 8), (2, 1, 2, 3, -4)]
    early = spark.createDataFrame([("a", "=== page 0 ===\n  -> keep\nline @x")], "path string, value string")
    with pytest.raises(Exception, match="verdict before any line"):
        dumps.parse_snapshot(early)[0].collect()


@pytest.mark.parametrize("name", ["verdict_diff", "trace"])
def test_verdicts_are_made_once(spark, name):
    df = registry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert all("_orderkey" in x for x in exchanges(df)) and plan.count(" parquet") == 3


def test_comparison_of_a_page_equals_that_of_frames(spark):
    kind = "line_no int, line string, kind string, reason string"
    a = [(0, "line @(0,0 1x1 conf=1): 'a'", "keep", None), (1, "line @(0,5 1x1 conf=1): 'b'", "REDACT", "region"), (4, "line @(0,6 1x1 conf=1): 'c'", "keep", None), (5, "line @(0,7 1x1 conf=1): 'd'", "keep", None)]
    b = [(4, a[2][1], "PARTIAL", "overlap"), (1, a[1][1], "REDACT", "region"), (0, "line @(0,0 1x1 conf=1): 'z'", "keep", None), (7, "line @(1,1 1x1 conf=1): 'e'", "keep", None)]
    page = spark.createDataFrame([(1, 0, a, b), (1, 1, [], b), (2, 0, a, []), (2, 1, a, a)], f"doc_id long, page int, a array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>, b array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
    for ignore_text in (False, True):
        frames = dumps.compare_verdicts(*(page.select("doc_id", "page", F.inline(x)) for x in "ab"), ignore_text)
        rows = page.select("doc_id", "page", F.inline(dumps.compare_page(F.col("a"), F.col("b"), ignore_text)))
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, frames.collect())) and frames.count() == 12 - ignore_text
