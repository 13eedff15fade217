"""Lines judged by documents at once equal those judged page by page; no line is rendered or matched twice."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_needs import SEEDS, SF, exchanges
from veilgrid.operators import regions, sheets, verdicts
from veilgrid.plans import registry
from veilgrid.schema import LINES
from veilgrid.sources import dumps

WORDS = ["Geburtsdatum", "13.03.1975", "1.2.80", "Max Mustermann", "MUSTER,ANDREA", "Person:", "Versicherten-Nr.", "4399267", "A123456789", "4,66 €", "1.234,56", "9,99", "Diagnose Mustermann", "mustermann", "MUSTERMANN 5", "Frau Öztürk", "Öztürk",
         "Frau Ｏztürk Ǆemal", "Patient Ǆemal", "Ǆemal", "0231 123456 - 0", "+49 231 12345678", "+59 231 12345678", "4111 1111 1111 1112", "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "Ruf 0231 12-34-56", "½ Tag", "é GmbH", "x ", "tab\t1,00"]


@pytest.fixture(scope="module")
def pages(spark):
    """Crowded pages of texts that patterns are made for, some in letters that only the JVM reads."""
    rng, rows = random.Random(9), []
    for doc in range(60):
        for page in range(rng.choice((1, 2, 3))):
            for i in range(rng.randrange(1, 28)):
                text = rng.choice(WORDS) if rng.random() < 0.6 else rng.choice(SEEDS)
                if rng.random() < 0.1:
                    text = rng.choice((text.upper(), text + rng.choice("ſ ١½ß.,"), text.replace("1", "7")))
                left, top = rng.choice((0, 4, 150, 500, 700)) + rng.randrange(8), rng.choice((rng.randrange(0, 1000), rng.randrange(0, 40) * 25))
                rows.append((doc, page, i, text, left, top, rng.choice((0, 40, 12 * len(text))), rng.choice((0, 20, 24, 24, 24, 60)), 99.0))
    return spark.createDataFrame(rows, LINES)


def by_page(spark, classifier):
    """The classifier as one that has to be asked page by page."""

    def classify(lines):
        return classifier(lines)

    classify.flag, classify.found = classifier.flag, classifier.found
    return classify


@pytest.mark.parametrize("params", [regions.RegionParams(), regions.RegionParams(padding=9, header_frac=0.3, vgap_factor=3.0), None])
def test_boxes_equal_those_of_pages(spark, pages, params):
    c = verdicts.patterns(least=0.65 if params else 0.0)
    new, old = (verdicts.all_boxes(pages, 1000, 1000, params, x) for x in (c, by_page(spark, c)))
    got = sorted(map(tuple, new.collect()))
    assert got == sorted(map(tuple, old.collect())) and len(got) > 500 and new.schema["x0"] == old.schema["x0"]


def test_boxes_take_lines_once(spark):
    df = registry.queries()["all_boxes"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" parquet") == 3 and all("_orderkey" in x for x in exchanges(df))


def test_documents_are_never_cut(spark):
    rows = [[sheets.pa.array(x, sheets.pa.int64()) for x in (d, n)] for d, n in (([1, 1], [0, 1]), ([1, 1, 2], [2, 3, 4]), ([2], [5]), ([2, 3, None], [6, 7, 8]), ([None, 4], [9, 10]))]
    for least in (1, 2, 3, 100):
        sheets.ROWS, kept = least, sheets.ROWS
        try:
            got = [[c.to_pylist() for c in x] for x in sheets.chunks(iter(rows))]
        finally:
            sheets.ROWS = kept
        assert [n for _, ns in got for n in ns] == list(range(11))
        docs = [set(d) for d, _ in got]
        assert all(not a & b for i, a in enumerate(docs) for b in docs[i + 1 :])


@pytest.mark.parametrize("params", [regions.RegionParams(), regions.RegionParams(padding=9, header_frac=0.3, vgap_factor=3.0)])
def test_snapshots_equal_those_of_pages(spark, pages, params):
    new = dumps.render_judged(verdicts.named_rows(pages, 1000, 1000, params), "x")
    old = dumps.render_snapshots(verdicts.outcome_documents(pages, 1000, 1000, params), "x")
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))


@pytest.mark.parametrize("name", ["snapshot_verdicts", "snapshot_regions"])
def test_snapshots_fold_no_lines(spark, name):
    """Arrays of lines are neither collected nor sorted: the JVM would do that one line at a time."""
    assert "collect_list" not in registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_comparison_of_rows_equals_that_of_frames(spark):
    a = [(0, "line @(0,0 1x1 conf=1): 'a'", "keep", None), (1, "line @(0,5 1x1 conf=1): 'b'", "REDACT", "region"), (4, "line @(0,6 1x1 conf=1): 'c" + "c" * 60 + "'", "keep", None), (5, "line @(0,7 1x1 conf=1): 'd'", "keep", None)]
    b = [(4, a[2][1], "PARTIAL", "overlap"), (1, a[1][1], "REDACT", "region"), (0, "line @(0,0 1x1 conf=1): 'z'", "keep", "x"), (7, "line @(1,1 1x1 conf=1): 'e'", "keep", None)]
    rows = [(*page, n, side, *rest) for page, sides in (((1, 0), (a, b)), ((1, 1), ([], b)), ((2, 0), (a, [])), ((2, 1), (b, b))) for side, xs in enumerate(sides) for n, *rest in xs]
    rows = spark.createDataFrame(rows, "doc_id long, page int, line_no int, side int, line string, kind string, reason string").coalesce(1)
    for ignore_text in (False, True):
        frames = dumps.compare_verdicts(rows.where("side = 0"), rows.where("side = 1"), ignore_text)
        assert sorted(map(tuple, dumps.compare_sides(rows, ignore_text).collect())) == sorted(map(tuple, frames.collect()))


def test_comparison_folds_no_lines(spark):
    assert "collect_list" not in registry.queries()["verdict_diff"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_trace_equals_that_of_pages(spark, pages):
    c = verdicts.patterns()
    new, old = (verdicts.trace(pages, x, size=(1000, 1000)) for x in (c, by_page(spark, c)))
    got = sorted(map(tuple, new.collect()))
    assert got == sorted(map(tuple, old.collect())) and any("region -> " in r[-1] for r in got) and any("Ignoring" in r[-1] for r in got)


def test_trace_folds_no_lines(spark):
    assert "collect_list" not in registry.queries()["trace"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
