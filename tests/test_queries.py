"""Queries against their oracle SQL, on the smallest tables."""

import duckdb
import pytest

from veilgrid.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["rendered_lines", "static_rule_match", "item_table_lines", "labeled_values", "name_memory_hits", "region_boxes", "verdict_summary", "entities_regex", "dump_lines", "snapshot_verdicts", "verdict_diff", "assemble_rows", "input_guards", "page_guards", "dump_plan", "code_fragments_fused", "code_growth"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v != v or v is None else f"{v:.8g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in want:
        if got[c].dtype != want[c].dtype and got[c].dtype.kind in "if":
            want[c] = want[c].astype(got[c].dtype)
    assert plain(got) == plain(want)


def test_every_oracle_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
