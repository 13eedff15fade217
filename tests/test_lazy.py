"""What is told early or late for speed equals what is told plainly; pages are made once."""

import random

from pyspark.sql import functions as F

from tests.test_needs import SEEDS, SF
from veilgrid.functions.text import entities, folded, has_entity, has_static_rule, is_name_evidence, has_name_rule, python_repr
from veilgrid.plans import registry


def test_short_ways_equal_the_long_ones(spark):
    rng = random.Random(6)
    texts = [*SEEDS, "it's", 'say "x"', "back\\slash", "€ ſ ž", "a­b", "x\u0085", "line\n"]
    texts += [" ".join(rng.sample(texts, 2)) for _ in range(400)]
    df, text = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("low", folded(F.col("text"))), F.col("text")
    named = has_name_rule(text, F.col("low"))
    got = df.select(
        "text", (has_entity(text) == (F.size(entities(text)) > 0)).alias("all"), (has_entity(text, least=0.65) == (F.size(entities(text, least=0.65)) > 0)).alias("sure"),
        (has_static_rule(text, F.col("low"), named) == has_static_rule(text)).alias("rule"), (is_name_evidence(text, F.col("low"), named) == is_name_evidence(text)).alias("name"), python_repr(text).alias("quoted"),
    ).collect()
    assert all(r["all"] and r["sure"] and r["rule"] and r["name"] and r["quoted"] == repr(r["text"]) for r in got)


def test_snapshots_make_pages_once(spark):
    plan = registry.queries()["snapshot_verdicts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("name-memory") == plan.count("MapInArrow") + 1 and plan.count(" parquet") == 3
