"""Proportional stratified interleaving of rows into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import Scratch, key_bucket, rank_within

#: Rows that one bucket of a stratum holds on the average.
BUCKET_ROWS = 2_000


def _shuffled(seed: int, *cols: Column) -> Column:
    """A key from 0 to 2^62 - 1 of the seed and columns, which SQL engines have too: the first 15 digits of an MD5."""
    said = F.concat_ws("|", F.lit(seed).cast("string"), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.shiftleft(F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long"), 2)


def interleave(df: DataFrame, n_shards: int, id_col: str, text_col: str, stratum_col: str, seed: int = 17) -> DataFrame:
    """One row for each input row: id, size, text_crc32, stratum, shard, slot (gapless from 0 in each shard).

    Rows of each stratum are ranked in a seeded order. The rank r of n becomes the fraction (r - 1/2) / n, all
    rows are sorted by it, and the sorted sequence is cut into n_shards runs whose row counts differ by one at
    most; so every run holds each stratum in its share of the whole, to within a row or two.

    A null stratum is a stratum of its own, a null id is ranked like any other, a null text counts no bytes and
    has the checksum of no bytes. Repeated rows each get a place; equal rows may swap places. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(stratum_col).alias("stratum"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("k", _shuffled(seed, F.col("id"), F.col("text_crc32")))
    rows = Scratch(spark).save(rows, "rows")
    n = rows.count()
    nb = max(1, min(1 << 20, n // BUCKET_ROWS))
    rows = rows.withColumn("b", key_bucket(F.col("k"), nb))
    order = [F.col(c) for c in ("k", "id", "text_crc32")]
    ranked = rank_within(rows, ["stratum"], "b", order, "rank", "n")
    ranked = ranked.withColumn("frac", (F.col("rank") * 2 - 1) / (F.col("n") * 2)).drop("b")
    ranked = ranked.withColumn("b", F.least(F.floor(F.col("frac") * nb), F.lit(nb - 1)).cast("long"))
    placed = rank_within(ranked, [], "b", [F.col("frac"), F.col("stratum"), *order], "pos")
    placed = placed.withColumn("shard", F.expr(f"((pos - 1) * {n_shards}L) div {max(n, 1)}L"))
    first = F.expr(f"(shard * {max(n, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select("id", "stratum", "size", "text_crc32", F.col("shard").cast("int"), (F.col("pos") - 1 - first).cast("long").alias("slot"))


def write_shards(df: DataFrame, placed: DataFrame, id_col: str, path: str) -> None:
    """Writes the rows of df as one folder of Parquet for each shard, in order of slots. An id that repeats, a null one too, is an error,
    as its rows' places cannot be told apart."""
    if placed.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError(f"{id_col} repeats")
    at = placed.select(F.col("id").alias("__id"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    (df.join(at, df[id_col].eqNullSafe(at["__id"])).drop("__id")
     .repartitionByRange(F.col("__shard"), F.col("__slot")).sortWithinPartitions("__shard", "__slot")
     .write.partitionBy("__shard").mode("overwrite").parquet(path))


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `rows`, each with the whole's mixture of sources."""
    placed = interleave(table(spark, sf_dir, "documents"), 40, "doc_id", "text", "source")
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"),
    )
