"""What the operators share: scratch tables, distributed ranks, byte-bounded blocks, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session may go without: it gets a folder of its own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veilgrid-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage: an executor that is lost takes none of their rows along."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/veilgrid-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes one table, or all; nothing may read it any more."""
        if self.spark.sparkContext._jsc is None:
            return
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # at exit the JVM may be gone already
            if name:
                raise


def rank_within(df: DataFrame, parts: list[str], bucket: str, order: list[Column], rank: str, total: str | None = None) -> DataFrame:
    """Adds `rank` (from 1) within `parts` by (bucket, order) without gathering a part in one task.

    `bucket` must not decrease along the wanted order. Rows are numbered within (parts, bucket) only; what
    comes before a bucket is a running sum over the counts, which have one row for each part and bucket.
    """
    counts = df.groupBy(*parts, bucket).agg(F.count(F.lit(1)).alias("__n"))
    spec = (Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))).orderBy(bucket)
    before = counts.select(
        *(F.col(c).alias(f"__k{i}") for i, c in enumerate([*parts, bucket])),
        (F.sum("__n").over(spec) - F.col("__n")).alias("__before"),
        F.sum("__n").over(spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
    )
    on = F.lit(True)
    for i, c in enumerate([*parts, bucket]):
        on = on & df[c].eqNullSafe(before[f"__k{i}"])
    own = Window.partitionBy(*parts, bucket).orderBy(*order)
    out = df.join(before, on).withColumn(rank, F.col("__before") + F.row_number().over(own))
    keep = [*df.columns, F.col(rank)] + ([F.col("__total").alias(total)] if total else [])
    return out.select(*keep)


def key_bucket(key: Column, n: int) -> Column:
    """The n-th part, in order, that a key from 0 to 2^62 - 1 lies in (n up to 2^22)."""
    return F.shiftright(F.shiftright(key, 22) * F.lit(n).cast("long"), 40)


def hash62(*cols: Column | str) -> Column:
    """A hash from 0 to 2^62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes in the column (a row that is longer stands alone)."""
    for batch in batches:
        _give_back()
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    _give_back()


def _give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Edges that one task joins by itself; with more, all tasks take turns at neighbourhoods.
TASK_EDGES = 400_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges to (id, component) for every id in them."""
    root: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            for x in (a, b):
                root.setdefault(x, x)
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            root[max(a, b)] = min(a, b)
    for x in sorted(root):  # a root is smaller than what hangs on it
        root[x] = root[root[x]]
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array(list(root.values()), pa.int64())], ["id", "component"])


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str, most: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), the smallest id reachable, for every id in an edge between two.

    Up to TASK_EDGES edges, which fit one task's memory, are joined there. More go through alternating large-star and small-star
    steps: every step hangs neighbours on the smallest one known, so chains and hubs shrink in a logarithmic number of rounds, each
    written to the shared folder. Either way nothing but counts and a checksum reaches the driver.
    """
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{name}-0")
    if e.count() <= TASK_EDGES:
        return scratch.save(e.repartition(1).mapInArrow(_forest, "id long, component long"), f"{name}-joined")
    last = None
    for step in range(1, most + 1):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = large.join(small_low, large.a == small_low.u)
        small = joined.select(F.col("a"), F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        e = scratch.save(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
