"""Approximate nearest neighbours over balanced posting lists with replicated boundary vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .common import Scratch, hash62
from .vectors import Graph, cosines, dimensions, fit_centroids, matrix, unit, usable

#: A vector goes to every list, up to REPLICAS, whose centroid is no farther than REPLICA_RATIO times the nearest one.
REPLICAS, REPLICA_RATIO = 8, 1.10
#: A query reads the lists, nearest first, up to PROBES, whose centroids are no farther than PROBE_RATIO times the nearest one.
PROBES, PROBE_RATIO = 48, 1.35
#: Vectors in one part of a list on the average, if a list has more.
PART = 4096


def _lists(graph, most: int, ratio: float, held: np.ndarray | None = None, floor: int = 0):
    """Rows (id, vec) to rows (list, id, vec), one for each list. Whatever the ratio, the nearest lists are taken until they hold
    `floor` vectors; `held` has what each list holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x = matrix(part.column("vec"))
                ids, far = graph.value.search(unit(x), most)
                taken = far <= ratio * far[:, :1] + 1e-12
                if held is not None:
                    taken |= np.isfinite(far) & (np.cumsum(held[ids], 1) - held[ids] < floor)
                row, place = np.nonzero(taken)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, place]), part.column("id").take(at), part.column("vec").take(at)], ["list", "id", "vec"])

    return run


def _nearest(k: int):
    """A part of a list and the queries that read it, to the k nearest of the part for each query."""

    def run(key, stored: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if stored.num_rows and asked.num_rows:
            ids, x = stored.column("id").to_numpy(), matrix(stored.column("vec"))
            ux = unit(x)
            query, q = asked.column("id").to_numpy(), matrix(asked.column("vec"))
            for i in range(0, len(query), 256):
                s = unit(q[i : i + 256]) @ ux.T
                s[query[i : i + 256, None] == ids[None, :]] = -np.inf
                last = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
                row, col = np.nonzero((s >= last[:, None] - 1e-9) & np.isfinite(s))
                exact = cosines(q[i + row], x[col])
                order = np.lexsort((ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                for o, v in zip(out, (query[i + row], ids[col], exact), strict=True):
                    o.append(v[place < k])
        arrays = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.Table.from_arrays([pa.array(arrays[0].astype(np.int64)), pa.array(arrays[1].astype(np.int64)), pa.array(arrays[2].astype(np.float64))], ["query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """The k nearest rows of df found for every row of queries (of the same columns), by cosine: (query_id, rank, vec_id, score).

    Centroids come from a bounded sample; every row of df is indexed. A vector near a boundary stands in several lists. A
    query walks the graph of centroids, which every task holds, and reads the lists whose distance is within a ratio of the
    nearest, and in any case so many that they hold twice as many vectors as are sure to have k others among them; a query
    that still finds fewer than k is held against all rows. Scores are exact, in doubles, on the vectors as given. A list of
    more than PART vectors is dealt out in parts, each of which meets the list's queries on its own, so one crowded list is
    no single task's work.

    Rows of a query's own id are no candidates, nor are vectors of another dimension than the query's: each dimension has
    an index of its own. Nulls and vectors without direction take no part (see usable); an id that repeats is one
    candidate, at its best score. Ties go to the smaller id. Fewer candidates give fewer rows; an empty table gives none.
    Other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(usable(df, id_col, vec_col), "rows")
    asked = scratch.save(usable(queries, id_col, vec_col), "asked")
    wanted = sorted(set(dimensions(rows)) & set(dimensions(asked)))
    if not wanted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_found(*(t.where(F.size("vec") == d) for t in (rows, asked)), k) for d in wanted]
    return found[0] if len(found) == 1 else _best(reduce(DataFrame.union, found), k)


def _found(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest of rows (id, vec) for those asked, all of one dimension."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    centroids = fit_centroids(rows)
    graph = spark.sparkContext.broadcast(Graph.build(centroids))  # MOST_LISTS vectors at most
    posted = rows.mapInArrow(_lists(graph, REPLICAS, REPLICA_RATIO), "list long, id long, vec array<double>")
    posted = scratch.save(posted, "lists")
    sizes = scratch.save(posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")), "sizes")
    held = np.zeros(len(centroids), np.int64)
    for r in sizes.collect():  # a row for each centroid
        held[r["list"]] = r["n"]
    parts = F.broadcast(sizes.select("list", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    stored = posted.join(parts, "list").withColumn("part", (hash62("id") % F.col("parts")).cast("int")).drop("parts")
    probes = asked.mapInArrow(_lists(graph, PROBES, PROBE_RATIO, held, 2 * REPLICAS * (k + 1)), "list long, id long, vec array<double>")
    probes = probes.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = "query_id long, vec_id long, score double"
    near = stored.groupBy("list", "part").cogroup(probes.groupBy("list", "part")).applyInArrow(_nearest(k), found)
    best = scratch.save(_best(near, k), "best")

    enough = best.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = scratch.save(asked.join(enough, "id", "left_anti"), "short")
    if short.isEmpty():
        return best
    n = max(1, -(-int(rows.count()) // PART))
    dealt = rows.withColumn("part", (hash62("id") % n).cast("int"))
    whole = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    late = _best(dealt.groupBy("part").cogroup(whole.groupBy("part")).applyInArrow(_nearest(k), found), k)
    return best.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").union(late)


def _best(near: DataFrame, k: int) -> DataFrame:
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op9_posting_lists_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, among all others."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0), "vec_id", "embedding", 5)
