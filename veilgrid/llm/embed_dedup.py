"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table look-ups, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .common import Scratch, components, hash62
from .vectors import MOST_LISTS, PER_LIST, SAMPLE, cosines, dimensions, kmeans, matrix, sample, squared, unit, usable

#: Nearest centroids whose bisectors tell which lists may hold a vector within reach; how many lists those are is not bounded.
PROBES = 24
#: Entries of a label in one block, a run of lists; blocks meet in one task, two and one on the average.
PART = 2048
#: Blocks whose spans of lists are sent to all tasks; with more, they are joined by label.
MOST_BLOCKS = 500_000


@dataclass(frozen=True)
class Quantiser:
    """Centroids of the lists, and for each run of dimensions the codewords of what the centroid leaves."""

    c: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @staticmethod
    def fit(x: np.ndarray, k: int, spaces: int = 8, words: int = 256) -> Quantiser:
        c = kmeans(x, k)
        c = c[_near_by_near(c)]
        rest = x - c[np.concatenate([np.argmin(squared(x[i : i + 4096], c), 1) for i in range(0, len(x), 4096)])]
        cuts = np.linspace(0, x.shape[1], min(spaces, x.shape[1]) + 1).astype(int).tolist()
        some = rest[: words * 16]
        return Quantiser(c, [kmeans(some[:, a:b], min(words, max(1, len(some) // 4)), 5) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], cuts)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and how far each is from what its code stands for."""
        codes = np.stack([np.argmin(squared(p, book), 1) for p, book in zip(self.parts(rest), self.books, strict=True)], 1)
        error = sum(((p - book[codes[:, m]]) ** 2).sum(1) for m, (p, book) in enumerate(zip(self.parts(rest), self.books, strict=True)))
        return codes.astype(np.uint8), np.sqrt(error)

    def distances(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """From what each code stands for (rows) to each vector (columns): sums of looked-up products.

        With y' = c + words, x * y' is x * c and a product for each run of dimensions, which no list changes."""
        same = (self.c @ x.T)[lists]
        stands = self.c[lists]
        for m, (p, book) in enumerate(zip(self.parts(x), self.books, strict=True)):
            same += (book @ p.T)[codes[:, m]]
            stands[:, self.cuts[m] : self.cuts[m + 1]] += book[codes[:, m]]
        return np.sqrt(np.maximum((stands * stands).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * same, 0))

    def within(self, d: np.ndarray, least: np.ndarray, most: np.ndarray, reach: float) -> np.ndarray:
        """From squared distances of vectors to centroids: the lists that may hold a vector y within reach, for each x.

        `least` and `most` are the distances of a list's own vectors from its centroid, so |x - c| is within reach of
        them. And y is no nearer to another centroid o than to its own, c, so x is beyond their bisector by reach at most:
        |x - c|^2 - |x - o|^2 <= 2 * reach * |c - o|.
        """
        far = np.sqrt(d)
        out = (far <= most + reach) & (far >= least - reach)
        n = min(PROBES, len(self.c))
        for o in np.argpartition(d, n - 1, axis=1)[:, :n].T:
            out &= d - np.take_along_axis(d, o[:, None], 1) <= 2 * reach * self.apart[o] + 1e-6
        return out

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances between centroids, for each task that needs them (64 MB at most)."""
        return np.concatenate([np.sqrt(squared(self.c[i : i + 256], self.c)).astype(np.float32) for i in range(0, len(self.c), 256)])


def _near_by_near(c: np.ndarray) -> np.ndarray:
    """An order of centroids in which neighbours are near: halves along the widest direction, again and again."""
    done, todo = [], [np.arange(len(c))]
    while todo:
        at = todo.pop()
        if len(at) <= 2:
            done += at.tolist()
            continue
        x = c[at] - c[at].mean(0)
        end = x[(x * x).sum(1).argmax()]
        other = x[((x - end) ** 2).sum(1).argmax()]
        at = at[np.argsort(x @ (other - end), kind="stable")]
        todo += [at[len(at) // 2 :], at[: len(at) // 2]]
    return np.array(done)


def _listed(quantiser):
    """Rows (label, vec, id, copies) with the list that a vector is stored in, and how far its centroid is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = quantiser.value.c
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                d = squared(unit(matrix(part.column("vec"))), c)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("label", "id", "vec", "copies")), pa.array(d.argmin(1).astype(np.int32)), pa.array(np.sqrt(d.min(1)))], ["label", "id", "vec", "copies", "list", "far"])

    return run


def _asking(quantiser, least: np.ndarray, most: np.ndarray, reach: float):
    """Rows with `own`, a vector's block, and `spans`, the first and last list of each block of its label, to one row for each
    block that it searches: its own, and of those after it all that hold part of a list within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pq = quantiser.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                own, spans = part.column("own").to_numpy(), part.column("spans")
                row = np.repeat(np.arange(len(own)), pc.list_value_length(spans).to_numpy())
                block, lo, hi = (spans.flatten().field(n).to_numpy() for n in ("block", "lo", "hi"))
                after = block >= own[row]
                row, block, lo, hi = row[after], block[after], lo[after], hi[after]
                hit = block == own[row]
                if not hit.all():
                    held = np.zeros((len(own), len(pq.c) + 1), np.int32)
                    held[:, 1:] = np.cumsum(pq.within(squared(unit(matrix(part.column("vec"))), pq.c), least, most, reach), 1)
                    hit |= held[row, hi + 1] > held[row, lo]
                row, block = row[hit], block[hit]
                for j in range(0, len(row), 16384):
                    at = pa.array(row[j : j + 16384])
                    yield pa.RecordBatch.from_arrays([*(part.column(n).take(at) for n in ("label", "id", "vec", "copies", "own")), pa.array(block[j : j + 16384])], ["label", "id", "vec", "copies", "own", "block"])

    return run


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins a[i] with b[i] in `root`, which holds for each place the first place of its tree."""
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        open_ = high != low
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root[:] = root[root]


def _linked(quantiser, least: float, reach: float):
    """A block and the vectors that search it, to counts of links and to edges that join what is linked here.

    The code of a stored vector y bounds its distance from x: |x - y| >= |x - code(y)| - error(y). Only pairs that this
    leaves within reach are compared, exactly. Two vectors of one block see each other; of two blocks only the vectors of the
    earlier one search, so y's count is raised here too.
    """

    def run(key, stored: pa.Table, asking: pa.Table) -> pa.Table:
        pq = quantiser.value
        got = [np.zeros(0, np.int64)] * 3
        if stored.num_rows and asking.num_rows:
            y, x = matrix(stored.column("vec")), matrix(asking.column("vec"))
            uy, ux = unit(y), unit(x)
            lists = stored.column("list").to_numpy()
            codes, error = pq.encode(uy - pq.c[lists])
            yid, xid = stored.column("id").to_numpy(), asking.column("id").to_numpy()
            ycopies, xcopies = stored.column("copies").to_numpy(), asking.column("copies").to_numpy()
            across = asking.column("own").to_numpy() != stored.column("block").to_numpy()[0]
            ids, place = np.unique(np.concatenate([yid, xid]), return_inverse=True)
            yat, xat = place[: len(yid)], place[len(yid) :]
            root, links = np.arange(len(ids)), np.zeros(len(ids))
            for i in range(0, len(x), 512):
                col, row = np.nonzero(pq.distances(ux[i : i + 512], lists, codes) <= reach + error[:, None])
                row += i
                other = xid[row] != yid[col]
                row, col = row[other], col[other]
                hit = np.concatenate([np.zeros(0, bool), *(cosines(x[row[j : j + 65536]], y[col[j : j + 65536]]) >= least for j in range(0, len(row), 65536))])
                row, col = row[hit], col[hit]
                links += np.bincount(xat[row], ycopies[col], len(ids))
                both = across[row]
                links += np.bincount(yat[col[both]], xcopies[row[both]], len(ids))
                _join(root, xat[row], yat[col])
            some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))) | (np.bincount(root, minlength=len(ids)) > 1))
            got = [ids[some], links[some], ids[root[some]]]
        return pa.Table.from_arrays([pa.array(v.astype(np.int64)) for v in got], ["id", "links", "joined"])

    return run


def near_duplicates(df: DataFrame, id_col: str, vec_col: str, label_col: str, least: float) -> DataFrame:
    """One row for each row of df: id, n_links, component_id, kept. Rows link if their labels are equal and not null
    and the cosine of their vectors is at least `least`.

    Equal vectors of a label are one entry with a count, so copies are never paired with each other. Entries are searched by
    product quantisation (see _linked). Each searches all lists that may hold a vector within reach by a proven bound (see
    Quantiser.within), so no pair is missed, whatever the data; where vectors form no clusters those are most lists, and the
    work grows with the square of a label's entries. Lists stand in an order of near by near; each PART entries of a label
    in this order are a block, so an entry moves once for a block, not for a list, and a crowded list is several blocks.

    Rows without id, label or direction (see usable) link with nothing. Only vectors of equal dimension link: each dimension
    that two rows or more have is a search of its own. Ids are whole numbers. Where one repeats, each of its rows is a vector
    of its own, equal rows too; kept then holds for all rows with the smallest id of their component. An empty table gives no rows.
    """
    spark = df.sparkSession
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    if ids.where("id IS NOT NULL").groupBy("id").count().where("count > 1").limit(1).count():
        own = df.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(id_col).isNotNull(), F.col(vec_col)).alias("vec"), F.col(label_col).alias("label"))
        own = Scratch(spark).save(own.withColumn("row", F.monotonically_increasing_id()), "numbered")
        found = near_duplicates(own.select("row", "vec", "label"), "row", "vec", "label", least).select(F.col("id").alias("row"), "n_links", F.col("component_id").alias("component"))
        found = own.select("id", "row").join(found, "row")
        smallest = found.groupBy("component").agg(F.min("id").alias("component_id"))
        return found.join(smallest, "component").select("id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    rows = Scratch(spark).save(usable(df, id_col, vec_col, label_col).where(F.col("label").isNotNull()), "rows")
    found = [_found(rows.where(F.size("vec") == d), least) for d in dimensions(rows, 2)]
    if not found:
        return ids.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    told = reduce(DataFrame.union, found)
    out = ids.join(told, ids.id == told["__id"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _found(rows: DataFrame, least: float) -> DataFrame:
    """Rows (__id, n_links, component_id) for all rows (id, vec, label), vectors of one dimension."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    entry = F.struct("label", F.transform("vec", lambda v: v + F.lit(0.0)).alias("vec"))  # -0.0 is 0.0
    keyed = rows.select("id", entry.alias("e")).select("id", "e.*")
    entries = scratch.save(keyed.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "entries").withColumnRenamed("rep", "id")
    k = max(1, min(MOST_LISTS, entries.count() // PER_LIST))
    some = sample(entries, max(k * SAMPLE, 4096) + 1000)
    quantiser = Quantiser.fit(some, k)
    sent = spark.sparkContext.broadcast(quantiser)  # MOST_LISTS vectors and 256 codewords a space at most
    label = rows.schema["label"].dataType.simpleString()
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    listed = scratch.save(entries.mapInArrow(_listed(sent), f"label {label}, id long, vec array<double>, copies long, list int, far double"), "listed")
    near, far = np.full(len(quantiser.c), np.inf), np.full(len(quantiser.c), -np.inf)
    for r in listed.groupBy("list").agg(F.min("far").alias("near"), F.max("far").alias("far")).collect():  # MOST_LISTS rows at most
        near[r["list"]], far[r["list"]] = r["near"], r["far"]

    n = F.count(F.lit(1))
    counts = listed.groupBy("label", "list").agg(n.alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("label").orderBy("list")) - F.col("n"))
    counts = scratch.save(counts, "counts")
    block = lambda at: F.floor(at / PART).cast("int")
    runs = counts.withColumn("block", F.explode(F.sequence(block(F.col("before")), block(F.col("before") + F.col("n") - 1))))
    runs = runs.groupBy("label", "block").agg(F.min("list").alias("lo"), F.max("list").alias("hi"))
    spans = scratch.save(runs.groupBy("label").agg(F.collect_list(F.struct("block", "lo", "hi")).alias("spans"), n.alias("blocks")), "spans")
    small = (spans.agg(F.sum("blocks")).first()[0] or 0) <= MOST_BLOCKS
    blocked = listed.join(counts, ["label", "list"]).withColumn("block", block(F.col("before") + hash62("id") % F.col("n"))).drop("far", "n", "before")
    blocked = scratch.save(blocked, "blocked")
    asking = blocked.withColumnRenamed("block", "own").join(F.broadcast(spans) if small else spans, "label").select("label", "id", "vec", "copies", "own", "spans")
    asking = asking.mapInArrow(_asking(sent, near, far, reach), f"label {label}, id long, vec array<double>, copies long, own int, block int")
    asking = scratch.save(asking, "asking")
    sizes = asking.groupBy("label", "block").agg(F.ceil(n / (2 * PART)).cast("int").alias("t"))
    stored = blocked.join(sizes, ["label", "block"]).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("t") - 1))).drop("t")
    asking = asking.join(sizes, ["label", "block"]).withColumn("q", (hash62("id") % F.col("t")).cast("int"))
    keys = ["label", "block", "q"]
    asking = asking.select(*(F.col(c).alias(c) for c in (*keys, "id", "vec", "copies", "own")))  # columns of its own
    found = stored.groupBy(keys).cogroup(asking.groupBy(keys)).applyInArrow(_linked(sent, least, reach), "id long, links long, joined long")
    found = scratch.save(found, "found")
    comps = components(spark, found.select(F.col("id").alias("a"), F.col("joined").alias("b")), scratch, "joined")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    done = entries.join(counts, "id", "left").join(comps.withColumnRenamed("id", "cid"), F.col("id") == F.col("cid"), "left").select(
        F.col("label").alias("__label"), F.col("vec").alias("__vec"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
    )
    return keyed.join(done, (keyed.label == done["__label"]) & (keyed.vec == done["__vec"])).select(F.col("id").alias("__id"), "n_links", "component_id")


def op7_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors whose labels are equal and whose cosine is at least 0.93."""
    out = near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.93)
    return out.withColumnRenamed("id", "vec_id")
