"""What the vector operators share: usable vectors, k-means on a bounded sample, and a graph over centroids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash62

#: Vectors that a centroid stands for on the average, and the most centroids there are.
PER_LIST, MOST_LISTS = 200, 4096
#: Sampled vectors for each centroid; so the sample has MOST_LISTS * SAMPLE rows at most.
SAMPLE = 24


def usable(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """Rows (id, vec as doubles, label) that take part: an id, and a vector that isn't null, empty or zero, with finite
    components only. Vectors may differ in dimension; see dimensions."""
    cols = [F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")]
    return df.select(*cols, *([F.col(label_col).alias("label")] if label_col else [])).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )


def dimensions(rows: DataFrame, least: int = 1) -> list[int]:
    """The dimensions that at least so many of the usable() rows have. Only vectors of one dimension have a cosine, so each
    dimension has an index of its own."""
    counts = rows.groupBy(F.size("vec").alias("d")).count().where(F.col("count") >= least)
    return sorted(r["d"] for r in counts.collect())


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in doubles, the same for equal rows wherever they stand."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


def sample(rows: DataFrame, most: int, seed: int = 3) -> np.ndarray:
    """About `most` unit vectors at most, picked by a seeded hash of the id and vector."""
    n = rows.count()
    picked = rows.where(hash62(F.lit(seed), "id", "vec") < F.lit(int((1 << 62) * min(1.0, most / max(n, 1)))))
    got = picked.select("id", "vec").toArrow().sort_by("id")
    return unit(matrix(got.column("vec"))) if got.num_rows else np.zeros((0, 1))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Balanced k-means: in every round the centroids of the smallest clusters move into clusters of over twice the mean size."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for step in range(rounds):
        own = np.concatenate([np.argmin(squared(x[i : i + 4096], c), 1) for i in range(0, len(x), 4096)])
        count = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
        if step < rounds - 1:
            large, small = np.flatnonzero(count > 2 * len(x) / len(c)), np.argsort(count, kind="stable")
            for big, little in zip(large, small, strict=False):
                members = x[own == big]
                c[little] = members[rng.integers(len(members))]
    return c


@dataclass(frozen=True)
class Graph:
    """Centroids and, for each, its nearest others; searched by a beam that starts from a few spread entries."""

    c: np.ndarray
    near: np.ndarray
    entries: np.ndarray

    @staticmethod
    def build(c: np.ndarray, degree: int = 32, entries: int = 16) -> Graph:
        d = squared(c, c)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, axis=1, kind="stable")[:, : min(degree, max(len(c) - 1, 1))] if len(c) > 1 else np.zeros((1, 1), np.int64)
        spread = [0]  # farthest first
        far = squared(c, c[:1])[:, 0]
        while len(spread) < min(entries, len(c)):
            spread.append(int(far.argmax()))
            far = np.minimum(far, squared(c, c[spread[-1:]])[:, 0])
        return Graph(c, near, np.array(spread))

    def search(self, x: np.ndarray, most: int, beam: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The `most` nearest centroids found for each row, nearest first, and their distances."""
        most = min(most, len(self.c))
        beam = min(len(self.c), max(beam or 2 * most, len(self.entries)))
        found, far = [], []
        for i in range(0, len(x), 1024):
            ids, d = self._beam(x[i : i + 1024], beam)
            found.append(ids[:, :most])
            far.append(np.sqrt(d[:, :most]))
        if not found:
            return np.zeros((0, most), np.int64), np.zeros((0, most))
        return np.concatenate(found), np.concatenate(far)

    def _beam(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(x))
        norms = (self.c * self.c).sum(1)
        own = (x * x).sum(1)
        seen = np.zeros((len(x), len(self.c)), bool)
        seen[:, self.entries] = True
        ids = np.full((len(x), beam), -1)
        d = np.full((len(x), beam), np.inf)
        first = squared(x, self.c[self.entries])
        ids[:, : len(self.entries)], d[:, : len(self.entries)] = self.entries, first
        done = ids < 0
        while True:
            open_ = np.where(done, np.inf, d)
            best = open_.argmin(1)
            active = rows[np.isfinite(open_[rows, best])]
            if not len(active):
                break
            done[active, best[active]] = True
            new = self.near[ids[active, best[active]]]
            dist = own[active, None] + norms[new] - 2 * np.einsum("ij,ikj->ik", x[active], self.c[new])
            dist = np.where(seen[active[:, None], new], np.inf, np.maximum(dist, 0))
            seen[active[:, None], new] = True
            all_d = np.concatenate([d[active], dist], 1)
            all_ids = np.concatenate([ids[active], new], 1)
            all_done = np.concatenate([done[active], ~np.isfinite(dist)], 1)
            keep = np.argsort(all_d, 1, kind="stable")[:, :beam]
            d[active] = np.take_along_axis(all_d, keep, 1)
            ids[active] = np.take_along_axis(all_ids, keep, 1)
            done[active] = np.take_along_axis(all_done, keep, 1)
        order = np.argsort(d, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)


def fit_centroids(rows: DataFrame) -> np.ndarray:
    """Centroids for usable() rows, as many as PER_LIST and MOST_LISTS say, from a bounded sample."""
    k = max(1, min(MOST_LISTS, rows.count() // PER_LIST))
    x = sample(rows, k * SAMPLE + 1000)
    return kmeans(x, k) if len(x) else np.zeros((1, 1))
