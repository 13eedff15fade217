"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table
from .bpe import _per_text, _taken
from .common import blocks, hash62

_WORD = re.compile(r"\w+")
#: Letters of a word that make its stem.
STEM = 5
#: Labelled rows that training takes at most, on the average of the seeded hash that picks them.
MAX_ROWS = 8_000
#: A score from here on means toxic.
THRESHOLD = 0.3


def _word_hashes(chunk: str) -> tuple[int, ...]:
    """Of each word of a chunk: the hash of the word, and of its first letters, which stand for its other forms."""
    return tuple(xxhash.xxh64_intdigest(x) for w in _WORD.findall(chunk.lower()) for x in (w, w[:STEM]))


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * kind)
    return (x >> np.uint64(32)).astype(np.uint32)


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, with repeats, and the number of each feature's text: words, stems, word pairs, and pairs
    with one word between. The words of a whole text count, however long it is."""
    lists = pc.ascii_split_whitespace(text.cast(pa.string()).fill_null(""))
    both, sizes = _taken(_word_hashes, lists.flatten(), pa.uint64())
    h, stem = both[::2], both[1::2]
    ends = _per_text(lists, sizes) // 2
    row = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
    found, rows = [], []
    with np.errstate(over="ignore"):
        made = [(1, h, 0), (2, stem, 0), (3, h[:-1] * np.uint64(31) + h[1:], 1), (4, h[:-2] * np.uint64(37) + h[2:], 2)]
        for kind, values, reach in made:
            if len(values):
                same = row[: len(row) - reach] == row[reach:]
                found.append(_mixed(values[same], kind))
                rows.append(row[reach:][same])
    none = np.zeros(0, np.uint32)
    return (np.concatenate(found) if found else none), (np.concatenate(rows) if rows else none.astype(np.int32))


def _distinct(feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's features once."""
    both = np.unique((row.astype(np.uint64) << np.uint64(32)) | feature)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Weights of the features that have one, by rising hash, and the intercept; a few thousand entries at most."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: pa.Array) -> np.ndarray:
        """Probabilities that the texts are toxic; each feature of a text counts once."""
        sums = np.full(len(text), self.bias)
        if len(self.keys):
            seen = np.zeros(1 << 20, bool)
            seen[self.keys & np.uint32(0xFFFFF)] = True
            feature, row = features(text)
            few = seen[feature & np.uint32(0xFFFFF)]
            feature, row = _distinct(feature[few], row[few])
            at = np.minimum(np.searchsorted(self.keys, feature), len(self.keys) - 1)
            hit = self.keys[at] == feature
            sums += np.bincount(row[hit], self.weights[at[hit]], len(text))
        return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, least_df: int = 3, passes: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0) -> Model:
    """FTRL-proximal on rows of distinct features, in the order given, a rate for each coordinate.

    A feature of fewer than `least_df` rows gets no weight; L1 leaves out most of the others. Without rows the
    model gives every text the score 0.5, and with one class only, a score that leans to it.
    """
    often = np.zeros(1 << 26, np.uint8)  # counts by part of the hash, so that most rare features go before they are sorted
    for r in rows:
        at = r & np.uint32((1 << 26) - 1)
        often[at] = np.minimum(often[at], 254) + 1
    some = [r[often[r & np.uint32((1 << 26) - 1)] >= least_df] for r in rows]
    keys, counts = np.unique(np.concatenate(some) if some else np.zeros(0, np.uint32), return_counts=True)
    keys = keys[counts >= least_df]
    del often
    z, n, bias_z, bias_n = np.zeros(len(keys)), np.zeros(len(keys)), 0.0, 0.0
    kept = []
    for r in some:
        at = np.minimum(np.searchsorted(keys, r), max(len(keys) - 1, 0))
        kept.append(at[keys[at] == r] if len(keys) else np.zeros(0, np.int64))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def bias() -> float:
        return -bias_z / ((beta + np.sqrt(bias_n)) / alpha)

    for _ in range(passes):
        for at, y in zip(kept, labels.tolist(), strict=True):
            w, b = weights(z[at], n[at]), bias()
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))
            g = p - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    w = weights(z, n)
    return Model(keys[w != 0], w[w != 0], float(bias()))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int = MAX_ROWS, seed: int = 5) -> Model:
    """Fits the model to labelled rows, of which a seeded hash of the id picks about `max_rows` at most.

    Several labels of one id count as the largest, and of its texts, if they differ, the one whose features sort first teaches; null
    ids and labels teach nothing; null texts are empty. Features are made where the rows are; one task learns from them in a fixed order, and what it holds is bounded by max_rows.
    """
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    n = told.count()
    picked = told.withColumn("__k", hash62(F.lit(seed), F.col("__id"))).where(F.col("__k") < F.lit(int((1 << 62) * min(1.0, max_rows / max(n, 1)))))
    rows = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("text"))
    joined = rows.join(F.broadcast(picked), F.col("__own") == F.col("__id")).select("text", "__y", "__k")  # picked: max_rows short rows

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 2 << 20):
            feature, row = _distinct(*features(b.column("text")))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            data = [feature[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("__k"), b.column("__y"), pa.array(data, pa.binary())], ["k", "y", "data"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys = [], []
        for b in batches:
            rows += [np.frombuffer(x.as_py(), np.uint32) for x in b.column("data")]
            ys += b.column("y").to_pylist()
        model = ftrl(rows, np.array(ys, np.float64))
        yield pa.RecordBatch.from_pydict({"keys": [model.keys.tobytes()], "weights": [model.weights.tobytes()], "bias": [model.bias]})

    each = joined.mapInArrow(made, "k long, y int, data binary").groupBy("k").agg(F.min(F.struct("data", "y")).alias("r")).select("k", "r.y", "r.data")
    one = each.repartition(1).sortWithinPartitions("k")
    got = one.mapInArrow(learn, "keys binary, weights binary, bias double").collect()
    if not got:
        return ftrl([], np.zeros(0))
    return Model(np.frombuffer(got[0]["keys"], np.uint32), np.frombuffer(got[0]["weights"]), got[0]["bias"])


def score(df: DataFrame, text_col: str, model: Model, out_col: str = "score") -> DataFrame:
    """Adds each whole text's score, from 0 to 1; a null text is empty. All columns stay; out_col must be free."""
    if out_col in df.columns:
        raise ValueError(f"there is a column {out_col}")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col, 2 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(b.column(text_col)))], names=[*b.schema.names, out_col])

    return df.mapInArrow(scored, T.StructType([*df.schema.fields, T.StructField(out_col, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score, learnt from the labels, is under the threshold. Columns are docs' own, whatever their names.

    Null and empty texts are scored as texts without words; repeated rows share a fate; an empty table gives no rows."""
    model = train(docs, labels, id_col, text_col, label_col)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    return score(plain, text, model, "__score").where(F.col("__score") < threshold).select(*names).toDF(*docs.columns)


def held_out(id_col: str):
    """Whether a row's label is kept from training: crc32 of the id as text leaves 2 on division by 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from labels of rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out("doc_id")), "doc_id", "text", "toxic")
    scored = score(docs.select("doc_id", "text"), "text", model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
