"""Repeated passages by sparse suffixes: kept at content-selected minimisers, sorted, compared, and extended to whole matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table
from .common import Scratch, blocks, hash62
from .jaccard import window_hashes, word_hashes

#: Words of the run that a suffix must begin with to meet another.
SEED_WORDS = 12
#: Bits of the filter of repeated seeds: 16 for each, within these bounds (64 MB at most).
FILTER_BITS = 1 << 20, 1 << 29
#: Suffixes with one seed that a task takes together, about; a seed with more is dealt out by their places, and its windows by their hashes.
RUN = 2_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def suffixes(text: pa.Array, words: int, seed: int) -> tuple[np.ndarray, ...]:
    """The retained suffixes of all texts: seed hash, text, first window and windows of each, and the hashes of all windows.

    A window is a run of `words` words in one text. Its minimiser is the seed with the smallest hash in it, the leftmost
    of equals; so equal windows have equal minimisers at equal places, and a suffix is kept where one begins. The windows of one
    suffix follow each other. Hashes of windows stand in the order of suffixes; first windows count from the text's start.
    """
    h, ends = word_hashes(text)
    n = np.diff(ends)
    none = np.zeros(0, np.int64)
    if not len(h) or n.max() < words:
        return np.zeros(0, np.uint64), none, none, none, np.zeros(0, np.uint64)
    seeds, whole = window_hashes(h, seed), window_hashes(h, words)
    width = words - seed + 1
    at = np.arange(len(seeds), dtype=np.uint64)
    least = (_sliding_min((seeds >> np.uint64(28) << np.uint64(28)) | at, width) & np.uint64((1 << 28) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(n)), np.maximum(n - words + 1, 0))
    count = np.maximum(n - words + 1, 0)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = ends[:-1][row] + window
    own = least[place]
    begin = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])]))
    return seeds[own[begin]], row[begin], window[begin], np.diff(np.concatenate([begin, [len(own)]])), whole[place]


def _seeds(words: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            key, n = np.unique(suffixes(b.column("text"), words, seed)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["seed", "n"])

    return run


def _filter(repeated: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each repeated seed, at the top bits of its hash; the bits are set where the seeds are and meet in slices."""
    want = 16 * repeated.count()
    bits = max(FILTER_BITS[0], min(FILTER_BITS[1], 1 << max(0, want - 1).bit_length()))
    shift = 64 - (bits.bit_length() - 1)
    size = 1 << 19

    def part(rows: pa.Table) -> pa.Table:
        bit = rows.column("bit").to_numpy()
        made = np.zeros(size, np.uint8)
        made[bit % size] = 1
        return pa.Table.from_pydict({"slice": [int(bit[0]) // size], "data": [np.packbits(made).tobytes()]})

    rows = repeated.select(F.shiftrightunsigned("seed", shift).alias("bit")).distinct().withColumn("slice", F.floor(F.col("bit") / size))
    whole = np.zeros(bits // 8, np.uint8)
    for r in rows.groupBy("slice").applyInArrow(part, "slice long, data binary").toLocalIterator():
        whole[r["slice"] * size // 8 :][: size // 8] = np.frombuffer(r["data"], np.uint8)
    return whole, shift


def _has(bits: np.ndarray, shift: int, key: np.ndarray) -> np.ndarray:
    at = (key >> np.uint64(shift)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _kept(words: int, seed: int, sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffixes whose seeds the filter lets pass, with the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift = sent.value
        for b in blocks(batches, "text"):
            key, row, first, count, whole = suffixes(b.column("text"), words, seed)
            hit = _has(bits, shift, key)
            value = whole[np.repeat(hit, count)].view(np.int64)
            at = pa.array(row[hit])
            windows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[hit])]), pa.int32()), pa.array(value))
            yield pa.RecordBatch.from_arrays([pa.array(key[hit].view(np.int64)), b.column("id").take(at), b.column("th").take(at), pa.array(first[hit].astype(np.int32)), windows], ["seed", "id", "th", "first", "windows"])

    return run


#: What a window is: met once, the first of several, a later one.
_ONCE, _FIRST, _LATER = 0, 1, 2


def _states(value: np.ndarray, group: np.ndarray, same: np.ndarray) -> np.ndarray:
    """States of windows that stand in their order: `same` numbers the rows that are alike in all, which count once."""
    order = np.lexsort((np.arange(len(value)), value, group))
    v, g, s = value[order], group[order], same[order]
    begin = np.concatenate([[True], (v[1:] != v[:-1]) | (g[1:] != g[:-1])])
    run = np.cumsum(begin) - 1
    lead = s == s[np.flatnonzero(begin)][run]
    several = np.bincount(run, ~lead) > 0
    out = np.empty(len(value), np.int8)
    out[order] = np.where(lead, np.where(several[run], _FIRST, _ONCE), _LATER)
    return out


def _compared() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffixes sorted by (seed, salt, id, th, first): neighbours with one seed are compared window by window, which is by how
    far the match extends to the left and right. Gives runs of windows of a state, and the windows of salted seeds one by one."""

    def close(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        lists = rows.column("windows").combine_chunks()
        count = lists.value_lengths().to_numpy(zero_copy_only=False)
        value = lists.flatten().to_numpy()
        seed, salt, th, first = (rows.column(c).to_numpy() for c in ("seed", "salt", "th", "first"))
        ids = rows.column("id").combine_chunks().dictionary_encode()
        ids = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = (seed[1:] != seed[:-1]) | (salt[1:] != salt[:-1])
        other = new.copy()
        other[1:] |= (ids[1:] != ids[:-1]) | (th[1:] != th[:-1]) | (first[1:] != first[:-1])
        row = np.repeat(np.arange(n), count)
        state = _states(value, (np.cumsum(new) - 1)[row], (np.cumsum(other) - 1)[row])
        at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        hot = (salt >= 0)[row]
        cut = np.ones(len(row), bool)
        cut[1:] = (row[1:] != row[:-1]) | (state[1:] != state[:-1]) | (hot[1:] & (state[1:] != _LATER))
        begin = np.flatnonzero(cut)
        keep = (state[begin] != _ONCE) | hot[begin]
        length = np.diff(np.concatenate([begin, [len(row)]]))[keep]
        begin = begin[keep]
        take = pa.array(row[begin])
        open_ = hot[begin] & (state[begin] != _LATER)
        return pa.RecordBatch.from_arrays(
            [rows.column("id").combine_chunks().take(take), pa.array(th[row[begin]]), pa.array(at[begin].astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(state[begin].astype(np.int32)), pa.array(value[begin], mask=~open_)],
            ["id", "th", "first", "n", "state", "window"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            seed, salt = b.column("seed").to_numpy(), b.column("salt").to_numpy()
            end = int(np.flatnonzero((seed != seed[-1]) | (salt != salt[-1]))[-1]) + 1 if (seed[0], salt[0]) != (seed[-1], salt[-1]) or len(np.unique(seed)) > 1 else 0
            if end:
                yield close(pa.Table.from_batches([*held, b.slice(0, end)]))
                held = []
            elif held and (held[-1].column("seed")[-1].as_py(), held[-1].column("salt")[-1].as_py()) != (seed[0], salt[0]):
                yield close(pa.Table.from_batches(held))
                held = []
            held.append(b.slice(end))
        if held:
            yield close(pa.Table.from_batches(held))

    return run


def repeated_passages(df: DataFrame, id_col: str, text_col: str, words: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """Passages of at least `words` words that stand at two places or more, in one text or in several.

    Rows: id, th (hash of the text), start_word, end_word, kept. A word is a run without ASCII white space, A-Z in lower case. The first
    place of a window of `words` words, by id (null first), text hash and position, is kept; at every later place it
    is redundant. A row with kept = false is a longest run of words in redundant windows, one with kept = true
    a longest run in windows that are kept and stand elsewhere too; so cutting the former leaves every passage once.

    1. Suffixes are retained at minimiser positions only (see suffixes), about one in 20 words.
    2. Seeds (their first words) that occur once are dropped by a filter with a bit for each repeated seed; what slips
       through costs time only.
    3. The others are sorted by seed and place, and those with one seed are compared in windows, which tells how far each match extends
       left and right: a window can only be repeated among suffixes with its minimiser.
    4. A seed with over RUN suffixes is dealt out by their places first, so a text that repeats it ever again is dealt out too; the windows that are first in a part then meet by their own hashes,
       one row a part. So no passage, however common, is a single task's work.

    Null, empty and shorter texts have no passages. Rows alike in id and text are one document. Texts, windows and seeds are told apart
    by 64-bit hashes. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    seed = min(SEED_WORDS, words)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    kind = rows.schema["id"].dataType
    counts = rows.select("text").mapInArrow(_seeds(words, seed), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1")
    counts = scratch.save(counts, "seeds")
    sent = spark.sparkContext.broadcast(_filter(counts))
    ddl = f"seed long, id {kind.simpleString()}, th long, first int, windows array<long>"
    made = rows.select("id", "th", "text").mapInArrow(_kept(words, seed, sent), ddl)
    hot = counts.where(F.col("n") > RUN).select("seed", F.ceil(F.col("n") / RUN).cast("int").alias("parts"))
    salt = F.when(F.col("parts").isNull(), -1).otherwise((hash62("id", "th", "first") % F.col("parts")).cast("int"))
    # each hot seed has RUN suffixes or more, so there are at most 1 / RUN as many hot seeds as suffixes
    salted = made.join(F.broadcast(hot) if hot.count() <= 1_000_000 else hot, "seed", "left").withColumn("salt", salt).drop("parts")
    ordered = salted.repartition("seed", "salt").sortWithinPartitions("seed", "salt", "id", "th", "first")
    out_ddl = f"id {kind.simpleString()}, th long, first int, n int, state int, window long"
    runs = scratch.save(ordered.mapInArrow(_compared(), out_ddl), "runs")

    open_ = runs.where("window IS NOT NULL").distinct()  # rows alike in id and text are one document
    place = F.struct(F.col("id").isNotNull().alias("a"), "id", "th", "first")
    met = open_.groupBy("window").agg(F.min(place).alias("lead"), F.count(F.lit(1)).alias("parts"), F.max("state").alias("most"))
    late = open_.join(met, "window").select("id", "th", "first", "n", F.when(place != F.col("lead"), _LATER).when((F.col("parts") > 1) | (F.col("most") == _FIRST), _FIRST).otherwise(_ONCE).alias("state"))
    all_runs = runs.where("window IS NULL").select("id", "th", "first", "n", "state").union(late).where(F.col("state") != _ONCE)
    grouped = all_runs.select("id", "th", (F.col("state") == _FIRST).alias("kept"), F.struct(F.col("first").alias("a"), (F.col("first") + F.col("n") + words - 1).alias("b")).alias("r"))
    grouped = grouped.groupBy("id", "th", "kept").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # the runs of one text
    merged = F.aggregate(
        "rs", F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, r: F.when((F.size(acc) > 0) & (r["a"] <= F.element_at(acc, -1)["b"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], r["b"]).alias("b"))))).otherwise(F.concat(acc, F.array(r))),
    )
    return grouped.select("id", "th", "kept", F.explode(merged).alias("r")).select("id", "th", F.col("r.a").alias("start_word"), F.col("r.b").alias("end_word"), "kept")


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    b = np.frombuffer(text, np.uint8)
    ink = np.concatenate([[False], ~((b == 32) | ((b >= 9) & (b <= 13))), [False]])
    edge = np.flatnonzero(ink[1:] != ink[:-1])
    return edge[::2], edge[1::2]


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (disjoint, rising) and the white space after them."""
    data = text.encode()
    start, _ = word_bounds(data)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : start[a]])
        at = start[b] if b < len(start) else len(data)
    return b"".join([*out, data[at:]]).decode()


def cut_repeats(df: DataFrame, id_col: str, text_col: str, chars_col: str | None = None, words: int = 50) -> DataFrame:
    """df with the redundant passages cut out of its texts, and chars_col, if given, set to the new length. A row of which no word is
    left is dropped; rows without redundant passages stay as they are, null texts too. Columns are df's own."""
    scratch = Scratch(df.sparkSession)
    spans = repeated_passages(df, id_col, text_col, words, scratch).where("NOT kept")
    per = scratch.save(spans.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("__spans")), "spans")
    names = [f"__c{i}" for i in range(len(df.columns))]  # whatever the columns are called
    at = {c: n for c, n in zip(df.columns, names, strict=True)}
    plain, text = df.toDF(*names), at[text_col]
    per = per.select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__spans")
    joined = plain.join(per, (F.xxhash64(F.col(text)) == F.col("__th")) & F.col(at[id_col]).eqNullSafe(F.col("__id")), "left").select(*names, "__spans")
    chars = chars_col and names.index(at[chars_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("__spans").to_pylist()
            texts = b.column(text).to_pylist()
            new = [t if s is None else cut_words(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(texts, spans, strict=True)]
            keep = pa.array([s is None or bool(t.strip()) for t, s in zip(new, spans, strict=True)])
            columns = list(b.columns[:-1])
            columns[names.index(text)] = pa.array(new, columns[names.index(text)].type)
            if chars is not None:
                old = columns[chars].to_pylist()
                columns[chars] = pa.array([o if s is None else len(t) for o, t, s in zip(old, new, spans, strict=True)], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, df.schema.fields, strict=True)])
    return joined.mapInArrow(run, schema).toDF(*df.columns)


def op3_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every passage of 50 words or more that repeats in the documents, in words."""
    out = repeated_passages(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "kept")
