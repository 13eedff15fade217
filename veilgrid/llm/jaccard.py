"""Joins of texts by the Jaccard similarity of their word shingles: grouped prefix join, and its components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .common import Scratch, blocks, components

#: Frequent shingles that are ordered by their counts, at most; all others come before them, in order of their hashes.
HOT_SHINGLES = 1 << 18
#: A shingle in the prefixes of more groups than this joins the frequent ones, and prefixes are made anew.
HEAVY_LIST = 4096
#: A list of more groups has four more pivots, other ones in every list, so that the links of a crowd soon hang together.
LONG_LIST = 32
#: Shingles that a task counts together (32 MB).
COUNTED = 1 << 22
#: Candidates' texts are found by a broadcast list of up to this many hashes (16 MB), else by a shuffled join.
BROADCAST_ROWS = 2_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _string_hashes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of strings, and their lengths in bytes: polynomials in a fixed odd base, taken from one running sum over all bytes."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(ends)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max(initial=0)) + 1, _ODD))
        place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[place])])
        h = total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]
        h = (h ^ (h >> np.uint64(31)) ^ size.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29)), size


def word_hashes(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space; A-Z lower-cased), and each text's bounds in them."""
    text = text.cast(pa.string()).fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    coded = lists.flatten().dictionary_encode()
    if not len(coded):
        return np.zeros(0, np.uint64), np.zeros(len(text) + 1, np.int64)
    own, size = _string_hashes(coded.dictionary)
    index = coded.indices.to_numpy()
    word = size[index] > 0  # white space at an end of a text leaves an empty piece
    ends = np.concatenate([[0], np.cumsum(word)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])]
    return own[index[word]], ends


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k values; a run over a text's end is the caller's to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(k))
        for i in range(k):
            out = (out ^ h[i : i + n]) * _ODD
            out ^= out >> np.uint64(32)
    return out


def shingle_sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's set of hashed k-word shingles, rising; with fewer words the whole sequence is the only one, without words there is none."""
    h, ends = word_hashes(text)
    runs = window_hashes(h, k)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield np.unique(runs[a : b - k + 1]) if b - a >= k else window_hashes(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def _frequent(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the shingles that a task meets twice among COUNTED in a row (a lossy count over all texts). They only order
    prefixes, so it does no harm that a text may count twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = np.empty(COUNTED, np.uint64)
        keys, counts, held = [], [], 0

        def fold(x: np.ndarray) -> None:
            x.sort()
            token, n = np.unique(x[1:][x[1:] == x[:-1]], return_counts=True)  # all but the first of equals
            keys.append(token)
            counts.append(n + 1)

        for b in blocks(batches, "text"):
            h, ends = word_hashes(b.column("text"))
            runs = window_hashes(h, k)
            whole = np.ones(len(runs), bool)
            for i in range(1, k):  # runs that cross the end of a text are none
                at = ends[1:-1] - i
                whole[at[(at >= 0) & (at < len(runs))]] = False
            runs = runs[whole]
            while len(runs):
                some = runs[: COUNTED - held]
                room[held : held + len(some)] = some
                held, runs = held + len(some), runs[len(some) :]
                if held == COUNTED:
                    fold(room)
                    held = 0
                    keys, counts = ([x] for x in _summed(keys, counts))
        fold(room[:held])
        token, n = _summed(keys, counts)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    return run


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    token, place = np.unique(np.concatenate(keys), return_inverse=True)
    return token, np.bincount(place, np.concatenate(counts), len(token)).astype(np.int64)


def _prefixed(k: int, percent: int, hot) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to rows of their sets: size, set and group hash, parity sketch, and the prefix where a task meets the set first.

    Two sets of n and m shingles with a similarity of t share t * n at least, so the first n - ceil(t * n) + 1 of each, in one
    order over all texts, have a shingle in common. Rare ones come first in the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = hot.value
        seen: set[int] = set()
        for b in blocks(batches, "text"):
            out: dict[str, list] = {c: [] for c in ("n", "node", "grp", "s0", "s1", "s2", "s3", "wide", "prefix")}
            for s in shingle_sets(b.column("text"), k):
                n = len(s)
                out["n"].append(n)
                if not n:
                    for c in list(out)[1:]:
                        out[c].append(None)
                    continue
                node = xxhash.xxh3_64_intdigest(s.tobytes())
                head = s
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    often = np.where(keys[at] == s, counts[at], 0)
                    if often.any():
                        head = s[np.lexsort((s, often))]
                head = head[: n - (percent * n + 99) // 100 + 1]
                row = (node - (1 << 63), xxhash.xxh3_64_intdigest(np.sort(head).tobytes(), seed=n) - (1 << 63), *_parity(s, 256).tolist(), _parity(s, max(256, 1 << int(n - 1).bit_length())))
                for c, v in zip(list(out)[1:-1], row, strict=True):
                    out[c].append(v)
                out["prefix"].append(None if node in seen else head.view(np.int64))
                if len(seen) < 1_000_000:
                    seen.add(node)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("th"), pa.array(out["n"], pa.int64()), *(pa.array(out[c], pa.int64()) for c in ("node", "grp", "s0", "s1", "s2", "s3")), *(pa.array(out[c], pa.list_(pa.int64())) for c in ("wide", "prefix"))],
                ["id", "th", "n", "node", "grp", "s0", "s1", "s2", "s3", "wide", "prefix"],
            )

    return run


def _parity(s: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each rest of the hashes on division by `bits`, a power of two: whether an odd number of them has it."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _most_apart(percent: int, a: str, b: str) -> str:
    """SQL: in how many shingles two sets as similar as asked differ at most."""
    total = f"({a}.n + {b}.n)"
    return f"({total} - 2 * (({percent} * {total} + {99 + percent}) div {100 + percent}))"


def _within(percent: int, a: str, b: str) -> Column:
    """Whether sizes and sketches leave it open that the sets a and b are as similar as asked. No similar pair is lost: a
    parity sketch differs in no more bits than the sets do in shingles. Null sketches leave everything open."""
    most = _most_apart(percent, a, b)
    bits = " + ".join(f"bit_count({a}.s{i} ^ {b}.s{i})" for i in range(4))
    return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND coalesce({bits} <= {most}, true)")


def _in_time(percent: int, a: str, b: str) -> Column:
    """Whether what two prefixes leave from a common token on can hold as many shingles as similar sets share. At the first token that they have
    in common it does, for every similar pair; so each pair passes there, and at later tokens only where they stand early."""
    total = f"({a}.n + {b}.n)"
    return F.expr(f"least({a}.n - {a}.pos, {b}.n - {b}.pos) >= ({percent} * {total} + {99 + percent}) div {100 + percent}")


def _within_wide(percent: int) -> Column:
    """The same as _within for rows x and y of nodes, by sketches with about a bit for each shingle; the longer one is folded to the other's length."""
    half = "least(size(x.wide), size(y.wide))"
    fold = lambda a: f"CASE WHEN size({a}.wide) > {half} THEN zip_with(slice({a}.wide, 1, {half}), slice({a}.wide, {half} + 1, {half}), (p, q) -> p ^ q) ELSE {a}.wide END"
    return F.expr(f"aggregate(zip_with({fold('x')}, {fold('y')}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v) <= {_most_apart(percent, 'x', 'y')}")


def _sets(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies of a text that one task meets
        for b in blocks(batches, "text"):
            node = b.column("node").to_pylist()
            new = [len(seen) >= 1_000_000 or not (x in seen or seen.add(x)) for x in node]
            b = b.filter(pa.array(new, pa.bool_()))
            sets = [s.view(np.int64) for s in shingle_sets(b.column("text"), k)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def _verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets, made anew from their texts, are as similar as asked."""
    x, y = (nodes.select("node", "n", "wide").alias(c) for c in "xy")
    near = pairs.alias("p").join(x, F.expr("p.a = x.node")).join(y, F.expr("p.b = y.node") & _within_wide(percent))
    pairs = scratch.save(near.select("p.a", "p.b"), f"{name}-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = scratch.save(nodes.join(ends, "node", "left_semi").select("node", F.col("th").alias("__th")), f"{name}-wanted")
    n = wanted.count()
    few = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
    texts = rows.join(few, rows.th == few["__th"]).select("node", "text")
    sets = scratch.save(texts.mapInArrow(_sets(k), "node long, shingles array<long>").dropDuplicates(["node"]) if n else texts.select("node", F.lit(None).cast("array<long>").alias("shingles")).limit(0), f"{name}-sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("t"))
    out = scratch.save(common.where(f"100 * c >= {percent} * (t - c)").select("a", "b"), f"{name}-links")
    for part in ("sets", "wanted", "pairs"):
        scratch.drop(f"{name}-{part}")
    return out


def similar_texts(df: DataFrame, id_col: str, text_col: str, k: int, percent: int, scratch: Scratch | None = None) -> DataFrame:
    """One row for each row of df: id, th (hash of its text), n_shingles, component (a long, null without shingles).

    Texts whose k-word shingle sets have a Jaccard similarity of `percent` / 100 or more are linked; components are exact.

    1. Equal sets are one node; nodes of equal prefix and size are one group.
    2. Groups that share a shingle of their prefixes meet in its list. Only tokens that several groups have go on, and of tokens with
       the same groups only the first in the order of shingles: it is the first of them for each group, so no pair is lost.
    3. First, each group of a list is held against two pivots of the list only (six, in a long list), a number linear in the
       list. Links that are verified join nodes to components.
    4. Then all pairs of groups of a list are filtered by size, place (see _in_time) and sketch, without those that a component joins
       already. What passes is expanded to members, filtered by their sketches, and verified on whole sets.
    So all links between different components are tested; links within one are tested until it is known to hang together.

    A null or empty text, or one of white space, has no shingles and links with nothing. Null and repeated ids are rows like any
    other. Sets and groups are told apart by 64-bit hashes. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    counted = rows.select("text").mapInArrow(_frequent(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequent = counted.orderBy(F.desc("n"), "token").limit(HOT_SHINGLES).toArrow()
    hot = frequent.column("token").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    for attempt in range(3):
        order = np.argsort(hot[0])
        sent = spark.sparkContext.broadcast((hot[0][order], hot[1][order]))
        made = scratch.save(rows.select("id", "th", "text").mapInArrow(_prefixed(k, percent, sent), f"id {id_type}, th long, n long, node long, grp long, s0 long, s1 long, s2 long, s3 long, wide array<long>, prefix array<long>"), f"rows{attempt}")
        tokens = made.where("prefix IS NOT NULL").select(F.posexplode("prefix").alias("pos", "token"), "grp")
        own = Window.partitionBy("token")
        met = tokens.repartition("token").groupBy("token", "grp").agg(F.min("pos").alias("pos"))  # all of a token in one shuffle
        met = met.select("*", F.count(F.lit(1)).over(own).alias("size"), *(F.bit_xor(F.xxhash64(F.lit(i), "grp")).over(own).alias(f"x{i}") for i in range(2)))
        shared = scratch.save(met.where("size > 1"), f"shared{attempt}")
        heavy = shared.where(F.col("size") > HEAVY_LIST).select("token", "size").distinct().orderBy(F.desc("size"), "token").limit(HOT_SHINGLES).toArrow()
        more, size = heavy.column("token").to_numpy().view(np.uint64), heavy.column("size").to_numpy()
        new = ~np.isin(more, hot[0])
        if attempt == 2 or not new.any():
            break
        for part in ("rows", "shared"):
            scratch.drop(f"{part}{attempt}")
        hot = np.concatenate([more[new], hot[0]])[:HOT_SHINGLES], np.concatenate([size[new], hot[1]])[:HOT_SHINGLES]

    sketch = ["s0", "s1", "s2", "s3"]
    nodes = scratch.save(made.where("node IS NOT NULL").groupBy("node").agg(F.min("th").alias("th"), *(F.first(c).alias(c) for c in ("n", "grp", *sketch, "wide"))), "nodes")
    told = scratch.save(made.select("id", "th", F.col("n").alias("n_shingles"), "node"), "ids")
    hits = shared.groupBy("size", "x0", "x1", "grp").agg(F.min(F.struct("pos", "token")).alias("t")).select("grp", "t.token", "t.pos")
    groups = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("chief"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in sketch))
    alone = F.col("members") == 1
    groups = scratch.save(groups.select("grp", "chief", "members", "n", *(F.when(alone, F.col(c)).alias(c) for c in sketch)), "groups")
    lists = scratch.save(hits.join(groups, "grp"), "lists")
    for part in ("rows", "shared"):
        scratch.drop(f"{part}{attempt}")

    # each group against the pivots of each list, and the members of a group against its chief
    def pivot(name: str, *seed: Column | int) -> Column:
        return F.min(F.struct(F.xxhash64(*(F.lit(x) if isinstance(x, int) else x for x in seed), "chief").alias("h"), "grp", "chief", "n", *sketch)).alias(name)

    two, more = ["p1", "p2"], ["p3", "p4", "p5", "p6"]
    chosen = lists.groupBy("token").agg(*(pivot(p, i) for i, p in enumerate(two)), *(pivot(p, i, F.col("token")) for i, p in enumerate(more)), F.count(F.lit(1)).alias("size"))
    taken = F.when(F.col("size") > LONG_LIST, F.array(*two, *more)).otherwise(F.array(*two))
    pivots = chosen.select("token", F.explode(taken).alias("p")).select("token", F.col("p.grp").alias("pgrp"), F.col("p.chief").alias("pchief"), *(F.col(f"p.{c}").alias(c) for c in ("n", *sketch)))
    against = lists.alias("x").join(pivots.alias("y"), (F.col("x.token") == F.col("y.token")) & F.expr("x.grp <> y.pgrp") & _within(percent, "x", "y"))
    against = against.select(F.col("x.grp").alias("grp"), F.col("y.pchief").alias("chief")).distinct()
    inside = groups.where(~alone).select("grp", "chief")
    members = nodes.select("grp", "node", "n", *sketch)
    chiefs = nodes.select(F.col("node").alias("chief"), "n", *sketch)
    first = against.union(inside).join(members, "grp").alias("x").join(chiefs.alias("y"), (F.col("x.chief") == F.col("y.chief")) & F.expr("x.node <> y.chief") & _within(percent, "x", "y"))
    first = first.select(F.greatest("x.node", "y.chief").alias("a"), F.least("x.node", "y.chief").alias("b")).distinct()
    links = _verified(rows, nodes, first, k, percent, scratch, "first")
    comps = components(spark, links, scratch, "near")

    # what no component joins yet
    placed = scratch.save(nodes.join(comps.withColumnRenamed("id", "node"), "node", "left").select("node", "grp", "n", *sketch, F.coalesce("component", "node").alias("comp")), "placed")
    one = placed.groupBy("grp").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).select("grp", F.when(F.col("c0") == F.col("c1"), F.col("c0")).alias("comp"))
    known = scratch.save(lists.join(one, "grp"), "known")
    open_lists = known.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count_if(F.col("comp").isNull()).alias("mixed")).where("c0 <> c1 OR mixed > 0").select("token")
    still = known.join(open_lists, "token").select("token", "grp", "comp", "pos", "n", *sketch)
    pairs = still.alias("x").join(still.alias("y"), (F.col("x.token") == F.col("y.token")) & F.expr("x.grp < y.grp") & ~F.coalesce(F.col("x.comp") == F.col("y.comp"), F.lit(False)) & _in_time(percent, "x", "y") & _within(percent, "x", "y"))
    pairs = pairs.select(F.col("x.grp").alias("g"), F.col("y.grp").alias("h")).distinct()
    pairs = pairs.union(one.where("comp IS NULL").select(F.col("grp").alias("g"), F.col("grp").alias("h")))
    left, right = placed.select(F.col("grp").alias("g"), "node", "comp", "n", *sketch), placed.select(F.col("grp").alias("h"), "node", "comp", "n", *sketch)
    rest = pairs.join(left, "g").select("h", "node", "comp", "n", *sketch).alias("x").join(right.alias("y"), (F.col("x.h") == F.col("y.h")) & F.expr("x.comp <> y.comp") & _within(percent, "x", "y"))
    rest = rest.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    late = _verified(rows, nodes, rest, k, percent, scratch, "rest")
    comps = components(spark, links.union(late), scratch, "all")

    for part in ("nodes", "groups", "lists", "placed", "known"):
        scratch.drop(part)
    out = told.join(comps.withColumnRenamed("id", "__node"), told.node == F.col("__node"), "left")
    return out.select("id", "th", "n_shingles", F.coalesce("component", "node").alias("component"))


def keep_one(df: DataFrame, id_col: str, text_col: str, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df, of each component of similar texts only the one with the smallest id (nulls last, then by the text's
    hash); texts without shingles all stay. Of rows alike in id and text one stays. Columns are df's own."""
    scratch = Scratch(df.sparkSession)
    told = scratch.save(similar_texts(df, id_col, text_col, k, percent, scratch), "told")
    best = told.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "th")).alias("m"), F.count(F.lit(1)).alias("rows"))
    best = best.select(F.col("m.id").alias("__id"), F.col("m.th").alias("__th"), "rows")
    again = told.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    names = [f"__c{i}" for i in range(len(df.columns))]  # whatever the columns are called
    plain = df.toDF(*names)
    at = {c: n for c, n in zip(df.columns, names, strict=True)}
    th = F.xxhash64(F.col(at[text_col]))
    void = told.where("component IS NULL").select(F.col("id").alias("__id"), F.col("th").alias("__th")).distinct()
    kept = best.select("__id", "__th").union(void)
    out = plain.join(kept, (th == F.col("__th")) & F.col(at[id_col]).eqNullSafe(F.col("__id"))).select(*names)
    if again:
        out = out.withColumn("__void", F.coalesce(F.length(F.regexp_replace(F.col(at[text_col]), "[ \\t\\n\\x0B\\f\\r]", "")), F.lit(0)) == 0)
        out = out.where("NOT __void").dropDuplicates([at[id_col], at[text_col]]).union(out.where("__void")).drop("__void")
    return out.toDF(*df.columns)


def op10_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and components of all documents, for 4 words and a similarity of 0.85."""
    scratch = Scratch(spark)
    told = scratch.save(similar_texts(table(spark, sf_dir, "documents"), "doc_id", "text", 4, 85, scratch), "told")
    least = told.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("least")).withColumnRenamed("component", "__c")
    out = told.join(least, F.col("component") == F.col("__c"), "left")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("least", "id").alias("component_id"))
