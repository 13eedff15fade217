import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilgrid.llm import bpe, common, jaccard, packing, shards, suffixes, toxicity, training_order, warc
from veilgrid.llm.common import Scratch, components

PATH = bpe.default_tokenizer()
TOK = Tokenizer.from_file(PATH)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def bag(rows):
    return Counter(tuple(r) for r in rows)


# packing ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("counts", [{}, {5: 3}, {10: 2, 1: 1}, {6: 3, 4: 2, 3: 4, 1: 2}, {7: 50, 3: 49, 2: 10, 5: 7}, {4: 9, 3: 9, 2: 9, 1: 9}])
def test_plan_packs_every_item_once(counts):
    runs = packing.plan(counts, 10)
    used = Counter()
    for sizes, times in runs:
        assert 0 < sum(sizes) <= 10
        for s in sizes:
            used[s] += times
    assert used == Counter(counts)
    assert sum(t for _, t in runs) >= -(-sum(s * c for s, c in counts.items()) // 10)


def best(items, capacity):
    """Fewest sequences, by trying all."""
    found = [len(items)]

    def put(i, left):
        if len(left) >= found[0]:
            return
        if i == len(items):
            found[0] = len(left)
            return
        for j in {x: j for j, x in enumerate(left)}.values():
            if left[j] >= items[i]:
                put(i + 1, [*left[:j], left[j] - items[i], *left[j + 1 :]])
        put(i + 1, [*left, capacity - items[i]])

    put(0, [])
    return found[0]


def test_dominance_keeps_the_optimum():
    rng = np.random.default_rng(3)
    for _ in range(60):
        items = sorted(rng.integers(1, 21, rng.integers(1, 9)).tolist(), reverse=True)
        bag_ = packing._Bag(Counter(items))
        fixed, left = 0, Counter(items)
        for j in sorted(set(items), reverse=True):
            while left[j] and (dom := packing._dominating(bag_, j, 20)):
                bag_.take(dom, 1)
                left -= dom
                fixed += 1
        assert fixed + (best(sorted(left.elements(), reverse=True), 20) if left else 0) == best(items, 20)


def test_packing_round_trip(documents, rows):
    got = packing.pack_texts(documents, "doc_id", "text", PATH, 256, 1).toPandas()
    want = Counter()
    for r in rows:
        ids = [*ids_of(r[1]), 1]
        for p in range(-(-len(ids) // 256)):
            part = ids[256 * p : 256 * p + 256]
            want[(r[0], p, 256 * p, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((None if k != k else int(k), *rest) for k, *rest in got[["key", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all()
    assert got.groupby("sequence_id").length.sum().max() <= 256


def test_packing_of_nothing(no_documents):
    assert packing.pack_texts(no_documents, "doc_id", "text", PATH, 256, 1).count() == 0


# tokens ----------------------------------------------------------------------------------------------------------


def test_encoding_is_the_library_s(rows):
    odd = ["ΑΣ ΣΑΣ", "a\x1cc\x85d e", "''s !!'s 'S", "a_b __ _x", "ẞ ŉ ǅ ﬁ ª º µ", "🙂🙂 ok\x00z", "İ'ı", "x" * 3000, " ́a", "<|startoftext|><|EndOfText|>"]
    texts = [r[1] for r in rows] + odd
    ids, ends = bpe.encode_column(pa.array(texts), PATH)
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == ids_of(t), t


def test_word_table(documents, rows):
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    got = bpe.encode_distinct(documents, "doc_id", "text", PATH, bpe.digests(PATH), schema, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string", buckets=7, block_bytes=500)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(r[0], len(i := ids_of(r[1])), sha(" ".join(map(str, i))), sha(TOK.decode(i, skip_special_tokens=False))) for r in rows]
    assert bag(got.collect()) == bag(want)


def test_word_table_of_nothing(no_documents):
    schema = pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    assert bpe.encode_distinct(no_documents, "doc_id", "text", PATH, bpe.digests(PATH), schema, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").count() == 0


def test_decoding(spark):
    df = spark.createDataFrame([(1, ids_of("hello worlds, it's")), (2, []), (3, None)], "k int, ids array<int>")
    got = {r.k: r.text for r in bpe.decode_ids(df, "ids", PATH, "text").collect()}
    assert got == {1: TOK.decode(ids_of("hello worlds, it's"), skip_special_tokens=False), 2: "", 3: None}


# training order --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 5000])
def test_permutation_is_a_bijection(n):
    a, b = (training_order.permute(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a.tolist()) == list(range(n))
    assert n < 50 or (a != b).any()


def test_training_order_round_trip(spark, documents, rows, tmp_path):
    out = str(tmp_path / "order")
    run = lambda: training_order.materialise(documents, "doc_id", "text", PATH, out, key=5, stride=32, per_shard=64).toPandas()
    got = run()
    want = Counter((r[0], p) for r in rows for p in range(-(-(len(ids_of(r[1])) + 1) // 32)))
    assert Counter((None if k != k else int(k), p) for k, p in zip(got.key, got.piece, strict=True)) == want
    assert sorted(got.slot) == list(range(len(got)))
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append([*ids_of(r[1]), 49407])
    for x in got.sample(40, random_state=1).itertuples():
        seq = training_order.read_slots(out, x.slot, 1)[0].tolist()
        assert zlib.crc32(np.array(seq, "<u4").tobytes()) == x.ids_crc32
        key = None if x.key != x.key else int(x.key)
        assert any(ids[32 * x.piece : 32 * x.piece + 32] == seq for ids in by_id[key])
    first = (tmp_path / "order" / "00000000.bin").stat()
    assert bag(run().itertuples(index=False)) == bag(got.itertuples(index=False)) or got.key.isna().any()
    assert (tmp_path / "order" / "00000000.bin").stat().st_mtime_ns == first.st_mtime_ns  # a shard that is there is left alone


def test_training_order_of_nothing(no_documents, tmp_path):
    assert training_order.materialise(no_documents, "doc_id", "text", PATH, str(tmp_path / "o"), key=5).count() == 0


# shards ----------------------------------------------------------------------------------------------------------


def test_interleaving(documents, rows):
    got = shards.interleave(documents, 8, "doc_id", "text", "source").toPandas()
    want = Counter((r[0], r[3], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((None if i != i else int(i), s, a, b) for i, s, a, b in zip(got.id, got.stratum, got["size"], got.text_crc32, strict=True)) == want
    sizes = got.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    mix = got.groupby(["shard", got.stratum.fillna("-")]).size().unstack(fill_value=0)
    share = got.stratum.fillna("-").value_counts() / 8
    assert ((mix - share[mix.columns]).abs() < 2.01).all().all()


def test_interleaving_of_nothing_and_of_few(no_documents, documents):
    assert shards.interleave(no_documents, 8, "doc_id", "text", "source").count() == 0
    few = shards.interleave(documents.where("doc_id < 9"), 40, "doc_id", "text", "source").collect()
    assert len({r.shard for r in few}) == len(few)


def test_written_shards(documents, tmp_path, spark):
    own = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    shards.write_shards(own, shards.interleave(own, 4, "doc_id", "text", "source"), "doc_id", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == own.count()
    with pytest.raises(ValueError, match="repeats"):
        shards.write_shards(documents, shards.interleave(documents, 4, "doc_id", "text", "source"), "doc_id", str(tmp_path / "t"))


# components, joins -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("alone", [400_000, 0])
def test_components(spark, alone, monkeypatch):
    monkeypatch.setattr(common, "TASK_EDGES", alone)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2050)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect()
    assert dict(got) == {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert components(spark, spark.createDataFrame([], "a long, b long"), Scratch(spark), "e").count() == 0


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(rows, k, percent):
    sets = [shingles(r[1], k) for r in rows]
    comp = list(range(len(rows)))

    def find(v):
        while comp[v] != v:
            v = comp[v]
        return v

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_similar_texts(documents, rows, k, percent):
    sets, comp = linked(rows, k, percent)
    got = jaccard.similar_texts(documents, "doc_id", "text", k, percent).toPandas()
    assert sorted(got.n_shingles) == sorted(map(len, sets))
    want = defaultdict(list)
    for r, s, c in zip(rows, sets, comp, strict=True):
        want[c if s else ("void", r[1])].append((r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    hashes = {t: h for t, h in documents.select("text", F.xxhash64("text")).distinct().collect()}
    have = defaultdict(list)
    text_of = {h: t for t, h in hashes.items()}
    for i, th, c in zip(got.id, got.th, got.component, strict=True):
        i, t = None if i != i else int(i), text_of[th]
        have[("void", t) if c != c or c is None else c].append((i is None, i or 0, t is None, t or ""))
    assert sorted(sorted(v) for v in want.values()) == sorted(sorted(v) for v in have.values())


def test_every_link_counts_in_a_crowd(spark):
    """Near copies by the hundred, and a common line in texts that are otherwise different."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        t = base.copy()
        for p in rng.integers(0, 60, rng.integers(0, 4)):
            t[p] = f"e{rng.integers(0, 30)}"
        texts.append(" ".join(t))
    texts += [" ".join([*(f"u{i}x{j}" for j in range(20)), *base[:30]]) for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    _, comp = linked(rows, 4, 85)
    got = jaccard.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text", 4, 85).toPandas()
    first = got.groupby("component").id.transform("min")
    assert dict(zip(got.id, first, strict=True)) == dict(enumerate(comp))


def test_keep_one(documents, rows):
    got = jaccard.keep_one(documents, "doc_id", "text")
    assert got.columns == documents.columns
    sets, comp = linked(rows, 5, 80)
    want = {}
    for r, s, c in zip(rows, sets, comp, strict=True):
        if s:
            want[c] = min(want.get(c, (True, 0)), (r[0] is None, r[0] or 0))
    kept = [(r.doc_id is None, r.doc_id or 0) for r in got.collect() if words_of(r.text)]
    assert sorted(kept) == sorted(want.values())
    assert sum(not words_of(r.text) for r in got.collect()) == sum(not s for s in sets)


def test_similar_texts_of_nothing(no_documents):
    assert jaccard.similar_texts(no_documents, "doc_id", "text", 4, 85).count() == 0
    assert jaccard.keep_one(no_documents, "doc_id", "text").count() == 0


# repeated passages -----------------------------------------------------------------------------------------------


def brute_spans(rows, words, order):
    places = defaultdict(list)
    for key in {(r[0], r[1]) for r in rows if r[1] is not None}:
        w = words_of(key[1])
        for p in range(len(w) - words + 1):
            places[tuple(w[p : p + words])].append((order[key], p, key))
    at = defaultdict(list)
    for v in places.values():
        for n, (_, p, key) in enumerate(sorted(v, key=lambda x: x[:2])):
            if len(v) > 1:
                at[(key, n == 0)].append(p)
    out = set()
    for (key, kept), ps in at.items():
        ps.sort()
        a, b = ps[0], ps[0] + words
        for p in ps[1:]:
            if p <= b:
                b = p + words
            else:
                out.add((*key, a, b, kept))
                a, b = p, p + words
        out.add((*key, a, b, kept))
    return out


@pytest.mark.parametrize(("words", "run"), [(50, 20_000), (15, 20_000), (15, 2)])
def test_repeated_passages(documents, rows, words, run, monkeypatch):
    monkeypatch.setattr(suffixes, "RUN", run)
    hashes = {t: h for t, h in documents.select("text", F.xxhash64("text")).distinct().collect()}
    order = {(r[0], r[1]): (r[0] is not None, r[0] or 0, hashes[r[1]]) for r in rows}
    text_of = {h: t for t, h in hashes.items()}
    got = {(r.id, text_of[r.th], r.start_word, r.end_word, r.kept) for r in suffixes.repeated_passages(documents, "doc_id", "text", words).collect()}
    assert got == brute_spans(rows, words, order)


def test_cut_repeats(documents, rows):
    got = suffixes.cut_repeats(documents, "doc_id", "text", "n_chars", 50)
    assert got.columns == documents.columns
    out = got.collect()
    assert suffixes.repeated_passages(got.where("text IS NOT NULL").dropDuplicates(["doc_id", "text"]), "doc_id", "text", 50).where("NOT kept").count() == 0
    hashes = {t: h for t, h in documents.select("text", F.xxhash64("text")).distinct().collect()}
    order = {(r[0], r[1]): (r[0] is not None, r[0] or 0, hashes[r[1]]) for r in rows}
    gone = defaultdict(set)
    for i, t, a, b, kept in brute_spans(rows, 50, order):
        if not kept:
            gone[i, t] |= set(range(a, b))
    left = [[w for p, w in enumerate(words_of(r[1])) if p not in gone[r[0], r[1]]] for r in rows]
    want = Counter((r[0], tuple(w)) for r, w in zip(rows, left, strict=True) if w or not gone[r[0], r[1]])
    assert Counter((r.doc_id, tuple(words_of(r.text))) for r in out) == want
    assert all(r.n_chars == len(r.text) for r in out if r.text and r.doc_id in (126, 129))
    assert suffixes.cut_words("a  b c\nd", [(1, 3)]) == "a  d" and suffixes.cut_words("a b", [(0, 2)]) == ""


def test_passages_of_nothing(no_documents):
    assert suffixes.repeated_passages(no_documents, "doc_id", "text").count() == 0
    assert suffixes.cut_repeats(no_documents, "doc_id", "text").count() == 0


# toxicity --------------------------------------------------------------------------------------------------------


def toxic_documents(spark, n=500):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        t = rng.choice(words, rng.integers(5, 60)).tolist()
        bad = i % 5 == 0
        for _ in range(2 if bad else 0):
            t[rng.integers(0, len(t))] = f"nasty{rng.choice(['er', 'st', 'ly', 'ness'])}"
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(None, None), (n, ""), (n + 1, None)]
    labels += [(n, None), (None, 1), (3, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def brute_features(text):
    """All distinct features of a text, word by word."""
    full = 1 << 64

    def mixed(x, kind):
        return (((x ^ (x >> 29)) * (0x9E3779B97F4A7C15 + 2 * kind)) % full) >> 32

    out, words = set(), []
    for chunk in re.split(r"[ \t\n\v\f\r]+", text or ""):
        words += [(xxhash.xxh64_intdigest(w), xxhash.xxh64_intdigest(w[:5])) for w in re.findall(r"\w+", chunk.lower())]
    for i, (h, stem) in enumerate(words):
        out |= {mixed(h, 1), mixed(stem, 2)}
        if i >= 1:
            out.add(mixed((words[i - 1][0] * 31 + h) % full, 3))
        if i >= 2:
            out.add(mixed((words[i - 2][0] * 37 + h) % full, 4))
    return out


def test_features_equal_a_loop(rows):
    feature, row = toxicity._distinct(*toxicity.features(pa.array([r[1] for r in rows], pa.string())))
    got = defaultdict(set)
    for f, r in zip(feature.tolist(), row.tolist(), strict=True):
        got[r].add(f)
    assert [got[i] for i in range(len(rows))] == [brute_features(r[1]) for r in rows]


def brute_ftrl(rows, labels, least_df, passes, alpha, beta, l1, l2):
    """One coordinate after the other, in plain floats."""
    df = Counter(f for r in rows for f in r)
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if f != "bias" and abs(z[f]) <= l1:
            return 0.0
        pull = 0.0 if f == "bias" else math.copysign(l1, z[f])
        return (pull - z[f]) / ((beta + math.sqrt(n[f])) / alpha + (0.0 if f == "bias" else l2))

    for _ in range(passes):
        for r, y in zip(rows, labels, strict=True):
            some = ["bias"] + [f for f in r if df[f] >= least_df]
            w = {f: weight(f) for f in some}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for f in some:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    bias = weight("bias")
    return {f: weight(f) for f in list(z) if f != "bias" and weight(f)}, bias


@pytest.mark.parametrize(("l1", "l2"), [(1.0, 0.0), (0.5, 0.3), (4.0, 0.0)])
def test_ftrl_equals_a_loop(l1, l2):
    rng = np.random.default_rng(6)
    rows = [sorted(set(rng.integers(0, 60, rng.integers(0, 12)).tolist())) for _ in range(120)]
    labels = [int(any(f < 6 for f in r)) for r in rows]
    want, bias = brute_ftrl(rows, labels, 3, 4, 1.0, 1.0, l1, l2)
    model = toxicity.ftrl([np.array(r, np.uint32) for r in rows], np.array(labels, float), 3, 4, 1.0, 1.0, l1, l2)
    got = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    assert want and got.keys() == want.keys()
    assert all(abs(got[f] - want[f]) < 1e-9 for f in want) and abs(model.bias - bias) < 1e-9


def test_scores_equal_a_loop(spark, documents, rows):
    docs, labels = toxic_documents(spark)
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    texts = [r[1] for r in rows] + [r.text for r in docs.collect()]
    want = [1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in brute_features(t)) - model.bias)) for t in texts]
    assert np.allclose(model.score(pa.array(texts, pa.string())), want, atol=1e-12)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_documents(spark)
    model = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id")), "doc_id", "text", "toxic")
    got = {r.doc_id: r.score for r in toxicity.score(docs, "text", model).collect()}
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 80
    right = sum((got[i] >= toxicity.THRESHOLD) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 503
    assert len(model.keys) < 500


def test_toxicity_drops_rows_and_keeps_columns(spark):
    docs, labels = toxic_documents(spark)
    out = toxicity.drop_toxic(docs.withColumn("score", F.lit("own")).withColumn("__score", F.lit(1)), labels, "doc_id", "text", "toxic")
    assert out.columns == ["doc_id", "text", "score", "__score"]
    assert 380 <= out.count() <= 410


def test_toxicity_without_rows_or_labels(spark, no_documents, documents):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(documents, "text", toxicity.train(documents, none, "doc_id", "text", "toxic")).collect()} == {0.5}
    assert toxicity.drop_toxic(no_documents, none, "doc_id", "text", "toxic").count() == 0


# archives --------------------------------------------------------------------------------------------------------


PAGES = [(1, "http://a.de/ü b", "<p>ä</p>"), (2, None, "<p>ä</p>"), (3, "u\r\nX: y", None), (4, "u", ""), (None, "u", "<p>ä</p>"), (None, "u", "only null"), (None, "v", "only null"), (7, "u", "x" * 200_000), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 5")]


def test_archives_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    scratch = Scratch(spark)
    index = warc.archive_pages(df, "page_id", "url", "html", scratch)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    got = warc.read_members(index, scratch.root, warc.read_page, schema, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long").collect()
    last = {}
    for p, _, h in PAGES:
        if p is not None:
            last[h or ""] = max(last.get(h or "", p), p)
    want = []
    for p, _, h in PAGES:
        data = (h or "").encode()
        to = last.get(h or "")
        revisit = to is not None and p != to
        want.append((p, len(data), warc.payload_digest(data), "revisit" if revisit else "response", to if revisit else None))
    assert bag(got) == bag(want)
    assert index.count() == len(PAGES)


def test_members_stand_alone_and_make_one_stream(spark):
    df = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string").coalesce(1)
    scratch = Scratch(spark)
    for path, rows in __import__("itertools").groupby(sorted(warc.archive_pages(df, "page_id", "url", "html", scratch).collect(), key=lambda r: (r.path, r.offset)), key=lambda r: r.path):
        data = open(path, "rb").read()
        parts = [data[r.offset : r.offset + r.length] for r in rows]
        assert b"".join(parts) == data
        assert b"".join(gzip.decompress(p) for p in parts) == gzip.decompress(data)
        assert len(open(path + ".idx").readlines()) == len(parts)


def test_damaged_streams_fail():
    whole = gzip.compress(warc.record(1, "u", b"abc", 3, "D", None, "d"))
    import io

    assert len(list(warc.records(warc._inflated(io.BytesIO(whole + whole))))) == 2
    for bad in (whole[:-9], gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab"), gzip.compress(b"hello\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.records(warc._inflated(io.BytesIO(bad))))


def test_no_pages(spark):
    scratch = Scratch(spark)
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url", "html", scratch).count() == 0


def test_archives_of_a_hot_payload(spark):
    """A third of all pages share a payload; of the others every second has one copy. Extra columns have the operator's own names."""
    rows = [(i, f"http://x/{i}", "hot" if i % 3 == 0 else f"p{i // 6}-{i % 3}", "other", 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, n long").repartition(5)
    scratch = Scratch(spark)
    index = warc.archive_pages(df, "page_id", "url", "html", scratch)
    schema = warc.pa.schema([("page_id", warc.pa.int64()), ("payload_bytes", warc.pa.int64()), ("payload_digest", warc.pa.string()), ("record_type", warc.pa.string()), ("refers_to", warc.pa.int64())])
    got = warc.read_members(index, scratch.root, warc.read_page, schema, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long").collect()
    last = {}
    for i, _, html, *_ in rows:
        last[html] = max(i, last.get(html, i))
    want = {(i, len(html), warc.payload_digest(html.encode()), "response" if last[html] == i else "revisit", None if last[html] == i else last[html]) for i, _, html, *_ in rows}
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
