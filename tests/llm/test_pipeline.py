import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from veilgrid.llm import registry, suffixes, toxicity

from .test_text_operators import brute_features, brute_spans, ids_of, linked


def test_stages_pass_documents_on(spark, tmp_path, documents):
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3 * i, i % 2, int(i == 4)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows.count()
        stage(spark, rows, str(tmp_path)).write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert rows.columns == docs.columns and 0 < rows.count() <= before
    assert {"doc_id", "sequence_id", "offset"} <= set(rows.columns)


def brute_pipeline(docs, model, hashes):
    """Pieces (doc_id, piece, start, length, ids_crc32) of (doc_id, text): scores, pairs of sets, windows and tokens, one by one."""
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    score = lambda t: 1 / (1 + np.exp(-sum(weights.get(f, 0.0) for f in brute_features(t)) - model.bias))
    docs = [d for d in docs if score(d[1]) < 0.3]
    sets, comp = linked(docs, 5, 80)
    first = {c: min(d[0] for d, x in zip(docs, comp, strict=True) if x == c) for c in comp}
    docs = [d for d, s, c in zip(docs, sets, comp, strict=True) if not s or d[0] == first[c]]
    gone = defaultdict(list)
    for i, t, a, b, kept in brute_spans(docs, 50, {d: (True, d[0], hashes.get(d[1])) for d in docs}):
        if not kept:
            gone[i, t].append((a, b))
    left = [(i, suffixes.cut_words(t, sorted(gone[i, t])) if gone[i, t] else t) for i, t in docs]
    out = Counter()
    for i, t in left:
        if not (t or "").split() and gone[i, dict(docs)[i]]:
            continue  # nothing is left of it
        ids = [*ids_of(t), 1]
        for p in range(-(-len(ids) // 4096)):
            part = ids[4096 * p : 4096 * p + 4096]
            out[i, p, 4096 * p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out, len(docs)


def test_run_equals_brute_force(spark, tmp_path, documents):
    """All four stages at once: toxic texts, near copies and repeated passages go, all else is packed whole."""
    nasty = [(1000 + i, f"{'nasty ' * (i % 2)}plain words number {i} of the day and w{i * 7}", "de", "s", 1) for i in range(200)]
    docs = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(nasty, "doc_id long, text string, lang string, source string, n_chars int"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(160)] + [(3 * i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs, labels = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    model = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id")), "doc_id", "text", "toxic")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    want, kept = brute_pipeline(rows, model, hashes)
    assert 100 < kept < len(rows) - 90
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all() and got.groupby("sequence_id").length.sum().max() <= 4096


def test_queries_are_registered():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "suffix_dedup", "packing"]
