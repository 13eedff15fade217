import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgrid.llm import ann, embed_dedup, vectors
from veilgrid.llm.vectors import Graph, kmeans, squared, unit


def made_vectors(n=900, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.1, 9, (n, 1))
    for i in range(0, n - 5, 6):  # near copies, and exact ones
        x[i + 1] = x[i] + rng.normal(size=dim) * np.linalg.norm(x[i]) * 0.05
        x[i + 2] = x[i] * 3
    for i in range(1, 40):
        x[i * 20] = x[20]
    return x


def vector_rows(n=900):
    x = made_vectors(n)
    rows = [(i, [float(v) for v in x[i]], i % 3 if i % 11 else None) for i in range(n)]
    return rows + [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [float("inf")] + [1.0] * 15, 1), (n + 4, [1.0, None] + [0.0] * 14, 1), (n + 5, [1.0, 2.0], 1), (n + 6, [], 1)]


SCHEMA = "vec_id long, embedding array<double>, label int"


def cos(a, b):
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_graph_finds_near_centroids():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(500, 16))
    x = rng.normal(size=(300, 16))
    found, far = Graph.build(c).search(x, 8)
    true = np.argsort(squared(x, c), 1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(found, true, strict=True)]) > 0.9
    assert (np.diff(far, axis=1) >= 0).all()
    assert Graph.build(c[:1]).search(x, 8)[0].tolist() == [[0]] * 300


def test_kmeans_is_balanced():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(900, 4)) * 0.05, rng.normal(size=(100, 4)) * 3])
    count = np.bincount(np.argmin(squared(x, kmeans(x, 20)), 1), minlength=20)
    assert count.max() < 400


def test_search_recall_and_order(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = ann.search(df, df.where("vec_id % 10 = 0"), "vec_id", "embedding", 5).toPandas()
    x = {i: np.array(v) for i, v, _ in rows[:900]}
    hits = total = 0
    for q in range(0, 900, 10):
        best = sorted((-round(cos(x[q], x[i]), 12), i) for i in x if i != q)[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1))
        assert (own.score.diff().dropna() <= 1e-12).all()
        assert all(abs(s - cos(x[q], x[i])) < 1e-12 for i, s in zip(own.vec_id, own.score, strict=True))
        hits += len({i for _, i in best} & set(own.vec_id))
        total += 5
    assert hits / total >= 0.9
    assert set(got.query_id) == set(range(0, 900, 10))


def test_search_of_little(spark):
    df = spark.createDataFrame(vector_rows()[:3], SCHEMA)
    assert ann.search(df, df, "vec_id", "embedding", 5).count() == 6
    none = spark.createDataFrame([], SCHEMA)
    assert ann.search(none, none, "vec_id", "embedding", 5).count() == 0
    assert ann.search(df, none, "vec_id", "embedding", 5).count() == 0


@pytest.mark.parametrize("probes", [48, 1])
def test_search_finds_k_from_lists_of_one_vector(spark, probes, monkeypatch):
    """Vectors that are their own centroids, at a distance of 0: as many rows as asked, and all rows searched where the lists hold too few."""
    monkeypatch.setattr(vectors, "PER_LIST", 2)
    monkeypatch.setattr(ann, "PROBES", probes)
    monkeypatch.setattr(ann, "REPLICAS", 1)
    x = np.random.default_rng(2).normal(size=(600, 32))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    got = ann.search(df, df.where("vec_id % 3 = 0"), "vec_id", "embedding", 5).toPandas()
    assert got.groupby("query_id")["rank"].apply(lambda r: sorted(r) == [1, 2, 3, 4, 5]).sum() == 200
    assert not (got.query_id == got.vec_id).any()
    assert all(abs(s - cos(x[q], x[v])) < 1e-12 for q, v, s in zip(got.query_id, got.vec_id, got.score, strict=True))
    if probes == 1:  # nearly all queries are short, and so exact
        s = unit(x[::3]) @ unit(x).T
        s[np.arange(200), np.arange(0, 600, 3)] = -2
        best = {(q * 3, v) for q, row in enumerate(np.argsort(-s, 1)[:, :5]) for v in row.tolist()}
        assert len(best & set(zip(got.query_id.tolist(), got.vec_id.tolist(), strict=True))) >= 900


@pytest.mark.parametrize("part", [2048, 16])
def test_near_duplicates(spark, part, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PART", part)
    rows = vector_rows()
    got = {r.id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding", "label", 0.93).collect()}
    u, label = unit(made_vectors()), np.array([i % 3 if i % 11 else -1 for i in range(900)])
    link = (u @ u.T >= 0.93) & (label[:, None] == label[None]) & (label >= 0)[:, None]
    np.fill_diagonal(link, False)
    comp = np.arange(900)
    while True:
        new = np.minimum(comp, np.where(link, comp[None], 10**9).min(1))
        if (new == comp).all():
            break
        comp = new
    assert len(got) == len(rows)
    assert [got[i].n_links for i in range(900)] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(900)] == comp.tolist()
    assert all(got[i].kept == (comp[i] == i) for i in range(900))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 907))


def test_pairs_at_the_bound_are_found():
    """Both vectors' lists among the other's 24 nearest: pairs at a cosine of 0.93, for a few and for many lists."""
    rng = np.random.default_rng(6)
    a = unit(rng.normal(size=(4000, 64)))
    u = rng.normal(size=a.shape)
    u = unit(u - (u * a).sum(1, keepdims=True) * a)
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * u
    for k in (4, 40, 160):
        c = kmeans(a, k)
        near = [np.argsort(squared(x, c), 1)[:, : embed_dedup.PROBES] for x in (a, b)]
        met = (near[0] == near[1][:, :1]).any(1) | (near[1] == near[0][:, :1]).any(1)
        assert met.mean() >= 0.999


def test_near_duplicates_of_a_crowd_over_many_lists(spark, monkeypatch):
    """A crowd of different near copies that spans hundreds of lists, beside vectors without clusters: no link is lost."""
    monkeypatch.setattr(embed_dedup, "PER_LIST", 5)
    monkeypatch.setattr(embed_dedup, "PART", 256)
    rng = np.random.default_rng(4)
    crowd = unit(rng.normal(size=(1, 64))) + rng.normal(size=(1500, 64)) * 0.27 / 8
    x = np.concatenate([crowd, rng.normal(size=(300, 64))])[rng.permutation(1800)]
    got = {r.id: r for r in embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA), "vec_id", "embedding", "label", 0.93).collect()}
    link = unit(x) @ unit(x).T >= 0.93
    np.fill_diagonal(link, False)
    assert link.sum() > 500_000
    assert [got[i].n_links for i in range(1800)] == link.sum(1).tolist()
    assert len({r.component_id for r in got.values()}) == 1800 - int((link.sum(1) > 0).sum()) + 1


def test_vectors_of_mixed_dimensions(spark):
    """Vectors of a rarer dimension link and are found among themselves as those of the most frequent one."""
    x = {i: np.random.default_rng(i % 40).normal(size=16 if i < 120 else 8 if i < 170 else 3) for i in range(171)}
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in x.items()], SCHEMA)
    got = {r.id: r for r in embed_dedup.near_duplicates(df, "vec_id", "embedding", "label", 0.93).collect()}
    near = {i: {j for j in x if j != i and len(x[j]) == len(x[i]) and cos(x[i], x[j]) >= 0.93} for i in x}
    assert near[120] and near[0] and not near[170]
    assert all(got[i].n_links == len(near[i]) and got[i].component_id == min({i, *near[i]}) for i in x)
    found = ann.search(df, df.where("vec_id % 10 = 0"), "vec_id", "embedding", 5).toPandas()
    assert found.groupby("query_id")["rank"].max().to_dict() == dict.fromkeys(range(0, 170, 10), 5)
    assert all(len(x[q]) == len(x[v]) and abs(s - cos(x[q], x[v])) < 1e-12 for q, v, s in zip(found.query_id, found.vec_id, found.score, strict=True))


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (7, [2.0, 0.0], 1), (5, [0.0, 1.0], 1), (3, [0.0, 3.0], 1), (9, None, 1), (9, [1.0, 1.0], 1), (None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("a")).withColumn("row", F.lit("b")).repartition(2)
    got = embed_dedup.near_duplicates(frame, "vec_id", "embedding", "label", 0.93).collect()
    want = [(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (5, 1, 3, False), (3, 1, 3, True), (9, 0, 9, True), (9, 0, 9, True), (None, 0, None, True), (None, 0, None, True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_no_vectors(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", "label", 0.93).count() == 0
    one = embed_dedup.near_duplicates(spark.createDataFrame([(4, None, None)], SCHEMA), "vec_id", "embedding", "label", 0.93).collect()
    assert [tuple(r) for r in one] == [(4, 0, 4, True)]
