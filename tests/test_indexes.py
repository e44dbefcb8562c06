import numpy as np
import pytest

from vexil.indexes import HybridIndex, Options, RefineIndex, load_index, make_index, open_index, preset, rebuild
from vexil.operators.lists import Model, chosen_lists
from vexil.types import IndexType, Metric, PQDistance

N, DIM, K = 3000, 16, 10


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, DIM)) * 3
    x = (centers[rng.integers(0, 30, N)] + rng.normal(size=(N, DIM))).astype(np.float32).astype(np.float64)  # as rows are kept
    rows = spark.createDataFrame([(v.tolist(), int(i % 5)) for i, v in enumerate(x)], "vector array<float>, kind long").cache()
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "qid long, vector array<double>").cache()
    return rows, asked, x


def truth(x, q, metric, ok=None):
    if metric == Metric.COSINE:
        x, q = (v / np.sqrt((v * v).sum(axis=1, keepdims=True)) for v in (x, q))
    d = -(q @ x.T) if metric == Metric.INNER_PRODUCT else ((q[:, None] - x[None]) ** 2).sum(axis=2)
    if ok is not None:
        d[:, ~ok] = np.inf
    return [set(np.argsort(r, kind="stable")[:K].tolist()) for r in d]


def recall(hits, want):
    got = {}
    for r in hits.collect():
        got.setdefault(r["qid"], set()).add(r["id"])
    return np.mean([len(got.get(i, set()) & w) / K for i, w in enumerate(want)])


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize(
    ("options", "least"),
    [({}, 0.99), ({"ivf_sq_bits": 8}, 0.95), ({"ivf_sq_bits": 4}, 0.5), ({"pq_subspaces": 8, "pq_rotate": True}, 0.4), ({"pq_subspaces": 8, "pq_fast_scan": True}, 0.2)],
)
def test_ivf(spark, vectors, metric, options, least):
    rows, asked, x = vectors
    index = make_index(spark, "ivf", DIM, metric=metric, nprobe=60, **options)
    with pytest.raises(RuntimeError):
        index.add(rows)
    index.train(rows)
    with pytest.raises(RuntimeError):
        index.train(rows)
    index.add(rows)
    want = truth(x, x[:20], metric)
    assert recall(index.batch_query(asked, K), want) >= least
    filtered = index.batch_query(asked, K, "kind = 3").collect()
    assert len(filtered) == 20 * K and all(r["id"] % 5 == 3 for r in filtered)
    if not options:  # all lists read: the exact answer
        index.options.nprobe = 100
        assert recall(index.batch_query(asked, K), want) == 1


def test_pq_is_exact_for_decoded_rows(spark, vectors):
    """Distances by tables are those to the decoded rows, for both kinds of table and after rotation."""
    rows, asked, x = vectors
    index = make_index(spark, "ivf", DIM, nprobe=100, pq_subspaces=4, pq_centroids=16, pq_rotate=True)
    index.train(rows)
    index.add(rows)
    m = index.model
    held = index.collection.rows.orderBy("slot").select("__list", "__codes").toArrow()
    at = held.column(0).to_numpy()
    codes = m.unpacked(held.column(1).combine_chunks())
    near = m.centroids[at] + m.book.decode(codes) @ m.rotation.T
    for r in index.batch_query(asked, 3).collect():
        assert abs(r["distance"] - ((x[r["qid"]] - near[r["id"]]) ** 2).sum()) < 1e-6
    index.pq_distance = PQDistance.SDC
    assert index.pq_distance == PQDistance.SDC and index.batch_query(asked, 3).count() == 60


def test_hnsw(spark, vectors):
    rows, asked, x = vectors
    some = rows.limit(600)
    for options in ({}, {"hnsw_sq_bits": 8}):
        index = make_index(spark, "hnsw", DIM, ef_construction=40, **options)
        if options:
            index.train(some)
        index.add(some)
        want = truth(x[:600], x[:20], Metric.L2)
        assert recall(index.batch_query(asked, K), want) > 0.85
        index.remove([0, 1, 2])
        found = {r["id"] for r in index.batch_query(asked, K).collect()}
        assert not found & {0, 1, 2}
        index.add(some.limit(5))  # a second build
        assert {r["id"] for r in index.batch_query(asked.where("qid < 3"), 1).collect()} == {600, 601, 602}
        assert index.compact() == 3 and {r["id"] for r in index.batch_query(asked.where("qid < 3"), 1).collect()} == {600, 601, 602}
        few = index.batch_query(asked, K, "kind = 1").collect()
        assert few and all(r["id"] % 5 == 1 for r in few if r["id"] < 600)


def test_refine_and_files(spark, vectors, tmp_path):
    rows, asked, x = vectors
    base = make_index(spark, "ivf", DIM, nprobe=40, pq_subspaces=8, pq_fast_scan=True, metric="cosine")
    index = RefineIndex(base, 16)
    index.train(rows)
    index.add(rows)
    with pytest.raises(ValueError):
        base.add(rows)
    with pytest.raises(ValueError):
        RefineIndex(index)
    want = truth(x, x[:20], Metric.COSINE)
    assert recall(index.batch_query(asked, K), want) > 0.95
    few = index.batch_query(asked, K, "kind = 2")  # 600 rows of 100 lists: scored exactly
    assert recall(few, truth(x, x[:20], Metric.COSINE, np.arange(N) % 5 == 2)) == 1
    flat = make_index(spark, IndexType.FLAT, DIM, metric="cosine")
    assert rebuild(index, flat).count() == N and recall(flat.batch_query(asked, K), want) == 1
    path = str(tmp_path / "i")
    store = index.persist(path)
    store.add(rows.limit(1))
    again, store = open_index(spark, path)
    assert isinstance(again, RefineIndex) and again.size == N + 1 and again.k_factor == 16
    assert [tuple(r) for r in again.query(x[0].tolist(), 2).select("rank", "id").collect()] == [(1, 0), (2, N)]
    index.save(str(tmp_path / "j"))
    hits = lambda i: [(r["qid"], r["rank"], r["id"]) for r in i.batch_query(asked, K).orderBy("qid", "rank").collect()]
    assert hits(load_index(spark, str(tmp_path / "j"))) == hits(index)


def test_sparse_and_hybrid(spark, vectors):
    rng = np.random.default_rng(2)
    rows, asked, x = vectors
    terms = [[(int(t), float(rng.integers(1, 6))) for t in rng.choice(60, 6)] for _ in range(200)]
    data = spark.createDataFrame([(x[i].tolist(), terms[i]) for i in range(200)], "vector array<double>, terms array<struct<term:bigint,weight:double>>")
    ask = spark.createDataFrame([(i, x[i].tolist(), terms[i]) for i in range(5)], "qid bigint, vector array<double>, terms array<struct<term:bigint,weight:double>>")
    dense = np.zeros((200, 60))
    for i, row in enumerate(terms):
        for t, w in row:
            dense[i, t] += w
    index = make_index(spark, "sparse")
    index.add(data.select("terms"))
    product = dense[:5] @ dense.T
    for r in index.batch_query(ask, K).collect():
        assert r["distance"] == -product[r["qid"], r["id"]]
    approx = make_index(spark, "sparse_approx", query_terms=0, list_depth=0)
    approx.add(data.select("terms"))
    both = [[(r["qid"], r["rank"], r["id"]) for r in i.batch_query(ask, K).orderBy("qid", "rank").collect()] for i in (index, approx)]
    assert both[0] == both[1] and len(both[0]) == 50
    from vexil.indexes import FlatIndex

    hybrid = HybridIndex(FlatIndex(spark, DIM, Options(), sparse=True))
    hybrid.add(data)
    hits = hybrid.batch_query(ask, 3).collect()
    assert len(hits) == 15 and {(r["qid"], r["id"]) for r in hits if r["rank"] == 1} == {(i, i) for i in range(5)}
    labels = spark.createDataFrame([(i, i, 1.0) for i in range(5)], "qid long, id long, grade double")
    assert hybrid.tune_weights(ask, labels, 3, grid=[(1.0, 0.0), (0.0, 1.0)]) == (1.0, 0.0)
    with pytest.raises(ValueError):
        hybrid.dense.add(data)


def test_rules(spark, vectors):
    rows = vectors[0]
    for wrong in ({"nlist": 10}, {"ivf_sq_bits": 3}, {"ivf_sq_bits": 4, "pq_subspaces": 4}, {"pq_subspaces": 5}):
        with pytest.raises(ValueError):
            make_index(spark, "ivf", DIM, **wrong)
    with pytest.raises(ValueError):
        make_index(spark, "hnsw", DIM, hnsw_m=1)
    assert preset(spark, "flat", rows).kind == IndexType.FLAT and preset(spark, "ivf-pq", rows).base.options.pq_centroids == 16
    index = make_index(spark, "ivf", DIM)
    assert index.batch_query(vectors[1], K).count() == 0 and make_index(spark, "hnsw", DIM).batch_query(vectors[1], K).count() == 0


def test_lists_under_a_filter():
    m = Model(Metric.L2, np.arange(10.0)[:, None])
    here = np.array([0, 0, 3, 0, 4, 0, 0, 9, 0, 0])
    # two lists at least, then on until five allowed rows lie in the lists before
    assert sorted(chosen_lists(m, np.array([[0.0]]), 2, 5, here, 0, scaling=False)) == [0, 1, 2, 3, 4]
    assert sorted(chosen_lists(m, np.array([[0.0]]), 2, 5, None, 0)) == [0, 1]
