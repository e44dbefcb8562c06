"""Searches whose memory and shuffle must not grow with the square of their input."""

import tracemalloc

import numpy as np
import pytest

from vexil.adapters import DocumentStore
from vexil.functions.kernels import normalized
from vexil.indexes import RefineIndex, make_index
from vexil.operators import fusion, hnsw, search, sparse
from vexil.types import Metric

TERMS = "array<struct<term:bigint,weight:double>>"


def joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_many_sparse_queries_are_scanned(spark):
    """Repeated terms, sums of zero, negative weights and ties, by a scan without a join of queries and postings."""
    rng = np.random.default_rng(5)
    given = [[(int(t), float(rng.integers(-2, 4))) for t in rng.choice(40, 8)] for _ in range(400)]
    dense, shared = np.zeros((400, 40)), np.zeros((400, 40), bool)
    for i, row in enumerate(given):
        for t, w in row:
            dense[i, t] += w
    shared = dense != 0
    index = make_index(spark, "sparse", custom_ids=True)
    index.add(spark.createDataFrame([(i, r) for i, r in enumerate(given)], f"id long, terms {TERMS}"))
    asked = index.rows.select(index.rows.id.alias("qid"), "terms")
    want = {}
    for q in range(400):
        met = np.flatnonzero((shared[q] & shared).any(axis=1))
        score = dense[met] @ dense[q]
        order = np.lexsort((met, -score))[:5]
        want[q] = [(int(met[i]), float(-score[i]) + 0.0) for i in order]
    for pruning in (False, True):
        index.pruning = pruning
        hits = index.batch_query(asked, 5)
        assert joins(hits) == joins(index.rows)
        got = {}
        for r in hits.orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append((r["id"], r["distance"] + 0.0))
        assert got == want
    # the same from postings
    postings = sparse.canonical(index.rows).join(index.rows.select("id", "slot"), "id")
    hits = sparse.sparse_search(postings, sparse.canonical(asked, "qid"), 5)
    assert sorted((r["qid"], r["rank"], r["id"]) for r in hits.collect()) == [(q, i + 1, x) for q, row in sorted(want.items()) for i, (x, _) in enumerate(row)]


def test_all_lists_of_a_sparse_index(spark):
    """Where every term and posting is read, the first scores are the exact ones and aren't made twice."""
    rows = spark.createDataFrame([(i, [(t, 1.0 + (i * t) % 7) for t in range(i % 5 + 1)]) for i in range(60)], f"id long, terms {TERMS}")
    exact, approx = make_index(spark, "sparse", custom_ids=True), make_index(spark, "sparse_approx", custom_ids=True, query_terms=0, list_depth=0, k_factor=1000)
    exact.add(rows), approx.add(rows)
    asked = rows.withColumnRenamed("id", "qid")
    both = [sorted(map(tuple, i.batch_query(asked, 7).collect())) for i in (exact, approx)]
    assert both[0] == both[1] and joins(approx.batch_query(asked, 7)) == joins(approx.rows)


def test_distances_held_at_once():
    """A block of queries against a batch of rows: not all their distances at once."""
    rng = np.random.default_rng(3)
    q, x = rng.normal(size=(4000, 4)), rng.normal(size=(5000, 4))
    tracemalloc.start()
    for i, (at, d) in enumerate(search.nearest(Metric.L2, q, x, np.arange(5000), 3)):
        if i % 997 == 0:
            want = ((x - q[i]) ** 2).sum(axis=1)
            assert at.tolist() == np.argsort(want)[:3].tolist() and np.allclose(d, want[at])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert i == 3999 and peak < 80e6  # all distances once are 160 MB


def test_inverted_file_without_joins(spark):
    """As many lists as a fifth of the rows, ties among centroids and rows; nothing is joined."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, size=(300, 4)).astype(float)
    c = np.concatenate([x[::5], x[:3]])
    rows = spark.createDataFrame([(i, i, v.tolist(), i % 9) for i, v in enumerate(x)], "slot long, id long, vector array<double>, kind int")
    asked = rows.where("id % 30 = 0").selectExpr("id as qid", "vector")
    assigned = search.assign_lists(rows, c)
    to = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    own = to.argmin(axis=1)
    assert {r["id"]: r["list"] for r in assigned.collect()} == dict(enumerate(own.tolist()))

    def want(q, lists, ok, k):
        at = np.flatnonzero(np.isin(own, lists) & ok)
        d = ((x[at] - x[q]) ** 2).sum(axis=1)
        return [(q, r + 1, int(at[i]), float(d[i])) for r, i in enumerate(np.lexsort((at, d))[:k])]

    every, queries = np.ones(300, bool), range(0, 300, 30)
    near = lambda q, n: np.lexsort((np.arange(len(c)), to[q]))[:n]
    for nprobe in (4, len(c)):
        hits = search.ivf_search(assigned, asked, c, 6, nprobe)
        assert joins(hits) == 0
        assert sorted(map(tuple, hits.collect())) == [w for q in queries for w in want(q, near(q, nprobe), every, 6)]
    probed = search.probe(asked, c, 3).collect()
    assert sorted((r["qid"], r["place"], r["list"]) for r in probed) == [(q, p, int(w)) for q in queries for p, w in enumerate(near(q, 3))]
    kind = np.arange(300) % 9 == 2
    here = np.bincount(own[kind], minlength=len(c))
    least = min(len(c), max(2, int(np.ceil(0.75 * 2 * (300 / kind.sum()) ** (1 / 3)))))
    hits = search.ivf_filtered_search(assigned, assigned.where("kind = 2"), asked, c, 20, 2)
    lists = {q: [w for p, w in enumerate(near(q, len(c))) if p < least or here[near(q, p)].sum() < min(20, kind.sum())] for q in queries}
    assert joins(hits) == 0 and sorted(map(tuple, hits.collect())) == [w for q in queries for w in want(q, lists[q], kind, 20)]


@pytest.mark.parametrize("metric", list(Metric))
def test_completed_answers(spark, metric):
    """Too narrow a beam, too few candidates: told to complete its answers, an index gives the exact ones."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(400, 8)) * rng.integers(1, 4, size=(400, 1)), 2, axis=0).astype(np.float32).astype(float)  # every row twice
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, vector array<double>, kind long")
    graph = make_index(spark, "hnsw", 8, custom_ids=True, metric=metric, hnsw_m=2, ef_construction=2, ef_search=1)
    codes = RefineIndex(make_index(spark, "ivf", 8, custom_ids=True, metric=metric, nprobe=1, pq_subspaces=2, pq_centroids=4), 1)
    codes.train(rows)
    for index in (graph, codes):
        index.add(rows)
        index.exact = True
        held = index.rows.select(index.rows.id.alias("qid"), "vector").where("qid % 50 = 0")
        v = search.as_matrix(index.rows.orderBy("id").select("vector").toArrow().column(0), 8)
        v = search.unit_rows(v) if metric == Metric.COSINE else v
        for where, ok in ((None, np.arange(800) >= 0), ("kind = 1", np.arange(800) % 3 == 1)):
            got = {(r["qid"], r["rank"]): r["id"] for r in index.batch_query(held, 10, where).collect()}
            for q in range(0, 800, 50):
                d = np.where(ok, search.exact(metric, v[q], v), np.inf)
                assert [got[q, r + 1] for r in range(10)] == np.lexsort((np.arange(800), d))[:10].tolist()
    with pytest.raises(ValueError):
        codes.base.exact = True


def test_a_norm_is_computed_once(spark):
    """Not once for every component."""
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    plan = df.select(normalized(df.v).alias("u"))
    assert plan.first()["u"] == [0.6, 0.8]
    assert "/ SQRT" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_ideal_gain_by_grades(spark):
    """Against plain Python: ties, more than k of a grade, fewer than k labels, no hit."""
    rng = np.random.default_rng(1)
    labels = [(q, i, float(g)) for q in range(6) for i, g in enumerate(rng.integers(0, 4, size=[3, 40, 12, 7, 25, 9][q])) if g or i == 0] + [(q, 99, 2.0) for q in range(6)]
    hits = [(q, r + 1, int(i)) for q in range(5) for r, i in enumerate(rng.permutation(30)[:15])]
    score = fusion.score(spark.createDataFrame(hits, "qid long, rank int, id long"), spark.createDataFrame(labels, "qid long, id long, grade double"), 10)
    grade = {(q, i): g for q, i, g in labels}
    want = {}
    for q in range(6):
        ideal = sum(g / np.log2(r + 2) for r, g in enumerate(sorted((g for (p, _), g in grade.items() if p == q and g > 0), reverse=True)[:10]))
        want[q] = sum(grade.get((q, i), 0.0) / np.log2(r + 1) for p, r, i in hits if p == q and r <= 10) / ideal
    got = {r["qid"]: r["value"] for r in score.collect()}
    assert got.keys() == want.keys() and np.allclose([got[q] for q in range(6)], [want[q] for q in range(6)])
    text = score._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in text  # no label is ranked


def test_graphs_of_bounded_size(spark, monkeypatch):
    """More parts than named when those had too many rows; several blocks of queries search the same graphs."""
    x = np.random.default_rng(2).normal(size=(240, 6))
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "slot long, id long, vector array<double>")
    asked = rows.where("id < 20").selectExpr("id as qid", "vector")
    monkeypatch.setattr(hnsw, "GRAPH_ROWS", 30)
    monkeypatch.setattr(search, "BLOCK", 8)
    found = hnsw.hnsw_search(rows, asked, 5, parts=2)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(slot#" in text and ", 8)" in text and text.count("FlatMapGroupsInArrow") == 1
    got = {(r["qid"], r["rank"]): r["id"] for r in found.collect()}
    for q in range(20):
        assert [got[q, r + 1] for r in range(5)] == np.argsort(((x - x[q]) ** 2).sum(axis=1))[:5].tolist()


def test_documents_are_counted_where_they_are(spark):
    store = DocumentStore(spark, 2, string_ids=True)
    assert store.count() == 0
    store.add(spark.createDataFrame([(f"d{i}", "t", ["en", "fr"][i % 2], [1.0, float(i)]) for i in range(9)], "id string, text string, lang string, vector array<double>"))
    for where in (None, {"lang": "fr"}, {"filters": [{"key": "lang", "operator": "text_match", "value": "e"}]}):
        assert store.count(where=where) == len(store.get(where=where))
    assert store.count(ids=["d1", "d2", "none"], where={"lang": "en"}) == 1


@pytest.mark.parametrize("metric", list(Metric))
def test_distances_written_out(spark, metric):
    """Vectors of one size are measured by compiled code, those of several sizes by lambdas; both as the other exact search."""
    x = np.random.default_rng(6).normal(size=(60, 5))
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "slot long, id long, vector array<double>")
    asked = rows.where("id % 9 = 0").selectExpr("id as qid", "vector")
    both = [sorted((r["qid"], r["rank"], r["id"], round(r["distance"], 9)) for r in f(rows, asked, 4, metric).collect()) for f in (search.flat_search, search.flat_search_sql)]
    assert both[0] == both[1]
    lambdas = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0].count("zip_with")
    assert lambdas(search.flat_search_sql(rows, asked, 4, metric)) == 0
    odd = rows.unionByName(spark.createDataFrame([(99, 99, [1.0])], rows.schema))
    assert lambdas(search.flat_search_sql(odd, asked, 4, metric)) > 0
