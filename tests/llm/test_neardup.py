"""Near-duplicate operators against brute force: every link, no link twice, whatever rows are dealt into how many tasks."""

import random

import numpy as np
import pytest

from vexil.llm import simhash
from vexil.llm._graph import connected_components
from vexil.llm.neardup_vectors import embedding_components
from vexil.llm.simhash import keep_representatives, simhash_components


def components(n, links):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def by_hand(rows, threshold):
    v = np.array([np.array(r[1]) / np.abs(r[1]).max() for r in rows])
    label = np.array([r[2] for r in rows])
    length = np.sqrt((v * v).sum(axis=1))
    linked = ((v @ v.T) / length[:, None] / length[None, :] >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    roots = components(len(rows), zip(*np.nonzero(np.triu(linked))))
    return {rows[i][0]: (int(linked[i].sum()), rows[roots[i]][0]) for i in range(len(rows))}


@pytest.mark.parametrize("options", [{}, {"chunk": 40, "blocks": 8}])
def test_embeddings_against_brute_force(spark, options):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 64)).astype(np.float32).astype(float)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(150 + i, (v * (1, 3, 1 / 7, 1e-20, 1e200)[i % 5]).tolist(), 1) for i, v in enumerate(x)]  # parallel to the first
    center = rng.normal(size=64)
    rows += [(300 + i, (center + rng.normal(size=64) * s).tolist(), 2) for i, s in enumerate(np.linspace(0, 0.5, 80))]
    rows += [(380 + i, rows[300 + i][1], 3) for i in range(20)] + [(400 + i, rows[300][1], 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(df, **options).collect()}
    assert got == by_hand(rows, 0.93)


def test_embeddings_odd_rows(spark):
    one = [1.0, 0.0, 2.0]
    rows = [
        (5, one, 1, 7), (5, one, 1, 7), (None, [2.0, 0.0, 4.0], 1, 7), (6, None, 1, 7), (7, [], 1, 7), (8, [0.0, 0.0, 0.0], 1, 7), (9, [1.0, None, 2.0], 1, 7),
        (10, [float("nan"), 1.0, 1.0], 1, 7), (11, one, None, 7), (12, [1.0, 0.0], 1, 7), (13, [1.0, -0.0, 2.0], 1, 7), (None, [9.0, -9.0, 0.0], 2, 7),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node int")
    got = sorted(map(tuple, embedding_components(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (6, 7, 8, 9, 10, 11, 12)] + [(None, 0, None, True)]
    assert got == sorted([(5, 3, 5, True)] * 2 + [(None, 3, 5, True), (13, 3, 5, False)] + alone, key=str)
    assert embedding_components(df.limit(0)).count() == 0


def ball_graph():
    rng = random.Random(3)
    fps = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    half = rng.getrandbits(32)
    fps |= {half << 32 | rng.getrandbits(32) for _ in range(100)} | {half << 32 | half ^ rng.getrandbits(6) for _ in range(60)}
    return sorted(fps)


@pytest.mark.parametrize("options", [{"block": 16}, {"segments": 1}])
def test_hamming_links_against_brute_force(spark, options):
    fps = ball_graph()
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, node long")
    got = dict(map(tuple, connected_components(simhash.hamming_links(df, **options)).collect()))
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_fingerprints_without_an_id_bridge(spark, monkeypatch):
    # 0 and 2 are 6 bits apart, the nameless one 3 from either
    prints = spark.createDataFrame([(1, 0b000000), (None, 0b000111), (2, 0b111111)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "simhash_fingerprints", lambda *a: prints)
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(prints, text_col="fp").collect()), key=str)
    assert got == [(1, 1), (2, 1), (None, 1)]


def test_representatives_are_rows(spark):
    rows = [
        (1, "a b c d e f", 5), (1, "wholly different text here now", 5), (2, "x y z w v u t", 5), (None, "a b c d e f", 5), (2, "x y z w v u t", 6),
        (None, "a text without an id", 5), (None, "another text that has none", 5), (3, None, 5), (4, "", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id int, text string, __h int")
    kept = keep_representatives(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(1, "a b c d e f"), (1, "wholly different text here now"), (2, "x y z w v u t"), (3, None), (None, "a text without an id"), (None, "another text that has none")]
    assert got == sorted(want, key=str)
    assert keep_representatives(df.limit(0)).count() == 0


def test_top_k_of_repeated_query_ids(spark):
    from pyspark.sql import functions as F

    from vexil.llm.topk import nra, top_k_inner_product

    rows = [(0, [1.0, 0.0], 9), (0, [0.0, 1.0], 9), (1, [0.9, 0.1], 9), (2, [0.5, 0.5], 9), (3, [0.1, 0.9], 9), (None, [5.0, 5.0], 9), (3, [0.1, 0.9], 9), (4, [1e9, 0.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = top_k_inner_product(df, F.col("vec_id") == 0, k=3).collect()
    floor = lambda x, y: int(np.floor(256 * x) * 256 + np.floor(256 * y) * 0)
    first = [(1, 4, 256 * 256 * 10**9), (2, 1, floor(0.9, 0)), (3, 2, floor(0.5, 0))]
    second = [(1, 3, floor(0.9, 0)), (2, 3, floor(0.9, 0)), (3, 2, floor(0.5, 0))]
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == sorted(first + second)
    assert {r.query_id for r in got} == {0}

    # a query that a few rows answer stops before the lists' end
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(2000, 8)) * 30)
    x[:10] += 500
    names, ids = np.array([-1, -2]), np.arange(2000)
    q = np.stack([np.full(8, 3.0), np.floor(rng.normal(size=8) * 30)])
    found, share = nra(q, names, x, ids, 5)
    for i in range(2):
        best = sorted((-int(s), j) for j, s in enumerate(x @ q[i]))[:5]
        assert [(j, s) for p, j, s in found if p == i] == [(j, -s) for s, j in best]
    assert share[0] < 0.1
