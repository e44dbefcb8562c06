import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil.adapters import DocumentStore, filters
from vexil.types import Metric

N, DIM = 120, 8


@pytest.fixture(scope="module")
def nodes(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(N, DIM)).astype(np.float32).astype(float)
    rows = [(i, f"node number{i} common", x[i].tolist(), 2000 + i % 10, None if i % 4 == 3 else "abc"[i % 3], f"doc{i // 5}") for i in range(N)]
    return spark.createDataFrame(rows, "id long, text string, vector array<double>, year long, source string, ref_doc_id string"), x


def ids(hits):
    return [r["id"] for r in hits.orderBy("qid", "rank").collect()]


def test_search_modes(spark, nodes):
    rows, x = nodes
    store = DocumentStore(spark, DIM, metric=Metric.L2)
    with pytest.raises(ValueError):
        store.search(rows, 1, "other")
    store.add(rows)
    ask = spark.createDataFrame([(0, x[7].tolist(), "number7")], "qid long, vector array<double>, text string")
    near = np.argsort(((x - x[7]) ** 2).sum(axis=1)).tolist()
    assert ids(store.search(ask, 4)) == near[:4]
    assert ids(store.search(ask, 2, ids=[3, 5, 999])) == [i for i in near if i in (3, 5)]
    assert ids(store.search(ask, 9, doc_ids=["doc2"])) == [i for i in near if i // 5 == 2]
    assert ids(store.search(ask, 9, "sparse")) == [7] and ids(store.search(ask, 1, "hybrid")) == [7]
    assert store.tune_hybrid_weights(ask, spark.createDataFrame([(0, 7, 1.0)], "qid long, id long, grade double"), 3) == 1.0
    assert store.search_mmr(x[7].tolist(), 3)[0] == 7
    assert store.delete(doc_ids=["doc1"]) == 5 and store.delete(ids=[0, 0, 5]) == 1
    store.add(rows.where("id = 0").withColumn("year", F.lit(1990).cast("long")))
    assert store.get([0])[0]["metadata"]["year"] == 1990 and store.delete(where={"year": 1990}) == 1
    assert store.clear() == N - 6 and store.collection.size == 0


def test_filters(nodes):
    rows, _ = nodes
    data = rows.collect()
    leaves = [
        ({"key": "year", "operator": ">=", "value": 2005}, lambda r: r["year"] >= 2005),
        ({"key": "source", "operator": "!=", "value": "a"}, lambda r: r["source"] != "a"),
        ({"key": "source", "operator": "nin", "value": ["a", "b"]}, lambda r: r["source"] not in ("a", "b")),
        ({"key": "source", "operator": "is_empty"}, lambda r: r["source"] is None),
        ({"source": ["a", "c"], "year": 2002}, lambda r: r["source"] in ("a", "c") and r["year"] == 2002),
    ]
    columns, expected = [], []
    for f, want in leaves:
        for g, other in leaves:
            for how, test in (("and", lambda a, b: a and b), ("or", lambda a, b: a or b), ("not", lambda a, b: not (a or b))):
                columns.append(F.count_if(filters({"condition": how, "filters": [f, g]}).column(rows.schema)))
                expected.append(sum(test(want(r), other(r)) for r in data))
    assert list(rows.select(*columns).first()) == expected


def test_presets_embedding_and_files(spark, nodes, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1100, DIM))
    table = spark.createDataFrame([(f"t{i}", v.tolist()) for i, v in enumerate(x)], "text string, vector array<double>").cache()
    embed = lambda rows: rows.join(table, "text")
    store = DocumentStore(spark, DIM, embed, index="ivf-pq")
    store.add(spark.createDataFrame([(i, f"t{i}") for i in range(1100)], "id long, text string"))
    ask = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "qid long, text string")
    assert ids(store.search(ask, 1, nprobe=100, k_factor=20)) == list(range(5)) and store.index.k_factor == 4 and store.index.options.nprobe == 10
    store.save(str(tmp_path / "d"))
    again = DocumentStore.load(spark, str(tmp_path / "d"), embed)
    assert ids(again.search(ask, 3)) == ids(store.search(ask, 3)) and again.get([2])[0]["text"] == "t2"
