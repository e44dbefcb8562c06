import json

import numpy as np
import pytest

from vexil.sources.readers import as_terms, from_csr, read_beir, read_csr, read_vecs


@pytest.mark.parametrize(("kind", "whole"), [("<f4", False), ("<i4", True)])
def test_vecs(spark, tmp_path, kind, whole):
    x = (np.random.default_rng(0).normal(size=(50, 6)) * 100).astype(kind)
    path = tmp_path / "x.vecs"
    np.concatenate([np.full((50, 1), 6, "<i4"), x.view("<i4")], axis=1).tofile(path)
    got = read_vecs(spark, str(path), whole).orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(50)) and (np.array([r["vector"] for r in got], kind) == x).all()
    path.write_bytes(path.read_bytes()[:-3])
    with pytest.raises(RuntimeError):
        read_vecs(spark, str(path), whole)


def test_csr(spark, tmp_path):
    starts, terms, weights = np.array([0, 2, 2, 5]), np.array([3, 1, 0, 2, 4]), np.array([1, 2, 0.5, 4, 8])
    path = tmp_path / "x.csr"
    path.write_bytes(np.array([3, 5, 5], "<i8").tobytes() + starts.astype("<i8").tobytes() + terms.astype("<i4").tobytes() + weights.astype("<f4").tobytes())
    rows = lambda df: [(r["slot"], [tuple(t) for t in r["terms"]]) for r in df.orderBy("slot").collect()]
    want = [(0, [(3, 1.0), (1, 2.0)]), (1, []), (2, [(0, 0.5), (2, 4.0), (4, 8.0)])]
    assert rows(read_csr(spark, str(path), 2)) == want == rows(from_csr(spark, starts, terms, weights))
    with pytest.raises(ValueError):
        from_csr(spark, [0, 3, 2], [1, 2], [1, 2])
    path.write_bytes(path.read_bytes() + b"x")
    with pytest.raises(RuntimeError):
        read_csr(spark, str(path))


def test_beir(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text(json.dumps({"_id": "d1", "title": "T", "text": "x", "metadata": {}}) + "\n")
    (tmp_path / "queries.jsonl").write_text(json.dumps({"_id": "q1", "text": "y"}) + "\n")
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\n")
    assert [list(map(tuple, df.collect())) for df in read_beir(spark, str(tmp_path))] == [[("d1", "T", "x")], [("q1", "y")], [("q1", "d1", 2.0)]]


def test_terms(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T

    first = lambda df: [tuple(t) for t in df.select(as_terms(df, "x")).first()[0]]
    assert sorted(first(spark.createDataFrame([({7: 2.0, 3: 1.0},)], "x map<bigint,float>"))) == [(3, 1.0), (7, 2.0)]
    assert first(spark.createDataFrame([([(5, 1.5)],)], "x array<struct<term:int,weight:float>>")) == [(5, 1.5)]
    assert first(spark.createDataFrame([(Vectors.sparse(9, {4: 2.0}),)], T.StructType([T.StructField("x", VectorUDT())]))) == [(4, 2.0)]
    with pytest.raises(TypeError):
        as_terms(spark.createDataFrame([("a",)], "x string"), "x")
