import numpy as np
import pytest

from vexil.collection import Collection
from vexil.operators.quantize import PQCodebook, kmeans, pack_nibbles, rounded_tables
from vexil.sources.store import Store, load, save
from vexil.types import Metric


def rows(spark, ids, dim=4, seed=0):
    x = np.random.default_rng(seed).normal(size=(len(ids), dim))
    return spark.createDataFrame([(i, v.tolist(), f"n{i % 3}") for i, v in zip(ids, x)], "id long, vector array<double>, name string")


def test_writes(spark):
    c = Collection(spark, 4, custom_ids=True)
    c.add(rows(spark, range(10)))
    with pytest.raises(ValueError):
        c.add(rows(spark, [3]))
    with pytest.raises(ValueError):
        c.add(rows(spark, [50], dim=3))
    assert c.size == 10 and c.remove([2, 2, 77]) == 1
    c.add(rows(spark, [2], seed=5))
    assert [r["slot"] for r in c.rows.where("id = 2").collect()] == [10]
    assert c.compact() == 1 and sorted(r["slot"] for r in c.rows.collect()) == list(range(10))
    with pytest.raises(ValueError):
        c.get_metadata([2, 2])
    with pytest.raises(ValueError):
        c.add(spark.createDataFrame([(90, [1.0] * 4, 5)], "id long, vector array<double>, name long"))


def test_cosine_refuses_zero(spark):
    c = Collection(spark, 2, Metric.COSINE)
    with pytest.raises(ValueError):
        c.add(spark.createDataFrame([([0.0, 0.0],)], "vector array<double>"))
    assert [r["id"] for r in c.add(spark.createDataFrame([([3.0, 4.0],)], "vector array<double>")).collect()] == [0]
    hits = c.query(spark.createDataFrame([(0, [4.0, 3.0])], "qid long, vector array<double>"), 3).collect()
    assert len(hits) == 1 and abs(hits[0]["distance"] - 0.04) < 1e-6


def test_store(spark, tmp_path):
    c = Collection(spark, 4, custom_ids=True)
    c.add(rows(spark, range(6)))
    store = Store.persist(c, str(tmp_path / "s"))
    store.add(rows(spark, [9], seed=3))
    store.remove([1])
    store.add_metadata_column("f", 0.5)
    (tmp_path / "s" / "log-1-00000004").mkdir()  # never sealed
    again = Store.open(spark, str(tmp_path / "s"))
    assert sorted(r["id"] for r in again.collection.rows.collect()) == [0, 2, 3, 4, 5, 9] and "f" in again.collection.rows.columns
    again.checkpoint()
    assert Store.open(spark, str(tmp_path / "s")).collection.size == 6
    with pytest.raises(ValueError):
        Store.persist(c, str(tmp_path / "s"))
    save(again.collection, str(tmp_path / "t"))
    assert load(spark, str(tmp_path / "t")).size == 6
    (tmp_path / "t" / "MANIFEST.json").write_text("{")
    with pytest.raises(RuntimeError):
        load(spark, str(tmp_path / "t"))


def test_quantizers(tmp_path):
    x = np.random.default_rng(1).normal(size=(300, 8))
    book = PQCodebook.train(x, 4, 16)
    codes = book.encode(x)
    exact = ((x[0] - book.decode(codes)) ** 2).sum(axis=1)
    assert np.allclose(book.distance_adc(book.compute_adc_table(x[0]), codes), exact)
    book.save(str(tmp_path / "b.npz"))
    assert (PQCodebook.load(str(tmp_path / "b.npz")).encode(x) == codes).all()
    whole, scale, offset = rounded_tables(book.compute_adc_table(x[0]))
    assert whole.max() == 63 and np.abs(whole[np.arange(4), codes].sum(axis=1) / scale + offset - exact).max() < 4 / scale
    assert (kmeans(x, 5, seed=2) == kmeans(x, 5, seed=2)).all()
    assert pack_nibbles(np.array([[1, 2, 3]])).tolist() == [[0x21, 3]]
