"""Clustering and quantizers (Q1-Q17): k-means, scalar and product quantization, balanced rotation.

Models are trained with numpy on a bounded sample on the driver, or by Spark
aggregates; they are small and travel to the executors.  Encoding and scoring
are column expressions or Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexil.operators.search import as_matrix
from vexil.types import Clustering, require

#: Vectors that a model is trained on, at most, per centroid.
PER_CENTROID = 256


def sample_matrix(corpus: DataFrame, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, those first by a hash of their slot."""
    chosen = corpus.select(F.col("vector").cast("array<double>").alias("vector"), "slot").orderBy(F.xxhash64("slot"), "slot").limit(rows)
    return as_matrix(chosen.select("vector").toArrow().column(0))


def _nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c * c).sum(axis=1)[None, :] - 2 * (x[i : i + 4096] @ c.T)).argmin(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


def kmeans(x: np.ndarray, k: int, iterations: int = 25, seed: int = 1, spherical: bool = False) -> np.ndarray:
    """Lloyd's iterations from k distinct rows; empty clusters restart at the rows farthest from theirs."""
    require(len(x) >= k, "fewer vectors than clusters")
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(iterations):
        at = _nearest_centroid(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = ((x - c[at]) ** 2).sum(axis=1).argsort()[::-1][: len(empty)]
            new[empty] = x[far]
        if spherical:
            new /= np.maximum(np.sqrt((new * new).sum(axis=1, keepdims=True)), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def emeans(x: np.ndarray, k: int, passes: int = 2, seed: int = 1, spherical: bool = False) -> np.ndarray:
    """Mini-batch k-means with decaying steps, dead centroids revived, means of the whole sample at the end."""
    require(len(x) >= k, "fewer vectors than clusters")
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    batch = max(256, min(len(x), 8 * k))
    steps = max(4, passes * len(x) // batch)
    for s in range(steps):
        rows = x[rng.choice(len(x), min(batch, len(x)), replace=False)]
        at = _nearest_centroid(rows, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, rows)
        rate = 0.5 * (1 + np.cos(np.pi * s / steps))
        c = np.where(n[:, None] > 0, (1 - rate) * c + rate * sums / np.maximum(n, 1)[:, None], c)
        if s % 5 == 4 and (n == 0).any():
            dead = np.flatnonzero(n == 0)
            c[dead] = rows[rng.choice(len(rows), len(dead), replace=len(rows) < len(dead))]
    return kmeans_from(x, c, 1, spherical)


def kmeans_from(x: np.ndarray, c: np.ndarray, iterations: int, spherical: bool = False) -> np.ndarray:
    for _ in range(iterations):
        at = _nearest_centroid(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if spherical:
            c = c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    return c


def train_lists(corpus: DataFrame, nlist: int, clustering: Clustering = Clustering.EMEANS, iterations: int = 10, passes: int = 2, seed: int = 1, spherical: bool = False) -> np.ndarray:
    require(100 <= nlist <= 65535, "nlist is from 100 to 65535")
    x = sample_matrix(corpus, PER_CENTROID * nlist)
    require(len(x) >= nlist, "fewer vectors than lists")
    if clustering == Clustering.LLOYD:
        return kmeans(x, nlist, iterations, seed, spherical)
    return emeans(x, nlist, passes, seed, spherical)


def lloyd_step(assigned: DataFrame) -> DataFrame:
    """(list, pos, value, n): the means of the lists, one row per coordinate, as a Spark aggregate."""
    return assigned.select("list", F.posexplode(F.col("vector").cast("array<double>")).alias("pos", "x")).groupBy("list", "pos").agg(F.avg("x").alias("value"), F.count(F.lit(1)).alias("n"))


# --- scalar quantizer --------------------------------------------------------------------------------------------------


def sq_ranges(corpus: DataFrame, bits: int = 8) -> DataFrame:
    """(pos, vmin, step) per dimension."""
    require(bits in (4, 8), "bits are 4 or 8")
    parts = corpus.select(F.posexplode(F.col("vector").cast("array<double>")).alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("vmin"), F.max("x").alias("vmax"))
    return parts.select("pos", "vmin", ((F.col("vmax") - F.col("vmin")) / F.lit(2**bits - 1)).alias("step"))


class ScalarQuantizer:
    def __init__(self, vmin: list[float], step: list[float], bits: int = 8):
        self.vmin, self.step, self.bits = vmin, step, bits

    @classmethod
    def train(cls, corpus: DataFrame, bits: int = 8) -> ScalarQuantizer:
        rows = sq_ranges(corpus, bits).orderBy("pos").collect()  # one row per dimension
        return cls([r["vmin"] for r in rows], [r["step"] for r in rows], bits)

    def encode(self, vector: Column) -> Column:
        """array<int> of levels."""
        steps = F.arrays_zip(F.lit(self.vmin).alias("lo"), F.lit(self.step).alias("step"))
        level = lambda x, s: F.when(s["step"] > 0, F.floor((x - s["lo"]) / s["step"] + 0.5)).otherwise(F.lit(0))
        top = F.lit(2**self.bits - 1)
        return F.zip_with(vector.cast("array<double>"), steps, lambda x, s: F.greatest(F.lit(0), F.least(top, level(x, s))).cast("int"))

    def decode(self, codes: Column) -> Column:
        steps = F.arrays_zip(F.lit(self.vmin).alias("lo"), F.lit(self.step).alias("step"))
        return F.zip_with(codes, steps, lambda c, s: s["lo"] + c.cast("double") * s["step"])


def pack_nibbles(codes: np.ndarray) -> np.ndarray:
    """Rows of 4-bit levels as bytes, the first of two in the low half."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return (codes[:, ::2] | (codes[:, 1::2] << 4)).astype(np.uint8)


# --- product quantizer -------------------------------------------------------------------------------------------------


class PQCodebook:
    """m subspaces of ``ksub`` centroids; the public standalone quantizer."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.float64)  # (m, ksub, dim / m)

    @classmethod
    def train(cls, x: np.ndarray, m: int, ksub: int = 256, iterations: int = 25, seed: int = 1) -> PQCodebook:
        require(x.shape[1] % m == 0, "m must divide the dimension")
        parts = np.split(np.asarray(x, np.float64), m, axis=1)
        return cls(np.stack([kmeans(p, ksub, iterations, seed + i) for i, p in enumerate(parts)]))

    def encode(self, x: np.ndarray) -> np.ndarray:
        parts = np.split(np.asarray(x, np.float64), len(self.centroids), axis=1)
        return np.stack([((p[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1) for p, c in zip(parts, self.centroids)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.centroids)], axis=1)

    def compute_adc_table(self, q: np.ndarray, inner: bool = False) -> np.ndarray:
        parts = np.split(np.asarray(q, np.float64), len(self.centroids))
        return np.stack([-(c @ p) if inner else ((c - p) ** 2).sum(axis=1) for p, c in zip(parts, self.centroids)])

    def sdc_tables(self) -> np.ndarray:
        return np.stack([((c[:, None] - c[None]) ** 2).sum(axis=2) for c in self.centroids])

    def distance_adc(self, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return table[np.arange(len(table)), codes].sum(axis=1)

    def distance_sdc(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        tables = self.sdc_tables()
        return tables[np.arange(len(tables)), a, b].sum(axis=-1)

    def write(self, spark, path: str) -> None:
        """A folder of its own kind on any file system that Spark reaches."""
        shape = list(self.centroids.shape)
        spark.createDataFrame([("pq-codebook", shape, self.centroids.tobytes())], "kind string, shape array<int>, value binary").coalesce(1).write.parquet(path)

    @classmethod
    def read(cls, spark, path: str) -> PQCodebook:
        table = spark.read.parquet(path)
        require(table.columns == ["kind", "shape", "value"], "not a codebook", RuntimeError)
        row = table.first()
        require(row is not None and row["kind"] == "pq-codebook", "not a codebook", RuntimeError)
        return cls(np.frombuffer(row["value"], np.float64).reshape(row["shape"]))

    def save(self, path: str) -> None:
        np.savez(path, kind=np.array("pq-codebook"), centroids=self.centroids)

    @classmethod
    def load(cls, path: str) -> PQCodebook:
        with np.load(path) as f:
            require("kind" in f and str(f["kind"]) == "pq-codebook", "not a codebook", RuntimeError)
            return cls(f["centroids"])


def rounded_tables(tables: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Tables as whole numbers from 0, the widest row up to 63, half to even; a distance is sum / scale + offset."""
    low = tables.min(axis=1)
    width = (tables.max(axis=1) - low).max()
    scale = 63 / width if width > 0 else 1.0
    return np.rint((tables - low[:, None]) * scale).astype(np.uint8), float(scale), float(low.sum())


def pq_encode(corpus: DataFrame, book: PQCodebook) -> DataFrame:
    """(slot, id, codes array<int>)."""
    shipped = corpus.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        b = shipped.value
        dim = b.centroids.shape[0] * b.centroids.shape[2]
        for batch in batches:
            codes = b.encode(as_matrix(batch.column(2), dim)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32), codes.ravel())], ["slot", "id", "codes"]
            )

    return corpus.select("slot", "id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "slot long, id long, codes array<int>")


def pq_search(codes: DataFrame, queries: DataFrame, book: PQCodebook, k: int, symmetric: bool = False, rounded: bool = False) -> DataFrame:
    """Top k by asymmetric (or symmetric) table distances; ``rounded`` uses the whole-number tables of a fast scan."""
    from vexil.operators.search import query_blocks, top_k

    hits = None
    for qids, q in query_blocks(queries):
        shipped = codes.sparkSession.sparkContext.broadcast((book, qids, q))

        def run(batches, shipped=shipped):
            b, qids, q = shipped.value
            coded, pairs = b.encode(q), b.sdc_tables() if symmetric else None
            m = np.arange(len(b.centroids))
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = as_matrix(batch.column(2), len(m)).astype(int)
                slot, ident = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for i, (qid, v) in enumerate(zip(qids, q)):
                    table = pairs[m, coded[i]] if symmetric else b.compute_adc_table(v)
                    if rounded:
                        whole, scale, offset = rounded_tables(table)
                        d = whole[m, rows].sum(axis=1, dtype=np.int64) / scale + offset
                    else:
                        d = table[m, rows].sum(axis=1)
                    at = np.lexsort((slot, d))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qid)), pa.array(slot[at]), pa.array(ident[at]), pa.array(d[at])], ["qid", "slot", "id", "distance"])

        part = codes.select("slot", "id", "codes").mapInArrow(run, "qid long, slot long, id long, distance double")
        hits = part if hits is None else hits.unionByName(part)
    return top_k(hits, k)


def balanced_rotation(x: np.ndarray, m: int) -> np.ndarray:
    """Orthogonal dim x dim: principal directions dealt so that the m subspaces get like products of variance."""
    values, vectors = np.linalg.eigh(np.cov(x.T))
    size = x.shape[1] // m
    parts: list[list[int]] = [[] for _ in range(m)]
    load = np.zeros(m)
    for i in np.argsort(values)[::-1]:
        open_ = [p for p in range(m) if len(parts[p]) < size]
        p = min(open_, key=lambda p: (load[p], p))
        parts[p].append(int(i))
        load[p] += np.log(max(values[i], 1e-12)) + 30
    return vectors[:, [i for p in parts for i in p]]


def rotate(corpus: DataFrame, rotation: np.ndarray) -> DataFrame:
    """The corpus with its vectors multiplied by the matrix."""
    shipped = corpus.sparkSession.sparkContext.broadcast(rotation)
    at = corpus.columns.index("vector")
    wide = corpus.withColumn("vector", F.col("vector").cast("array<double>"))

    def run(batches):
        r = shipped.value
        for batch in batches:
            y = as_matrix(batch.column(at), r.shape[0]) @ r
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32), y.ravel())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return wide.mapInArrow(run, wide.schema)


