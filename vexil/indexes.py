"""Indexes: a collection and a way to search it (W15, D1-D20, G1-G10, Q14-Q17, X3-X8, H5-H7, IO5-IO12, R1-R6).

An index keeps what its search needs beside the rows: inverted lists and codes
are columns made when rows are added, graphs are built once for the rows added
since the last search.  All share the collection's ids, writes and filters.
Raw vectors stay in the table; scans of codes don't read that column.
"""

from __future__ import annotations

import uuid
from copy import copy
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.collection import Collection
from vexil.materialize import materialize
from vexil.operators import fusion, lists, sparse
from vexil.operators.hnsw import GRAPH_ROWS, Graph
from vexil.operators.quantize import PER_CENTROID, PQCodebook, ScalarQuantizer, balanced_rotation, emeans, kmeans, sample_matrix
from vexil.operators.search import as_matrix, completed, flat_search, padded, query_blocks, refine, top_k, unit_rows
from vexil.sources.store import Folder, Store, load, save
from vexil.types import Clustering, IndexType, Metric, PQDistance, require

@dataclass
class Options:
    """Options of ``make_index``; each type reads its own."""

    nlist: int = 100
    nprobe: int = 10
    pq_subspaces: int = 0
    pq_centroids: int = 256
    pq_fast_scan: bool = False
    pq_rotate: bool = False
    ivf_sq_bits: int = 0
    hnsw_m: int = 16
    ef_construction: int = 200
    ef_search: int = 64
    hnsw_sq_bits: int = 0
    query_terms: int = 10
    list_depth: int = 10_000
    k_factor: int = 10
    custom_ids: bool = False
    metric: Metric = Metric.L2


class Index:
    """Exact search; the base of the others."""

    kind = IndexType.FLAT

    def __init__(self, spark: SparkSession, dim: int | None, options: Options | None = None, sparse: bool = False, collection: Collection | None = None):
        self.spark, self.options = spark, options or Options()
        self.collection = collection or Collection(spark, dim, self.options.metric, self.options.custom_ids, sparse)
        self.collection.describe = self._describe
        self.wrapped, self._exact = False, False

    @property
    def exact(self) -> bool:
        return self._exact

    @exact.setter
    def exact(self, value: bool) -> None:
        """Complete every answer: rows that aren't farther than the index's k-th hit are looked for among all (see ``completed``)."""
        require(not value or self._scores(), "distances by codes are no limits: re-score them first")
        self._exact = bool(value)

    def _scores(self) -> bool:
        """Whether hits have their exact distances."""
        return self.collection.dim is not None

    def __getattr__(self, name: str):
        """What the collection has: dim, metric, size, slots, ids, get_vectors, get_metadata, metadata_schema, and the writes."""
        if name.startswith("_") or name == "collection":
            raise AttributeError(name)
        if name in ("add", "remove", "upsert", "compact", "update_metadata", "add_metadata_column", "drop_metadata_column"):
            require(not self.wrapped, "this part belongs to another index: write to that one")
        return getattr(self.collection, name)

    def query(self, vector: list[float], k: int, where=None, allowed: DataFrame | None = None) -> DataFrame:
        """(rank, id, distance) for one vector."""
        one = self.spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, vector array<double>")
        return self.batch_query(one, k, where, allowed).drop("qid").orderBy("rank")

    def batch_query(self, queries: DataFrame, k: int, where=None, allowed: DataFrame | None = None, pad: bool = False) -> DataFrame:
        """(qid, rank, id, distance) for queries (qid, vector)."""
        rows = self.collection.allowed(where, allowed)
        hits = self._hits(queries, k, rows, where is not None or allowed is not None)
        hits = completed(hits, rows, queries, k, self.metric) if self.exact else hits
        return padded(hits, queries, k) if pad else hits

    def _hits(self, queries: DataFrame, k: int, rows: DataFrame, filtered: bool) -> DataFrame:
        return flat_search(rows, queries, k, self.metric)

    def _direct(self, rows: DataFrame, filtered: bool, factor: int) -> tuple[bool, int]:
        return False, 0

    def with_settings(self, **options) -> Index:
        """The same rows searched under other settings (nprobe, ef_search, k_factor, ...); this index stays as it is."""
        view = copy(self)
        view.options = replace(self.options, **options)
        return view

    # --- snapshots

    def _model(self) -> dict[str, np.ndarray]:
        return {}

    def _restore(self, model: dict[str, np.ndarray], extra: dict) -> None: ...

    def _extra(self) -> dict:
        return {}

    def _describe(self, path: str) -> dict:
        arrays = {n: a for n, a in self._model().items() if a is not None}
        name = None
        if arrays:
            name = f"model-{uuid.uuid4().hex[:12]}"
            table = [(n, list(a.shape), a.astype(np.float64).tobytes()) for n, a in arrays.items()]
            self.spark.createDataFrame(table, "name string, shape array<int>, value binary").write.parquet(f"{path}/{name}")
        return {"kind": self.kind.value, "options": asdict(self.options) | {"metric": self.options.metric.value}, "model": name, **self._extra()}

    def save(self, path: str) -> None:
        save(self.collection, path)

    def persist(self, path: str) -> Store:
        """From here on writes go through the store that this returns."""
        require(not self.wrapped, "this part belongs to another index")
        return Store.persist(self.collection, path)


class FlatIndex(Index): ...


class IVFIndex(Index):
    kind = IndexType.IVF

    def __init__(self, spark: SparkSession, dim: int, options: Options | None = None, sparse: bool = False, collection: Collection | None = None):
        super().__init__(spark, dim, options, sparse, collection)
        o = self.options
        require(100 <= o.nlist <= 65535, "nlist is from 100 to 65535")
        require(not (o.pq_subspaces and o.ivf_sq_bits), "product and scalar codes exclude each other")
        require(o.ivf_sq_bits in (0, 4, 8), "bits are 4 or 8")
        self.filter_probe_scaling, self.model = True, None
        if o.pq_subspaces:
            self.enable_pq(o.pq_subspaces, o.pq_centroids, o.pq_fast_scan, o.pq_rotate)
        self.collection.encode = self._encode

    def _scores(self) -> bool:
        return not (self.options.pq_subspaces or self.options.ivf_sq_bits)

    def _untouched(self) -> None:
        require(self.model is None and not self.collection.slots, "only before training and adding", RuntimeError)

    def enable_pq(self, m: int, centroids: int = 256, fast_scan: bool = False, rotate: bool = False) -> None:
        self._untouched()
        require(not self.options.ivf_sq_bits, "product and scalar codes exclude each other", RuntimeError)
        centroids = 16 if fast_scan else centroids
        require(self.collection.dim % m == 0, "the subspaces must divide the dimension")
        require(1 < centroids <= 256, "2 to 256 centroids a subspace")
        require(not fast_scan or (m % 2 == 0 and m <= 1024), "a fast scan needs an even number of subspaces, at most 1024")
        o = self.options
        o.pq_subspaces, o.pq_centroids, o.pq_fast_scan, o.pq_rotate = m, centroids, fast_scan, rotate

    def enable_sq(self, bits: int) -> None:
        self._untouched()
        require(bits in (4, 8), "bits are 4 or 8")
        require(not self.options.pq_subspaces, "product and scalar codes exclude each other", RuntimeError)
        self.options.ivf_sq_bits = bits

    @property
    def pq_distance(self) -> PQDistance:
        return PQDistance.SDC if self.model is not None and self.model.symmetric else PQDistance.ADC

    @pq_distance.setter
    def pq_distance(self, value: PQDistance) -> None:
        require(self.model is not None and self.model.book is not None, "no product codes", RuntimeError)
        symmetric = PQDistance(value) == PQDistance.SDC
        require(not symmetric or not (self.model.fast_scan or self.model.inner), "symmetric tables don't go with a fast scan or products")
        self.model.symmetric = symmetric

    @property
    def precomputed_tables(self) -> bool:
        return self.model is not None and self.model.fixed is not None

    @precomputed_tables.setter
    def precomputed_tables(self, value: bool) -> None:
        """Keep the part of the distance tables that no query changes; False where it would take more than 256 MB."""
        require(self.model is not None and self.model.book is not None, "no product codes", RuntimeError)
        require(not value or not self.model.inner, "tables of products have no such part")
        if not value:
            self.model.fixed = None
        else:
            self.model.precompute()

    @property
    def cosine_inner_product(self) -> bool:
        return self.model is not None and self.collection.metric == Metric.COSINE and bool(self.model.inner)

    @cosine_inner_product.setter
    def cosine_inner_product(self, value: bool) -> None:
        """One table of products per query instead of one of distances per list; training chooses by a trial."""
        require(self.model is not None and self.model.book is not None, "no product codes", RuntimeError)
        require(self.collection.metric == Metric.COSINE, "only for cosine")
        require(not value or not self.model.symmetric, "symmetric tables don't go with products")
        self.model.inner = bool(value)
        self.model.fixed = None

    def train(self, vectors: DataFrame, iterations: int = 10, passes: int = 2, clustering: Clustering = Clustering.EMEANS, seed: int = 1) -> None:
        """Centroids, rotation and codebook from a sample of at most 256 vectors per centroid; scalar ranges from all."""
        require(self.model is None, "trained already", RuntimeError)
        require(not self.collection.slots, "train before adding", RuntimeError)
        o, metric = self.options, self.collection.metric
        given = vectors.where("vector is not null").select("vector").withColumn("slot", F.xxhash64("vector"))
        x = sample_matrix(given, PER_CENTROID * max(o.nlist, o.pq_centroids if o.pq_subspaces else 0))
        require(len(x) >= o.nlist, "fewer vectors than lists")
        cosine = metric == Metric.COSINE
        x = unit_rows(x) if cosine else x
        c = kmeans(x, o.nlist, iterations, seed, cosine) if clustering == Clustering.LLOYD else emeans(x, o.nlist, passes, seed, cosine)
        model = lists.Model(metric, c)
        if o.pq_subspaces:
            model.rotation = balanced_rotation(x, o.pq_subspaces) if o.pq_rotate else None
            residual = model.turned(x - c[lists._nearest_centroid(x, c)])
            model.book = PQCodebook.train(residual[: PER_CENTROID * o.pq_centroids], o.pq_subspaces, o.pq_centroids, seed=seed)
            model.fast_scan = o.pq_fast_scan
            model.inner = metric == Metric.INNER_PRODUCT or (cosine and lists.better_inner(model, x))
        elif o.ivf_sq_bits:
            _scalar(model, given, o.ivf_sq_bits, cosine)
        self.model = model

    def _encode(self, df: DataFrame) -> DataFrame:
        require(self.model is not None, "train before adding", RuntimeError)
        return lists.encode(df, self.model)

    def _hits(self, queries: DataFrame, k: int, rows: DataFrame, filtered: bool) -> DataFrame:
        if not self.collection.slots:
            return flat_search(rows, queries, k, self.metric)
        here, live = None, 0
        if filtered:
            here = np.zeros(self.options.nlist, np.int64)
            for r in rows.groupBy("__list").count().collect():  # one row a list
                here[r[0]] = r[1]
            if not self.options.pq_subspaces and here.sum() <= 3 * self.options.nlist:
                return flat_search(rows, queries, k, self.metric)  # so few that scoring them all is cheaper
            live = self.collection.size
        return lists.scan(rows, queries, self.model, k, self.options.nprobe, here, live, self.filter_probe_scaling)

    def _direct(self, rows: DataFrame, filtered: bool, factor: int = 6) -> tuple[bool, int]:
        if not filtered:
            return False, 0
        n = rows.limit(factor * self.options.nlist + 1).count()
        return n <= factor * self.options.nlist, n

    def _model(self) -> dict[str, np.ndarray]:
        m = self.model
        return {} if m is None else {n: getattr(m, n) for n in m.arrays} | {"book": m.book.centroids if m.book is not None else None}

    def _extra(self) -> dict:
        m = self.model
        return {} if m is None else {"bits": m.bits, "fast_scan": m.fast_scan, "inner": bool(m.inner), "symmetric": m.symmetric}

    def _restore(self, model: dict[str, np.ndarray], extra: dict) -> None:
        if model:
            book = model.pop("book", None)
            self.model = lists.Model(
                self.collection.metric, book=None if book is None else PQCodebook(book), **model, **{n: extra[n] for n in ("bits", "fast_scan", "inner", "symmetric")}
            )


def _scalar(model: lists.Model, vectors: DataFrame, bits: int, cosine: bool) -> None:
    from vexil.functions.kernels import normalized

    q = ScalarQuantizer.train(vectors.withColumn("vector", normalized(F.col("vector"))) if cosine else vectors, bits)
    model.low, model.step, model.bits = np.array(q.vmin), np.array(q.step), bits


class HNSWIndex(Index):
    """Graphs over at most about ``GRAPH_ROWS`` rows each, built once; with ``hnsw_sq_bits`` over scalar codes."""

    kind = IndexType.HNSW

    def __init__(self, spark: SparkSession, dim: int, options: Options | None = None, sparse: bool = False, collection: Collection | None = None):
        super().__init__(spark, dim, options, sparse, collection)
        require(self.options.hnsw_m >= 2 and self.options.ef_search >= 1, "M is at least 2 and ef_search at least 1")
        require(self.options.hnsw_sq_bits in (0, 4, 8), "bits are 4 or 8")
        self.model = None
        self._graphs, self._built, self.filter_ef_scaling = None, 0, True
        if self.options.hnsw_sq_bits:
            self.collection.encode = self._encode

    def _scores(self) -> bool:
        return not self.options.hnsw_sq_bits

    def enable_sq(self, bits: int) -> None:
        require(self.model is None and not self.collection.slots, "only before training and adding", RuntimeError)
        require(bits in (4, 8), "bits are 4 or 8")
        self.options.hnsw_sq_bits = bits
        self.collection.encode = self._encode

    def train(self, vectors: DataFrame) -> None:
        """Ranges of the scalar codes."""
        require(bool(self.options.hnsw_sq_bits), "there is nothing to train without codes", RuntimeError)
        require(self.model is None and not self.collection.slots, "train once, before adding", RuntimeError)
        model = lists.Model(self.collection.metric, np.zeros((0, self.collection.dim)))
        _scalar(model, vectors, self.options.hnsw_sq_bits, self.collection.metric == Metric.COSINE)
        self.model = model

    def _encode(self, df: DataFrame) -> DataFrame:
        require(self.model is not None, "train before adding", RuntimeError)
        return lists.encode(df, self.model, lists=False)

    def with_settings(self, **options) -> Index:
        self._segments()  # graphs are built once, not in every view
        return super().with_settings(**options)

    def compact(self) -> int:
        require(not self.wrapped, "this part belongs to another index: write to that one")
        freed = self.collection.compact()
        self._graphs, self._built = None, 0
        return freed

    def _segments(self) -> DataFrame | None:
        """(part, slots, ids, graph): builds what was added since; parts never mix rows of two builds."""
        slots = self.collection.slots
        if slots > self._built:
            o, model, metric, dim = self.options, self.model, self.collection.metric, self.collection.dim
            first, parts = self._built, max(1, -(-(slots - self._built) // GRAPH_ROWS))
            coded = bool(o.hnsw_sq_bits)
            shipped = self.spark.sparkContext.broadcast(model)

            def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
                import pickle

                order = np.argsort(rows.column("slot").to_numpy(), kind="stable")
                m = shipped.value
                x = m.low + m.unpacked(rows.column("value").combine_chunks()) * m.step if coded else as_matrix(rows.column("value"), dim)
                x = x[order]
                graph = Graph(x, o.hnsw_m, o.ef_construction, 1, metric == Metric.INNER_PRODUCT)
                slot, ident = rows.column("slot").to_numpy()[order], rows.column("id").to_numpy()[order]
                return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "graph": pa.array([pickle.dumps((slot, ident, graph))], pa.binary())})

            new = self.collection.rows.where(F.col("slot") >= first)
            value = F.col("__codes") if coded else F.col("vector").cast("array<double>")
            dealt = new.select((F.pmod(F.xxhash64("slot"), F.lit(parts)) + F.lit(first)).alias("part"), "slot", "id", value.alias("value"))
            built = materialize(dealt.groupBy("part").applyInArrow(build, "part long, graph binary"))
            self._graphs = built if self._graphs is None else self._graphs.unionByName(built)
            self._parts = [*(self._parts if self._built else []), (first, slots, parts)]
            self._built = slots
        return self._graphs

    def _hits(self, queries: DataFrame, k: int, rows: DataFrame, filtered: bool) -> DataFrame:
        graphs = self._segments()
        if graphs is None:
            return flat_search(rows, queries, k, self.metric)
        ef, half = self.options.ef_search, 0.5 if self.metric == Metric.COSINE else 1.0
        # the part of a live row follows from its slot
        part = F.lit(None).cast("long")
        for first, end, parts in self._parts:
            part = F.when((F.col("slot") >= first) & (F.col("slot") < end), F.pmod(F.xxhash64("slot"), F.lit(parts)) + F.lit(first)).otherwise(part)
        live = rows.select(part.alias("part"), "slot")
        hits = None
        for qids, q in query_blocks(queries) if k > 0 else ():
            q = unit_rows(q) if self.metric == Metric.COSINE else q
            shipped = self.spark.sparkContext.broadcast((qids, q))

            some = graphs.groupBy("part").cogroup(live.groupBy("part")).applyInArrow(_finder(shipped, k, ef, half, self.filter_ef_scaling), lists.HITS)
            hits = some if hits is None else hits.unionByName(some)
        if hits is None:
            return flat_search(rows, queries, 0, self.metric)
        return top_k(hits, k)

    def _model(self) -> dict[str, np.ndarray]:
        return {} if self.model is None else {"low": self.model.low, "step": self.model.step}

    def _restore(self, model: dict[str, np.ndarray], extra: dict) -> None:
        if model:
            self.model = lists.Model(self.collection.metric, np.zeros((0, self.collection.dim)), **model, bits=self.options.hnsw_sq_bits)


def _finder(shipped, k: int, ef: int, half: float, scaling: bool = True):
    """(graphs of a part, slots of its live rows) to the part's hits."""

    def find(blobs: pa.Table, live: pa.Table) -> pa.Table:
        import pickle

        qids, q = shipped.value
        out = []
        for blob in blobs.column("graph"):
            slot, ident, graph = pickle.loads(blob.as_py())
            ok = np.isin(slot, live.column("slot").to_numpy())
            for qid, v in zip(qids, q):
                out += [(int(qid), int(slot[i]), int(ident[i]), d * half) for d, i in graph.search(v, k, ef, None if ok.all() else ok, scaling)]
        kinds = [("qid", pa.int64()), ("slot", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())]
        return pa.table({n: pa.array([o[j] for o in out], t) for j, (n, t) in enumerate(kinds)})

    return find


class RefineIndex(Index):
    """Re-scores ``k * k_factor`` candidates of another index exactly; shares its rows and owns its writes."""

    def __init__(self, base: Index, k_factor: int = 10):
        require(not isinstance(base, RefineIndex) and not base.wrapped, "a part belongs to one index")
        require(not base.collection.slots, "the base has rows already")
        require(k_factor >= 1, "k_factor is at least 1")
        super().__init__(base.spark, None, base.options, collection=base.collection)
        self.base, self.k_factor, self.kind = base, k_factor, base.kind
        base.wrapped = True
        self.collection.describe = lambda path: base._describe(path) | {"refine": self.k_factor}

    def train(self, *args, **options) -> None:
        self.base.train(*args, **options)

    def with_settings(self, k_factor: int | None = None, **options) -> Index:
        view = super().with_settings(**options)
        view.base, view.k_factor = self.base.with_settings(**options), k_factor or self.k_factor
        return view

    def compact(self) -> int:
        self.base.wrapped = False
        try:
            return self.base.compact()
        finally:
            self.base.wrapped = True

    def _hits(self, queries: DataFrame, k: int, rows: DataFrame, filtered: bool) -> DataFrame:
        if self.base._direct(rows, filtered, 6)[0]:
            return flat_search(rows, queries, k, self.metric)
        asked = queries
        if self.metric == Metric.COSINE:
            from vexil.functions.kernels import normalized

            asked = queries.withColumn("vector", normalized(F.col("vector").cast("array<double>")))
        return refine(self.base._hits(queries, k * self.k_factor, rows, filtered), rows, asked, k, self.metric)


class InvertedIndex(Index):
    """Exact sparse search over rows with ``terms``; queries are (qid, terms) or (qid, term, weight)."""

    kind = IndexType.SPARSE

    def __init__(self, spark: SparkSession, dim: int | None = None, options: Options | None = None, collection: Collection | None = None):
        super().__init__(spark, None, options, True, collection)
        self.pruning = False  # the same results by bounds on the terms' weights

    def _postings(self, rows: DataFrame) -> DataFrame:
        return sparse.canonical(rows.select("id", "terms")).join(rows.select("id", "slot"), "id")

    @staticmethod
    def _asked(queries: DataFrame) -> DataFrame:
        return sparse.canonical(queries.select("qid", "terms") if "terms" in queries.columns else queries, "qid")

    def query(self, terms: dict[int, float], k: int, where=None, allowed: DataFrame | None = None) -> DataFrame:
        one = self.spark.createDataFrame([(0, int(t), float(w)) for t, w in terms.items()], "qid long, term long, weight double")
        return self.batch_query(one, k, where, allowed).drop("qid").orderBy("rank")

    def batch_query(self, queries: DataFrame, k: int, where=None, allowed: DataFrame | None = None, pad: bool = False) -> DataFrame:
        hits = self._hits(queries, k, self.collection.allowed(where, allowed), where is not None or allowed is not None)
        return padded(hits, queries.select("qid").distinct(), k) if pad else hits

    def _hits(self, queries: DataFrame, k: int, rows: DataFrame, filtered: bool) -> DataFrame:
        return sparse.scan_search(rows, self._asked(queries), k, self.pruning)

    def counts(self) -> tuple[int, int]:
        """(terms, postings)."""
        return tuple(sparse.canonical(self.collection.rows).agg(F.countDistinct("term"), F.count(F.lit(1))).first())


class SparseApproxIndex(InvertedIndex):
    """Keeps its postings with their places in their lists; what was added since is always read, and merged
    when it is more than 64 rows and more than an eighth of those that are sorted (at most 4,096)."""

    kind = IndexType.SPARSE_APPROX

    def __init__(self, spark: SparkSession, dim: int | None = None, options: Options | None = None, collection: Collection | None = None):
        super().__init__(spark, dim, options, collection)
        self._sorted, self._end, self._count = None, 0, 0

    def settle(self) -> None:
        """Rank the postings of all rows."""
        rows = self.collection.rows
        self._sorted, self._end, self._count = materialize(sparse.ranked_postings(self._postings(rows))), self.collection.slots, rows.count()

    def compact(self) -> int:
        require(not self.wrapped, "this part belongs to another index: write to that one")
        freed = self.collection.compact()
        self._sorted, self._end, self._count = None, 0, 0
        return freed

    def _hits(self, queries: DataFrame, k: int, rows: DataFrame, filtered: bool) -> DataFrame:
        o, every = self.options, 2**31 - 1  # 0 stands for all
        if not o.query_terms and not o.list_depth:  # all terms and postings: the candidates' scores are the exact ones
            return sparse.scan_search(rows, self._asked(queries), k)
        if self.collection.slots - self._end > max(64, min(self._count // 8, 4096)) or self._sorted is None:
            self.settle()
        postings = self._sorted
        if self.collection.slots > self._end:
            postings = postings.unionByName(self._postings(rows.where(F.col("slot") >= self._end)).withColumn("place", F.lit(0)))
        if filtered:  # places are among the rows that may be found
            postings = sparse.ranked_postings(postings.drop("place").join(rows.select("id"), "id", "left_semi"))
        else:
            postings = postings.join(rows.select("slot"), "slot", "left_semi")
        return sparse.sparse_approx_search(postings, self._asked(queries), k, o.query_terms or every, o.list_depth or every, o.k_factor)


class HybridIndex(Index):
    """A dense index whose rows carry ``terms`` as well; queries are (qid, vector, terms)."""

    kind = IndexType.HYBRID

    def __init__(self, dense: Index, method: str = "linear", weights: tuple[float, float] = (1.0, 1.0), rrf_k: float = 60.0, depth_factor: int = 5):
        require(dense.collection.sparse and dense.collection.dim is not None, "the dense part needs rows with terms (sparse=True)")
        require(not dense.wrapped, "a part belongs to one index")
        describe = dense.collection.describe
        super().__init__(dense.spark, None, dense.options, collection=dense.collection)
        self.dense, self.sparse_part = dense, InvertedIndex(dense.spark, options=dense.options, collection=dense.collection)
        self.collection.describe = lambda path: describe(path) | {"hybrid": {"method": self.method, "weights": list(self.weights), "rrf_k": self.rrf_k, "depth_factor": self.depth_factor}}
        self.method, self.weights, self.rrf_k, self.depth_factor = method, tuple(weights), rrf_k, depth_factor
        dense.wrapped = self.sparse_part.wrapped = True

    def _lists(self, queries: DataFrame, k: int, where=None, allowed: DataFrame | None = None) -> DataFrame:
        n = k * self.depth_factor
        return fusion.as_lists(self.dense.batch_query(queries.select("qid", "vector"), n, where, allowed), self.sparse_part.batch_query(queries.select("qid", "terms"), n, where, allowed))

    def batch_query(self, queries: DataFrame, k: int, where=None, allowed: DataFrame | None = None, pad: bool = False) -> DataFrame:
        """(qid, rank, id, score), best first."""
        require(not pad, "scores aren't padded")
        return fusion.fuse(self._lists(queries, k, where, allowed), list(self.weights), self.method, k, self.rrf_k)

    def query(self, vector: list[float], terms: dict[int, float], k: int, where=None, allowed: DataFrame | None = None) -> DataFrame:
        pairs = [(int(t), float(w)) for t, w in terms.items()]
        one = self.spark.createDataFrame([(0, [float(x) for x in vector], pairs)], "qid long, vector array<double>, terms array<struct<term:bigint,weight:double>>")
        return self.batch_query(one, k, where, allowed).drop("qid").orderBy("rank")

    def tune_weights(self, queries: DataFrame, labels: DataFrame, k: int, metric: str = "ndcg", grid: list[tuple[float, float]] | None = None) -> tuple[float, float]:
        """Sets and returns the weights whose mean metric over the labelled queries is best; the lists are retrieved once."""
        fusion.check_labels(labels)
        self.weights = fusion.tune_weights(self._lists(queries, k), labels, k, metric, self.method, grid)[0][0]
        return self.weights


_TYPES = {IndexType.FLAT: FlatIndex, IndexType.IVF: IVFIndex, IndexType.HNSW: HNSWIndex, IndexType.SPARSE: InvertedIndex, IndexType.SPARSE_APPROX: SparseApproxIndex}


def make_index(spark: SparkSession, kind: IndexType | str, dim: int | None = None, **options) -> Index:
    """An empty index of a type; a hybrid one is made from its dense part."""
    kind = IndexType(kind)
    require(kind in _TYPES, "make a hybrid index from its dense part")
    if "metric" in options:
        options["metric"] = Metric(options["metric"])
    return _TYPES[kind](spark, dim, Options(**options))


def preset(spark: SparkSession, name: str, vectors: DataFrame, metric: Metric = Metric.COSINE, custom_ids: bool = False) -> Index:
    """flat, hnsw, or ivf-pq: lists by the square root of the rows, 4-bit codes of pairs, exact re-scoring of 4 k."""
    dim = vectors.select(F.size("vector")).first()[0]
    options = {"metric": metric, "custom_ids": custom_ids}
    if name in ("flat", "hnsw"):
        return make_index(spark, name, dim, **options)
    require(name == "ivf-pq", "presets are flat, hnsw and ivf-pq")
    n = vectors.count()
    require(n >= 1000 and dim % 2 == 0, "ivf-pq needs 1,000 vectors of even dimension to train on")
    index = RefineIndex(make_index(spark, "ivf", dim, nlist=max(100, round(n**0.5)), pq_subspaces=dim // 2, pq_fast_scan=True, **options), 4)
    index.train(vectors)
    return index


def _attached(spark: SparkSession, path: str, c: Collection) -> Index:
    about = Folder(spark, path).read("MANIFEST.json").get("index")
    require(about is not None, "a collection without an index", RuntimeError)
    options = Options(**about["options"] | {"metric": Metric(about["options"]["metric"])})
    model = {}
    if about["model"]:
        for r in spark.read.parquet(f"{path}/{about['model']}").collect():  # a handful of arrays
            model[r["name"]] = np.frombuffer(r["value"], np.float64).reshape(r["shape"])
    held, c._state = c._state, type(c._state)(c._state.rows)  # parts are checked as for an empty index
    kind = _TYPES[IndexType(about["kind"])]
    index = kind(spark, c.dim, options, collection=c)
    index._restore(model, about)
    if about.get("refine"):
        index = RefineIndex(index, about["refine"])
    if about.get("hybrid"):
        index = HybridIndex(index, **about["hybrid"])
    c._state = held
    return index


def load_index(spark: SparkSession, path: str, mapped: bool = True) -> Index:
    return _attached(spark, path, load(spark, path, mapped))


def open_index(spark: SparkSession, path: str, mapped: bool = True) -> tuple[Index, Store]:
    """The index as its log leaves it, and the store to write through."""
    made: list[Index] = []
    store = Store.open(spark, path, mapped, lambda c: made.append(_attached(spark, path, c)))
    return made[0], store


def rebuild(index: Index, into: Index) -> DataFrame:
    """Add all live rows of one index to another, in the order of their slots; returns the new ids."""
    own = {"slot", "__list", "__codes"} | (set() if into.options.custom_ids else {"id"})
    rows = index.collection.rows.orderBy("slot")
    return into.add(rows.select(*(c for c in rows.columns if c not in own)))


def set_num_threads(spark: SparkSession, n: int) -> None:
    """The number of tasks of a shuffle; 0 leaves the session's own."""
    require(n >= 0, "a number of threads isn't negative")
    if n:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))

