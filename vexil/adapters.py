"""A document store over a collection: texts, embeddings, metadata filters, hybrid and MMR search (A1-A16)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.collection import Collection
from vexil.functions.predicate import Expr, IsNull, Not, all_of, any_of, as_expr, field
from vexil.indexes import Index, load_index, make_index, open_index, preset
from vexil.materialize import materialize
from vexil.operators.fusion import as_lists, check_labels, fuse, tune_weights
from vexil.operators.hnsw import mmr
from vexil.operators.sparse import BM25, sparse_search
from vexil.sources.store import Folder
from vexil.types import Metric, require

#: The column of documents' own ids, where those are strings.
KEY = "doc_key"


class SparseEncoder(Protocol):
    """Texts to (id, term, weight) rows."""

    def document_weights(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame: ...

    def query_weights(self, queries: DataFrame, id_col: str, text_col: str) -> DataFrame: ...


#: Operators that no column answers; they are checked against a document's whole metadata.
BY_DOCUMENT = ("text_match", "text_match_insensitive", "contains", "any", "all")


def filters(spec, known=None) -> Expr:
    """A dict (a list means any of), SQL, (SQL, parameters), an Expr, or nested {condition, filters: [...]}.

    ``known`` are the metadata columns: in nested filters a key that none has matches !=, nin and is_empty
    only. Operators of BY_DOCUMENT raise NotImplementedError.
    """
    if isinstance(spec, dict) and "filters" in spec:
        terms = [filters(f, known) for f in spec["filters"]]
        if not terms:
            return Constant(True)
        how = spec.get("condition", "and").lower()
        return {"and": lambda: all_of(*terms), "or": lambda: any_of(*terms), "not": lambda: Not(any_of(*terms))}[how]()
    if isinstance(spec, dict) and "key" in spec:
        return _leaf(spec["key"], spec.get("operator", "==").lower(), spec.get("value"), known)
    if isinstance(spec, dict):
        return all_of(*(field(k).isin(v) if isinstance(v, (list, tuple)) else field(k) == v for k, v in spec.items()))
    return as_expr(spec)


class Constant(Expr):
    """Every row, or none."""

    def __init__(self, value: bool):
        self.value = value

    def column(self, schema):
        return F.lit(self.value)

    def __repr__(self) -> str:
        return str(self.value).upper()


class _Empty(Expr):
    """No value, or an empty string."""

    def __init__(self, name: str):
        self.name = name

    def column(self, schema):
        test = IsNull(self.name).column(schema)
        return test | (field(self.name) == "").column(schema) if schema[self.name].dataType.simpleString() == "string" else test

    def __repr__(self) -> str:
        return f"{self.name} IS EMPTY"


def _leaf(key: str, op: str, value, known) -> Expr:
    if op in BY_DOCUMENT:
        raise NotImplementedError(f"{op} isn't a filter of columns")
    if known is not None and key not in known:  # no document has it
        return Constant(op in ("!=", "nin", "is_empty"))
    f, missing = field(key), IsNull(key)
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    table = {
        "==": lambda: f == value, ">": lambda: f > value, ">=": lambda: f >= value, "<": lambda: f < value, "<=": lambda: f <= value,
        "in": lambda: f.isin(values), "!=": lambda: (f != value) | missing, "nin": lambda: ~f.isin(values) | missing, "is_empty": lambda: _Empty(key),
    }
    if op not in table:
        raise ValueError(f"unsupported filter: {op}")
    return table[op]()


def matches(spec: dict, metadata: dict) -> bool:
    """The same filters, and those of BY_DOCUMENT, against one document's metadata."""
    if "filters" in spec:
        hits = [matches(f, metadata) for f in spec["filters"]]
        how = spec.get("condition", "and").lower()
        return all(hits) if how == "and" else any(hits) if how == "or" else not any(hits)
    there, value, op = metadata.get(spec["key"]), spec.get("value"), spec.get("operator", "==").lower()
    if op == "is_empty":
        return there is None or there == "" or there == []
    if there is None:
        return op in ("!=", "nin")
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    held = there if isinstance(there, list) else [there]
    tests = {
        "==": lambda: there == value, "!=": lambda: there != value, ">": lambda: there > value, ">=": lambda: there >= value, "<": lambda: there < value, "<=": lambda: there <= value,
        "in": lambda: there in values, "nin": lambda: there not in values, "text_match": lambda: value in there, "text_match_insensitive": lambda: value.lower() in there.lower(),
        "contains": lambda: value in held, "any": lambda: any(v in held for v in values), "all": lambda: all(v in held for v in values),
    }
    if op not in tests:
        raise ValueError(f"unsupported filter: {op}")
    return bool(tests[op]())


Embed = Callable[[DataFrame], DataFrame]


class DocumentStore:
    """Texts with vectors and metadata over an index.

    With ``string_ids`` documents are known by strings, made up where none are given; the index numbers
    its rows itself.  With ``persist_directory`` the documents there are opened, and later writes are logged there.

    ``index`` is a preset (flat, hnsw, ivf-pq) or an empty index with custom ids;
    ivf-pq trains on the first rows added.  ``embed`` adds ``vector`` to rows with
    ``text``; ``encoder`` makes sparse weights of texts, BM25 over the store's own
    texts if none is given.
    """

    def __init__(self, spark: SparkSession, dim: int, embed: Embed | None = None, metric: Metric = Metric.COSINE, index: str | Index = "flat", encoder: SparseEncoder | None = None, string_ids: bool = False, persist_directory: str | None = None):
        self.spark, self.dim, self.embed, self.metric, self._encoder, self.string_ids = spark, dim, embed, metric, encoder, string_ids
        self.persist_directory, self._store = persist_directory, None
        if persist_directory and Folder(spark, persist_directory).exists("MANIFEST.json"):
            index, self._store = open_index(spark, persist_directory)
        self._preset = index if isinstance(index, str) else None
        self.index: Index | None = None if self._preset == "ivf-pq" else make_index(spark, index, dim, metric=metric, custom_ids=not string_ids) if self._preset else index
        require(self.index is None or self.index.options.custom_ids != string_ids, "a document store needs custom ids, or string ids and none")
        self._bm25: BM25 | None = None

    @property
    def collection(self) -> Collection:
        return self.index.collection if self.index is not None else Collection(self.spark, self.dim, self.metric, custom_ids=True)

    def _embedded(self, rows: DataFrame) -> DataFrame:
        return self.embed(rows) if self.embed is not None and "vector" not in rows.columns and "text" in rows.columns else rows

    def add(self, docs: DataFrame) -> DataFrame:
        """Rows (id, text, vector unless there is ``embed``, metadata...); an id that is there is replaced.

        The metadata are kept as JSON as well.
        """
        if self.string_ids:
            given = F.col("id").cast("string") if "id" in docs.columns else F.lit(None).cast("string")
            docs = materialize(docs.withColumn(KEY, F.coalesce(given, F.expr("uuid()"))).drop("id"))
            require(not docs.groupBy(KEY).count().where("count > 1").limit(1).count(), "repeated ids")
        names = [c for c in docs.columns if c not in ("id", "text", "vector", KEY)]
        docs = self._embedded(docs.withColumn("meta_json", F.to_json(F.struct(*names)) if names else F.lit("{}")))
        if self.index is None:
            self.index = preset(self.spark, self._preset, docs, self.metric, custom_ids=not self.string_ids)
        self._bm25 = None
        if self.persist_directory and self._store is None:
            self._store = self.index.persist(self.persist_directory)
        writer = self._store or self.index
        known = {f.name for f in self.collection.rows.schema}
        if not self.string_ids:
            gone = self.collection.rows.join(docs.select(F.col("id").cast("long").alias("id")), "id", "left_semi")
        elif KEY in known:
            gone = self.collection.rows.join(docs.select(KEY), KEY, "left_semi")
        else:
            gone = None
        if gone is not None and not gone.isEmpty():
            writer.remove(gone.select("id"))
        added = writer.add(docs)
        return docs.select(F.col(KEY).alias("id")) if self.string_ids else added

    def add_texts(self, texts: list[str], metadatas: list[dict] | None = None, ids: list | None = None) -> list:
        """Embed and add texts; returns their ids."""
        require(self.embed is not None, "texts need embed")
        require(ids is not None or self.string_ids, "ids are missing")
        metadatas = metadatas or [{}] * len(texts)
        require(len(metadatas) == len(texts) and (ids is None or len(ids) == len(texts)), "as many ids and metadata as texts")
        ids = list(ids) if ids is not None else [str(uuid.uuid4()) for _ in texts]
        if not texts:
            return []
        names = sorted({k for m in metadatas for k in m})
        kinds = {bool: "long", int: "long", float: "double", str: "string"}

        def kind(name: str) -> str:
            found = {kinds.get(type(m[name]), "string") for m in metadatas if m.get(name) is not None}
            return "double" if found == {"long", "double"} else found.pop() if len(found) == 1 else "string"

        schema = ", ".join(["id " + ("string" if self.string_ids else "long"), "text string", *(f"`{n}` {kind(n)}" for n in names)])
        cast = {"long": int, "double": float, "string": lambda v: v if isinstance(v, str) else json.dumps(v)}
        rows = [(i, t, *(None if m.get(n) is None else cast[kind(n)](m[n]) for n in names)) for i, t, m in zip(ids, texts, metadatas)]
        self.add(self.spark.createDataFrame(rows, schema))
        return ids

    def _numbers(self, ids: list) -> DataFrame:
        """The rows' own numbers of these ids, unknown ones left out."""
        if not self.string_ids:
            return self.spark.createDataFrame([(int(i),) for i in set(ids)], "id long")
        asked = self.spark.createDataFrame([(str(i),) for i in set(ids)], f"{KEY} string")
        return self.collection.rows.join(F.broadcast(asked), KEY, "left_semi").select("id")

    def _named(self, hits: DataFrame) -> DataFrame:
        """Hits by the documents' own ids."""
        if not self.string_ids:
            return hits
        return F.broadcast(hits).join(self.collection.rows.select("id", KEY), "id").select(*(F.col(KEY).alias("id") if c == "id" else F.col(c) for c in hits.columns))

    def _selected(self, ids: list | None = None, where=None, doc_ids: list[str] | None = None) -> DataFrame:
        """Rows by ids and filter; what no column answers is checked document by document, row at a time."""
        rows = self.collection.rows if ids is None else self.collection.rows.join(F.broadcast(self._numbers(ids)), "id", "left_semi")
        try:
            condition = self._condition(where, doc_ids)
            return rows if condition is None else rows.where(condition.column(rows.schema))
        except NotImplementedError:
            if doc_ids is not None:
                rows = rows.where(self._condition(None, doc_ids).column(rows.schema))
            test = F.udf(lambda m: matches(where, json.loads(m)), "boolean")
            return rows.where(test("meta_json"))

    def get(self, ids: list | None = None, where=None) -> list[dict]:
        """Documents by ids, in their order (unknown and repeated ids are errors), or by filter."""
        if self.index is None:
            return []
        key = KEY if self.string_ids else "id"
        if ids is not None:
            require(len(set(ids)) == len(ids), "repeated ids")
        rows = self._selected(ids, where).orderBy("slot").collect()
        if ids is not None and where is None:
            require(len(rows) == len(ids), "unknown ids")
        place = {i: n for n, i in enumerate(ids or [])}
        rows = sorted(rows, key=lambda r: place.get(r[key], 0))
        return [{"id": r[key], "text": r["text"], "metadata": json.loads(r["meta_json"])} for r in rows]

    def count(self, ids: list | None = None, where=None, doc_ids: list[str] | None = None) -> int:
        """How many documents ``delete`` would take; none of them comes to the driver."""
        return 0 if self.index is None else self._selected(ids, where, doc_ids).count()

    def delete(self, ids: list | None = None, where=None, doc_ids: list[str] | None = None) -> int:
        """By ids, by source documents (metadata ``ref_doc_id``), by filter, or by several of them; all rows without any."""
        self._bm25 = None
        if self.index is None:
            return 0
        return (self._store or self.index).remove(self._selected(ids, where, doc_ids).select("id"))

    def clear(self) -> int:
        return self.delete()

    def _condition(self, where=None, doc_ids: list[str] | None = None) -> Expr | None:
        terms = [filters(where, self.collection.rows.columns)] if where is not None else []
        terms += [field("ref_doc_id").isin(doc_ids)] if doc_ids is not None else []
        return all_of(*terms) if terms else None

    def encoder(self) -> SparseEncoder:
        if self._encoder is not None:
            return self._encoder
        if self._bm25 is None:
            self._bm25 = BM25().added(self.collection.rows, "id", "text")
        return self._bm25

    def _sides(self, where, ids, doc_ids, settings):
        """Dense and sparse search under the same restrictions, each by (queries, k)."""
        condition = self._condition(where, doc_ids)
        allowed = None if ids is None else self._numbers(ids)
        index = self.index.with_settings(**settings) if settings else self.index
        dense = lambda queries, n: index.batch_query(self._embedded(queries), n, condition, allowed)

        def sparse(queries, n):
            rows, encoder = self.collection.allowed(condition, allowed), self.encoder()
            postings = encoder.document_weights(rows, "id", "text").join(rows.select("id", "slot"), "id")
            return sparse_search(postings, encoder.query_weights(queries, "qid", "text"), n)

        return dense, sparse

    def search(
        self, queries: DataFrame, k: int, mode: str = "default", where=None, alpha: float = 0.5, depth: int = 5, method: str = "linear",
        ids: list | None = None, doc_ids: list[str] | None = None, fetch_k: int = 20, trade: float = 0.5, **settings,
    ) -> DataFrame:
        """queries: (qid, vector and/or text). Modes: default, sparse, text_search, hybrid (weights alpha and 1 - alpha),
        mmr (k of the ``fetch_k`` nearest, each near the query and, by 1 - ``trade``, far from those before it).

        ``settings`` (nprobe, ef_search, k_factor) hold for this search only.
        """
        require(mode in ("default", "sparse", "text_search", "hybrid", "mmr"), "mode is default, sparse, text_search, hybrid or mmr")
        require(self.index is not None, "the store is empty")
        dense, sparse = self._sides(where, ids, doc_ids, settings)
        if mode == "default":
            return self._named(dense(queries, k))
        if mode == "mmr":
            return self._named(self._diverse(self._embedded(queries), dense, k, max(fetch_k, k), trade))
        if mode != "hybrid":
            return self._named(sparse(queries, k))
        return self._named(fuse(as_lists(dense(queries, k * depth), sparse(queries, k * depth)), [alpha, 1 - alpha], method, k))

    def _diverse(self, queries: DataFrame, dense, k: int, fetch_k: int, trade: float) -> DataFrame:
        """Each query's fetch_k candidates meet in one group, bounded by fetch_k."""
        near = dense(queries, fetch_k).join(self.collection.rows.select("id", "vector"), "id").join(queries.select("qid", F.col("vector").cast("array<double>").alias("q")), "qid")

        def choose(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("rank")
            at = mmr(np.array(rows.column("vector").to_pylist()), np.array(rows.column("q")[0].as_py()), k, trade)
            picked = rows.select(["qid", "id", "distance"]).take(pa.array(at))
            return picked.add_column(1, "rank", pa.array(np.arange(1, len(at) + 1, dtype=np.int32)))

        return near.select("qid", "rank", "id", "distance", "vector", "q").groupBy("qid").applyInArrow(choose, "qid long, rank int, id long, distance double")

    def tune_hybrid_weights(self, queries: DataFrame, labels: DataFrame, k: int, metric: str = "ndcg", depth: int = 5, method: str = "linear") -> float:
        """The alpha whose mean metric over labels (qid, id, grade) is best."""
        check_labels(labels)
        dense, sparse = self._sides(None, None, None, {})
        return tune_weights(as_lists(dense(queries, k * depth), sparse(queries, k * depth)), labels, k, metric, method)[0][0][0]

    def search_mmr(self, vector: list[float], k: int, fetch_k: int = 20, trade: float = 0.5, where=None) -> list:
        """Ids by maximal marginal relevance among the fetch_k nearest."""
        one = self.spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, vector array<double>")
        return [r["id"] for r in self.search(one, k, "mmr", where, fetch_k=fetch_k, trade=trade).orderBy("rank").collect()]

    def save(self, path: str) -> None:
        require(self.index is not None, "the store is empty")
        self.index.save(path)

    def checkpoint(self) -> None:
        require(self._store is not None, "the store has no persist_directory")
        self._store.checkpoint()

    @classmethod
    def load(cls, spark: SparkSession, path: str, embed: Embed | None = None, encoder: SparseEncoder | None = None) -> DocumentStore:
        index = load_index(spark, path)
        return cls(spark, index.dim, embed, index.metric, index, encoder, string_ids=not index.options.custom_ids)


def relevance(distance: float, metric: Metric) -> float:
    """A score from 0 to 1 for cosine, 1 / (1 + d) for L2, the product itself otherwise."""
    if metric == Metric.COSINE:
        return 1 - distance / 2
    return 1 / (1 + distance) if metric == Metric.L2 else -distance
