"""Exact top-k inner-product search by no-random-access aggregation.

Each shard of candidates keeps one list per dimension, sorted by value.  Lists
are read in sequence, in rounds of growing depth, the same in each list: a query
reads a list from the top where its weight is positive, from the bottom where it
is negative.  What has been read bounds every candidate's score: a component not
yet read lies between the list's far end and the value last read.  Entries not
yet read are not used; the bounds of all queries and candidates of a task are
matrix products over what was read.  Reading stops, query by query, when so few
candidates have an upper bound that reaches the k-th best lower bound that the
others, seen or not, cannot qualify; the scores of those left are then resolved
exactly, in integers.  Candidates that no open query can use any more are left
out of later rounds.  Without such a stop the lists are read to their end, where
the bounds are the scores.

Queries are a stated share of all rows, dealt into groups; candidates are dealt
into shards; each (shard, group) is one task, and each gives at most k rows per
query.  Neither side is broadcast or collected.  Components travel in two bytes
each where they fit.

Vectors are floor(scale * x) in double precision.  Defined results: a vector
that is null, empty, or holds a null or non-finite component takes no part;
queries meet candidates of their own length only; ties go to the smaller id; a
query's own row is never its candidate, nor is another row with its id; each of
several query rows with one id gets its own ranks; repeated candidate ids count
as a row each; null ids take no part; fewer candidates than k give fewer rows; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexil.llm._store import materialize
from vexil.llm._vectors import matrix

#: Shares of a list read by the end of each round.
ROUNDS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1.0)


class _Lists:
    """Sorted lists of a shard, and what has been read of them from either end."""

    def __init__(self, rows: np.ndarray, kind: type):
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, self.order, axis=0)
        self.read, self.kind, self.depth = np.full((2, *rows.shape), np.nan, kind), kind, 0

    def advance(self, depth: int) -> None:
        n = len(self.values)
        for side, part in ((0, slice(n - depth, n - self.depth)), (1, slice(self.depth, depth))):
            np.put_along_axis(self.read[side], self.order[part], self.values[part].astype(self.kind), axis=0)
        self.depth = depth

    def bounds(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(high, low) components, first as read from the top and then as read from the bottom, of the candidates left."""
        ends = np.stack([self.values[0], self.values[-1]]).astype(self.kind)
        last = np.stack([self.values[-self.depth], self.values[self.depth - 1]]).astype(self.kind)
        read = self.read[:, left]
        fill = lambda x: np.concatenate(np.where(np.isnan(read), x[:, None, :], read), axis=1)
        return fill(last), fill(ends)


def nra(queries: np.ndarray, names: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, rounds=ROUNDS, block: int = 512):
    """(query position, id, score) of each query's k best rows, ties to smaller ids; whole numbers, as doubles.

    With it the share of the list entries that each query read.
    """
    n, dim = rows.shape
    largest = (np.abs(rows).max() if rows.size else 0) * (np.abs(queries).max() if queries.size else 0) * dim
    exact = largest < 2**53
    kind = np.float32 if largest < 2**24 else np.float64
    slack = 0.0 if exact else largest * 1e-12
    weights = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1).astype(kind)
    lists, share = _Lists(rows, kind), np.ones(len(queries))
    open_, left, out = np.arange(len(queries)), np.arange(n), []

    def resolve(q: int, few: np.ndarray) -> None:
        if exact:
            score = (rows[few] @ queries[q]).astype(np.int64)
        else:  # beyond doubles' whole numbers: Python's own integers
            wide = [int(x) for x in queries[q]]
            score = np.array([sum(int(x) * y for x, y in zip(r, wide)) for r in rows[few]], object)
        best = sorted(range(len(few)), key=lambda i: (-int(score[i]), int(ids[few[i]])))[:k]
        out.extend((q, int(ids[few[i]]), int(score[i])) for i in best)

    for depth in rounds:
        if not len(open_):
            break
        lists.advance(max(lists.depth, min(n, max(k + 1, int(np.ceil(n * depth))))))
        whole = lists.depth == n
        high, low = lists.bounds(left)
        still, wanted = [], np.zeros(len(left), bool)
        for s in range(0, len(open_), block):
            some = open_[s : s + block]
            upper = weights[some] @ high.T
            own = names[some][:, None] == ids[left][None, :]
            lower = np.where(own, -np.inf, upper if whole else weights[some] @ low.T)
            kth = np.partition(lower, len(left) - k, axis=1)[:, len(left) - k] if len(left) > k else np.full(len(some), -np.inf)
            may = (upper >= (kth - slack)[:, None]) & ~own
            settled = (may.sum(axis=1) <= max(4 * k, n // 64)) | whole
            for i in np.flatnonzero(settled):
                share[some[i]] = lists.depth / n
                resolve(int(some[i]), left[may[i]])
            wanted |= may[~settled].any(axis=0)
            still.append(some[~settled])
        # a query's own row was among the candidates: those wanted, with the k best lower bounds among them, decide the rest
        open_, left = np.concatenate(still), left[wanted]
    return out, share


def _packed(scale: float):
    """(id, vector, asked) to (id, dim, components, asked): two bytes a component where all fit, eight elsewhere."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy()
            for dim in map(int, np.unique(sizes[sizes > 0])):
                rows = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                v = np.floor(scale * matrix(rows.column(1), dim))
                fit = np.isfinite(v).all(axis=1)
                rows, v = rows.filter(pa.array(fit)), v[fit]
                small = (np.abs(v) < 2**15).all(axis=1)
                data = [(x.astype(np.int16) if s else x).tobytes() for x, s in zip(v, small)]
                dims = pa.array(np.full(len(v), dim, np.int32))
                yield pa.RecordBatch.from_arrays([rows.column(0), dims, pa.array(data, pa.binary()), rows.column(2)], ["id", "dim", "components", "asked"])

    return run


def _unpacked(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    blobs = column.to_pylist()
    out = np.empty((len(blobs), dim))
    small = np.fromiter((len(b) == 2 * dim for b in blobs), bool, len(blobs))
    for kind, at in ((np.int16, np.flatnonzero(small)), (np.float64, np.flatnonzero(~small))):
        out[at] = np.frombuffer(b"".join([blobs[i] for i in at]), kind).reshape(-1, dim)
    return out


def _task(k: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        v = _unpacked(rows.column("components"), int(key[2].as_py()))
        ids, number = rows.column("id").to_numpy(), rows.column("number").to_numpy()
        asks = number >= 0
        found, _ = nra(v[asks], ids[asks], v[~asks], ids[~asks], k) if asks.any() and not asks.all() else ([], None)
        names, numbers = ids[asks], number[asks]
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        return pa.table(
            {
                "number": pa.array([int(numbers[q]) for q, _, _ in found], pa.int64()),
                "query_id": pa.array([int(names[q]) for q, _, _ in found], pa.int64()),
                "vec_id": pa.array([i for _, i, _ in found], pa.int64()),
                "score": pa.array([clip(s) for _, _, s in found], pa.int64()),
            }
        )

    return run


def top_k_inner_product(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: float = 256.0,
    shard: int = 32768,
    group: int = 16384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product, for each query row."""
    given = vectors.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    )
    rows = given.mapInArrow(_packed(scale), "id long, dim int, components binary, asked boolean")
    # a query row is known by a number of its own: ids may be repeated
    queries = materialize(rows.where("asked").drop("asked").withColumn("number", F.monotonically_increasing_id()))
    n, asked = vectors.count(), queries.count()
    # tables below a shard a core are dealt into smaller ones
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    shards, groups = max(1, -(-n // shard), min(2 * cores, -(-n // 2048))), max(1, -(-asked // group))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m, salt: F.pmod(F.xxhash64("id", "components", F.lit(salt)), F.lit(m)).cast("int")
    there = rows.select(dealt(shards, 1).alias("shard"), every(groups).alias("group"), "dim", "id", "components", F.lit(-1).cast("long").alias("number"))
    asking = queries.select(every(shards).alias("shard"), dealt(groups, 2).alias("group"), "dim", "id", "components", "number")
    found = there.unionByName(asking).groupBy("shard", "group", "dim").applyInArrow(_task(k), "number long, query_id long, vec_id long, score long")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The five best rows for every embedding whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k_inner_product(vectors, F.col("vec_id") % 50 == 0)
