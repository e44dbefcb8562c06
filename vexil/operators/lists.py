"""Scans of inverted lists that hold floats, scalar codes or product codes (D4-D17).

Rows carry ``__list``, the nearest centroid, and ``__codes``, their packed codes,
both made once when the rows are added.  A block of queries chooses its lists on
the driver (its size is bounded, and so is the number of lists); the choice
travels to the executors, each batch scores its rows list by list and keeps k
rows per query, so no row of the corpus is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexil.operators.quantize import PQCodebook, _nearest_centroid, pack_nibbles
from vexil.operators.search import as_matrix, best_of_batch, nearest, query_blocks, top_k, unit_rows
from vexil.types import Metric

HITS = "qid long, slot long, id long, distance double"


@dataclass
class Model:
    """What training yields; its size is set by the index's options."""

    metric: Metric
    centroids: np.ndarray
    book: PQCodebook | None = None
    rotation: np.ndarray | None = None
    low: np.ndarray | None = None  # scalar codes
    step: np.ndarray | None = None
    bits: int = 0
    fast_scan: bool = False
    inner: bool = False  # one table of products per query instead of one of distances per list
    symmetric: bool = False
    arrays: tuple[str, ...] = field(default=("centroids", "rotation", "low", "step"), repr=False)
    fixed: np.ndarray | None = None  # the part of the tables of distances that no query changes, by list

    def precompute(self, most_mb: int = 256) -> bool:
        """Keep |y|^2 + 2 c y for every list's c and every code's y, if that takes at most ``most_mb`` MB."""
        m, codes, _ = self.book.centroids.shape
        if len(self.centroids) * m * codes * 8 > most_mb << 20:
            return False
        c = np.stack(np.split(self.turned(self.centroids), m, axis=1))
        self.fixed = ((self.book.centroids**2).sum(axis=2)[:, None, :] + 2 * c @ self.book.centroids.transpose(0, 2, 1)).transpose(1, 0, 2)
        return True

    def turned(self, x: np.ndarray) -> np.ndarray:
        return x if self.rotation is None else x @ self.rotation

    def levels(self, x: np.ndarray) -> np.ndarray:
        """Nearest scalar level of each component, halves up."""
        safe = np.where(self.step > 0, self.step, 1.0)
        return np.clip(np.floor((x - self.low) / safe + 0.5), 0, 2**self.bits - 1).astype(np.uint8)

    def width(self) -> tuple[int, bool]:
        """Codes per row, and whether two share a byte."""
        if self.book is not None:
            return len(self.book.centroids), self.book.centroids.shape[1] <= 16
        return len(self.low), self.bits == 4

    def packed(self, x: np.ndarray, lists: np.ndarray | None) -> np.ndarray:
        codes = self.book.encode(self.turned(x - self.centroids[lists])).astype(np.uint8) if self.book is not None else self.levels(x)
        return pack_nibbles(codes) if self.width()[1] else codes

    def unpacked(self, column: pa.Array) -> np.ndarray:
        n, halves = self.width()
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        if not halves:
            return raw
        return np.stack([raw & 15, raw >> 4], axis=2).reshape(len(raw), -1)[:, :n]

    def tables(self, q: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Tables (queries, subspaces, codes) for one list and what to add to their sums."""
        c = self.centroids[at]
        parts = lambda x: np.split(self.turned(x), len(self.book.centroids), axis=1)
        if self.inner:
            return np.stack([-(p @ y.T) for p, y in zip(parts(q), self.book.centroids)], axis=1), (self.metric == Metric.COSINE) - q @ c
        r = q - c
        if self.fixed is not None and not self.symmetric:
            base = np.stack([(p * p).sum(axis=1) for p in parts(r)], axis=1)
            products = np.stack([p @ y.T for p, y in zip(parts(q), self.book.centroids)], axis=1)
            return base[:, :, None] + self.fixed[at][None] - 2 * products, np.zeros(len(q))
        if self.symmetric:
            decoded = self.book.decode(self.book.encode(self.turned(r)))
            split = np.split(decoded, len(self.book.centroids), axis=1)
        else:
            split = parts(r)
        return np.stack([((p[:, None, :] - y[None]) ** 2).sum(axis=2) for p, y in zip(split, self.book.centroids)], axis=1), np.zeros(len(q))

    def distances(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """(queries, rows) by product codes."""
        tables, base = self.tables(q, at)
        if self.fast_scan:  # whole numbers from 0, the widest row up to 63, half to even
            low = tables.min(axis=2)
            wide = (tables.max(axis=2) - low).max(axis=1)
            scale = np.where(wide > 0, 63 / np.where(wide > 0, wide, 1.0), 1.0)
            tables = np.rint((tables - low[:, :, None]) * scale[:, None, None])
        total = np.zeros((len(q), len(codes)))
        for s in range(tables.shape[1]):
            total += tables[:, s, codes[:, s]]
        if self.fast_scan:
            total = total / scale[:, None] + low.sum(axis=1)[:, None]
        return (total + base[:, None]) * (0.5 if self.metric == Metric.COSINE and not self.inner else 1.0)

    def rank_lists(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries to the centroids."""
        product = q @ self.centroids.T
        return -product if self.metric == Metric.INNER_PRODUCT else (self.centroids**2).sum(axis=1)[None, :] - 2 * product


def encode(df: DataFrame, model: Model, lists: bool = True) -> DataFrame:
    """Adds ``__list`` and, with a quantizer, ``__codes``; rows of a task come out in the order of their lists."""
    coded = model.book is not None or model.bits > 0
    shipped = df.sparkSession.sparkContext.broadcast(model)
    at, dim = df.columns.index("vector"), model.centroids.shape[1] if lists else len(model.low)

    def run(batches):
        m = shipped.value
        for batch in batches:
            x = as_matrix(batch.column(at), dim)
            columns, names = list(batch.columns), list(batch.schema.names)
            found = _nearest_centroid(x, m.centroids) if lists else None
            if lists:
                columns.append(pa.array(found.astype(np.int32)))
                names.append("__list")
            if coded:
                codes = np.ascontiguousarray(m.packed(x, found))
                ends = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
                columns.append(pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes)]))
                names.append("__codes")
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [*df.schema.fields]
    fields += [T.StructField("__list", T.IntegerType())] if lists else []
    fields += [T.StructField("__codes", T.BinaryType())] if coded else []
    out = df.mapInArrow(run, T.StructType(fields))
    return out.sortWithinPartitions("__list") if lists else out


def chosen_lists(model: Model, q: np.ndarray, nprobe: int, k: int, here: np.ndarray | None, live: int, scaling: bool = True) -> dict[int, np.ndarray]:
    """Lists to the queries that read them.

    ``here`` counts the allowed rows of each list when there is a filter: then more
    lists are read as the filter narrows, and on until enough allowed rows are reached.
    """
    n = len(model.centroids)
    least, want = min(nprobe, n), 0
    if here is not None:
        want = min(k, int(here.sum()))
        if scaling:
            least = min(n, max(nprobe, math.ceil(0.75 * nprobe * (live / max(int(here.sum()), 1)) ** (1 / 3))))
    pairs = []
    for i in range(0, len(q), 256):
        order = np.argsort(model.rank_lists(q[i : i + 256]), axis=1, kind="stable")
        keep = np.zeros(order.shape, bool)
        keep[:, :least] = True
        if here is not None:
            counts = here[order]
            keep |= np.cumsum(counts, axis=1) - counts < want
        row, place = np.nonzero(keep)
        pairs.append(np.stack([order[row, place], row + i]))
    lists, rows = np.concatenate(pairs, axis=1)
    by = np.argsort(lists, kind="stable")
    which, starts = np.unique(lists[by], return_index=True)
    return {int(w): r for w, r in zip(which, np.split(rows[by], starts[1:]))}


def _best(d: np.ndarray, slots: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k least, ties by slot."""
    if len(d) > k:
        at = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        return at[np.lexsort((slots[at], d[at]))[:k]]
    return np.lexsort((slots, d))


def scan(rows: DataFrame, queries: DataFrame, model: Model, k: int, nprobe: int, here: np.ndarray | None = None, live: int = 0, scaling: bool = True) -> DataFrame:
    """(qid, rank, id, distance): the k best of each query in the lists it reads."""
    source = "__codes" if model.book is not None or model.bits else "vector"
    hits = None
    for qids, q in query_blocks(queries) if k > 0 else ():
        q = unit_rows(q) if model.metric == Metric.COSINE else q
        asking = chosen_lists(model, q, nprobe, k, here, live, scaling)
        shipped = rows.sparkSession.sparkContext.broadcast((model, qids, q, asking))

        def run(batches, shipped=shipped):
            m, qids, q, asking = shipped.value
            for batch in batches:
                lists = batch.column(2).to_numpy()
                order = np.argsort(lists, kind="stable")
                which, starts = np.unique(lists[order], return_index=True)
                slot, ident = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                out = []
                for w, at in zip(which.tolist(), np.split(order, starts[1:])):
                    who = asking.get(w)
                    if who is None:
                        continue
                    held = batch.column(3).take(pa.array(at))
                    if m.book is not None:
                        codes = m.unpacked(held)
                        room = max(1, 2_000_000 // max(len(at), m.book.centroids.shape[0] * m.book.centroids.shape[1]))
                        for i in range(0, len(who), room):
                            some = who[i : i + room]
                            for j, d in zip(some, m.distances(q[some], w, codes)):
                                best = _best(d, slot[at], k)
                                out.append((np.full(len(best), j), at[best], d[best]))
                    else:
                        x = m.low + m.unpacked(held) * m.step if m.bits else as_matrix(held, q.shape[1])
                        for j, (best, d) in zip(who, nearest(m.metric, q[who], x, slot[at], k)):
                            out.append((np.full(len(best), j), at[best], d))
                if not out:
                    continue
                yield from best_of_batch(out, qids, slot, ident, k)

        # the lists that no query reads are left out before Python sees them
        read = rows if len(asking) == len(model.centroids) else rows.where(F.col("__list").isin([*asking]))
        values = F.col("vector").cast("array<double>") if source == "vector" else F.col(source)
        part = read.select("slot", "id", "__list", values).mapInArrow(run, HITS)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return rows.sparkSession.createDataFrame([], "qid long, rank int, id long, distance double")
    return top_k(hits, k)


def better_inner(model: Model, x: np.ndarray) -> bool:
    """Whether tables of products rank a sample's own neighbours at least as well as tables of distances."""
    asked, kept = 200, 20
    if len(x) < 11 * asked:
        return True  # too few to tell
    q, rows = x[-asked:], x[: min(20_000, len(x) - asked)]
    lists = _nearest_centroid(rows, model.centroids)
    codes = model.book.encode(model.turned(rows - model.centroids[lists]))
    truth = np.argsort(-(q @ rows.T), axis=1, kind="stable")[:, :10]
    met = []
    for inner in (True, False):
        model.inner = inner
        d = np.empty((asked, len(rows)))
        for w in np.unique(lists):
            at = np.flatnonzero(lists == w)
            d[:, at] = model.distances(q, int(w), codes[at])
        found = np.argsort(d, axis=1, kind="stable")[:, :kept]
        met.append(sum(len(np.intersect1d(a, b)) for a, b in zip(truth, found)))
    return met[0] >= met[1]
