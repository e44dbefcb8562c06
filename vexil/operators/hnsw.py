"""Proximity graphs (G1-G10): one per partition, all searched, results merged by one window."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.operators.search import as_matrix, query_blocks, top_k, unit_rows
from vexil.types import Metric, require

#: Rows of one graph at most, on average.
GRAPH_ROWS = 20_000


class Graph:
    """A hierarchical navigable small-world graph over the rows of a matrix."""

    def __init__(self, x: np.ndarray, m: int = 16, ef_construction: int = 200, seed: int = 1, inner: bool = False):
        require(m >= 2, "M is at least 2")
        self.raw, self.inner = x, inner
        if inner:  # one more coordinate makes the largest product the least distance
            sq = (x * x).sum(axis=1)
            x = np.concatenate([x, np.sqrt(np.maximum(sq.max(initial=0) - sq, 0))[:, None]], axis=1)
        self.x, self.m, self.ef = x, m, ef_construction
        rng = np.random.default_rng(seed)
        self.levels = np.floor(-np.log(np.maximum(rng.random(len(x)), 1e-300)) / math.log(m)).astype(int)
        self.links: list[list[list[int]]] = []
        self.entry = -1
        for i in range(len(x)):
            self._insert(i)

    def _d(self, q: np.ndarray, at) -> np.ndarray:
        d = self.x[at] - q
        return (d * d).sum(axis=1)

    def _beam(self, q: np.ndarray, start: list[int], ef: int, level: int, allowed=None) -> list[tuple[float, int]]:
        d = self._d(q, start).tolist()
        seen = set(start)
        frontier = list(zip(d, start))
        heapq.heapify(frontier)
        best = [(-a, b) for a, b in frontier if allowed is None or allowed[b]]
        heapq.heapify(best)
        while frontier:
            near, i = heapq.heappop(frontier)
            if len(best) >= ef and near > -best[0][0]:
                break
            new = [j for j in self.links[i][level] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for dj, j in zip(self._d(q, new).tolist(), new):
                if len(best) < ef or dj < -best[0][0]:
                    heapq.heappush(frontier, (dj, j))
                    if allowed is None or allowed[j]:
                        heapq.heappush(best, (-dj, j))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-a, b) for a, b in best)

    def _select(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Nearest first; one stays only if no other that stayed is nearer to it."""
        kept: list[int] = []
        for d, i in found:
            if len(kept) == m:
                break
            if not kept or (self._d(self.x[i], kept) >= d).all():
                kept.append(i)
        return kept

    def _insert(self, i: int) -> None:
        level = int(self.levels[i])
        self.links.append([[] for _ in range(level + 1)])
        if self.entry < 0:
            self.entry = i
            return
        q, at = self.x[i], [self.entry]
        top = int(self.levels[self.entry])
        for lv in range(top, level, -1):
            at = [self._beam(q, at, 1, lv)[0][1]]
        for lv in range(min(top, level), -1, -1):
            found = self._beam(q, at, self.ef, lv)
            self.links[i][lv] = self._select(found, self.m)
            limit = 2 * self.m if lv == 0 else self.m
            for j in self.links[i][lv]:
                back = self.links[j][lv]
                back.append(i)
                if len(back) > limit:
                    self.links[j][lv] = self._select(sorted(zip(self._d(self.x[j], back).tolist(), back)), limit)
            at = [b for _, b in found]
        if level > top:
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int, allowed: np.ndarray | None = None, scaling: bool = True) -> list[tuple[float, int]]:
        if self.entry < 0 or k == 0:
            return []
        ef = max(ef, k)
        if allowed is not None:
            count = int(allowed.sum())
            if not count:
                return []
            if count * count <= (2 if scaling else 1) * ef * self.m * len(self.x):  # so few that scoring them all is cheaper
                at = np.flatnonzero(allowed)
                return sorted(zip(self._score(q, at).tolist(), at.tolist()))[:k]
            ef = max(k, round(ef * (count / len(self.x)) ** (1 / 3))) if scaling else ef
        wide = np.append(q, 0.0) if self.inner else q
        at = [self.entry]
        for lv in range(int(self.levels[self.entry]), 0, -1):
            at = [self._beam(wide, at, 1, lv)[0][1]]
        found = [i for _, i in self._beam(wide, at, ef, 0, allowed)]
        return sorted(zip(self._score(q, found).tolist(), found))[:k] if found else []

    def _score(self, q: np.ndarray, at) -> np.ndarray:
        if self.inner:
            return -(self.raw[at] @ q)
        return self._d(q, at)


def hnsw_search(corpus: DataFrame, queries: DataFrame, k: int, metric: Metric = Metric.L2, m: int = 16, ef_construction: int = 200, ef_search: int = 64, parts: int = 4, seed: int = 1, allowed: str | None = None) -> DataFrame:
    """Builds a graph in each of ``parts`` parts (by a hash of the slot), more if they had over GRAPH_ROWS rows, and searches
    all, each graph for all blocks of queries; ``allowed`` names a boolean column."""
    require(ef_search >= 1, "ef_search is at least 1")
    parts = max(parts, -(-corpus.count() // GRAPH_ROWS))
    dealt = corpus.select(
        F.pmod(F.xxhash64("slot"), F.lit(parts)).cast("int").alias("part"), "slot", "id", F.col("vector").cast("array<double>").alias("vector"), F.col(allowed).alias("ok") if allowed else F.lit(True).alias("ok")
    )

    blocks = [corpus.sparkSession.sparkContext.broadcast((qids, unit_rows(q) if metric == Metric.COSINE else q)) for qids, q in query_blocks(queries)]

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("slot").to_numpy(), kind="stable")
        x = as_matrix(rows.column("vector"))[order]
        x = unit_rows(x) if metric == Metric.COSINE else x
        slot, ident = rows.column("slot").to_numpy()[order], rows.column("id").to_numpy()[order]
        ok = rows.column("ok").to_numpy(zero_copy_only=False)[order].astype(bool)
        graph = Graph(x, m, ef_construction, seed, metric == Metric.INNER_PRODUCT)
        half = 0.5 if metric == Metric.COSINE else 1.0
        found = []
        for shipped in blocks:
            for qid, v in zip(*shipped.value):
                hits = graph.search(v, k, ef_search, None if ok.all() else ok)
                at = np.array([i for _, i in hits], int)
                found.append((np.full(len(at), qid), slot[at], ident[at], np.array([d for d, _ in hits]) * half))
        kinds = [("qid", np.int64), ("slot", np.int64), ("id", np.int64), ("distance", np.float64)]
        return pa.table({n: np.concatenate([f[j] for f in found]).astype(kind) for j, (n, kind) in enumerate(kinds)})

    if not blocks:
        return corpus.sparkSession.createDataFrame([], "qid long, rank int, id long, distance double")
    return top_k(dealt.groupBy("part").applyInArrow(run, "qid long, slot long, id long, distance double"), k)


def mmr(candidates: np.ndarray, query: np.ndarray, k: int, trade: float = 0.5) -> list[int]:
    """Positions by maximal marginal relevance: near the query, far from what is already chosen (cosine)."""
    x, q = unit_rows(np.asarray(candidates, float)), np.asarray(query, float)
    q = q / max(np.sqrt((q * q).sum()), 1e-12)
    relevance, chosen = x @ q, []
    worst = np.full(len(x), -np.inf)
    while len(chosen) < min(k, len(x)):
        value = relevance if not chosen else trade * relevance - (1 - trade) * worst
        value = value.copy()
        value[chosen] = -np.inf
        i = int(value.argmax())
        chosen.append(i)
        worst = np.maximum(worst, x @ x[i])
    return chosen
