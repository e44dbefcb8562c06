"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors have cosine >= c exactly if their squared distance is at most
2 - 2 c.  After a rotation the coordinates are split into ``blocks`` low-
dimensional blocks, and each block gets a share of that squared distance
proportional to its number of coordinates.  By the pigeonhole principle a pair
within the whole distance is within the share of at least one block, so the
union of the blocks' range joins has every link.

A vector is rotated once and its coordinates are rounded to whole numbers of
1 / ``SCALE``; all that follows is computed from these, so every task finds the
same for the same two rows.  Rounding moves a distance by less than the square
root of the number of coordinates, and each share is widened by that.

A block's range join is over cells of its first two coordinates, twice as wide
as the block's radius: a vector is at home in its cell and visits those of the
later neighbours that its radius reaches.  Who meets in a cell is compared within
the task by matrix products.  A pair counts in the first of the blocks whose
share it keeps to, so in one only.  Pairs surely within or beyond the distance,
whatever the rounding, are settled there; those at the edge (within 0.0001 of a
cosine, at 64 components) are joined with the vectors themselves and verified by
the cosine in double precision.  Tasks give sums of links per vector and a
spanning forest of the links, never the pairs.

Equal vectors are one class with a count, so that a hot group of copies costs
one row.  Cells with more than ``chunk`` rows are cut into chunks, and each pair
of chunks is a task.

Defined results: a vector that is null, empty, zero or holds a null or
non-finite component, or whose label is null, has no links and is its own
component; vectors of different lengths never link; a null id keeps its row, its
component is null if it has no links; repeated ids keep a row each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexil.llm._graph import connected_components, union_find_forest
from vexil.llm._join import lookup
from vexil.llm._store import materialize
from vexil.llm._vectors import matrix

#: Whole numbers to a unit; coordinates fit in 16 bits.
SCALE = 32000
_LATER = ((0, 1), (1, -1), (1, 0), (1, 1))


@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix. Any serves: it spreads what the vectors share over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def split(dim: int, blocks: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]


def shares(dim: int, blocks: int, threshold: float) -> np.ndarray:
    """The largest squared distance, of rounded coordinates, that may lie within each block's share."""
    sizes = np.array([s.stop - s.start for s in split(dim, blocks)])
    return np.floor((SCALE * np.sqrt(max(2 - 2 * threshold, 0) * sizes / dim) + np.sqrt(sizes) + 1e-3) ** 2)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _packed(kind: str):
    """(vec_id, label, vector) to (vec_id, label, dim, vector): the components' bytes, or null if the vector links with nothing."""

    def run(batches):
        for batch in batches:
            sizes = np.where(batch.column(1).is_null(), 0, batch.column(2).value_lengths().fill_null(0).to_numpy())
            for dim in map(int, np.unique(sizes)):
                at = pa.array(np.flatnonzero(sizes == dim))
                vectors = pa.nulls(len(at), pa.binary())
                if dim:
                    v = matrix(batch.column(2).take(at), dim) + 0.0  # no negative zeros: equal vectors have equal bytes
                    fit = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
                    vectors = pa.array([r.tobytes() if ok else None for r, ok in zip(v.astype(kind), fit)], pa.binary())
                names = ["vec_id", "label", "dim", "vector"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (0, 1)), pa.array(np.full(len(at), dim, np.int32)), vectors], names)

    return run


def _unpacked(column: pa.Array, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dim).astype(np.float64)


def _cells(threshold: float, blocks: int, kind: str):
    """(label, node, mult, dim, vector) to rows (label, node, mult, dim, turned, block, x, y, visits), one for each cell of each block."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for dim in map(int, np.unique(sizes)):
                at = np.flatnonzero(sizes == dim)
                rows = batch.take(pa.array(at))
                q = np.rint((_unit(_unpacked(rows.column(4), kind, dim)) @ rotation(dim)) * SCALE).astype(np.int16)
                turned = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * dim), len(q), [None, pa.py_buffer(np.ascontiguousarray(q))]).cast(pa.binary())
                out = []
                for b, (part, within) in enumerate(zip(split(dim, blocks), shares(dim, blocks, threshold))):
                    width = 2 * math.ceil(math.sqrt(within))
                    x = q[:, part.start].astype(np.int64)
                    y = q[:, part.start + 1].astype(np.int64) if part.stop - part.start > 1 else np.zeros(len(q), np.int64)
                    cx, cy = x // width, y // width
                    every = np.arange(len(q))
                    out.append((every, b, cx, cy, False))
                    for dx, dy in _LATER:
                        gap_x = (cx + 1) * width - x if dx else 0
                        gap_y = (cy + 1) * width - y if dy > 0 else y - cy * width + 1 if dy < 0 else 0
                        to = np.flatnonzero(gap_x * gap_x + gap_y * gap_y <= within)
                        out.append((to, b, cx[to] + dx, cy[to] + dy, True))
                which = np.concatenate([o[0] for o in out])
                take = pa.array(which)
                spread = lambda k, kind: pa.array(np.repeat(np.array([o[k] for o in out], kind), [len(o[0]) for o in out]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c).take(take) for c in range(4)), turned.take(take),
                        spread(1, np.int32), *(pa.array(np.concatenate([o[k] for o in out])) for k in (2, 3)), spread(4, bool),
                    ],
                    ["label", "node", "mult", "dim", "turned", "block", "x", "y", "visits"],
                )

    return run


def _join(threshold: float, blocks: int):
    """A cell's rows to (a, null, links): links of a; (a, b, 0): an edge of the spanning forest; (a, b, -1): a pair to be verified."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        dim, block = int(key[1].as_py()), int(key[2].as_py())
        parts, within = split(dim, blocks), shares(dim, blocks, threshold)
        q = np.frombuffer(b"".join(rows.column("turned").to_pylist()), np.int16).reshape(-1, dim)
        node, mult = rows.column("node").to_numpy(), rows.column("mult").to_numpy()
        visits, chunk = rows.column("visits").to_numpy(), rows.column("chunk").to_numpy()
        sub = q[:, parts[block]].astype(np.float64)
        norm, one = (sub * sub).sum(axis=1), np.ones(len(sub))
        # the product of these is the squared distance, in whole numbers
        left, right = np.column_stack([-2 * sub, norm, one]), np.column_stack([sub, one, norm])
        edge, error = SCALE * math.sqrt(max(2 - 2 * threshold, 0)), math.sqrt(dim) + 1e-3
        starts = [p.start for p in parts]
        links = np.zeros(len(q), np.int64)
        empty = np.zeros(0, np.int64)
        edges_a, edges_b, unsure_a, unsure_b = [empty], [empty], [empty], [empty]

        def compare(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal edges_a, edges_b
            for s in range(0, len(i), 1 << 15):
                a, b = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
                diff = q[a].astype(np.int64) - q[b]
                sums = np.add.reduceat(diff * diff, starts, axis=1)
                own = ((sums <= within).argmax(axis=1) == block) & (node[a] != node[b])
                a, b, far = a[own], b[own], np.sqrt(sums[own].sum(axis=1))
                sure, near = far + error <= edge, far - error <= edge
                unsure_a.append(node[a[near & ~sure]])
                unsure_b.append(node[b[near & ~sure]])
                a, b = a[sure], b[sure]
                np.add.at(links, a, mult[b])
                np.add.at(links, b, mult[a])
                edges_a.append(a)
                edges_b.append(b)
                if sum(map(len, edges_a)) > 1 << 18:
                    edges_a, edges_b = _thin(edges_a, edges_b)

        def meet(one: np.ndarray, other: np.ndarray, within_one: bool = False) -> None:
            for s in range(0, len(one), 512):
                i, j = np.nonzero(left[one[s : s + 512]] @ right[other].T <= within[block] + 0.5)
                if within_one:
                    later = j > i + s
                    i, j = i[later], j[later]
                compare(one[s + i], other[j])

        home, guest = np.flatnonzero(~visits), np.flatnonzero(visits)
        ci, cj = int(key[5].as_py()), int(key[6].as_py())
        if ci == cj:
            meet(home, home, True)
            meet(home, guest)
        else:
            of = lambda at, c: at[chunk[at] == c]
            meet(of(home, ci), of(home, cj))
            meet(of(home, ci), of(guest, cj))
            meet(of(home, cj), of(guest, ci))
        edges_a, edges_b = _thin(edges_a, edges_b)
        linked, a, b = np.flatnonzero(links), np.concatenate(unsure_a), np.concatenate(unsure_b)
        return pa.table(
            {
                "a": pa.array(np.concatenate([node[linked], node[edges_a[0]], a])),
                "b": pa.array(np.concatenate([linked, node[edges_b[0]], b]), mask=np.arange(len(linked) + len(edges_a[0]) + len(a)) < len(linked)),
                "links": pa.array(np.concatenate([links[linked], np.zeros(len(edges_a[0]), np.int64), np.full(len(a), -1)])),
            }
        )

    return run


def _thin(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    a, b = np.concatenate(a), np.concatenate(b)
    keep = union_find_forest(a, b)
    return [a[keep]], [b[keep]]


def _exact(threshold: float, kind: str):
    """(a, b, dim, v, w) to the pairs (a, b) whose vectors' cosine reaches the threshold."""

    def run(batches):
        for batch in batches:
            sizes, kept = batch.column(2).to_numpy(), []
            for dim in map(int, np.unique(sizes)):
                at = np.flatnonzero(sizes == dim)
                v, w = (_unpacked(batch.column(c).take(pa.array(at)), kind, dim) for c in (3, 4))
                product, length = (v * w).sum(axis=1), np.sqrt((v * v).sum(axis=1)) * np.sqrt((w * w).sum(axis=1))
                odd = ~np.isfinite(length) | (length < 1e-290) | ~np.isfinite(product)  # squares of huge or tiny components
                if odd.any():
                    v, w = v[odd] / np.abs(v[odd]).max(axis=1, keepdims=True), w[odd] / np.abs(w[odd]).max(axis=1, keepdims=True)
                    product[odd], length[odd] = (v * w).sum(axis=1), np.sqrt((v * v).sum(axis=1)) * np.sqrt((w * w).sum(axis=1))
                kept.append(at[product / length >= threshold])
            yield batch.select([0, 1]).take(pa.array(np.concatenate([*kept, np.zeros(0, np.int64)])))

    return run


def embedding_components(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    blocks: int = 4,
    chunk: int = 16384,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; see the module's text."""
    kind = vectors.schema[vector_col].dataType
    kind = "float32" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "float64"
    given = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"),
        F.col(f"`{vector_col}`").cast("array<float>" if kind == "float32" else "array<double>").alias("vector"),
    )
    rows = given.mapInArrow(_packed(kind), "vec_id long, label string, dim int, vector binary")
    fit = rows.where("vector is not null")
    # a class: equal vectors of a label; its node is a number of its own, its name the smallest id
    classes = materialize(
        fit.groupBy("vector", "label", "dim").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("mult"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    cells = classes.select("label", "node", "mult", "dim", "vector").mapInArrow(
        _cells(threshold, blocks, kind), "label string, node long, mult long, dim int, turned binary, block int, x long, y long, visits boolean"
    )
    at = ["label", "dim", "block", "x", "y"]
    crowded = cells.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("chunks")).where("chunks > 1")
    crowded = materialize(crowded)
    if crowded.isEmpty():
        dealt = cells.select("*", *(F.lit(0).alias(c) for c in ("chunk", "ci", "cj")))
    else:
        dealt = (
            cells.join(F.broadcast(crowded) if crowded.count() <= 10_000 else crowded, at, "left")
            .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("ci", F.least("chunk", "other"))
            .withColumn("cj", F.greatest("chunk", "other"))
        )
    found = materialize(
        dealt.groupBy("label", "dim", "block", "x", "y", "ci", "cj")
        .applyInArrow(_join(threshold, blocks), "a long, b long, links long")
    )
    counted, edges = found.where("b is null").select("a", "links"), found.where("links = 0").select("a", "b")
    unsure = found.where("links = -1").select("a", "b")
    if not unsure.isEmpty():
        of = lambda c, v: classes.select(F.col("node").alias(c), F.col("vector").alias(v), "dim")
        exact = unsure.join(of("a", "v"), "a").select("a", "b", "dim", "v").join(of("b", "w").drop("dim"), "b").select("a", "b", "dim", "v", "w")
        linked = materialize(exact.mapInArrow(_exact(threshold, kind), "a long, b long"))
        mult = classes.select("node", "mult")
        ends = linked.select("a", F.col("b").alias("node")).unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("node")))
        counted = counted.unionByName(ends.join(mult, "node").select("a", F.col("mult").alias("links")))
        edges = edges.unionByName(linked)
    links = counted.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    # nodes take the place of ids here: a class's component is named by the smallest id in it
    roots = connected_components(edges)
    named = classes.select("vector", "label", "node", "name", "mult").join(links, "node", "left").join(roots, "node", "left")
    named = materialize(named.withColumn("root", F.coalesce("root", "node")))
    least = named.groupBy("root").agg(F.min("name").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = lookup(named, least, ["root"], "size").select(
        "vector", "label", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id", "mult"
    )
    linked = lookup(fit.drop("dim"), materialize(named), ["vector", "label"], "mult").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.93, within equal labels."""
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
