"""Fusing ranked lists, hybrid search and ranking metrics (H1-H13).

A ranked list is (qid, list, pos, id, distance), pos from 1 in the list as
given, padding included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vexil.operators.sparse import few


def _limited(scored: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("qid", "rank", "id", "score")


def _weighted(lists: DataFrame, weights: list[float]) -> DataFrame:
    w = F.get(F.lit([float(x) for x in weights]), F.col("list"))
    return lists.withColumn("w", w).where(F.col("w") != 0)


def fuse_rrf(lists: DataFrame, weights: list[float], limit: int = 10, rrf_k: float = 60.0) -> DataFrame:
    """Reciprocal ranks: sum of w / (k + pos), an id's first position in each list counts."""
    first = _weighted(lists, weights).where("id >= 0").groupBy("qid", "list", "id", "w").agg(F.min("pos").alias("pos"))
    return _limited(first.groupBy("qid", "id").agg(F.round(F.sum(F.col("w") / (F.lit(rrf_k) + F.col("pos"))), 12).alias("score")), limit)


def fuse_linear(lists: DataFrame, weights: list[float], limit: int = 10) -> DataFrame:
    """Min-max normalised distances: sum of w * (max - d) / (max - min), 1 where all are equal."""
    finite = _weighted(lists, weights).where("id >= 0 and not isnan(distance) and abs(distance) < double('Infinity')")
    span = Window.partitionBy("qid", "list")
    low, high = F.min("distance").over(span), F.max("distance").over(span)
    part = finite.withColumn("part", F.when(high > low, (high - F.col("distance")) / (high - low)).otherwise(F.lit(1.0)))
    first = part.groupBy("qid", "list", "id", "w").agg(F.min_by("part", "pos").alias("part"))
    return _limited(first.groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * F.col("part")), 12).alias("score")), limit)


def fuse(lists: DataFrame, weights: list[float], method: str = "rrf", limit: int = 10, rrf_k: float = 60.0) -> DataFrame:
    if method == "rrf":
        return fuse_rrf(lists, weights, limit, rrf_k)
    if method == "linear":
        return fuse_linear(lists, weights, limit)
    raise ValueError("method is rrf or linear")


def as_lists(*hits: DataFrame) -> DataFrame:
    """Search results (qid, rank, id, distance) as ranked lists 0, 1 and so on."""
    parts = [h.select("qid", F.lit(i).alias("list"), F.col("rank").alias("pos"), "id", "distance") for i, h in enumerate(hits)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tune_weights(lists: DataFrame, labels: DataFrame, k: int, metric: str = "ndcg", method: str = "linear", grid: list[tuple[float, float]] | None = None) -> list[tuple[tuple[float, float], float]]:
    """Mean metric of each weight pair, best first (of equals the first in the grid); the lists are retrieved once."""
    grid = grid or [(round(1 - i / 10, 1), round(i / 10, 1)) for i in range(11)]
    lists = lists.cache()
    scored = []
    for pair in grid:
        hits = fuse(lists, list(pair), method, k)
        scored.append((pair, float(score(hits, labels, k, metric).agg(F.avg("value")).first()[0] or 0.0)))
    lists.unpersist()
    return sorted(scored, key=lambda s: -s[1])


def check_labels(labels: DataFrame) -> None:
    """Repeated ids, grades that aren't finite, and queries without a positive grade are errors."""
    bad = labels.groupBy("qid").agg(
        (F.count("id") != F.countDistinct("id")).alias("repeated"), F.max(F.isnan("grade") | (F.abs("grade") == float("inf"))).alias("odd"), (F.max("grade") <= 0).alias("none")
    )
    if bad.where("repeated or odd or none").limit(1).count():
        raise ValueError("labels need distinct ids, finite grades and a positive grade per query")


def score(hits: DataFrame, labels: DataFrame, k: int, metric: str = "ndcg") -> DataFrame:
    """(qid, value) for each labelled query: recall, ndcg or mrr at k; an id's first rank counts."""
    good = labels.where("grade > 0")
    first = hits.where((F.col("rank") <= k) & (F.col("id") >= 0)).groupBy("qid", "id").agg(F.min("rank").alias("rank"))
    met = few(first).join(good, ["qid", "id"])  # labels may be many more than hits
    base = good.select("qid").distinct()
    if metric == "recall":
        got = met.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        want = good.groupBy("qid").agg(F.count(F.lit(1)).alias("of"))
        return base.join(want, "qid").join(got, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / F.col("of")).alias("value"))
    if metric == "mrr":
        got = met.groupBy("qid").agg((F.lit(1.0) / F.min("rank")).alias("value"))
    elif metric == "ndcg":
        # the best k grades by how often each occurs: labels of equal grade are alike, and none is sorted
        grades = good.groupBy("qid", "grade").agg(F.count(F.lit(1)).alias("n"))
        above = Window.partitionBy("qid").orderBy(F.col("grade").desc()).rowsBetween(Window.unboundedPreceding, -1)
        first = grades.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).where(F.col("above") < k)
        ranks = F.sequence(F.col("above") + 1, F.least(F.col("above") + F.col("n"), F.lit(k).cast("long")))
        best = first.select("qid", "grade", F.explode(ranks).alias("rank"))
        dcg = lambda df, name: df.groupBy("qid").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1.0)).alias(name))
        got = dcg(met, "dcg").join(dcg(best, "ideal"), "qid").select("qid", (F.col("dcg") / F.col("ideal")).alias("value"))
    else:
        raise ValueError("metric is recall, ndcg or mrr")
    return base.join(got, "qid", "left").select("qid", F.coalesce("value", F.lit(0.0)).alias("value"))


def neighbor_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, value): the share of the true k nearest that was found."""
    met = found.select("qid", "id").join(truth.select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return truth.select("qid").distinct().join(met, "qid", "left").select("qid", (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("value"))
