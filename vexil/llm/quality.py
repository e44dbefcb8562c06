"""Quality classifier: a sparse ensemble of rules over document statistics.

Statistics of every whole text come from a few numpy passes over its bytes.
Small boosted trees over the statistics of labelled documents give paths; every
path from a root is a conjunctive rule.  A logistic model with an L1 penalty
(fitted by accelerated proximal gradient) weighs the rules and drops most.  What
is left is compiled into one Spark column expression over the statistics.

The model is fitted on at most about ``sample`` labelled documents, chosen by a
hash of their id; that bound is the only limit, and every document is scored
from its whole text.

Defined results: a null text counts as empty, all of whose statistics are 0, and
gets the model's score for that; labels that are null or not 0 or 1, and labels
of unknown documents, are ignored; of several labels of one document each
counts; without labels the score is 0.5, with one kind of label only it is the
smoothed share of it; null or repeated ids keep their rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexil.llm import _text

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "bars", "exclaims", "stops", "blanks",
    "line_words", "repeats", "repeated_lines", "wide",
]


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars.encode())] = 1
    return table


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_SYMBOL, _BAR, _EXCLAIM, _STOP, _BLANK = _class("#$%&*<>{}[]=_~^@\\/+`"), _class("|"), _class("!?"), _class(".,;:'\"-()"), _class(" \t\r")


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text."""
    n = np.diff(off)
    size = np.maximum(n, 1)
    hashes, at = _text.words(raw, off)
    count = np.diff(at)
    some = np.maximum(count, 1)
    share = lambda table: _text.sums(table[raw], off) / size
    letters = _text.sums((_text.WORD[raw] != 0).view(np.uint8), off)
    upper = _text.sums(_UPPER[raw], off) / np.maximum(letters, 1)
    same = np.zeros(len(hashes), np.uint8)
    same[1:] = hashes[1:] == hashes[:-1]
    same[at[:-1][at[:-1] < len(same)]] = 0
    breaks = raw == 10
    lines = _text.sums(breaks.view(np.uint8), off) + 1
    # lines: their hashes, and how many of a text's are there before in the text
    first = breaks.copy()
    if len(raw):
        first[1:] = breaks[:-1]
        first[off[:-1][off[:-1] < len(raw)]] = True
        first[0] = True
        starts = np.flatnonzero(first)
        pos = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
        with np.errstate(over="ignore"):
            weighted = np.where(breaks, 0, raw).astype(np.uint64) * (_text._POW[pos & 4095] + (pos >> 12).astype(np.uint64))
            of = np.searchsorted(off, starts, side="right") - 1
            key = _text.mix(np.add.reduceat(weighted, starts)) ^ _text.mix(of.astype(np.uint64) + np.uint64(1))
        _, kept = np.unique(key, return_index=True)
        again = len(starts) and np.bincount(of, minlength=len(n)) - np.bincount(of[kept], minlength=len(n))
    else:
        again = np.zeros(len(n))
    return np.stack(
        [
            np.log1p(n), np.log1p(count), letters / some, upper, share(_DIGIT), share(_SYMBOL), share(_BAR), share(_EXCLAIM),
            share(_STOP), share(_BLANK), count / lines, _text.sums(same, at) / some, again / lines, share((np.arange(256) >= 128).astype(np.uint8)),
        ],
        axis=1,
    )


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        found = np.concatenate([statistics(raw, off) for _, _, raw, off in _text.runs(batch.column(1))])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], ["doc_id", *STATISTICS])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one double per statistic) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _statistics, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    )


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, cut) and so on, all of which must hold


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) == above
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 16, depth: int = 3, seed: int = 9) -> list[Rule]:
    """The paths of boosted trees on random halves of the rows and statistics."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 25))) for c in x.T]
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        p = _sigmoid(margin)
        residual, weight = y - p, np.maximum(p * (1 - p), 1e-4)
        half = rng.random(len(y)) < 0.5
        some = rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False)
        grown: list[tuple[Rule, np.ndarray]] = [((), np.ones(len(y), bool))]
        for _ in range(depth):
            deeper = []
            for rule, inside in grown:
                fit = inside & half
                best, g, h = None, residual[fit], weight[fit]
                if len(g) < 20:
                    continue
                for j in some:
                    v = x[fit, j]
                    for cut in cuts[j]:
                        up = v > cut
                        k = int(up.sum())
                        if 5 <= k <= len(g) - 5:
                            gu, hu = g[up].sum(), h[up].sum()
                            gain = gu**2 / (hu + 1) + (g.sum() - gu) ** 2 / (h.sum() - hu + 1)
                            if best is None or gain > best[0]:
                                best = gain, j, float(cut)
                if best and best[0] > g.sum() ** 2 / (h.sum() + 1) + 1e-3:
                    for above in (True, False):
                        longer = (*rule, (int(best[1]), above, best[2]))
                        deeper.append((longer, inside & ((x[:, best[1]] > best[2]) == above)))
                        rules[longer] = None
            for rule, inside in deeper or grown:
                fit = inside & half
                if fit.any():
                    margin[inside] += 0.3 / max(1, depth) * residual[fit].sum() / (weight[fit].sum() + 1)
            grown = deeper
    return list(rules)


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float = 2e-3, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights, by FISTA; the intercept is free of the penalty."""
    a = np.concatenate([np.ones((len(m), 1)), m], axis=1).astype(np.float64)
    step = 4 * len(y) / max(np.linalg.norm(a.T @ a, 2), 1e-9)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        new = z - step * (a.T @ (_sigmoid(a @ z) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


class RuleEnsemble:
    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            p = (y.sum() + 1) / (len(y) + 2)
            return cls(float(np.log(p / (1 - p))), [])
        rules = tree_rules(x, y)
        m = np.stack([_holds(r, x) for r in rules], axis=1) if rules else np.zeros((len(y), 0))
        intercept, weights = lasso_logistic(m, y)
        return cls(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4])

    def column(self, prefix: str = "") -> Column:
        """The probability of label 1 as an expression over the columns named in STATISTICS."""
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            test = F.lit(True)
            for j, above, cut in rule:
                c = F.col(prefix + STATISTICS[j])
                test = test & (c > cut if above else c <= cut)
            z = z + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_quality(
    docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = 8000
) -> RuleEnsemble:
    """Fit on the labelled documents whose id passes ``train``, at most about ``sample`` of them."""
    known = labels.where(train & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    n = known.count()
    share = 1_000_000 if n <= sample else -(-sample * 1_000_000 // n)
    # at most about `sample` rows of 16 bytes
    known = F.broadcast(known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < share))
    here = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(known.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = document_statistics(here).join(known, "doc_id").orderBy("doc_id", "y", *STATISTICS).toArrow()
    x = np.stack([rows.column(s).to_numpy() for s in STATISTICS], axis=1)
    return RuleEnsemble.fit(x, rows.column("y").to_numpy())


def score_quality(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    return document_statistics(docs, id_col, text_col).select("doc_id", model.column().alias("score"))


def keep_good(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, whose score reaches the threshold."""
    from pyspark.sql import types as T

    column, prefix = docs.columns.index(text_col), "__statistic_"
    names = [prefix + s for s in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.concatenate([statistics(raw, off) for _, _, raw, off in _text.runs(batch.column(column))])
                more = [pa.array(np.ascontiguousarray(c)) for c in found.T]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return docs.mapInArrow(run, schema).where(model.column(prefix) >= threshold).drop(*names)


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Learn quality where crc32(id) mod 4 is not 2, score every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rest = _text.crc_rest("doc_id", 4)
    model = fit_quality(docs, labels, F.coalesce(rest != 2, F.lit(False)))
    return score_quality(docs, model).select(
        "doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
