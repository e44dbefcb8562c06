"""Language identification by language-bitmask n-gram filters.

Training takes a bounded, documented sample: at most about
``sample_per_language`` documents of each language (chosen by a hash of the id,
so the choice doesn't depend on the partitioning).  From it come, for each
language, the byte 4-grams that are typical of it: those whose share in the
language is at least ``typical`` of their largest share in any language.

The filters of all languages are one bit-sliced Bloom filter: a table of slots,
each a bitmask with one bit per language.  An n-gram looks up ``HASHES`` slots;
the AND of their masks has the bit of every language that contains the n-gram
(and of a few that don't: false positives).  A text's hits per language are
popcounts over its n-grams' masks, corrected for the filter's own rate of false
positives; the language with most corrected hits wins.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
and every text if there is nothing to learn from; a text whose n-grams no
language knows goes to the language first in the alphabet, with score 0; ties go
to the language first in the alphabet; rows with a null or repeated id get a row
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexil.llm import _text

HASHES = 2
SLOTS = 1 << 18


def _grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-grams of the words' bytes as uint32, offsets of the texts).

    Anything between words is one blank; a text starts and ends with one.
    """
    b = _text.WORD[raw]
    # a blank after every text, then runs of blanks shrink to one
    joined = np.zeros(len(b) + len(off), np.uint8)
    shift = np.repeat(np.arange(1, len(off)), np.diff(off))
    joined[np.arange(len(b)) + shift] = b
    keep = np.ones(len(joined), bool)
    keep[1:] = (joined[1:] != 0) | (joined[:-1] != 0)
    limit = np.concatenate(([0], np.cumsum(keep)))
    ends = limit[off + np.arange(len(off))]  # of the blank in front of each text, and of the last
    s = joined[keep].astype(np.uint32)
    if len(s) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    g = s[:-3] | (s[1:-2] << np.uint32(8)) | (s[2:-1] << np.uint32(16)) | (s[3:] << np.uint32(24))
    # an n-gram belongs to the text that its second byte is in; those that touch two words are left out
    inner = (s[1:-2] != 0) & (s[2:-1] != 0)
    of = np.concatenate(([0], np.cumsum(inner)))
    return g[inner], of[np.minimum(ends, len(g))]


def _slots(g: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = g * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        one = h & np.uint32(slots - 1)
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
    return one, h & np.uint32(slots - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed within each run of texts."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for name in sorted(set(langs)):
            mine = batch.column(1).filter(pa.array(langs == name))
            for _, _, raw, off in _text.runs(mine, 8 << 20):
                g, n = np.unique(_grams(raw, off)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )


class LanguageFilters:
    """The bit-sliced filter: ``table[w, slot]`` has the bits of languages 64 w to 64 w + 63."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table
        fill = [float(np.mean((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(languages))]
        #: chance that an n-gram that isn't in the filter seems to be
        self.false_rate = np.array(fill) ** HASHES

    @classmethod
    def build(cls, counts: dict[str, dict[int, int]], typical: float = 0.25, least: int = 3, slots: int = SLOTS) -> LanguageFilters:
        languages = sorted(counts)
        best: dict[int, float] = {}
        shares = {}
        for name in languages:
            total = sum(counts[name].values()) or 1
            shares[name] = {g: n / total for g, n in counts[name].items()}
            for g, s in shares[name].items():
                best[g] = max(best.get(g, 0.0), s)
        table = np.zeros((max(1, (len(languages) + 63) // 64), slots), np.uint64)
        for i, name in enumerate(languages):
            few = max(counts[name].values(), default=0) < 8 * least  # a tiny sample has no repeated n-grams to ask for
            g = np.array([g for g, s in shares[name].items() if (few or counts[name][g] >= least) and s >= typical * best[g]], np.uint32)
            for slot in _slots(g, slots):
                table[i // 64][slot] |= np.uint64(1 << (i % 64))
        return cls(languages, table)

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Corrected share of n-grams per text and language."""
        g, at = _grams(raw, off)
        one, two = _slots(g, self.table.shape[1])
        n = np.diff(at)
        hits = np.empty((len(n), len(self.languages)))
        small = self.table.astype(np.uint8) if len(self.languages) <= 8 else self.table
        for w in range(len(small)):
            mask = small[w][one] & small[w][two]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                hits[:, i] = _text.sums(((mask >> (i % 64)) & 1).astype(np.uint8), at)
        wrong = self.false_rate[None, :]
        return np.clip((hits - n[:, None] * wrong) / np.maximum(1 - wrong, 1e-9), 0, None) / np.maximum(n, 1)[:, None]


def _has_letter(texts: pa.Array, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    low = raw | 32
    found = _text.sums((low >= 97) & (low <= 122) & (raw < 128), off) > 0
    for i in np.flatnonzero(~found):
        if off[i + 1] > off[i]:
            found[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    return found


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: LanguageFilters | None = model.value
        for batch in batches:
            texts = batch.column(1)
            names: list[str] = []
            score = np.zeros(len(texts))
            for i, j, raw, off in _text.runs(texts):
                if filters is None or not filters.languages:
                    names += ["und"] * (j - i)
                    continue
                s = filters.scores(raw, off)
                top = s.argmax(axis=1)
                best = s[np.arange(j - i), top]
                second = np.partition(s, -2, axis=1)[:, -2] if s.shape[1] > 1 else np.zeros(j - i)
                ok = _has_letter(texts.slice(i, j - i), raw, off)
                score[i:j] = np.where(ok & (best > 0), best / np.maximum(best + second, 1e-12), 0)
                names += [filters.languages[k] if o else "und" for k, o in zip(top, ok)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"]
            )

    return run


def fit_languages(
    docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
    sample_per_language: int = 2000,
) -> LanguageFilters | None:
    """Learn from the rows where ``train`` holds and text and language are there; None if there are none."""
    labelled = docs.where(train & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not sizes:
        return None
    share = F.lit(0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col(lang_col) == name, F.lit(min(1_000_000, -(-sample_per_language * 1_000_000 // n)))).otherwise(share)
    sample = labelled.where((F.pmod(F.xxhash64(F.col(id_col), F.lit(6)), F.lit(1_000_000)) < share) & F.col(text_col).isNotNull())
    rows = (
        sample.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
        .mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts: dict[str, dict[int, int]] = {name: {} for name in sizes}
    for name, gram, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "gram", "n"))):
        counts[name][gram] = n
    return LanguageFilters.build(counts)


def identify_language(docs: DataFrame, filters: LanguageFilters | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(filters)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _predict(shipped), "doc_id long, lang_pred string, score double"
    )


def keep_identified(
    docs: DataFrame, filters: LanguageFilters | None, text_col: str = "text", least: float = 0.05
) -> DataFrame:
    """The rows, unchanged, whose text is in a language the filters know: not ``und``, and of its n-grams
    at least the share ``least`` (corrected for false positives) in the best language's filter.

    Without filters every row stays.
    """
    if filters is None:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(filters)
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column)
            keep = np.zeros(len(texts), bool)
            for i, j, raw, off in _text.runs(texts):
                best = shipped.value.scores(raw, off).max(axis=1)
                keep[i:j] = (best >= least) & _has_letter(texts.slice(i, j - i), raw, off)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Learn where crc32(id) mod 4 is not 2, predict everywhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = _text.crc_rest("doc_id", 4)
    filters = fit_languages(docs, F.coalesce(rest != 2, F.lit(False)))
    return identify_language(docs, filters).select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
