"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

Every document becomes its ids and a closing id; only what is longer than a
sequence is cut.  Pieces that fill a sequence are one; the others are dealt into
shards of about ``shard`` pieces by a hash, and each shard is packed by
``islands`` populations apart from each other:

* a solution is a list of bins (grouping representation); the first is best-fit
  decreasing, the others best-fit in disturbed orders;
* crossover injects whole well-filled bins of one parent into the other, removes
  the bins that hold duplicates of the injected documents, and best-fits the
  documents displaced by that, largest first;
* fewer bins win, then the larger sum of squared fills;
* islands send their elites to one more population per shard (migration), which
  goes on from them.

A population stops when it reaches the lower bound of ``ceil(tokens / length)``.
Bins of a shard that are filled below ``full`` are opened, and their pieces are
dealt and packed again, until they fit in one shard, or until over 0.9 of a
round's pieces would be opened again: then every shard keeps its bins, poorly
filled ones too.  Tasks hold one shard each; nothing is collected.

Defined results: a null text counts as empty and is the closing id alone; null
or repeated ids keep their rows; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm._store import materialize
from vexil.llm._tokens import remembering


def _cut(path: str, length: int, close: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remembering(path)
        end = int(close).to_bytes(4, "little")
        for batch in batches:
            doc, piece, start, size, crc = [], [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                ids = end
                if text.is_valid:
                    ids = words.ids(words.encoder.split_words(text.as_buffer().to_pybytes())) + end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, length)):
                    part = ids[4 * at : 4 * (at + length)]
                    doc.append(name), piece.append(k), start.append(at), size.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


Bins = list[list[int]]


def best_fit(bins: Bins, loose: list[int], sizes: list[int], length: int) -> Bins:
    """Put each loose piece, in the order given, where it leaves least room; else open a bin."""
    free: dict[int, list[int]] = {}
    some = 0  # bit r: a bin with room r is there
    for b, content in enumerate(bins):
        r = length - sum(sizes[i] for i in content)
        free.setdefault(r, []).append(b)
        some |= 1 << r
    for i in loose:
        s = sizes[i]
        fits = some >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            held = free[r]
            b = held.pop()
            if not held:
                some &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = length, len(bins)
            bins.append([i])
        free.setdefault(r - s, []).append(b)
        some |= 1 << (r - s)
    return bins


def fitness(bins: Bins, sizes: list[int]) -> tuple[int, int]:
    """Less is better."""
    return len(bins), -sum(sum(sizes[i] for i in b) ** 2 for b in bins)


def crossover(into: Bins, other: Bins, sizes: list[int], length: int, rng: random.Random) -> Bins:
    """Inject well-filled bins of ``other`` into ``into``; every piece stays in exactly one bin."""
    good = [b for b in other if sum(sizes[i] for i in b) >= 0.995 * length] or other
    injected = rng.sample(good, max(1, len(good) // rng.choice((2, 3, 5))))
    taken = {i for b in injected for i in b}
    kept, loose = [], []
    for b in into:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            loose += [i for i in b if i not in taken]
    loose.sort(key=lambda i: -sizes[i])
    return best_fit([*map(list, injected), *kept], loose, sizes, length)


def evolve(sizes: list[int], length: int, seed: int, elites: list[Bins] = (), population: int = 4, generations: int = 12) -> Bins:
    """The best solution that one population finds."""
    rng = random.Random(seed)
    bound = -(-sum(sizes) // length)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    people = [[*map(list, e)] for e in elites]
    if not people:
        people.append(best_fit([], order, sizes, length))
    key = lambda b: fitness(b, sizes)
    if len(min(people, key=len)) > bound:
        while len(people) < population:
            noisy = sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.8, 1))
            people.append(best_fit([], noisy, sizes, length))
    people.sort(key=key)
    for _ in range(generations):
        if len(people[0]) <= bound or len(people) < 2:
            break
        a, b = rng.sample(people, 2)
        child = crossover(a, b, sizes, length, rng)
        if key(child) < key(people[-1]):
            people[-1] = child
            people.sort(key=key)
    return people[0]


def _island(length: int, round_: int):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("row", kind="stable").reset_index(drop=True)
        bins = evolve(items["length"].tolist(), length, hash((round_, *map(int, key))) & 0xFFFF)
        place = np.zeros(len(items), np.int32)
        for b, content in enumerate(bins):
            place[content] = b
        return items[["row", "length", "shard", "island"]].assign(bin=place)

    return run


def _migrate(length: int, full: float, round_: int):
    def run(key: tuple, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values(["island", "row"], kind="stable")
        sent = [g for _, g in told.groupby("island")]
        items = sent[0].reset_index(drop=True)
        sizes = items["length"].tolist()
        elites = []
        for g in sent:
            bins: Bins = [[] for _ in range(int(g["bin"].max()) + 1)]
            for i, b in enumerate(g["bin"].tolist()):
                bins[b].append(i)
            elites.append(bins)
        bins = evolve(sizes, length, round_ * 7919 + int(key[0]) + 1, elites)
        bin_, offset, filled = (np.zeros(len(items), np.int64) for _ in range(3))
        for b, content in enumerate(bins):
            at = 0
            for i in content:
                bin_[i], offset[i] = b, at
                at += sizes[i]
            filled[content] = at
        return items[["row", "length", "shard"]].assign(bin=bin_, offset=offset, done=filled >= full * length)

    return run


def cut_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, close: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids, closed and cut."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _cut(tokenizer_path, length, close), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def place_pieces(items: DataFrame, n: int, length: int = 2048, shard: int = 2048, islands: int = 2, full: float = 0.98) -> DataFrame:
    """(row, sequence_id, offset) of the ``n`` items (row, length), all shorter than a sequence."""
    placed, base, round_ = None, 0, 0
    while True:
        shards = max(1, -(-n // shard))
        alone = shards == 1
        dealt = items.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(round_)), F.lit(shards)).cast("int"))
        apart = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        told = apart.groupBy("shard", "island").applyInPandas(_island(length, round_), "row long, length long, shard int, island int, bin int")
        best = materialize(
            told.groupBy("shard").applyInPandas(
                _migrate(length, 0.0 if alone else full, round_), "row long, length long, shard int, bin long, offset long, done boolean"
            )
        )
        here = best.where("done").select("row", (F.col("shard") * F.lit(1 << 20) + F.col("bin") + F.lit(base)).alias("sequence_id"), "offset")
        placed = here if placed is None else placed.unionByName(here)
        if alone:
            return placed
        items = best.where("not done").select("row", "length")
        left = items.count()
        if left > 0.9 * n:  # opening bins again doesn't pay: they stay as they are
            rest = best.where("not done").select("row", (F.col("shard") * F.lit(1 << 20) + F.col("bin") + F.lit(base)).alias("sequence_id"), "offset")
            return placed.unionByName(rest)
        n, base, round_ = left, base + shards * (1 << 20), round_ + 1


def pack_documents(
    docs: DataFrame, tokenizer_path: str, length: int = 2048, close: int = 0, id_col: str = "doc_id", text_col: str = "text",
    shard: int = 2048, islands: int = 2,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(cut_documents(docs, tokenizer_path, length, close, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    short = cut.where(F.col("length") < length).select("row", "length")
    placed = place_pieces(short, short.count(), length, shard, islands)
    whole = cut.where(F.col("length") == length).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return cut.join(placed.unionByName(whole), "row").drop("row")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of 2,048 tokens of the public word BPE."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
