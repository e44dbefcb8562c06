"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Fingerprints: A-Z are lower-cased, words are runs of anything but ASCII white
space, shingles are ``shingle`` consecutive words joined by a space (a shorter
text is one shingle of all its words), each hashed with XXH64, seed 42.  A bit
of the 64 is set if it is set in more than half the hashes; without words the
fingerprint is 0.

Links: fingerprints that differ in at most ``radius`` bits.  The 64 bits are cut
into ``segments`` parts; if two fingerprints differ in at most ``radius`` bits,
one part differs in at most ``radius // segments`` of them.  Every *distinct*
part emits all its variants within half of that bound, so two such parts meet in
at least one variant; the variants are shuffled.  With one segment this is ball
hashing over the whole fingerprint: 2,081 variants for radius 4.  With the
default of two it is 66, for the same links.  A variant is shared by no more
parts than it has variants itself (33 with two segments), however many
fingerprints have those parts.

The fingerprints of two parts that met, and of one part alone, are verified on
all 64 bits in numpy inside the task; only a spanning forest of the links found
leaves it, never all pairs.  A part with more than ``block`` fingerprints is cut
into blocks of them, and each pair of blocks is a task of its own.

Defined results: a null text counts as empty; empty texts have fingerprint 0 and
link with each other (and with any fingerprint within the radius); a null
``doc_id`` keeps its row and links like any other, the component's name is the
smallest id in it, null if there is none; repeated ids
keep a row each; an empty table gives an empty table; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm._graph import connected_components, union_find_forest
from vexil.llm._join import lookup
from vexil.llm._store import materialize

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of one text as an unsigned 64-bit number."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return digest(b" ".join(parts), 42)
    step = b" ".join
    counts, n = np.zeros(64, np.int64), len(parts) - shingle + 1
    for i in range(0, n, 1 << 16):
        block = parts[i : i + (1 << 16) + shingle - 1]
        hashes = np.array([digest(step(t), 42) for t in zip(*(block[k:] for k in range(shingle)))], np.uint64)
        counts += _bit_counts(hashes)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255):
        bits = np.unpackbits(hashes[i : i + 255].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return total


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "h", "fp"])

    return run


def _width(segments: int, radius: int) -> int:
    if segments not in (1, 2, 4) or radius // segments > 4:
        raise ValueError("segments must be 1, 2 or 4, and a segment's bound at most 4")
    return 64 // segments


def _parts(fp, segments: int, width: int):
    """Array of longs: each segment of the fingerprint, the segment's number in front."""
    if segments == 1:
        return F.array(fp)
    mask = F.lit((1 << width) - 1).cast("long")
    return F.array(*(F.shiftrightunsigned(fp, s * width).bitwiseAND(mask).bitwiseOR(F.lit(s << width).cast("long")) for s in range(segments)))


def _variants(part, segments: int, radius: int):
    """Array of longs: the variants of a part within half its bound."""
    width, half = _width(segments, radius), (radius // segments + 1) // 2
    masks = [0]
    if half >= 1:
        masks += [1 << i for i in range(width)]
    if half >= 2:
        masks += [(1 << i) | (1 << j) for i in range(width) for j in range(i)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    flips = F.array(*[F.lit(signed(m)).cast("long") for m in masks])  # folded into one constant
    return F.transform(flips, lambda m: part.bitwiseXOR(m))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(variant, part), sorted by variant, to the pairs of parts that share one."""
    before = pa.table({"variant": pa.array([], pa.int64()), "part": pa.array([], pa.int64())})

    def pairs(variant: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        out, at, step = [], np.arange(len(variant)), 1
        while len(at := at[at + step < len(variant)]):
            at = at[variant[at + step] == variant[at]]
            out.append(np.stack([part[at], part[at + step]], axis=1))
            step += 1
        found = np.sort(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=1)
        found = np.unique(found, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["one", "two"])

    for batch in batches:
        now = pa.concat_tables([before, pa.Table.from_batches([batch.select([0, 1])]).cast(before.schema)])
        variant, part = (now.column(c).to_numpy() for c in (0, 1))
        # the last variant may go on in the next batch; it is shared by a few parts only
        cut = int(np.searchsorted(variant, variant[-1])) if len(variant) else 0
        yield pairs(variant[:cut], part[:cut])
        before = now.slice(cut).combine_chunks()
    yield pairs(*(before.column(c).to_numpy() for c in (0, 1)))


def _verify(radius: int):
    """Rows sorted by bucket: link those of one bucket that differ in at most radius bits; forests come out.

    Where two parts or blocks meet (``across``), only pairs of rows of different sides count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def links(table: pa.Table) -> pa.RecordBatch:
            one, two, ci, cj = (table.column(c).to_numpy() for c in ("one", "two", "ci", "cj"))
            fp, node, side = (table.column(c).to_numpy() for c in ("fp", "node", "side"))
            across = (one != two) | (ci != cj)
            fp = fp.view(np.uint64)
            new = np.ones(len(fp), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (ci[1:] != ci[:-1]) | (cj[1:] != cj[:-1])
            end = np.append(np.flatnonzero(new)[1:], len(fp))[np.cumsum(new) - 1]
            out_a, out_b = [], []
            at, step = np.arange(len(fp)), 1
            while len(at := at[at + step < end[at]]):
                other = at + step
                near = np.bitwise_count(fp[at] ^ fp[other]) <= radius
                near &= ~across[at] | (side[at] != side[other])
                out_a.append(node[at[near]])
                out_b.append(node[other[near]])
                if sum(map(len, out_a)) > 1 << 18:
                    a, b = np.concatenate(out_a), np.concatenate(out_b)
                    keep = union_find_forest(a, b)
                    out_a, out_b = [a[keep]], [b[keep]]
                step += 1
            a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
            b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
            keep = union_find_forest(a, b)
            return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

        def cut(table: pa.Table) -> int:
            """Where the last bucket of the rows begins: it may go on in the next batch."""
            keys = [table.column(c).to_numpy() for c in ("one", "two", "ci", "cj")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            return int(len(same) - np.argmin(same[::-1])) if not same.all() else 0

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 15:
                table = pa.Table.from_batches(held)
                k = cut(table)
                if k:
                    yield links(table.slice(0, k))
                held, rows = table.slice(k).to_batches(), table.num_rows - k
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, h, fp): a hash and the fingerprint of every whole text, as signed longs."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(
        _fingerprints(shingle), "doc_id long, h long, fp long"
    )


def hamming_links(distinct: DataFrame, radius: int = 4, segments: int = 2, block: int = 4096) -> DataFrame:
    """Edges (a, b) that span the components of fingerprints within ``radius`` bits.

    ``distinct`` has one row per fingerprint: fp long, node long.
    """
    width = _width(segments, radius)
    every = distinct.select("fp", "node", F.explode(_parts(F.col("fp"), segments, width)).alias("part"))
    parts = materialize(every.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    # a number of tasks of its own: these few small rows become many
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    emitted = parts.select("part").repartition(tasks, "part").select(F.explode(_variants(F.col("part"), segments, radius)).alias("variant"), "part")
    met = materialize(emitted.repartition("variant").sortWithinPartitions("variant").mapInArrow(_met, "one long, two long").distinct())
    size = F.ceil(F.col("n") / F.lit(block)).cast("int")
    of = lambda c, k: parts.select(F.col("part").alias(c), size.alias(k), F.col("n").alias(f"n_{c}"))
    two = lookup(lookup(met, of("one", "c1"), ["one"], "n_one"), of("two", "c2"), ["two"], "n_two")
    alone = parts.where("n > 1").select(F.col("part").alias("one"), F.col("part").alias("two"), size.alias("c1"), size.alias("c2"), "n")
    # who takes part: (part, one, two, side, own blocks, the other's blocks); one part alone has one side
    places = materialize(
        two.select(F.col("one").alias("part"), "one", "two", F.lit(0).alias("side"), F.col("c1").alias("own"), F.col("c2").alias("others"), F.col("n_one").alias("n"))
        .unionByName(two.select(F.col("two").alias("part"), "one", "two", F.lit(1).alias("side"), F.col("c2").alias("own"), F.col("c1").alias("others"), F.col("n_two").alias("n")))
        .unionByName(alone.select(F.col("one").alias("part"), "one", "two", F.lit(0).alias("side"), F.col("c1").alias("own"), F.col("c2").alias("others"), "n"))
    )
    # fingerprints of crowded parts stay where they are: the places of a bounded number of parts are broadcast
    crowded = F.broadcast(parts.where(F.col("n") > block).orderBy(F.col("n").desc(), "part").limit(1000).select("part", F.lit(True).alias("crowded")))
    places = places.join(crowded, "part", "left")
    every = every.join(crowded, "part", "left")
    few, many = (lambda df: df.where("crowded is null").drop("crowded")), (lambda df: df.where("crowded").drop("crowded"))
    placed = few(every).join(few(places), "part").unionByName(many(every).join(F.broadcast(many(places)), "part"))
    mine = F.pmod(F.xxhash64("fp"), F.col("own")).cast("int")
    dealt = placed.select("fp", "node", "one", "two", "side", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
    alike = F.col("one") == F.col("two")
    first = F.when(alike, F.least("mine", "other")).when(F.col("side") == 0, F.col("mine")).otherwise(F.col("other"))
    last = F.when(alike, F.greatest("mine", "other")).when(F.col("side") == 0, F.col("other")).otherwise(F.col("mine"))
    dealt = dealt.select("one", "two", first.alias("ci"), last.alias("cj"), F.when(alike, F.col("mine")).otherwise(F.col("side")).alias("side"), "fp", "node")
    keys = ["one", "two", "ci", "cj"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(radius), "a long, b long").distinct()


def _components(prints: DataFrame, radius: int, segments: int, block: int) -> DataFrame:
    """(fp, root, name, size) of each fingerprint: its component, the smallest id in that, and how many rows have the fingerprint."""
    # a node is a number of its own, so that fingerprints of rows without an id link as well
    distinct = materialize(
        prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")).withColumn("node", F.monotonically_increasing_id())
    )
    roots = connected_components(hamming_links(distinct.select("fp", "node"), radius, segments, block))
    rooted = materialize(distinct.join(roots, "node", "left").select("fp", "least", "size", F.coalesce("root", "node").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("kinds"))
    return lookup(rooted.drop("least"), names, ["root"], "kinds").select("fp", "root", "name", "size")


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = 4,
    segments: int = 2,
    block: int = 4096,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document; see the module's text."""
    prints = materialize(simhash_fingerprints(docs, id_col, text_col, shingle).select("doc_id", "fp"))
    classes = materialize(_components(prints, radius, segments, block))
    return lookup(prints, classes, ["fp"], "size").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("name").alias("component_id")
    )


def keep_representatives(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = 4,
    segments: int = 2,
    block: int = 4096,
) -> DataFrame:
    """One row, unchanged, of each component: that with the smallest id (rows without an id last), of several with it
    that with the smallest hash of its text, of equal ones any."""
    from pyspark.sql import Window

    prints = materialize(simhash_fingerprints(docs, id_col, text_col, shingle))
    classes = materialize(_components(prints, radius, segments, block).select("fp", "root", "size"))
    keys = ["__none", "__id", "__h"]
    placed = F.struct(F.col("doc_id").isNull().alias("__none"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("h").alias("__h"))
    each = prints.select(placed.alias("row"), "fp").groupBy("row", "fp").agg(F.count(F.lit(1)).alias("copies"))
    first = lookup(each, classes, ["fp"], "size").groupBy("root").agg(F.min(F.struct("row", "copies")).alias("first"))
    kept = materialize(first.select(*(F.col(f"first.row.{k}").alias(k) for k in keys), F.col("first.copies").alias("__copies")))
    given = F.col(f"`{id_col}`").cast("long")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")  # so that no name clashes
    marked = docs.select(whole, given.isNull().alias("__none"), F.coalesce(given, F.lit(0)).alias("__id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("__h"))
    here = lookup(marked, kept, keys, "__copies").where("__copies is not null")
    order = Window.partitionBy(*keys).orderBy("__copies")
    repeated = here.where("__copies > 1").withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")
    return here.where("__copies = 1").unionByName(repeated).select("__row.*")


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
