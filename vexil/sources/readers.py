"""Readers of benchmark files and of other forms of sparse rows (IO1-IO4, IO23).

Files of fixed records (fvecs, ivecs) are split by Spark's own record reader;
compressed sparse rows are read by row ranges, each task its own part of the
file, so they must lie on a folder that all executors mount.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexil.types import require

TERMS = "array<struct<term:bigint,weight:double>>"


def read_vecs(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(slot, vector) of an fvecs file, or of an ivecs file if ``whole``; slots are places in the file.

    Every record is its dimension and that many 4-byte numbers; all have one dimension.
    """
    head = spark.read.format("binaryFile").load(path).select("length").first()
    require(head is not None and head["length"] >= 4 and head["length"] % 4 == 0, "not a file of vectors", RuntimeError)
    first = spark.sparkContext.binaryRecords(path, 4).first()
    dim = struct.unpack("<i", first)[0]
    require(dim > 0 and head["length"] % (4 + 4 * dim) == 0, "not a file of vectors of one dimension", RuntimeError)
    records = spark.sparkContext.binaryRecords(path, 4 + 4 * dim).zipWithIndex()
    rows = spark.createDataFrame(records.map(lambda r: (r[1], bytearray(r[0]))), "slot long, record binary")
    kind = "<i4" if whole else "<f4"

    def run(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, 4 + 4 * dim)
            if (raw[:, :4].copy().view("<i4") != dim).any():
                raise RuntimeError("vectors of different dimensions")
            x = raw[:, 4:].copy().view(kind)
            ends = np.arange(0, x.size + 1, dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, x.ravel())], ["slot", "vector"])

    return rows.mapInArrow(run, f"slot long, vector array<{'int' if whole else 'float'}>")


def read_csr(spark: SparkSession, path: str, rows_per_task: int = 100_000) -> DataFrame:
    """(slot, terms) of a file of compressed sparse rows: rows, columns and entries as 8-byte numbers, then
    the rows' starts (8 bytes each), the terms (4) and the float weights (4)."""
    with open(path, "rb") as f:
        n, columns, entries = np.fromfile(f, "<i8", 3)
        f.seek(0, 2)
        require(f.tell() == 24 + 8 * (n + 1) + 8 * entries, "not a file of sparse rows", RuntimeError)
    tasks = max(1, -(-int(n) // rows_per_task))

    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                low, high = t * rows_per_task, min(int(n), (t + 1) * rows_per_task)
                with open(path, "rb") as f:
                    f.seek(24 + 8 * low)
                    starts = np.fromfile(f, "<i8", high - low + 1)
                    if (np.diff(starts) < 0).any() or starts[0] < 0 or starts[-1] > entries:
                        raise RuntimeError("the rows' starts aren't in order")
                    size, base = int(starts[-1] - starts[0]), 24 + 8 * (int(n) + 1)
                    f.seek(base + 4 * int(starts[0]))
                    terms = np.fromfile(f, "<i4", size)
                    f.seek(base + 4 * int(entries) + 4 * int(starts[0]))
                    weights = np.fromfile(f, "<f4", size)
                if size and not (0 <= terms.min() and terms.max() < columns):
                    raise RuntimeError("a term out of range")
                pairs = pa.StructArray.from_arrays([pa.array(terms.astype(np.int64)), pa.array(weights.astype(np.float64))], ["term", "weight"])
                lists = pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), lists], ["slot", "terms"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, f"slot long, terms {TERMS}")


def read_beir(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus (id, title, text), queries (qid, text) and labels (qid, id, grade) of a BEIR folder; ids are strings."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl").withColumnRenamed("_id", "id")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").withColumnRenamed("_id", "qid")
    labels = spark.read.schema("qid string, id string, grade double").csv(f"{folder}/qrels/{split}.tsv", sep="\t", header=True)
    return corpus, queries, labels


def as_terms(df: DataFrame, name: str) -> Column:
    """The column as ``array<struct<term, weight>>``: from a map, from arrays of such structs, or from an ML vector (its non-zeros)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(name), lambda e: F.struct(e["key"].cast("long").alias("term"), e["value"].cast("double").alias("weight"))).alias("terms")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        require(kind.elementType.names == ["term", "weight"], "structs of term and weight", TypeError)
        return F.col(name).cast(TERMS).alias("terms")
    if kind.typeName() in ("vectorudt", "vector"):
        from pyspark.ml.functions import vector_to_array

        entries = F.transform(vector_to_array(F.col(name)), lambda x, i: F.struct(i.cast("long").alias("term"), x.alias("weight")))
        return F.filter(entries, lambda e: e["weight"] != 0).alias("terms")
    raise TypeError(f"{name}: sparse rows are maps, arrays of (term, weight), or vectors, not {kind.simpleString()}")


def from_csr(spark: SparkSession, starts, terms, weights) -> DataFrame:
    """(slot, terms) of compressed sparse rows in memory."""
    starts = np.asarray(starts, np.int64)
    require(len(terms) == len(weights) and len(starts) > 0 and starts[0] == 0 and starts[-1] == len(terms) and bool((np.diff(starts) >= 0).all()), "starts don't fit the terms")
    pairs = list(zip(np.asarray(terms).tolist(), np.asarray(weights, float).tolist()))
    return spark.createDataFrame([(i, pairs[a:b]) for i, (a, b) in enumerate(zip(starts[:-1], starts[1:]))], f"slot long, terms {TERMS}")
