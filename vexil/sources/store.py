"""Durable collections: checkpoints, an operation log, and a manifest switched by rename (IO5-IO17).

A store is a folder with ``MANIFEST.json`` (format, settings, generation), one
folder of Parquet per generation, and numbered log entries.  An entry's header
is written last and seals it; entries without one are ignored on opening.
Folders are reached through Hadoop's file systems, so any that Spark reads will do.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.collection import Collection, State
from vexil.types import Metric, require

#: Written now; folders of earlier formats are read as well.
FORMAT, READABLE = 2, (1, 2)


class Folder:
    """Small files and renames on any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._p(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._p(""))) if self.exists() else []

    def write(self, name: str, value: dict) -> None:
        out = self.fs.create(self._p(name + ".tmp"), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self.exists(name):
            self.fs.delete(self._p(name), False)
        require(self.fs.rename(self._p(name + ".tmp"), self._p(name)), f"can't rename {name}", RuntimeError)

    def read(self, name: str) -> dict:
        for n in (name, name + ".tmp"):  # the rename may have been cut off after the old file went
            if self.exists(n):
                try:
                    stream = self.fs.open(self._p(n))
                    text = bytes(stream.readAllBytes()).decode()
                    stream.close()
                    return json.loads(text)
                except (ValueError, Py4JJavaError) as e:  # no JSON, or the file system's checksum doesn't match
                    raise RuntimeError(f"{n} is damaged") from e
        raise RuntimeError(f"no {name} in {self.path}")

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._p(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str) -> None:
        self.fs.delete(self._p(name), True)


def save(collection: Collection, path: str) -> None:
    """One snapshot, replacing what is there."""
    folder = Folder(collection.spark, path)
    n = folder.read("MANIFEST.json")["generation"] + 1 if folder.exists("MANIFEST.json") else 1
    _snapshot(collection, folder, n)
    for old in folder.names():
        if old.startswith("checkpoint-") and old != f"checkpoint-{n}":
            folder.delete(old)


def _snapshot(collection: Collection, folder: Folder, generation: int) -> None:
    collection.rows.write.mode("overwrite").parquet(f"{folder.path}/checkpoint-{generation}")
    state = collection._state
    folder.write("MANIFEST.json", {
        "format": FORMAT, "kind": "collection", "generation": generation, "dim": collection.dim, "metric": collection.metric.value, "custom_ids": collection.custom_ids,
        "sparse": collection.sparse, "batches": collection.batches, "next_slot": state.next_slot, "next_id": state.next_id, "metadata": list(state.metadata),
        "index": collection.describe(folder.path) if collection.describe else None,
    })


def _check_rows(rows: DataFrame, m: dict) -> None:
    """What must hold of a snapshot's rows: unique ids and slots below the next ones, vectors of the right length."""
    odd = F.lit(False)
    if m["dim"]:
        odd = F.coalesce(F.size("vector") != m["dim"], F.lit(True)) | F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    if m["sparse"]:
        odd = odd | F.coalesce(F.exists("terms", lambda t: t["term"].isNull() | (t["term"] < 0) | F.isnan(t["weight"])), F.lit(False))
    bad = F.coalesce(odd | F.col("slot").isNull() | (F.col("slot") < 0) | (F.col("slot") >= m["next_slot"]) | F.col("id").isNull() | (F.col("id") < 0) | (F.col("id") >= m["next_id"]), F.lit(True))
    require(not rows.where(bad).limit(1).count(), "rows out of range, or vectors of another length", RuntimeError)
    for key in ("id", "slot"):
        require(not rows.groupBy(key).count().where("count > 1").limit(1).count(), f"a repeated {key}", RuntimeError)


def load(spark: SparkSession, path: str, mapped: bool = True, check: bool = True) -> Collection:
    """The last snapshot; ``mapped`` leaves the rows in their files, else they are cached. ``check`` reads them all once."""
    folder = Folder(spark, path)
    m = folder.read("MANIFEST.json")
    require(m.get("format") in READABLE and m.get("kind") == "collection", "not a collection of this format", RuntimeError)
    c = Collection(spark, m["dim"], Metric(m["metric"]), m["custom_ids"], m["sparse"])
    rows = spark.read.parquet(f"{folder.path}/checkpoint-{m['generation']}")
    require({"slot", "id", *m["metadata"]} <= set(rows.columns), "columns are missing", RuntimeError)
    if check:
        _check_rows(rows, m)
    c.batches, c.mapped = m.get("batches") or {}, mapped
    c._state = State(rows if mapped else rows.cache(), m["next_slot"], m["next_id"], tuple(m["metadata"]))
    return c


class Store:
    """A collection whose writes are logged before they count.

    One handle at a time: a checkpoint deletes the files of the generation before, which
    snapshots taken through another handle still read.
    """

    #: A checkpoint is due when the log has more bytes than this, and more than a quarter of the last checkpoint's.
    AUTO_BYTES = 64 << 20

    def __init__(self, collection: Collection, folder: Folder, generation: int, sequence: int = 0, auto: bool = True):
        self.collection, self.folder, self.generation, self.sequence, self.failed, self.auto = collection, folder, generation, sequence, False, auto
        collection.persist_path = folder.path

    @classmethod
    def persist(cls, collection: Collection, path: str, sync: bool = True) -> Store:
        """``sync`` is accepted: an entry counts when its header is renamed, which the file system makes durable."""
        folder = Folder(collection.spark, path)
        require(not folder.names(), "the folder isn't empty")
        _snapshot(collection, folder, 1)
        return cls(collection, folder, 1)

    @classmethod
    def open(cls, spark: SparkSession, path: str, mapped: bool = True, prepare: Callable[[Collection], object] | None = None, sync: bool = True) -> Store:
        """``prepare`` sees the collection before the log is replayed, so that an index can encode what that adds."""
        folder = Folder(spark, path)
        c = load(spark, path, mapped)
        if prepare:
            prepare(c)
        generation = folder.read("MANIFEST.json")["generation"]
        store = cls(c, folder, generation)
        names = folder.names()
        while f"log-{generation}-{store.sequence + 1:08d}.json" in names:
            store.sequence += 1
            store._apply(folder.read(f"log-{generation}-{store.sequence:08d}.json"), store.sequence)
        for n in names:  # other generations' files, and entries that were never sealed
            if n.startswith(("checkpoint-", "log-")) and not n.startswith((f"checkpoint-{generation}", f"log-{generation}-")):
                folder.delete(n)
        return store

    def _data(self, sequence: int) -> str:
        return f"{self.folder.path}/log-{self.generation}-{sequence:08d}"

    def _apply(self, entry: dict, sequence: int):
        c, op = self.collection, entry["op"]
        df = c.spark.read.parquet(self._data(sequence)) if entry["data"] else None
        if op == "add":
            added = c.add(df.orderBy("__order").drop("__order"))
            if entry.get("stream") is not None:
                c.batches[entry["stream"]] = entry["batch"]
            return added
        if op == "remove":
            return c.remove(df)
        if op == "update_metadata":
            return c.update_metadata(df)
        if op == "add_column":
            return c.add_metadata_column(entry["name"], entry.get("default"), kind=entry.get("kind"))
        if op == "add_column_values":
            return c.add_metadata_column(entry["name"], values=df)
        if op == "drop_column":
            return c.drop_metadata_column(entry["name"])
        raise RuntimeError(f"unknown operation {op}")

    def _logged(self, entry: dict, df: DataFrame | None):
        """Write the data, apply them (which checks them), then seal the entry."""
        require(not self.failed, "an earlier write failed; open the store again", RuntimeError)
        sequence = self.sequence + 1
        if df is not None:
            try:
                df.write.mode("overwrite").parquet(self._data(sequence))
            except Exception:
                self.failed = True
                raise
        entry["data"] = df is not None
        out = self._apply(entry, sequence)
        try:
            self.folder.write(f"log-{self.generation}-{sequence:08d}.json", entry)
        except Exception:
            self.failed = True
            raise
        self.sequence = sequence
        if self.auto and self._log_bytes() > max(self.AUTO_BYTES, self.folder.size(f"checkpoint-{self.generation}") // 4):
            self.checkpoint()
        return out

    def _log_bytes(self) -> int:
        return sum(self.folder.size(n) for n in self.folder.names() if n.startswith(f"log-{self.generation}-"))

    def add(self, df: DataFrame, stream: str | None = None, batch: int = 0) -> DataFrame | None:
        """``stream`` and ``batch`` name a micro-batch: one that was added before is not added again."""
        if stream is not None and self.collection.batches.get(stream, -1) >= batch:
            return None
        return self._logged({"op": "add", "stream": stream, "batch": batch}, df.withColumn("__order", F.monotonically_increasing_id()))

    def remove(self, ids: list[int] | DataFrame) -> int:
        gone = ids.select("id").distinct() if isinstance(ids, DataFrame) else self.collection.spark.createDataFrame([(int(i),) for i in set(ids)], "id long")
        return self._logged({"op": "remove"}, gone)

    def update_metadata(self, df: DataFrame) -> None:
        self._logged({"op": "update_metadata"}, df)

    def add_metadata_column(self, name: str, default=None, values: DataFrame | None = None, kind: str | None = None) -> None:
        if values is not None:
            self._logged({"op": "add_column_values", "name": name}, values)
        else:
            self._logged({"op": "add_column", "name": name, "default": default, "kind": kind}, None)

    def drop_metadata_column(self, name: str) -> None:
        self._logged({"op": "drop_column", "name": name}, None)

    def checkpoint(self) -> None:
        """A new generation; the manifest's rename makes it count, then the old one goes."""
        old = self.generation
        _snapshot(self.collection, self.folder, old + 1)
        self.generation, self.sequence = old + 1, 0
        self.collection._state = load(self.collection.spark, self.folder.path, check=False)._state
        for n in self.folder.names():
            if n == f"checkpoint-{old}" or n.startswith(f"log-{old}-"):
                self.folder.delete(n)
