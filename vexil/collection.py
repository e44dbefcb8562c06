"""Collections: ids, slots, metadata, writes and searches over one DataFrame (W1-W16, IO1-IO22, F17-F18, R*).

A collection is an immutable snapshot swapped under a lock: every write builds a
new DataFrame after all its checks, so a failed write changes nothing.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexil.functions.kernels import normalized
from vexil.functions.predicate import as_expr
from vexil.materialize import materialize
from vexil.operators.search import flat_search, padded
from vexil.types import Metric, require

_OWN = ("slot", "id", "vector", "terms")
_KINDS = (T.LongType, T.DoubleType, T.StringType)


@dataclass(frozen=True)
class State:
    rows: DataFrame  # slot, id, vector?, terms?, metadata...
    next_slot: int = 0
    next_id: int = 0
    metadata: tuple[str, ...] = ()


def _typed(df: DataFrame, names: list[str]) -> DataFrame:
    """Metadata columns as bigint, double or string."""
    for n in names:
        kind = df.schema[n].dataType
        if isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
            df = df.withColumn(n, F.col(n).cast("long"))
        elif isinstance(kind, T.FloatType):
            df = df.withColumn(n, F.col(n).cast("double"))
        elif not isinstance(kind, _KINDS):
            raise TypeError(f"{n}: metadata are whole numbers, floats or strings, not {kind.simpleString()}")
    return df


#: Writes after which the rows are materialized, so that plans stay short.
WRITES = 16


def _starts(df: DataFrame, part: str) -> tuple[DataFrame, int]:
    """(__part, __start): how many rows lie in the partitions before; and the number of all rows. One row per partition."""
    starts, at = [], 0
    for p, n in sorted(df.groupBy(part).count().collect()):
        starts.append((p, at))
        at += n
    return df.sparkSession.createDataFrame(starts or [(0, 0)], "__part int, __start long"), at


class Collection:
    def __init__(self, spark: SparkSession, dim: int | None = None, metric: Metric = Metric.L2, custom_ids: bool = False, sparse: bool = False):
        self.spark, self.dim, self.metric, self.custom_ids, self.sparse = spark, dim, Metric(metric), custom_ids, sparse
        fields = "slot long, id long" + (", vector array<float>" if dim else "") + (", terms array<struct<term:bigint,weight:double>>" if sparse else "")
        self._state = State(spark.createDataFrame([], fields))
        self._lock, self._writes = threading.Lock(), 0
        self.persist_path: str | None = None
        self.mapped = False
        self.batches: dict[str, int] = {}  # the last micro-batch of each stream
        # what an index over these rows adds: derived columns of new rows, and its own description in a snapshot
        self.encode: Callable[[DataFrame], DataFrame] | None = None
        self.describe: Callable[[str], dict] | None = None

    # --- what is there

    @property
    def rows(self) -> DataFrame:
        return self._state.rows

    @property
    def size(self) -> int:
        return self.rows.count()

    @property
    def slots(self) -> int:
        return self._state.next_slot

    @property
    def metadata_schema(self) -> list[tuple[str, str]]:
        return [(n, self.rows.schema[n].dataType.simpleString()) for n in self._state.metadata]

    def allowed(self, where=None, allowed: DataFrame | None = None) -> DataFrame:
        """The live rows under a predicate and a set of ids (unknown and repeated ones don't matter)."""
        rows = self.rows
        if where is not None:
            rows = rows.where(as_expr(where).column(rows.schema))
        if allowed is not None:
            rows = rows.join(allowed.select("id").distinct(), "id", "left_semi")
        return rows

    def ids(self, where=None) -> DataFrame:
        return self.allowed(where).select("id").orderBy("id")

    def _by_id(self, ids: list[int]) -> DataFrame:
        require(len(set(ids)) == len(ids), "repeated ids")
        asked = self.spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "place long, id long")
        found = asked.join(self.rows, "id")
        require(found.count() == len(ids), "unknown ids")
        return found.orderBy("place")

    def get_vectors(self, ids: list[int]) -> DataFrame:
        return self._by_id(ids).select("id", "vector")

    def get_metadata(self, ids: list[int], columns: list[str] | None = None) -> DataFrame:
        return self._by_id(ids).select("id", *(columns or self._state.metadata))

    # --- writes

    def _swap(self, rows: DataFrame, **changes) -> None:
        self._writes += 1
        if self._writes % WRITES == 0:
            rows = materialize(rows)
        self._state = replace(self._state, rows=rows, **changes)

    def _checked(self, df: DataFrame) -> DataFrame:
        if self.dim:
            odd = F.col("vector").isNull() | (F.size("vector") != self.dim) | F.exists("vector", lambda x: x.isNull())
            require(not df.where(odd).limit(1).count(), f"vectors need {self.dim} components")
            df = df.withColumn("vector", F.col("vector").cast("array<float>"))
            if self.metric == Metric.COSINE:
                require(not df.where(~F.exists("vector", lambda x: x != 0)).limit(1).count(), "a zero vector has no direction")
                df = df.withColumn("vector", normalized(F.col("vector")).cast("array<float>"))
        return df

    def add(self, df: DataFrame) -> DataFrame:
        """Add rows (vector and/or terms, id if ids are custom, metadata); returns their ids."""
        with self._lock:
            state = self._state
            names = [c for c in df.columns if c not in _OWN]
            df = self._checked(_typed(df, names))
            for n in names:
                if n in state.metadata:
                    new, old = df.schema[n].dataType, state.rows.schema[n].dataType
                    if isinstance(old, T.DoubleType) and isinstance(new, T.LongType):
                        df = df.withColumn(n, F.col(n).cast("double"))
                    else:
                        require(new == old, f"{n} is {old.simpleString()}")
            # the id is the partition above 33 bits of the place in it: with the partitions' starts it gives the row's number
            placed = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33).cast("int"))
            placed = materialize(self.encode(placed) if self.encode else placed)
            starts, n = _starts(placed, "__part")
            place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
            numbered = placed.join(F.broadcast(starts), "__part").withColumn("__n", F.col("__start") + place).withColumn("slot", F.col("__n") + state.next_slot)
            if self.custom_ids:
                require("id" in df.columns, "ids are missing")
                require(isinstance(df.schema["id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)), "ids are whole numbers", TypeError)
                numbered = numbered.withColumn("id", F.col("id").cast("long"))
                bad = numbered.groupBy("id").count().where("count > 1 or id < 0 or id is null").limit(1).count()
                require(not bad and not numbered.join(state.rows, "id", "left_semi").limit(1).count(), "ids are repeated, negative or in use")
            else:
                require("id" not in df.columns, "this collection gives the ids itself")
                numbered = numbered.withColumn("id", F.col("__n") + state.next_id)
            fresh = numbered.drop("__at", "__n", "__part", "__start")
            if not n:
                return fresh.select("id")
            top = fresh.agg(F.max("id")).first()[0]
            metadata = (*state.metadata, *(c for c in names if c not in state.metadata))
            self._swap(state.rows.unionByName(fresh, allowMissingColumns=True), next_slot=state.next_slot + n, next_id=max(state.next_id, top + 1), metadata=metadata)
            return fresh.select("id")

    def remove(self, ids: list[int] | DataFrame) -> int:
        """Unknown ids are skipped; returns how many rows went."""
        with self._lock:
            gone = ids.select("id").distinct() if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in set(ids)], "id long")
            n = self.rows.join(gone, "id", "left_semi").count()
            self._swap(self.rows.join(gone, "id", "left_anti"))
            return n

    def upsert(self, df: DataFrame) -> DataFrame:
        self.remove(df.select(F.col("id").cast("long").alias("id")))
        return self.add(df)

    def compact(self) -> int:
        """Renumber the slots of the live rows in their order; ids stay. Returns the slots freed.

        Slots are a total order, so numbering is by range partitions: each counts its rows,
        the counts' running sums are its start.
        """
        with self._lock:
            state = self._state
            ranged = materialize(state.rows.repartitionByRange("slot").withColumn("__part", F.spark_partition_id()))
            lookup, at = _starts(ranged, "__part")
            inner = F.row_number().over(Window.partitionBy("__part").orderBy("slot"))
            rows = ranged.withColumn("__n", inner).join(F.broadcast(lookup), "__part").withColumn("slot", F.col("__start") + F.col("__n") - 1)
            freed = state.next_slot - at
            self._swap(rows.drop("__part", "__start", "__n"), next_slot=at)
            return freed

    def update_metadata(self, df: DataFrame) -> None:
        """Overwrite columns of rows by id; null is a value. Unknown or repeated ids and unknown columns are errors."""
        with self._lock:
            names = [c for c in df.columns if c != "id"]
            for n in names:
                require(n in self._state.metadata, f"no such column: {n}")
            df = _typed(df, names)
            require(not df.groupBy("id").count().where("count > 1").limit(1).count(), "repeated ids")
            require(not df.join(self.rows, "id", "left_anti").limit(1).count(), "unknown ids")
            new = df.select("id", F.lit(True).alias("__hit"), *(F.col(n).alias(f"__new_{n}") for n in names))
            rows = self.rows.join(new, "id", "left")
            for n in names:
                rows = rows.withColumn(n, F.when(F.col("__hit"), F.col(f"__new_{n}").cast(self.rows.schema[n].dataType)).otherwise(F.col(n)))
            self._swap(rows.select(*self.rows.columns))

    def add_metadata_column(self, name: str, default=None, values: DataFrame | None = None, kind: str | None = None) -> None:
        """A constant for every row, or values (id, value) with null elsewhere."""
        with self._lock:
            require(name not in self.rows.columns, f"{name} is there")
            if values is not None:
                require(not values.join(self.rows, "id", "left_anti").limit(1).count(), "unknown ids")
                require(not values.groupBy("id").count().where("count > 1").limit(1).count(), "repeated ids")
                rows = self.rows.join(_typed(values.select("id", F.col("value").alias(name)), [name]), "id", "left")
            else:
                column = F.lit(int(default) if isinstance(default, bool) else default)
                rows = self.rows.withColumn(name, column.cast(kind or {int: "long", bool: "long", float: "double", str: "string"}[type(default)]))
            self._swap(rows, metadata=(*self._state.metadata, name))

    def drop_metadata_column(self, name: str) -> None:
        with self._lock:
            require(name in self._state.metadata, f"no such column: {name}")
            self._swap(self.rows.drop(name), metadata=tuple(m for m in self._state.metadata if m != name))

    # --- searches

    def query(self, queries: DataFrame, k: int, where=None, allowed: DataFrame | None = None, pad: bool = False) -> DataFrame:
        """Exact search among the rows that the filters allow; filters come before the top k."""
        hits = flat_search(self.allowed(where, allowed), queries, k, self.metric)
        return padded(hits, queries, k) if pad else hits
