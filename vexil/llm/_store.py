"""Where intermediate tables go.

Lineage is only ever cut through the folder that the cluster names in
``spark.checkpoint.dir``; a folder of this machine's own is used in local mode
alone, when no folder is named (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that ``DataFrame.checkpoint`` has a folder all executors share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vexil-checkpoint-")
    sc.setCheckpointDir(named)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep the rows in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``materialize``, then no more partitions than one for each ``rows`` rows.

    Grouping and joining tables of one partition moves nothing, which matters where a loop
    passes over small tables; larger ones keep the partitions they have up to that number.
    """
    out = materialize(df)
    return out.coalesce(max(1, -(-out.count() // rows)))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it again; for wide rows such as texts."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
