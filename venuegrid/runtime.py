"""Session helpers: where lineage is cut, and how big a broadcast may be."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names; only a local session may fall back to
    a scratch folder, because executors elsewhere could not read it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="venuegrid-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def scratch_folder(spark: SparkSession) -> str:
    """A new folder of its own below the one that all executors reach."""
    return f"{ensure_checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_for(df: DataFrame, rows: int, rows_each: int) -> int:
    """Partitions for costly work on ``rows`` rows: enough to use the cluster,
    no more than the session's shuffle partitions."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-rows // rows_each)))


BROADCAST_ROWS = 10_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a table that is expected to be small, and ask for a
    broadcast only if its row count really is."""
    small = materialise(df)
    return F.broadcast(small) if small.count() <= limit else small
