"""Session settings and small helpers that look at a session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup side is broadcast; larger sides are shuffled.
BROADCAST_ROWS = 10_000
#: Bytes up to which it is.
BROADCAST_BYTES = 32 << 20


def build(app: str = "rolegrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Only a ``local`` master, whose one process sees its own disk, falls back to a temporary folder; on a cluster a missing
    ``spark.checkpoint.dir`` is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="rolegrain-")
    spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: lineage ends, columns stay prunable."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote. Only for tables that no later plan reads: what came of them is stored itself."""
    for table in tables:
        spark, path = table.sparkSession, table.__dict__["stored_path"]
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fits(df: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``limit`` rows of ``size`` bytes in all (as JSON); reads no more than ``limit + 1`` rows."""
    head = df.limit(limit + 1).agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    return head["rows"] <= limit and (head["bytes"] or 0) <= size


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the checkpoint folder for tables a job writes and reads back."""
    return os.path.join(ensure_checkpoint_dir(spark), name)
