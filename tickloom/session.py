"""Session settings and the shared folder that jobs write intermediate tables to."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A join by instrument may feed an aggregation by instrument; split it all the same.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

PARTITION_BYTES = 256 << 20


def sized_for(input_bytes: int) -> dict[str, str]:
    """Settings under which a scan or shuffle partition of that much input fits in a task."""
    partitions = max(200, math.ceil(input_bytes / PARTITION_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
    }


def build_session(
    app: str = "tickloom", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sized = sized_for(input_bytes) if input_bytes else {}
    for key, value in {**SETTINGS, **sized, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor can reach.

    A machine-local folder is only made up for local masters (tests); on a cluster a missing
    setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        folder = named
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="tickloom-")
        context.setCheckpointDir(folder)
    return named or context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written_once(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read back from there, however often they are used.

    They outlive the executors that computed them, and cut the lineage. Parquet lets each reader
    take the columns it needs and gives the planner the size.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
