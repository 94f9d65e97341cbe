"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every job relies on.  They are SQL settings, so they can be put on
#: a session that somebody else created.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Splitting a hot join partition is worth the extra shuffle it can cause further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

def prepare(spark: SparkSession) -> SparkSession:
    """Put the SQL settings on a running session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", checkpoints: str | None = None
) -> SparkSession:
    """A local session for tests and the bench; on a cluster use ``prepare``."""
    builder = SparkSession.builder if checkpoints is None else SparkSession.builder.config("spark.checkpoint.dir", checkpoints)
    spark = (
        builder.master(f"local[{cores}]")
        .appName("rollbook")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording the Python call site of every expression makes large plans slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, named by ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may do without; it gets a temporary folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="rollbook-"))
    return _local_folder[0]


def staged(df: DataFrame) -> DataFrame:
    """Rows that are computed once and read back from Parquet files in the shared folder.

    Unlike a checkpoint this is compressed and by column, so it suits wide rows of which every reader takes some columns.
    """
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
