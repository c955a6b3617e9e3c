"""Session settings that the engine relies on, and table loading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The setting under which Spark removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def utc(spark: SparkSession) -> SparkSession:
    """All times are UTC; the other settings are the caller's."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, its naive times taken as UTC."""
    df = utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    naive = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(naive) if naive else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session; only local sessions may do without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-checkpoints")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint. Its estimated size stays that of the plan, so a loop that joins its own result takes ``stored``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder, read back: lineage and estimated size begin anew, and the shuffle files of the write go with it."""
    spark, path = df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            assert "/stored-" in folder, folder
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
