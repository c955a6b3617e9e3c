"""What several of the training-data operators share: scratch tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The setting under which Spark removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Without one the executors would write where nobody else reads, so it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-scratch"
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def cut(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the scratch folder and return the table read back.

    The lineage ends here, so a lost executor costs the tasks that it held and no more. The shuffle files of the write go with it: nothing reads
    them again, and until the driver collects its garbage they would stand beside those of all later steps.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` whose successors are written; nothing may read them afterwards."""
    for df in tables:
        jvm, folder = df.sparkSession._jvm, {f.rpartition("/")[0] for f in df.inputFiles()}
        for path in folder:
            assert "/tidemark-" in path, path
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, ids: DataFrame, key: str, most: int = 500_000) -> DataFrame:
    """The rows of ``df`` whose key is not in ``ids``; up to ``most`` ids are counted and broadcast, more are joined by shuffle."""
    n = ids.count()
    if not n:
        return df
    return df.join(F.broadcast(ids) if n <= most else ids, key, "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str, most: int = 500_000) -> DataFrame:
    """The rows of ``df`` whose key is in ``ids``; up to ``most`` ids are counted and broadcast, more are joined by shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, key, "left_semi")


def bounded_sample(ids: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of the key: the same ones on every run."""
    return ids.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of the links ``(a, b)``: ``(id, component)`` with the smallest id reachable.

    Alternates large-star and small-star steps, each a partial aggregation to the smallest neighbour and an
    equi-join, until a round changes nothing, however many that takes (about the logarithm of the longest path).
    Only the two convergence sums reach the driver. Ids may be of any type that has an order.
    """
    start = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    edges, before = start, None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(large, *([edges] if edges is not start else []))
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    discard(start)
    # every id of a link but the least of its component is the larger end of an edge to that least one
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
