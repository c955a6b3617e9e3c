"""Readers and writers of the file formats that the studies use. All go through Spark's sources, so any file system works."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.tables import best, insert_new, replace_version, upsert


class SourceError(ValueError):
    """A source does not have the promised form or content."""


def read_by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header or Parquet; another suffix is refused."""
    if path.endswith(".csv") or path.endswith(".csv.gz"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise SourceError(f"unknown suffix: {path}")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def read_fixed_block(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Rows of a mixed text file whose first field is an 8-digit date; percentages become fractions."""
    parts = F.split("value", r"\s*,\s*")
    rows = spark.read.text(path).where(F.regexp_like("value", F.lit(r"^\s*[0-9]{8}\s*,"))).select(parts.alias("p"))
    return rows.select(F.to_date(F.trim(F.col("p")[0]), "yyyyMMdd").alias("date"), *[(F.col("p")[i + 1].cast("double") / 100).alias(n) for i, n in enumerate(names)])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; empty lines and those that start with # are comments."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that is a list of records or ``{"records": [..]}``."""
    text = spark.read.option("wholetext", True).text(path)
    record = f"array<struct<{schema}>>"
    wrapped = F.from_json("value", f"struct<records:{record}>")["records"]
    return text.select(F.inline(F.coalesce(F.when(F.regexp_like("value", F.lit(r"^\s*\[")), F.from_json("value", record)), wrapped, F.array().cast(record))))


def columnar_rows(df: DataFrame, column: str, fields: Sequence[str]) -> DataFrame:
    """A struct of equally long arrays as rows."""
    return df.select(F.inline(F.arrays_zip(*[F.col(f"{column}.{f}").alias(f) for f in fields])))


def pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The text of a file whose content hash is pinned; another content is refused."""
    row = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h"), F.col("content").cast("string").alias("text")).first()
    if row is None or row["h"] != sha256:
        raise SourceError(f"content of {path} has drifted")
    return spark.createDataFrame([(row["text"],)], "text string")


def verified_documents(spark: SparkSession, path: str, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents whose hash is in the manifest, files or manifest rows without a match)."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("text"))
    good = files.join(manifest, "sha256")
    bad = files.join(manifest, "sha256", "left_anti").select("sha256", F.lit("UNLISTED").alias("reason")).union(manifest.join(files, "sha256", "left_anti").select("sha256", F.lit("MISSING").alias("reason")))
    return good, bad


def append_new(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> None:
    """Appends the rows whose keys the table at ``path`` does not have (insert or ignore)."""
    new = best(new, list(keys), *[F.lit(0)])
    try:
        new = new.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    except Exception as e:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def write_version(df: DataFrame, path: str, version: str) -> None:
    """Replaces the versions in ``df`` and no others: one partition folder per version."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


def write_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


__all__ = ["SourceError", "append_new", "columnar_rows", "insert_new", "pinned", "read_by_suffix", "read_fixed_block", "read_jsonl", "read_manifest", "read_tsv", "replace_version", "upsert", "verified_documents", "write_journal", "write_version"]
