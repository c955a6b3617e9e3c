"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import compact_windows, decontam, html_lstm, mixing, ngram_join, pii, quality_pu, quality_rules, toxicity, warc
from .common import scratch_dir, table

#: The key of the registered query; real runs pass their own.
PII_KEY = "tidemark-query-key"


def op2_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.surrogates(docs, PII_KEY).withColumn("entity_kinds", F.array_join("entity_kinds", ","))


def op10_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op5_decontamination(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_compact_windows(spark, sf_dir):
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


def _remainder(n):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.toxicity(docs, labels.where(_remainder(3) != 1), threshold=0.7)
    return out.withColumn("held_out", _remainder(3) == 1)


def op4_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_pu.quality(docs, labels.where((_remainder(5) != 0) & (F.col("quality") == 1)), threshold=0.3)
    return out.withColumn("held_out", _remainder(5) == 0)


def op3_warc(spark, sf_dir):
    path = f"{scratch_dir(spark)}/tidemark-{uuid.uuid4().hex}/warc"
    warc.write_captures(table(spark, sf_dir, "pages"), path)
    return warc.captures(warc.read_records(spark, path))


def op7_html_extraction(spark, sf_dir):
    return html_lstm.extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extraction": op7_html_extraction, "op3_warc": op3_warc, "op1_toxicity": op1_toxicity, "op4_quality_classifier": op4_quality_classifier, "op5_decontamination": op5_decontamination, "op9_compact_windows": op9_compact_windows, "op2_quality_rules": op2_quality_rules, "op6_mixing": op6_mixing, "op8_surrogates": op8_surrogates, "op10_ngram_join": op10_ngram_join}
ORACLES = {"op3_warc": warc.oracle(), "op2_quality_rules": quality_rules.oracle(), "op6_mixing": mixing.oracle(), "op10_ngram_join": ngram_join.oracle()}
