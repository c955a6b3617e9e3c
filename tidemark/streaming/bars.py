"""Streaming twins of the bar, detector and de-duplication operators; on bounded input they give the batch results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.portfolio import flow_bars


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, naive times taken as UTC."""
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    naive = {f.name: F.col(f.name).cast("timestamp") for f in schema if isinstance(f.dataType, T.TimestampNTZType)}
    return s.withColumns(naive) if naive else s


def quotes_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", F.col("event_type").alias("ticker"), "ts", "user_id", "value", k.alias("k"))


def stream_bars(quotes: DataFrame, width: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Signed-flow bars; a bar is final once the watermark has passed it."""
    return flow_bars(quotes.withWatermark("ts", late), width)


def stream_dedupe(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark, for insert-once ledgers."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_cusum(values: DataFrame, drift: float) -> DataFrame:
    """One-sided CUSUM per ticker and day over ``(ticker, day, ts, x)``; the state is the two sums.

    Rows of a batch are taken in time order; a batch must not hold rows older than the batches before it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        up, down = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for x in rows["x"]:
            if pd.isna(x):
                out.append(None)
                continue
            up, down = max(0.0, up + x - drift), max(0.0, down - x - drift)
            out.append(up if x >= 0 else down)
        state.update((up, down))
        yield pd.DataFrame({"ticker": rows["ticker"], "day": rows["day"], "ts": rows["ts"], "cusum": pd.Series(out, index=rows.index, dtype="float64")})

    return values.groupBy("ticker", "day").applyInPandasWithState(run, "ticker string, day date, ts timestamp, cusum double", "up double, down double", "append", "NoTimeout")


def drain(stream: DataFrame, checkpoint: str, name: str, mode: str = "append") -> None:
    """Runs a stream over what is there into the memory table ``name`` and stops."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
