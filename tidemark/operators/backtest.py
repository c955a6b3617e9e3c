"""Rule backtests with limited places: admission feeds back from position to position and is a fold, all valuation is declarative."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def admit(candidates: DataFrame, opens: DataFrame, book: Sequence[str], places: int, hold: int = 63, fresh: int = 10) -> DataFrame:
    """``(book.., ticker, entry, exit)`` of the positions that each book takes.

    ``candidates`` has ``ticker, ready, priority`` (``ready``: the session from which it may be bought), ``opens`` has ``ticker, idx, open``. On every session
    that has an open of the ticker, up to ``fresh`` after ``ready``, a candidate may enter while fewer than ``places`` tickers are held; the highest priority
    goes first, ties by the ticker. A position ends ``hold`` sessions later, or on the session after its ticker's last price. Rows without a ticker, session or
    priority never enter. The fold of a book holds its open positions only, at most ``places``; books run side by side.
    """
    priced = opens.where("open > 0").select("ticker", F.col("idx").alias("at"))
    last = priced.groupBy("ticker").agg(F.max("at").alias("last"))
    c = candidates.where("ticker is not null and ready is not null and priority is not null")
    c = c.withColumn("at", F.explode(F.sequence("ready", F.col("ready") + fresh))).groupBy(*book, "at", "ticker").agg(F.max(F.col("priority").cast("double")).alias("priority"))
    rows = c.join(priced, ["ticker", "at"]).join(last, "ticker").select(*book, F.col("at").cast("long").alias("at"), "ticker", "priority", F.col("last").cast("long").alias("last"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "priority", "ticker"], ascending=[True, False, True], kind="stable")
        held, out = {}, []
        for k, (at, ticker, gone) in enumerate(zip(pdf["at"].tolist(), pdf["ticker"], pdf["last"].tolist(), strict=True)):
            if len(held) >= places or ticker in held:
                held = {t: e for t, e in held.items() if e > at}
            if len(held) < places and ticker not in held:
                held[ticker] = min(at + hold, gone + 1)
                out.append((k, held[ticker]))
        got = pdf.iloc[[k for k, _ in out]][[*book, "ticker", "at"]].rename(columns={"at": "entry"})
        got["exit"] = pd.Series([e for _, e in out], index=got.index, dtype="int64")
        return got

    schema = rows.select(*book, "ticker", F.col("at").alias("entry"), F.col("at").alias("exit")).schema
    return rows.groupBy(*book).applyInPandas(run, schema)


def nav(positions: DataFrame, opens: DataFrame, sessions: DataFrame, book: Sequence[str], places: int, cost_bps: float) -> DataFrame:
    """``(book.., idx, ret, turnover, equity)`` for every session from a book's first entry on, equity 1 before it.

    Each position weighs ``1 / places``, the rest is cash. Marks go from open to open, a missing open is carried; the names that change cost ``cost_bps`` a side.
    """
    end = sessions.agg(F.max("idx").alias("end"))
    p = positions.crossJoin(F.broadcast(end))  # one row
    days = p.withColumn("idx", F.explode(F.sequence("entry", F.least("exit", F.col("end").cast("long")))))
    days = days.join(opens.where("open > 0").select("ticker", F.col("idx").cast("long").alias("idx"), "open"), ["ticker", "idx"], "left")
    own = W.partitionBy(*book, "ticker", "entry").orderBy("idx")
    days = days.withColumn("mark", F.last("open", ignorenulls=True).over(own))
    days = days.withColumn("gain", F.col("mark") / F.lag("mark").over(own) - 1)
    gains = days.groupBy(*book, "idx").agg((F.coalesce(F.sum("gain"), F.lit(0.0)) / places).alias("ret"))
    moves = p.select(*book, "ticker", F.explode(F.array(F.struct(F.col("entry").alias("idx"), F.lit(1).alias("way")), F.struct(F.col("exit").alias("idx"), F.lit(-1).alias("way")))).alias("m")).select(*book, "ticker", "m.*")
    moves = moves.groupBy(*book, "idx", "ticker").agg(F.abs(F.sum("way")).alias("n")).groupBy(*book, "idx").agg((F.sum("n") / (2.0 * places)).alias("turnover"))
    life = p.groupBy(*book).agg(F.min("entry").alias("first"), F.max("end").cast("long").alias("end"))
    life = life.select(*book, F.explode(F.sequence("first", "end")).alias("idx"))
    x = life.join(gains, [*book, "idx"], "left").join(moves, [*book, "idx"], "left").fillna(0.0, ["ret", "turnover"])
    step = F.log1p("ret") + F.log1p(-F.col("turnover") * 2 * cost_bps / 1e4)
    return x.withColumn("equity", F.exp(F.sum(step).over(W.partitionBy(*book).orderBy("idx"))))
