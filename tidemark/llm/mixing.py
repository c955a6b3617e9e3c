"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Token totals per source give capped targets. Blocks of equal token count are apportioned to the sources and, inside each
source, to its shards, always to the highest quotient v / (2 s + 1). A shard's documents stand in a seeded order; the
quota takes that many tokens from the start of the order, going round again where the quota exceeds the shard.
Shards hold a bounded number of documents, so that a source with a third of all rows is many windows, not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"


def _seats(votes: Column, total: Column) -> Column:
    """Sainte-Laguë seats for an array of ``struct(k, v, cap)``: array of ``struct(k, seats)``.

    A divisor d gives floor(v / d + 1/2) seats, at most cap. Bisection finds the largest seat count that fits the
    total; what is left goes to the highest next quotients, ties by position.
    """
    at = lambda d: F.aggregate(votes, F.lit(0).cast("long"), lambda n, x: n + F.least(x["cap"], F.floor(x["v"] / d + 0.5)))
    top = F.aggregate(votes, F.lit(0.0), lambda n, x: F.greatest(n, x["v"]))
    mid = lambda s: (s["lo"] + s["hi"]) / 2
    divisor = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.struct(F.lit(0.0).alias("lo"), (2 * top + 1).alias("hi")),
        lambda s, _: F.when(at(mid(s)) > total, F.struct(mid(s).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid(s).alias("hi"))),
        lambda s: s["hi"],
    )
    return divisor


def apportion(df: DataFrame, group: list[str], key: str, total: str) -> DataFrame:
    """``df`` has a row per group with ``votes`` (array of struct(k, v, cap)) and ``total``: rows (group, key, seats)."""
    df = df.withColumn("d", _seats(F.col("votes"), F.col(total)))
    base = F.transform("votes", lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"), x["cap"].alias("cap"), F.least(x["cap"], F.floor(x["v"] / F.col("d") + 0.5)).alias("n")))
    df = df.withColumn("base", base)
    left = F.col(total) - F.aggregate("base", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    quotient = lambda x: F.struct((-(x["v"] / (x["n"] + 0.5))).alias("q"), x["k"].alias("k"))
    order = F.array_sort(F.transform(F.filter("base", lambda x: x["n"] < x["cap"]), quotient))
    # one more seat goes to the keys up to the last that fits, found once and compared with each
    df = df.withColumn("last", F.get(order, (F.least(left, F.size(order)) - 1).cast("int")))
    one = lambda x: F.when((F.col("last").isNotNull()) & (x["n"] < x["cap"]) & (quotient(x) <= F.col("last")), 1).otherwise(0)
    seats = F.transform("base", lambda x: F.struct(x["k"].alias(key), (x["n"] + one(x)).alias("seats")))
    return df.select(*group, F.inline(seats))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), repeat: int = 3, block: int = 8, shard_docs: int = 20_000, seed: str = "mix", row_col: str | None = None,
) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken)`` for every row of ``docs``, and ``row_col``, a key of rows, if one is given.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last. An
    empty table gives no rows. Rows with equal ids and sizes are interchangeable. Other columns are ignored.
    Only the table of sources (one row per distinct source) passes through single-row steps.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    keys = [row_col] if row_col else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *keys)
    rows = cut(rows.withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t"))), "sizes")

    src = rows.groupBy("sk").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    byname, whole = Window.orderBy("sk"), Window.partitionBy()
    src = src.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(byname) - 1) % len(weights) + 1)).cast("long"))
    src = src.withColumns({"cap": repeat * F.col("source_size"), "all": F.sum("source_size").over(whole), "allw": F.sum("w").over(whole)})
    before = Window.orderBy(F.col("cap") / F.col("w"), "sk").rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumns({"pc": F.coalesce(F.sum("cap").over(before), F.lit(0)), "pw": F.coalesce(F.sum("w").over(before), F.lit(0))})
    # capped where the cap is below the share of what the sources before it leave
    src = src.withColumn("capped", F.col("cap") * (F.col("allw") - F.col("pw")) <= F.col("w") * (F.col("all") - F.col("pc")))
    cc = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0))
    cw = F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(whole), F.lit(0))
    share = F.col("w") * (F.col("all") - cc) / F.nullif(F.col("allw") - cw, F.lit(0))
    src = src.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share.cast("double")))
    src = cut(src.select("sk", "source_size", "n", "target", "all"), "sources", 1)

    votes = F.array_sort(F.collect_list(F.struct(F.col("sk").alias("k"), F.col("target").alias("v"), F.ceil(repeat * F.col("source_size") / block).alias("cap"))))
    total = F.floor(F.max("all") / block + 0.5).cast("long")
    quota = apportion(src.agg(votes.alias("votes"), total.alias("total")), [], "sk", "total")

    # the first eight hex digits deal to shards, the rest orders the shard
    h = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = rows.join(src.select("sk", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("n") / shard_docs)).alias("shards")), "sk")
    placed = placed.withColumns({"shard": F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % F.col("shards"), "ord": F.substring(h, 9, 24)})
    shard = placed.groupBy("sk", "shard").agg(F.sum("size").alias("shard_size"))
    lists = shard.groupBy("sk").agg(F.array_sort(F.collect_list(F.struct(F.col("shard").alias("k"), F.col("shard_size").cast("double").alias("v"), F.ceil(repeat * F.col("shard_size") / block).alias("cap")))).alias("votes"))
    per_shard = apportion(lists.join(quota, "sk"), ["sk"], "shard", "seats").join(shard, ["sk", "shard"])
    per_shard = per_shard.select("sk", "shard", "shard_size", F.least(F.col("seats") * block, repeat * F.col("shard_size")).alias("quota"))

    order = Window.partitionBy("sk", "shard").orderBy("ord", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0))).join(per_shard, ["sk", "shard"])
    full = F.coalesce(F.floor(F.col("quota") / F.nullif(F.col("shard_size"), F.lit(0))), F.lit(0))
    rest = F.col("quota") - full * F.col("shard_size")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return out.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), *keys)


def oracle(block: int = 8, repeat: int = 3, shard_docs: int = 20_000, seed: str = "mix") -> str:
    """DuckDB SQL of the same mix; it ranks every quotient instead of bisecting."""
    return rf"""
WITH r AS (SELECT doc_id, source, coalesce('s' || source, 't') AS sk, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM r GROUP BY sk),
s1 AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY sk) - 1) % 3 + 1 AS INT)] AS w, {repeat} * source_size AS cap, sum(source_size) OVER () AS tot FROM s0),
s2 AS (SELECT *, sum(w) OVER () AS allw, coalesce(sum(cap) OVER b, 0) AS pc, coalesce(sum(w) OVER b, 0) AS pw FROM s1
  WINDOW b AS (ORDER BY cap / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap * (allw - pw) <= w * (tot - pc) AS capped FROM s2),
s4 AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w * (tot - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) AS DOUBLE)
  / CAST(nullif(allw - coalesce(sum(w) FILTER (WHERE capped) OVER (), 0), 0) AS DOUBLE) END AS target,
  CAST(ceil({repeat} * source_size / {block}::DOUBLE) AS BIGINT) AS seatcap, CAST(floor(tot / {block}::DOUBLE + 0.5) AS BIGINT) AS seats_all FROM s3),
q AS (SELECT sk, seats_all, target / (j + 0.5::DOUBLE) AS quot FROM s4, unnest(range(0, least(seatcap, CAST(target / {block} AS BIGINT) * 2 + 50))) AS u(j)),
qr AS (SELECT *, row_number() OVER (ORDER BY quot DESC, sk) AS rk FROM q WHERE quot > 0),
quota AS (SELECT sk, count(*) AS seats FROM qr WHERE rk <= seats_all GROUP BY sk),
p AS (SELECT r.*, source_size, target, md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, greatest(1, CAST(ceil(n / {shard_docs}::DOUBLE) AS BIGINT)) AS shards FROM r JOIN s4 USING (sk)),
p2 AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % shards AS shard, substr(h, 9, 24) AS ord FROM p),
sh AS (SELECT sk, shard, sum(size) AS shard_size FROM p2 GROUP BY ALL),
sq AS (SELECT sk, shard, coalesce(seats, 0) AS seats, shard_size / (j + 0.5::DOUBLE) AS quot FROM sh LEFT JOIN quota USING (sk), unnest(range(0, CAST(ceil({repeat} * shard_size / {block}::DOUBLE) AS BIGINT))) AS u(j)),
sqr AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY quot DESC, shard) AS rk FROM sq),
shq AS (SELECT sh.sk, sh.shard, shard_size, least({block} * (SELECT count(*) FROM sqr WHERE sqr.sk = sh.sk AND sqr.shard = sh.shard AND rk <= seats), {repeat} * shard_size) AS quota FROM sh),
o AS (SELECT p2.*, shard_size, quota, coalesce(sum(size) OVER (PARTITION BY sk, shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p2 JOIN shq USING (sk, shard))
SELECT doc_id, size, source, source_size, target,
  CAST(coalesce(quota // nullif(shard_size, 0), 0) * size + greatest(0, least(size, quota - coalesce(quota // nullif(shard_size, 0), 0) * shard_size - start)) AS BIGINT) AS taken FROM o"""
