"""Catalysts: articles told apart by identity, near duplicates merged within a bounded span, each cluster known from its earliest article."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text
from tidemark.operators.asof import within
from tidemark.session import checkpointed, removed, stored

#: A cluster spans at most so many seconds; alike by words, or by letters and the words of the shorter one.
SPAN, JACCARD, LETTERS, WORDS = 12 * 3600, 0.72, 0.88, 0.75
#: Capitalised phrases that name nothing.
GENERIC = (
    "after", "amid", "before", "breaking", "company", "exclusive", "federal", "global", "markets", "new", "news", "president", "report", "says", "stocks",
    "the", "update", "wall street",
)
#: Fixed value: one to four capitalised words or words in capitals.
NAME = r"(?U)\b(?:[A-Z][a-z]{2,}|[A-Z]{2,})(?:\s+(?:[A-Z][a-z]{2,}|[A-Z]{2,})){0,3}\b"


def entities(title: Column, tickers: Column) -> Column:
    """The names in a headline and its tickers, ``name:`` or ``ticker:`` before each; generic phrases are none. NULL headlines have no names."""
    names = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(NAME), F.lit(0)), text.normalised)
    names = F.filter(F.array_distinct(names), lambda x: (x != "") & ~x.isin(*GENERIC))
    own = F.filter(F.coalesce(tickers, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.array_union(F.transform(own, lambda x: F.concat(F.lit("ticker:"), F.upper(x))), F.transform(names, lambda x: F.concat(F.lit("name:"), x)))


def revisions(articles: DataFrame) -> DataFrame:
    """One row per (identity, time, normalised headline): ``rev, identity, at, norm, w, entities, events``.

    ``articles`` has ``event_id, identity, public_time, title, tickers``. Rows without a time are left out; without an identity, time and
    headline stand for it, and without a headline the event does.
    """
    a = articles.where("public_time is not null").withColumns({"norm": text.normalised(F.coalesce("title", F.lit(""))), "at": F.unix_micros("public_time")})
    event = F.col("event_id").cast("string")
    own = F.concat_ws("|", F.lit("fallback"), F.col("at").cast("string"), "norm", F.when(F.col("norm") == "", event))
    a = a.withColumn("identity", F.coalesce(F.when(F.trim("identity") != "", F.trim("identity")), own))
    a = a.withColumns({"rev": F.substring(F.sha1(F.concat_ws("|", "identity", F.col("at").cast("string"), "norm")), 1, 20), "e": entities(F.col("title"), F.col("tickers"))})
    g = a.groupBy("rev", "identity", "at", "norm").agg(F.array_distinct(F.flatten(F.collect_set("e"))).alias("entities"), F.array_sort(F.collect_set("event_id")).alias("events"))
    return g.withColumn("w", text.tokens(F.col("norm")))


@F.pandas_udf(T.DoubleType())
def letters(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching letters of two headlines, twice over their lengths."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def candidates(r: DataFrame) -> DataFrame:
    """``(one, two)``, each pair once: ids of revisions within the span of which one may hold three quarters of the other's words, as all that read alike do.

    Of two such headlines the one with fewer words, n, shares a word among its n // 4 + 1 rarest with the other, so it is looked up by these
    only. Each word sets one of 128 bits; bits that the other one lacks are words that it lacks, and more than n // 4 are too many.
    """
    words = r.where(F.size("w") > 0).select("id", F.timestamp_micros("at").alias("t"), F.explode(F.transform("w", lambda x: F.xxhash64(x))).alias("word"))
    ranked = words.join(words.groupBy("word").agg(F.count("*").alias("c")), "word").groupBy("id", "t").agg(F.array_sort(F.collect_list(F.struct("c", "word"))).alias("k"))
    ranked = ranked.select("id", "t", F.size("k").alias("n"), F.transform("k", lambda x: x["word"]).alias("h"))
    half = lambda k: F.expr(f"aggregate(h, 0L, (b, x) -> b | if(pmod(x, 128) div 64 = {k}, shiftleft(1L, cast(pmod(x, 64) as int)), 0L))").alias(f"b{k}")
    ranked = checkpointed(ranked.select("*", half(0), half(1)))
    side = lambda who, h: ranked.select(F.explode(h).alias("word"), *[F.col(c).alias(f"{c}_{who}") for c in ("id", "t", "n", "b0", "b1")])
    x = within(side("all", F.col("h")), side("few", F.slice("h", F.lit(1), F.floor(F.col("n") / 4).cast("int") + 1)), ["word"], "t_all", "t_few", SPAN, SPAN)
    lacks = F.bit_count(F.col("b0_few").bitwiseAND(F.bitwise_not("b0_all"))) + F.bit_count(F.col("b1_few").bitwiseAND(F.bitwise_not("b1_all")))
    gap = F.abs(F.unix_micros("t_all") - F.unix_micros("t_few"))
    x = x.where((F.col("n_few") <= F.col("n_all")) & (F.col("id_few") != F.col("id_all")) & (gap <= SPAN * 1_000_000) & (lacks <= F.floor(F.col("n_few") / 4)))
    return x.select(F.least("id_few", "id_all").alias("one"), F.greatest("id_few", "id_all").alias("two")).distinct()


def alike(r: DataFrame) -> DataFrame:
    """``(early, late)`` of revisions of different identity within the span that share an entity and read alike. ``r`` has an ``id`` too, fixed from read to read."""
    wide = lambda n: r.select(F.col("id").alias(n), F.struct("at", "rev").alias(f"o_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in ("identity", "norm", "w", "entities")])
    x = candidates(r).join(wide("one"), "one").join(wide("two"), "two").where("identity_one <> identity_two").where(F.arrays_overlap("entities_one", "entities_two"))
    x = x.withColumns({"j": text.jaccard(F.col("w_one"), F.col("w_two")), "c": text.containment(F.col("w_one"), F.col("w_two"))})
    first = F.col("o_one") < F.col("o_two")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    x = x.select(pick("o_one.rev", "o_two.rev").alias("early"), pick("o_two.rev", "o_one.rev").alias("late"), pick("norm_one", "norm_two").alias("n_early"), pick("norm_two", "norm_one").alias("n_late"), "j", "c")
    # letters are compared only where words do not settle it
    sure = x.where(F.col("j") >= JACCARD)
    rest = x.where((F.col("j") < JACCARD) & (F.col("c") >= WORDS)).where(letters("n_late", "n_early") >= LETTERS)
    return sure.select("early", "late").union(rest.select("early", "late"))


def connected(edges: DataFrame) -> DataFrame:
    """``(rev, component)`` of all revisions with an edge, ``component`` the smallest that edges reach.

    All neighbours above a revision are tied to its least one, then its neighbours below: about as many rounds as the logarithm of the longest path.
    Each round is a table of its own. A checkpoint keeps the estimated size, which joins multiply: it had twice the digits after every round.
    """
    edges, before = stored(edges.select(F.greatest("early", "late").alias("u"), F.least("early", "late").alias("v")).where("u <> v").distinct()), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        above = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = above.groupBy("u").agg(F.min("v").alias("m"))
        below = above.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = stored(below.union(low.select("u", F.col("m").alias("v"))).distinct())
        removed(edges, above)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("rev"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        before = now


def _capped(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges of one component in order: equal identities first, then alike pairs by the later article; none may stretch a cluster beyond the span."""
    pdf = pdf.sort_values(["at", "rev"], kind="stable").reset_index(drop=True)
    low, place = pdf["at"].tolist(), {r: i for i, r in enumerate(pdf["rev"])}
    high, parent = list(low), list(range(len(pdf)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def merge(i: int, j: int) -> bool:
        i, j = root(i), root(j)
        first, last = min(low[i], low[j]), max(high[i], high[j])
        if i != j and last - first <= SPAN * 1_000_000:
            parent[max(i, j)], low[min(i, j)], high[min(i, j)] = min(i, j), first, last
        return last - first <= SPAN * 1_000_000

    anchor: dict[str, int] = {}
    for i, who in enumerate(pdf["identity"]):
        if who not in anchor or not merge(i, anchor[who]):
            anchor[who] = i
    for i, earlier in enumerate(pdf["earlier"]):
        for j in sorted(place[r] for r in earlier if r is not None):
            merge(i, j)
    heads = [root(i) for i in range(len(pdf))]
    best: dict[int, tuple] = {}
    for h, *key in zip(heads, pdf["at"], pdf["identity"], pdf["rev"], strict=True):
        best[h] = min(best.get(h, tuple(key)), tuple(key))
    pdf["anchor_at"], pdf["anchor"] = [best[h][0] for h in heads], [best[h][1] for h in heads]
    return pdf[["rev", "anchor_at", "anchor"]]


def catalysts(articles: DataFrame, version: str = "v1") -> DataFrame:
    """``(catalyst_id, event_id, public_time, earliest)``: each event with its cluster, named after build version and earliest article.

    Candidates are found by their rarest words; connected ones go to one task, where merges are made in order of time, because the cap
    on the span makes them depend on their order. An article without a link is its own cluster and goes nowhere.
    """
    # words are split again where they are needed: in the table they would take more room than all the rest
    r = checkpointed(revisions(articles).drop("w").withColumn("id", F.monotonically_increasing_id())).withColumn("w", text.tokens(F.col("norm")))
    pairs = checkpointed(alike(r))
    same = r.select("identity", F.col("rev").alias("late")).join(r.groupBy("identity").agg(F.min("rev").alias("early"), F.count("*").alias("n")).where("n > 1"), "identity").where("early <> late")
    label = connected(pairs.union(same.select("early", "late")))
    earlier = pairs.groupBy(F.col("late").alias("rev")).agg(F.collect_list("early").alias("earlier"))
    linked = r.select("rev", "identity", "at").join(label, "rev")
    nodes = linked.join(earlier, "rev", "left").withColumn("earlier", F.coalesce("earlier", F.array().cast("array<string>")))
    found = nodes.groupBy("component").applyInPandas(_capped, "rev string, anchor_at long, anchor string")
    alone = r.join(label, "rev", "left_anti").select("at", "events", F.col("at").alias("anchor_at"), F.col("identity").alias("anchor"))
    found = found.join(r.select("rev", "at", "events"), "rev").select("at", "events", "anchor_at", "anchor").union(alone)
    name = F.substring(F.sha1(F.concat_ws("|", F.lit(version), "anchor", F.col("anchor_at").cast("string"))), 1, 20)
    out = found.select("*", F.explode("events").alias("event_id"))
    return out.select(name.alias("catalyst_id"), "event_id", F.timestamp_micros("at").alias("public_time"), F.timestamp_micros("anchor_at").alias("earliest"))


def first_links(members: DataFrame, asset: str) -> DataFrame:
    """``(catalyst_id, asset, first_link, event_id)``: an asset becomes usable at its own first link, not at the earliest time of the catalyst."""
    return members.where(F.col(asset).isNotNull()).groupBy("catalyst_id", asset).agg(F.min("public_time").alias("first_link"), F.min_by("event_id", F.struct("public_time", "event_id")).alias("event_id"))
