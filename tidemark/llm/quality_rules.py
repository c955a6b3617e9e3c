"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every document gets exact counts. A base rule rejects texts that are too short or mostly repeated. Beyond it,
steps of joint cutoffs, one for each rule, are learned per stratum (length band): on labelled good documents that pass the base rule, a
step is admissible if an exact binomial test shows, at the corrected level, that all its rules together would reject at most
``max_false_rejection`` of good documents of that stratum. What is tested is the verdict itself, so several rules cannot add up to more. Within a stratum the steps are
tested from the mildest to the strictest and testing ends at the first failure (fixed-sequence testing keeps the error level along it); across strata
the level is divided by their number (Bonferroni). Strata without enough labels get no step and reject
nothing beyond the base rule.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rules: share name, numerator, denominator. A larger share is worse.
RULES = (
    ("symbol_share", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("shout_share", "n_bangs", "n_words"),
    ("long_word_share", "word_chars", "n_words"),
)
#: Cutoffs of each step from the mildest to the strictest, in thousandths, so that SQL and Spark compare integers.
GRID = {
    "symbol_share": (3000, 2000, 1500, 1000, 750, 500, 300, 150),
    "dup_line_share": (900, 800, 700, 600, 500, 400, 300, 200),
    "repeat_share": (450, 400, 350, 300, 250, 200, 150, 100),
    "shout_share": (3000, 2000, 1500, 1000, 750, 500, 300, 150),
    "long_word_share": (40000, 30000, 25000, 20000, 17000, 15000, 13000, 12000),
}
STEPS = 8
BANDS = ((0, 200), (200, 1000), (1000, None))


def stratum(n_words: Column) -> Column:
    """Length band: 0 under 200 words, 1 under 1000, else 2."""
    return F.when(n_words < 200, 0).when(n_words < 1000, 1).otherwise(2)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the counts of its whole text; a null text counts as empty.

    Repeated words are found by sorting the hashes of the 3-word windows, so that long texts cost n log n.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id", "t", F.array_remove(F.split("t", SPACE), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("l"),
    )
    n = F.size("w")
    df = df.select(
        "doc_id", n.cast("long").alias("n_words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("t") - F.length(F.translate("t", "!", ""))).cast("long").alias("n_bangs"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
        ).alias("tri"),
    )
    keep = [c for c in df.columns if c != "tri"]
    df = df.select(*keep, "tri", F.sort_array("tri").alias("st"))
    again = F.exists(F.sequence(F.lit(1), F.size("st")), lambda i: F.get("st", i) == F.get("st", i - 1))
    pairs = F.array_sort(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select(*keep, F.when((F.size("st") > 1) & again, pairs).alias("sp"))
    twice = F.filter("sp", lambda x, i: (x["h"] == F.get("sp", i - 1)["h"]) | (x["h"] == F.get("sp", i + 1)["h"]))
    df = df.select(*keep, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("at"))
    covered = F.aggregate(
        "at", F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(3), p - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return df.select(*keep, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= x), exactly."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(x + 1)]
    return min(1.0, math.fsum(math.exp(v) for v in logs))


def _over(rule: tuple[str, str, str], cutoff: int) -> Column:
    return 1000 * F.col(rule[1]) > cutoff * F.col(rule[2])


def _rejects(step: int) -> Column:
    """Whether any rule fires at a step."""
    return functools.reduce(Column.__or__, [_over(r, GRID[r[0]][step]) for r in RULES])


def certified(rejected: list[int], n: int, max_false_rejection: float, share: float) -> int | None:
    """The last step before the first whose test fails at level ``share``; None if the first fails."""
    last = None
    for step, x in enumerate(rejected):
        if binomial_tail(x, n, max_false_rejection) > share:
            break
        last = step
    return last


def learn_steps(good: DataFrame, max_false_rejection: float = 0.02, level: float = 0.05) -> dict[int, int]:
    """The certified step of each stratum on the counts of labelled good documents.

    One aggregation brings three rows of counts (a row per length band) to the driver, whatever the input.
    """
    rows = (
        good.where(~base_failed()).groupBy(stratum(F.col("n_words")).alias("stratum"))
        .agg(F.count("*").alias("n"), *[F.count_if(_rejects(k)).alias(f"x{k}") for k in range(STEPS)]).collect()
    )
    found = {r["stratum"]: certified([r[f"x{k}"] for k in range(STEPS)], r["n"], max_false_rejection, level / len(BANDS)) for r in rows}
    return {s: k for s, k in found.items() if k is not None}


def judge(feats: DataFrame, steps: dict[int, int]) -> DataFrame:
    """Adds ``base_failed``, ``stratum``, ``rejected_by`` (first rule that fires at the certified step) and ``kept``."""
    fired = F.lit(None).cast("string")
    for rule in reversed(RULES):
        for s, k in steps.items():
            fired = F.when((F.col("stratum") == s) & _over(rule, GRID[rule[0]][k]), rule[0]).otherwise(fired)
    df = feats.withColumns({"base_failed": base_failed(), "stratum": stratum(F.col("n_words"))}).withColumn("rejected_by", fired)
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    max_false_rejection: float = 0.02, level: float = 0.05,
) -> DataFrame:
    """A verdict per row of ``docs``.

    Null and empty texts fail the base rule. Repeated rows each get their row. Without labels (or an empty
    table) only the base rule decides. Other columns are ignored, whatever their names.
    """
    feats = cut(counts(docs, id_col, text_col), "counts")
    good = labels.where("quality = 1").select("doc_id").distinct()
    return judge(feats, learn_steps(feats.join(good, "doc_id", "left_semi"), max_false_rejection, level))


def oracle() -> str:
    """DuckDB SQL of the same verdicts."""
    any_of = lambda k: " OR ".join(f"1000 * {r[1]} > {GRID[r[0]][k]} * {r[2]}" for r in RULES)
    cells = " UNION ALL ".join(f"SELECT stratum, {k} AS step, count(*) AS n, count(*) FILTER (WHERE {any_of(k)}) AS x FROM good GROUP BY 1" for k in range(STEPS))
    cutoff = lambda r: "[" + ", ".join(map(str, GRID[r[0]])) + "][step + 1]"
    fired = " ".join(f"WHEN {r[1]} * 1000 > {cutoff(r)} * {r[2]} THEN '{r[0]}'" for r in RULES)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
dup AS (SELECT doc_id, g FROM tri GROUP BY doc_id, g HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tri JOIN dup USING (doc_id, g), (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(translate(t, '!', '')) AS BIGINT) AS n_bangs,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN n_words < 200 THEN 0 WHEN n_words < 1000 THEN 1 ELSE 2 END AS stratum FROM c),
good AS (SELECT * FROM j WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
cells AS ({cells}),
tails AS (SELECT stratum, step, (SELECT sum(exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - CASE WHEN n > i THEN lgamma(n - i + 1) ELSE 0 END
  + i * ln(0.02::DOUBLE) + (n - i) * ln(0.98::DOUBLE))) FROM unnest(range(0, x + 1)) AS u(i)) AS p FROM cells),
runs AS (SELECT *, bool_and(p <= 0.05::DOUBLE / {len(BANDS)}) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM tails),
sel AS (SELECT stratum, CAST(max(step) AS INT) AS step FROM runs WHERE ok GROUP BY ALL),
f AS (SELECT j.*, CASE {fired} END AS rejected_by FROM j LEFT JOIN sel USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_bangs, n_lines, n_dup_lines, n_repeat_words, base_failed, stratum, rejected_by,
  NOT base_failed AND rejected_by IS NULL AS kept FROM f"""
