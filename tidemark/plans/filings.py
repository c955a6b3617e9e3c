"""Queries over filings: parsing, classification, guidance, reconciliation, coverage."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from tidemark.functions import filings as f
from tidemark.functions import market
from tidemark.plans import tables as t
from tidemark.registry import query
from tidemark.session import load


def cycle(key, values):
    """One of the values by the key, for the labels that the tables lack; ``cycle_sql`` is the same for the oracles."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def key():
    return F.col("o_orderkey")


def cycle_sql(key: str, values) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({key}) % {len(values)} + 1]"


AMOUNTS = ("$1,001 - $15,000", "Unknown", "Over $50,000,000", "$15,001 - $50,000", "$1,001 -", "$7,500", None, "$99,000,001")
BRACKET = lambda i: " ".join(f"WHEN len(n) = 1 AND n[1] BETWEEN {b[0]} AND {b[1]} THEN {b[i]}" for b in f.BRACKETS)
BOUND = lambda i: f"CASE WHEN s = '$1,001 -' THEN {(1001, 15000)[i]} WHEN s = 'Over $50,000,000' THEN {(50000000, 100000000)[i]} WHEN len(n) >= 2 THEN n[{i + 1}] {BRACKET(i)} ELSE n[1] END::DOUBLE"


@query("amount_range_parse", rf"""WITH s AS (SELECT o_orderkey AS trade_id, CASE WHEN o_orderkey % 9 = 8 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) ELSE {cycle_sql("o_orderkey", AMOUNTS)} END AS s FROM orders),
  n AS (SELECT *, list_transform(regexp_extract_all(s, '\d[\d,]*'), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS n FROM s), b AS (SELECT trade_id, {BOUND(0)} AS lo, {BOUND(1)} AS hi FROM n) SELECT trade_id, lo, hi, (lo + hi) / 2 AS mid FROM b""")
def amount_range_parse(spark, d):
    whole = F.concat(F.lit("$"), F.floor("o_totalprice").cast("string"))
    label = F.when(key() % 9 == 8, whole).otherwise(cycle(key(), AMOUNTS))
    return load(spark, d, "orders").select(key().alias("trade_id"), f.amount_range(label).alias("a")).select("trade_id", "a.*")


@query("multi_format_date", "SELECT o_orderkey AS trade_id, CASE WHEN o_orderkey % 5 < 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def multi_format_date(spark, d):
    at = lambda fmt: F.date_format("o_orderdate", fmt)
    s = F.element_at(F.array(at("MM/dd/yyyy"), at("yyyy-MM-dd"), at("M/d/yy"), F.lit("N/A"), F.lit("--")), (key() % 5 + 1).cast("int"))
    return load(spark, d, "orders").select(key().alias("trade_id"), f.reported_date(s).alias("day"))


TYPES, OWNERS = ("Sale (Partial)", "PURCHASE", " Buy", "Exchange", "Gift", "--", None), ("Spouse", "Joint", "Dependent", "SELF ", "", "Trust", "N/A", None)
TICKERS = ("aapl", "BRK.B", "N/A", "123X", "--", " msft", "TOOLONGX", None, "rds-a", "none", "")


@query("label_normalisers", f"""WITH s AS (SELECT o_orderkey AS trade_id, lower(trim({cycle_sql("o_orderkey", TYPES)})) AS a, lower(trim(coalesce({cycle_sql("o_orderkey", OWNERS)}, ''))) AS b, upper(trim({cycle_sql("o_orderkey", TICKERS)})) AS c FROM orders)
  SELECT trade_id, CASE WHEN contains(a, 'purchase') OR a = 'buy' THEN 'purchase' WHEN contains(a, 'sale') OR contains(a, 'sell') THEN 'sale' WHEN contains(a, 'exchange') THEN 'exchange' END AS tx_type,
  CASE WHEN b IN ('', '--', 'n/a') THEN 'unknown' WHEN contains(b, 'spouse') THEN 'spouse' WHEN contains(b, 'joint') THEN 'joint' WHEN contains(b, 'child') OR contains(b, 'dependent') THEN 'child' WHEN contains(b, 'self') THEN 'self' ELSE b END AS owner,
  CASE WHEN c NOT IN ('', '--', 'N/A', 'NONE') AND regexp_full_match(c, '[A-Z][A-Z.-]{{0,5}}') THEN c END AS ticker FROM s""")
def label_normalisers(spark, d):
    return load(spark, d, "orders").select(key().alias("trade_id"), f.trade_type(cycle(key(), TYPES)).alias("tx_type"), f.trade_owner(cycle(key(), OWNERS)).alias("owner"), f.ticker(cycle(key(), TICKERS)).alias("ticker"))


@query("source_identity", """WITH s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'A' || page_id END AS pid, CASE WHEN page_id % 3 = 1 THEN url END AS u, TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 MINUTE AS tm, CASE WHEN page_id % 9 = 2 THEN '' ELSE 'Deal: no. ' || page_id END AS h FROM pages),
  n AS (SELECT *, trim(regexp_replace(lower(h), '[^a-z0-9]+', ' ', 'g')) AS k FROM s) SELECT page_id, CASE WHEN pid <> '' THEN 'provider:wire:' || pid WHEN u <> '' THEN 'url:' || trim(u)
  ELSE 'fallback:wire|' || strftime(tm, '%Y-%m-%dT%H:%M:%S') || '|' || k || CASE WHEN k = '' THEN '|' || page_id ELSE '' END END AS source FROM n""")
def source_identity(spark, d):
    i = F.col("page_id")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + i * 60)
    head = F.when(i % 9 == 2, "").otherwise(F.concat(F.lit("Deal: no. "), i.cast("string")))
    key = f.source_identity(F.lit(" Wire"), F.when(i % 3 == 0, F.concat(F.lit("A"), i.cast("string"))), F.when(i % 3 == 1, F.col("url")), at, head, i)
    return load(spark, d, "pages").select("page_id", key.alias("source"))


@query("sgml_documents", "SELECT item_id, CAST(0 AS INT) AS pos, '8-K' AS type, 'a' || item_id || '.htm' AS filename, text AS raw FROM benchmark UNION ALL SELECT item_id, 1, 'EX-99.1', 'b.htm', chr(10) || '<TYPE> ex-99.1' || chr(10) || '<FILENAME>b.htm' || chr(10) FROM benchmark")
def sgml_documents(spark, d):
    i = F.col("item_id").cast("string")
    filing = F.concat(F.lit("head <DOCUMENT>\n<TYPE>8-K\n<FILENAME>a"), i, F.lit(".htm\n<TEXT>"), F.col("text"), F.lit("</TEXT>\n</DOCUMENT>\n<document>\n<TYPE> ex-99.1\n<FILENAME>b.htm\n</document> tail"))
    return load(spark, d, "benchmark").select("item_id", F.posexplode(f.sgml_documents(filing)).alias("pos", "doc")).select("item_id", "pos", "doc.*")


PHRASES = ("Quarterly  results", "Results for the fiscal quarter", "A quiet day", "This press release has our operating results")
FIGURES = ("revenue and net income", "diluted EPS was up", "consolidated financial statements, net sales", "weather", "net loss; earnings per share")
PERIODS = ("ended March 31, 2024", "as of June 30, 2023", "", "ended December 31, 2019", "on April 28, 2024", "ended June 31, 2023 and ended September 30 2023")
NEWS = lambda c: f"{c('o_orderkey', PHRASES)} || ' ' || {c('o_orderkey // 4', FIGURES)} || ' ' || {c('o_orderkey // 20', PERIODS)}"
FOUND = lambda rules: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '{p}', 's') THEN '{n}' END" for n, p in rules) + "], lambda v: v IS NOT NULL), ',')"
DAYS = lambda p: f"list_transform(regexp_extract_all(x, '{p}', 0, 'i'), lambda v: try_strptime(regexp_replace(regexp_replace(v, '^ended *', '', 'i'), ',', ''), '%B %d %Y')::DATE)"
DATED = f"({f.MONTHS}) +[0-9]{{1,2}},? +20[0-9]{{2}}"


@query("earnings_release", f"""WITH s AS (SELECT o_orderkey AS trade_id, lower({NEWS(cycle_sql)}) AS x, DATE '2024-05-01' + CAST(o_orderkey % 7 AS INT) AS day FROM orders), p AS (SELECT trade_id, {FOUND(f.RELEASES)} AS phrases, {FOUND(f.ANCHORS)} AS anchors,
  coalesce(list_max(list_filter({DAYS('ended +' + DATED)}, lambda v: v BETWEEN day - 370 AND day + 7)), list_max(list_filter({DAYS(DATED)}, lambda v: v BETWEEN day - 370 AND day - 5))) AS period_end FROM s)
  SELECT *, phrases <> '' AND contains(anchors, ',') AND period_end IS NOT NULL AS is_release FROM p""")
def earnings_release(spark, d):
    """An explicit phrase of results, two kinds of figures and the end of a period make a release."""
    news = F.concat_ws(" ", cycle(key(), PHRASES), cycle(F.floor(key() / 4), FIGURES), cycle(F.floor(key() / 20), PERIODS))
    x = load(spark, d, "orders").select(key().alias("trade_id"), F.lower(news).alias("x"), F.date_add(F.lit("2024-05-01").cast("date"), (key() % 7).cast("int")).alias("day"))
    found = lambda rules: f.names(F.col("x"), [(n, "(?s)" + p) for n, p in rules])
    x = x.select("trade_id", found(f.RELEASES).alias("p"), found(f.ANCHORS).alias("a"), f.fiscal_period_end(F.col("x"), F.col("day")).alias("period_end"))
    return x.select("trade_id", F.array_join("p", ",").alias("phrases"), F.array_join("a", ",").alias("anchors"), "period_end", ((F.size("p") > 0) & (F.size("a") > 1) & F.col("period_end").isNotNull()).alias("is_release"))


SENTENCES = (
    "We expect full-year 2024 revenue of $10 to $15.5 million. Thank you!", "The company raises its first quarter 2023 EPS outlook to $1.25.", "Guidance for gross margin is unchanged at 41.5%. Guidance for gross margin is unchanged at 41.5%.",
    "We withdraw our fiscal year outlook for capital expenditures! Weather was fine.", "Net sales rose 4% in 2022.", "Adjusted EBITDA is expected at 50 million by 2025; bookings guidance is lowered to 12.5 bn or 13 bn for the third quarter.", "", None,
)
# the rows that the sentences above must give, worked by hand: sentence, metric, period, low, high, units, currency, status, action
EXPECTED = (
    (0, "revenue", "FY2024", 10.0, 15.5e6, "absolute", "USD", "AVAILABLE", "UNSPECIFIED"), (1, "eps", "Q1-2023", 1.25, 1.25, "per_share", "USD", "AVAILABLE", "RAISED"),
    (2, "gross_margin", "PERIOD-UNKNOWN", 41.5, 41.5, "percent", None, "REAFFIRMED", "REAFFIRMED"), (3, "capex", "FYUNKNOWN", None, None, None, None, "WITHDRAWN", "WITHDRAWN"),
    (5, "ebitda", "PERIOD-2025", 50e6, 50e6, "absolute", None, "AVAILABLE", "UNSPECIFIED"), (5, "bookings", "Q3-UNKNOWN", 12.5e9, 13e9, "absolute", None, "AVAILABLE", "LOWERED"),
)
VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in row) + ")" for row in EXPECTED)


@query("guidance_extract", f"SELECT o_orderkey AS trade_id, v.* EXCLUDE (k) FROM orders JOIN (VALUES {VALUES}) v(k, metric, period, low, high, units, currency, status, action) ON k = o_orderkey % {len(SENTENCES)}")
def guidance_extract(spark, d):
    """Sentences of guidance with a metric and, unless reaffirmed or withdrawn, a number; equal sentences of a text count once."""
    x = load(spark, d, "orders").select(key().alias("trade_id"), F.explode(F.split(cycle(key(), SENTENCES), r"(?<=[.!?;])\s+")).alias("s"))
    x = x.where(f.matches(F.col("s"), "(?i)" + f.GUIDANCE)).select("trade_id", "s", f.first_name(F.col("s"), [(n, "(?i)" + p) for n, p in f.METRICS]).alias("metric")).where("metric is not null")
    x = x.select("*", f.guidance_period(F.col("s")).alias("period"), f.guidance_action(F.col("s")).alias("action"), f.guidance_numbers(F.col("s"), F.col("metric")).alias("v"))
    x = x.withColumn("status", F.when(F.col("action").isin("WITHDRAWN", "REAFFIRMED"), F.col("action")).otherwise("AVAILABLE")).where((F.col("status") != "AVAILABLE") | (F.size("v") > 0))
    two = F.slice(F.col("v.value"), 1, 2)
    x = x.dropDuplicates(["trade_id", "metric", "period", "s"])
    return x.select("trade_id", "metric", "period", F.array_min(two).alias("low"), F.array_max(two).alias("high"), F.get("v.units", F.lit(0)).alias("units"), F.get(F.array_compact("v.currency"), F.lit(0)).alias("currency"), "status", "action")


@query("guidance_reconcile", """SELECT o_orderkey AS trade_id, CASE o_orderkey % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'AGREED' WHEN 2 THEN 'DISAGREED' WHEN 3 THEN 'AGREED' ELSE 'DISAGREED' END AS agreement FROM orders""")
def guidance_reconcile(spark, d):
    """Two extractors agree on a metric and period if one record of the second has both bounds within 1% and the same status."""
    rows = load(spark, d, "orders").select(key().alias("trade_id"), F.when(key() % 6 != 3, F.col("o_totalprice")).alias("lower"), F.lit("AVAILABLE").alias("status"))
    k = F.col("trade_id") % 6
    other = rows.where(k.isin(1, 2, 3, 4)).select("trade_id", (F.col("lower") * F.when(k == 2, 1.2).otherwise(1.005)).alias("lower2"), F.when(k == 4, "WITHDRAWN").otherwise("AVAILABLE").alias("status2"))
    other = other.unionByName(other.where(F.col("trade_id") % 6 == 1).withColumn("lower2", F.lit(0.0)))
    j = rows.join(other, "trade_id", "left").withColumn("ok", f.close_enough(F.col("lower"), F.col("lower2")) & (F.col("status") == F.col("status2")))
    # the second extractor has not seen the texts of the sixth part at all
    g = j.groupBy("trade_id").agg(F.max("ok").alias("ok"))
    return g.select("trade_id", F.when(F.col("trade_id") % 6 == 0, "PENDING").when(F.col("ok"), "AGREED").otherwise("DISAGREED").alias("agreement"))


@query("index_legs", """WITH r AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, [['AAA', 'BBB'], ['CCC'], [], []][o_orderkey % 4 + 1] AS a, [['DDD'], [], ['EEE', 'FF.A', 'G'], []][o_orderkey % 4 + 1] AS b FROM orders)
  SELECT k AS event_id, 'INDEX|' || day AS batch_id, 'addition' AS side, unnest(a) AS ticker, CAST(len(a) AS INT) AS batch_size FROM r UNION ALL SELECT k, 'INDEX|' || day, 'deletion', unnest(b), CAST(len(b) AS INT) FROM r""")
def index_legs(spark, d):
    """A row per ticker of the comma lists, with the batch and its size."""
    listed = lambda v: F.filter(F.transform(F.split(F.coalesce(cycle(key(), v), F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    sides = F.array(*[F.struct(F.lit(side).alias("side"), listed(v).alias("list")) for side, v in (("addition", ("AAA, BBB", "CCC,", "", None)), ("deletion", (" DDD", None, "EEE,FF.A ,G", "")))])
    x = load(spark, d, "orders").select(key().alias("event_id"), F.concat(F.lit("INDEX|"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("batch_id"), F.explode(sides).alias("s"))
    return x.select("event_id", "batch_id", "s.side", F.size("s.list").alias("batch_size"), F.explode("s.list").alias("ticker"))


@query("iso_times", """WITH s AS (SELECT event_id, date_trunc('second', ts) AS x FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch(x) WHEN 1 THEN epoch(x) - 7200 WHEN 2 THEN epoch(x) + 19800 END::BIGINT AS utc,
  CASE event_id % 4 WHEN 0 THEN epoch(x) WHEN 1 THEN epoch(x) - 7200 WHEN 2 THEN epoch(x) + 19800 ELSE epoch(timezone('America/New_York', x)) END::BIGINT AS accepted FROM s""")
def iso_times(spark, d):
    s = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), cycle(F.col("event_id"), ("Z", "+02:00", "-05:30", "")))
    return load(spark, d, "events").select("event_id", F.unix_timestamp(f.utc_instant(s)).alias("utc"), F.unix_timestamp(f.acceptance_time(s)).alias("accepted"))


@query("event_window_bounds", """WITH n AS (SELECT event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS n FROM events), s AS (SELECT *, isodow(n) AS w, hour(n) AS h FROM n),
  a AS (SELECT *, CASE WHEN w > 5 THEN 8 - w WHEN h >= 16 THEN CASE WHEN w = 5 THEN 3 ELSE 1 END ELSE 0 END AS ahead FROM s)
  SELECT event_id, CAST(floor(epoch(ts - INTERVAL 4 DAY)) AS BIGINT) AS start_at, epoch(timezone('America/New_York', CAST(n AS DATE) + CAST(ahead + 10 AS INT) + INTERVAL 975 MINUTE))::BIGINT AS end_at FROM a""")
def event_window_bounds(spark, d):
    start, end = f.event_window(F.col("ts"), market.release_session(F.col("ts")))
    return load(spark, d, "events").select("event_id", F.unix_timestamp(start).alias("start_at"), F.unix_timestamp(end).alias("end_at"))


@query("format_hint", "SELECT page_id, CASE WHEN html IS NULL THEN 'unknown' WHEN contains(lower(html), '<table') THEN CASE WHEN regexp_matches(lower(html), 'guidance|outlook|expects|anticipates') THEN 'mixed' ELSE 'table' END ELSE 'prose' END AS hint FROM pages")
def format_hint(spark, d):
    return load(spark, d, "pages").select("page_id", f.format_hint(F.col("html")).alias("hint"))


AGENCIES = ("Department of Defense", "Department of Energy", None, "DEFENSE Logistics")


@query("availability_lag", f"disc: SELECT trade_id, CASE WHEN contains(lower({cycle_sql('trade_id', AGENCIES)}), 'defense') THEN tx_date ELSE tx_date + 30 END AS seen FROM disc")
def availability_lag(spark, d):
    return t.disclosures(spark, d).select("trade_id", f.first_seen(cycle(F.col("trade_id"), AGENCIES), F.col("tx_date")).alias("seen"))


FUNDS = {"BUILDING": "XLRE", "MACHINERY": "XLI", "AUTOMOBILE": "XLY"}
SYMBOLS = ("spy", "XLK", "QQQ", "abc", "IWM", "zz")


@query("hedge_benchmark", f"members: SELECT member, CASE upper(s) WHEN 'SPY' THEN NULL WHEN 'XLK' THEN 'SPY' WHEN 'QQQ' THEN 'SPY' WHEN 'IWM' THEN 'SPY' ELSE CASE sector WHEN 'BUILDING' THEN 'XLRE' WHEN 'MACHINERY' THEN 'XLI' WHEN 'AUTOMOBILE' THEN 'XLY' ELSE 'SPY' END END AS hedge FROM (SELECT *, {cycle_sql('member', SYMBOLS)} AS s FROM members)")
def hedge_benchmark(spark, d):
    return t.members(spark, d).select("member", f.hedge_benchmark(cycle(F.col("member"), SYMBOLS), F.col("sector"), FUNDS).alias("hedge"))


POLICY = {"max_positions": 1, "cost_bps": 16.0, "exit": "15:50"}


def policy_hash(policy: dict) -> str:
    """SHA-256 of the canonical JSON: sorted keys, no blanks."""
    return hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@query("policy_version", """SELECT r_regionkey, sha256('{"cost_bps":16.0,"exit":"15:50","max_positions":1}') AS version FROM region""")
def policy_version(spark, d):
    return load(spark, d, "region").select("r_regionkey", F.lit(policy_hash(POLICY)).alias("version"))


@query("resolved_compare", "disc: SELECT ticker IS NOT NULL AS resolved, CAST(year(tx_date) AS INT) AS year, tx_type, count(*) AS n, round(avg(amount), 3) AS mean_size FROM disc GROUP BY GROUPING SETS ((1), (1, 2), (1, 3))")
def resolved_compare(spark, d):
    """Resolved against unresolved rows, by year, by type and as a whole, in one pass."""
    x = t.disclosures(spark, d).select(F.col("ticker").isNotNull().alias("resolved"), F.year("tx_date").alias("year"), "tx_type", "amount")
    c = F.col
    g = x.groupingSets([[c("resolved")], [c("resolved"), c("year")], [c("resolved"), c("tx_type")]], c("resolved"), c("year"), c("tx_type"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("amount"), 3).alias("mean_size"))


@query("corpus_distribution", """SELECT d.source, d.lang, count(*) AS n, count(l.doc_id) AS labelled, count(*) FILTER (WHERE b.text IS NOT NULL) AS shared FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT DISTINCT text FROM benchmark) b ON b.text = d.text GROUP BY 1, 2""")
def corpus_distribution(spark, d):
    """Counts per source and language; a corpus is disjoint from the other one where ``shared`` is 0. Texts meet by their hashes."""
    docs, same = load(spark, d, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("h")), load(spark, d, "benchmark").select(F.sha2("text", 256).alias("h")).distinct()
    j = docs.join(load(spark, d, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left").join(same.withColumn("b", F.lit(1)), "h", "left")
    return j.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count("l").alias("labelled"), F.count("b").alias("shared"))


@query("extraction_funnel", "disc: SELECT count(*) AS filings, count(ticker) AS linked, count(*) FILTER (WHERE ticker IS NOT NULL AND tx_type = 'PURCHASE') AS purchases, count(*) FILTER (WHERE ticker IS NOT NULL AND tx_type = 'PURCHASE' AND filing_date - tx_date <= 10) AS timely, round(count(ticker) / count(*), 6) AS linked_share, round(count(*) FILTER (WHERE ticker IS NOT NULL AND tx_type = 'PURCHASE') / count(ticker), 6) AS purchase_share FROM disc")
def extraction_funnel(spark, d):
    linked = F.col("ticker").isNotNull()
    buys = linked & (F.col("tx_type") == "PURCHASE")
    x = t.disclosures(spark, d).agg(F.count("*").alias("filings"), F.count_if(linked).alias("linked"), F.count_if(buys).alias("purchases"), F.count_if(buys & (F.datediff("filing_date", "tx_date") <= 10)).alias("timely"))
    return x.select("*", F.round(F.try_divide("linked", "filings"), 6).alias("linked_share"), F.round(F.try_divide("purchases", "linked"), 6).alias("purchase_share"))


@query("linkage_failures", """disc: WITH m AS (SELECT member, count(*) AS n, min(filing_date) AS since, count(*) FILTER (WHERE tx_type = 'EXCHANGE') = count(*) AS conflict FROM disc WHERE ticker IS NOT NULL GROUP BY 1)
  SELECT CASE WHEN m.n IS NULL THEN 'NO_EVIDENCE' WHEN conflict THEN 'CONFLICTING' ELSE 'MISSING_INTERVAL' END AS category, count(*) AS tags, count(DISTINCT d.member) AS members FROM disc d LEFT JOIN m USING (member) WHERE m.n IS NULL OR conflict OR d.tx_date < m.since GROUP BY 1""")
def linkage_failures(spark, d):
    """Rows without a valid mapping by the first reason that holds: tags and distinct members."""
    x = t.disclosures(spark, d)
    m = x.where("ticker is not null").groupBy("member").agg(F.min("filing_date").alias("since"), F.bool_and(F.col("tx_type") == "EXCHANGE").alias("conflict"))
    reason = F.when(F.col("since").isNull(), "NO_EVIDENCE").when(F.col("conflict"), "CONFLICTING").when(F.col("tx_date") < F.col("since"), "MISSING_INTERVAL")
    j = x.join(m, "member", "left").withColumn("category", reason).where("category is not null")
    return j.groupBy("category").agg(F.count("*").alias("tags"), F.count_distinct("member").alias("members"))


@query("revision_rollup", """SELECT o_custkey AS event_id, CAST(count(DISTINCT m) AS BIGINT) AS metrics, count(*) FILTER (WHERE a = 'RAISED') AS raised, count(*) FILTER (WHERE a = 'LOWERED') AS lowered, count(*) FILTER (WHERE a = 'WITHDRAWN') > 0 AS withdrawn, round(avg(v) + 1e-7, 4) AS mean_revision,
  round(avg(CASE WHEN m = 'eps' THEN v END) + 1e-7, 4) AS eps_revision, CASE WHEN avg(v) > 0 THEN 'POSITIVE' WHEN avg(v) < 0 THEN 'NEGATIVE' ELSE 'MIXED_OR_FLAT' END AS direction
  FROM (SELECT o_custkey, """ + cycle_sql("o_orderkey", ("eps", "revenue", "capex")) + " AS m, " + cycle_sql("o_orderkey", ("RAISED", "LOWERED", "REAFFIRMED", "WITHDRAWN")) + " AS a, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice - 100000 END AS v FROM orders) GROUP BY 1")
def revision_rollup(spark, d):
    """A row per event: counts of the actions, means over what is there, in all and for one metric."""
    x = load(spark, d, "orders").select("o_custkey", cycle(key(), ("eps", "revenue", "capex")).alias("m"), cycle(key(), ("RAISED", "LOWERED", "REAFFIRMED", "WITHDRAWN")).alias("a"), F.when(key() % 5 > 0, F.col("o_totalprice") - 100000).alias("v"))
    did = lambda a: F.count_if(F.col("a") == a)
    g = x.groupBy(F.col("o_custkey").alias("event_id")).agg(
        F.count_distinct("m").alias("metrics"), did("RAISED").alias("raised"), did("LOWERED").alias("lowered"), (did("WITHDRAWN") > 0).alias("withdrawn"),
        F.avg("v").alias("mean"), F.round(F.avg(F.when(F.col("m") == "eps", F.col("v"))) + 1e-7, 4).alias("eps_revision"),
    )
    direction = F.when(F.col("mean") > 0, "POSITIVE").when(F.col("mean") < 0, "NEGATIVE").otherwise("MIXED_OR_FLAT")
    return g.select("event_id", "metrics", "raised", "lowered", "withdrawn", F.round(F.col("mean") + 1e-7, 4).alias("mean_revision"), "eps_revision", direction.alias("direction"))
