"""Scalar functions of filings and announcements: amounts, dates, labels, periods, guidance sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import normalised

# The brackets in which amounts are reported, and the labels that name one bound only.
BRACKETS = (
    (1_001, 15_000), (15_001, 50_000), (50_001, 100_000), (100_001, 250_000), (250_001, 500_000), (500_001, 1_000_000),
    (1_000_001, 5_000_000), (5_000_001, 25_000_000), (25_000_001, 50_000_000), (50_000_000, 100_000_000),
)
OPEN_LABELS = {"$1,001 -": (1_001, 15_000), "$50,000,000 +": (50_000_000, 100_000_000), "Over $50,000,000": (50_000_000, 100_000_000)}
# Metrics of guidance in the order in which they are tried.
METRICS = (
    ("gross_margin", r"gross\s+margin"),
    ("operating_income", r"operating\s+(?:income|profit)"),
    ("ebitda", r"(?:adjusted\s+)?ebitda"),
    ("bookings", r"bookings?"),
    ("arr", r"annual\s+recurring\s+revenue|\barr\b"),
    ("capex", r"capital\s+expenditures?|\bcapex\b"),
    ("eps", r"(?:diluted\s+)?(?:earnings|loss)\s+per\s+share|\beps\b"),
    ("revenue", r"(?:net\s+sales|revenue)"),
)
# What makes a sentence one of guidance, its numbers, its action and its status.
GUIDANCE = r"guidance|outlook|expects?|forecasts?|projects?|anticipates?|raises?|lowers?|reaffirms?|withdraws?"
NUMBER = r"(?i)([$€£])?\s*(-?\d+(?:\.\d+)?)\s*(billion|million|thousand|bn|mm|m|k)?\s*(%)?"
ACTIONS = (
    ("WITHDRAWN", "withdraw|suspend|no longer provid"), ("REAFFIRMED", "reaffirm|maintain|unchanged"), ("RAISED", "rais|increas|upward"),
    ("LOWERED", "lower|reduc|downward"), ("INITIATED", "initiat|introduc|first time"),
)
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
# Phrases of an earnings release and the figures that it must speak of.
RELEASES = (
    ("financial_results", r"(?:financial|quarterly|annual)\s+results"),
    ("results_for_period", r"results\s+for\s+the\s+(?:fiscal\s+)?(?:quarter|year)"),
    ("reports_period", r"reports?\s+(?:fiscal\s+)?(?:first|second|third|fourth|quarter|year).{0,80}results"),
    ("press_release_results", r"press\s+release.{0,160}(?:financial|operating)\s+results"),
)
ANCHORS = (
    ("revenue", r"\b(?:revenue|net sales)\b"),
    ("income", r"\b(?:net income|net loss|operating income)\b"),
    ("eps", r"\b(?:earnings|loss) per (?:diluted )?share\b|\bdiluted eps\b"),
    ("statements", r"(?:condensed|consolidated)\s+(?:financial\s+)?statements"),
)


def matches(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(pattern))


def first_name(x: Column, rules) -> Column:
    """The name of the first rule whose pattern is found, else NULL."""
    return F.coalesce(*[F.when(matches(x, p), F.lit(name)) for name, p in rules])


def names(x: Column, rules) -> Column:
    """The names of all rules whose pattern is found, in order."""
    return F.array_compact(F.array(*[F.when(matches(x, p), F.lit(name)) for name, p in rules]))


def amount_range(x: Column) -> Column:
    """``struct(lo, hi, mid)`` of a reported amount: the two bounds; for one number the bracket that holds it, else itself; NULLs without a number."""
    x = F.trim(x)
    n = F.transform(F.regexp_extract_all(x, F.lit(r"(\d[\d,]*)"), 1), lambda v: F.replace(v, F.lit(","), F.lit("")).cast("double"))
    one, size = F.get(n, F.lit(0)), F.size(n)
    inside = [one.between(lo, hi) for lo, hi in BRACKETS]
    bound = lambda i: F.coalesce(
        *[F.when(x == label, F.lit(float(b[i]))) for label, b in OPEN_LABELS.items()],
        F.when(size >= 2, F.get(n, F.lit(i))),
        *[F.when((size == 1) & hit, F.lit(float(b[i]))) for hit, b in zip(inside, BRACKETS, strict=True)],
        one,
    )
    return F.struct(bound(0).alias("lo"), bound(1).alias("hi"), ((bound(0) + bound(1)) / 2).alias("mid"))


def reported_date(x: Column) -> Column:
    """A date as month/day/year with four or two digits of the year (69 and later in the last century) or as ISO; else NULL."""
    at = lambda fmt: F.try_to_timestamp(F.trim(x), F.lit(fmt)).cast("date")
    short = at("M/d/yy")
    return F.coalesce(at("M/d/yyyy"), at("yyyy-M-d"), F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short))


def trade_type(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.contains("purchase") | (low == "buy"), "purchase").when(low.contains("sale") | low.contains("sell"), "sale").when(low.contains("exchange"), "exchange")


def trade_owner(x: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    out = F.when(low.isin("", "--", "n/a"), "unknown").when(low.contains("spouse"), "spouse").when(low.contains("joint"), "joint")
    return out.when(low.contains("child") | low.contains("dependent"), "child").when(low.contains("self"), "self").otherwise(low)


def ticker(x: Column) -> Column:
    up = F.upper(F.trim(x))
    return F.when(~up.isin("", "--", "N/A", "NONE") & matches(up, r"^[A-Z][A-Z.\-]{0,5}$"), up)


def source_identity(provider: Column, provider_id: Column, url: Column, public_time: Column, headline: Column, event_id: Column) -> Column:
    """The provider's id, else the exact address, else provider, time and whole headline (and the row's own id where that is empty)."""
    who, head = F.lower(F.trim(F.coalesce(provider, F.lit("unknown")))), normalised(headline)
    last = F.concat_ws("|", who, F.date_format(public_time, "yyyy-MM-dd'T'HH:mm:ss"), head, F.when(head == "", event_id.cast("string")))
    return F.when(provider_id != "", F.concat(F.lit("provider:"), who, F.lit(":"), provider_id)).when(url != "", F.concat(F.lit("url:"), F.trim(url))).otherwise(F.concat(F.lit("fallback:"), last))


def sgml_documents(x: Column) -> Column:
    """``array<struct<type, filename, raw>>`` of the documents of a filing; without a text element the whole block is the text."""
    field = lambda b, name: F.trim(F.regexp_extract(b, rf"(?i)<{name}>\s*([^\r\n<]+)", 1))
    body = lambda b: F.when(matches(b, r"(?is)<TEXT>.*?</TEXT>"), F.regexp_extract(b, r"(?is)<TEXT>(.*?)</TEXT>", 1)).otherwise(b)
    blocks = F.regexp_extract_all(x, F.lit(r"(?is)<DOCUMENT>(.*?)</DOCUMENT>"), 1)
    return F.transform(blocks, lambda b: F.struct(F.upper(field(b, "TYPE")).alias("type"), field(b, "FILENAME").alias("filename"), body(b).alias("raw")))


def fiscal_period_end(x: Column, public: Column) -> Column:
    """The latest date after 'ended' from 370 days before the publication to 7 after; else the latest date named at least 5 days before it."""

    def latest(pattern: str, until: Column) -> Column:
        parts = F.arrays_zip(*[F.regexp_extract_all(x, F.lit(pattern), i).alias(n) for i, n in ((1, "m"), (2, "d"), (3, "y"))])
        days = F.transform(parts, lambda p: F.try_to_timestamp(F.concat_ws(" ", F.initcap(p["m"]), p["d"], p["y"]), F.lit("MMMM d yyyy")).cast("date"))
        return F.array_max(F.filter(days, lambda v: v.between(F.date_sub(public, 370), until)))

    dated = rf"({MONTHS})\s+(\d{{1,2}}),?\s+(20\d{{2}})"
    return F.coalesce(latest(r"(?i)\bended\s+" + dated, F.date_add(public, 7)), latest("(?i)" + dated, F.date_sub(public, 5)))


def guidance_period(x: Column) -> Column:
    year = F.regexp_extract(x, r"\b(20\d{2})\b", 1)
    year = F.when(year == "", "UNKNOWN").otherwise(year)
    spelled = F.lower(F.regexp_extract(x, r"(?i)\b(first|second|third|fourth) quarter\b", 1))
    short = F.regexp_extract(x, r"(?i)\bQ([1-4])", 1)
    # the one that is named first counts
    both = F.lower(F.regexp_extract(x, r"(?i)\b(Q[1-4]|(?:first|second|third|fourth) quarter\b)", 1))
    n = F.when(both.startswith("q"), F.upper(F.substring(both, 2, 1))).when(spelled == "first", "1").when(spelled == "second", "2").when(spelled == "third", "3").when(spelled == "fourth", "4").otherwise(short)
    return F.when(matches(x, r"(?i)full[- ]year|fiscal year|\bFY\b"), F.concat(F.lit("FY"), year)).when(both != "", F.concat(F.lit("Q"), n, F.lit("-"), year)).otherwise(F.concat(F.lit("PERIOD-"), year))


def guidance_numbers(x: Column, metric: Column) -> Column:
    """``array<struct<value, units, currency>>``: numbers with scale; bare numbers from 1900 to 2100 are years."""
    parts = F.arrays_zip(*[F.regexp_extract_all(x, F.lit(NUMBER), i).alias(n) for i, n in ((1, "c"), (2, "n"), (3, "s"), (4, "p"))])
    kept = F.filter(parts, lambda p: ~(p["n"].cast("double").between(1900, 2100) & (p["c"] == "")))

    def value(p: Column) -> Column:
        scale, percent = F.lower(p["s"]), (p["p"] != "") | (metric == "gross_margin")
        times = F.when(percent, 1.0).when(scale.isin("billion", "bn"), 1e9).when(scale.isin("million", "mm", "m"), 1e6).when(scale.isin("thousand", "k"), 1e3).otherwise(1.0)
        units = F.when(percent, "percent").when(metric == "eps", "per_share").otherwise("absolute")
        currency = F.when(p["c"] == "$", "USD").when(p["c"] == "€", "EUR").when(p["c"] == "£", "GBP")
        return F.struct((p["n"].cast("double") * times).alias("value"), units.alias("units"), currency.alias("currency"))

    return F.transform(kept, value)


def guidance_action(x: Column) -> Column:
    return F.coalesce(first_name(F.lower(x), ACTIONS), F.lit("UNSPECIFIED"))


def close_enough(a: Column, b: Column) -> Column:
    """Equal within 1%, or within 0.001 of the larger of both and 1; two NULLs are equal."""
    gap, top = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    near = gap <= F.greatest(0.01 * top, 0.001 * F.greatest(top, F.lit(1.0)))
    return F.coalesce(near, a.isNull() & b.isNull())


def utc_instant(x: Column) -> Column:
    """An ISO time with an explicit offset; NULL without one."""
    return F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def acceptance_time(x: Column, zone: str = "America/New_York") -> Column:
    """As ``utc_instant``; a time without an offset is one of ``zone``."""
    return F.coalesce(utc_instant(x), F.to_utc_timestamp(F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss")), zone))


def event_window(public: Column, session: Column, zone: str = "America/New_York") -> tuple[Column, Column]:
    """From four days before the publication to 16:15 local time ten days after its session."""
    local = F.from_utc_timestamp(public, zone)
    day, dow = local.cast("date"), F.weekday(local)  # 0 is Monday
    late = (session == "AMC") | ((session == "UNKNOWN") & (F.hour(local) >= 16))
    ahead = F.when(dow >= 5, 7 - dow).when(late, F.when(dow == 4, 3).otherwise(1)).otherwise(0)
    end = F.to_utc_timestamp(F.date_add(day, ahead + 10).cast("timestamp") + F.expr("interval 16 hours 15 minutes"), zone)
    return public - F.expr("interval 4 days"), F.when(end <= public, public + F.expr("interval 2 days")).otherwise(end)


def format_hint(html: Column) -> Column:
    low = F.lower(html)
    prose = matches(low, "guidance|outlook|expects|anticipates")
    return F.when(html.isNull(), "unknown").when(low.contains("<table") & prose, "mixed").when(low.contains("<table"), "table").otherwise("prose")


def first_seen(agency: Column, day: Column, lag: int = 30) -> Column:
    """Awards of defence agencies are public on their day, others ``lag`` days later."""
    return F.when(F.lower(agency).contains("defense"), day).otherwise(F.date_add(day, lag))


def hedge_benchmark(symbol: Column, sector: Column, etfs: dict[str, str], market: str = "SPY", broad: tuple[str, ...] = ("QQQ", "DIA", "IWM")) -> Column:
    """None for the market itself, the market for funds, the fund of the sector where there is one, else the market."""
    up = F.upper(symbol)
    own = F.coalesce(*[F.when(sector == s, F.lit(e)) for s, e in etfs.items()], F.lit(market))
    return F.when(up == market, None).when(up.startswith("XL") | up.isin(*broad), market).otherwise(own)
