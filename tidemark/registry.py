"""Where queries and their DuckDB oracles are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query; ``oracle`` may start with names of shared tables, as in ``"bars, prices: SELECT .."``."""

    def keep(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = expand(oracle)
        return f

    return keep


#: Shared tables of the oracles, as common table expressions over the bundled tables.
CTE = {
    "bars": """bars AS (SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
      arg_max(value, ts) AS close, sum(value) AS volume, count(*) AS trades FROM events GROUP BY 1, 2)""",
    "prices": """prices AS (SELECT p_type AS ticker, CAST(l_shipdate AS DATE) AS date, min(l_extendedprice / l_quantity) AS open, max(l_extendedprice / l_quantity) AS high,
      min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS close, sum(l_quantity) AS volume
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "disc": """disc AS (SELECT o_orderkey AS trade_id, o_custkey AS member, CAST(o_orderdate AS DATE) AS tx_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INT) AS filing_date,
      o_totalprice AS amount, CASE o_orderstatus WHEN 'F' THEN 'PURCHASE' WHEN 'O' THEN 'SALE' ELSE 'EXCHANGE' END AS tx_type, t.ticker FROM orders
      LEFT JOIN (SELECT l_orderkey, min(p_type) AS ticker FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) t ON l_orderkey = o_orderkey)""",
    "members": """members AS (SELECT c_custkey AS member, c_name AS name, c_mktsegment AS sector, n_name AS nation, r_name AS region, c_acctbal AS balance
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "quotes": """quotes AS (SELECT event_id, event_type AS ticker, ts, user_id, value, CAST(json_extract(props, '$.k') AS INT) AS k,
      value * (1 - CAST(json_extract(props, '$.k') AS INT) / 10000.0::DOUBLE) AS bid, value * (1 + CAST(json_extract(props, '$.k') AS INT) / 10000.0::DOUBLE) AS ask FROM events)""",
    "headlines": """headlines AS (SELECT doc_id AS event_id, left(text, 120) AS title, source AS publisher, lang, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS public_time FROM documents)""",
    "sessions": "sessions AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INT) AS idx FROM (SELECT DISTINCT date FROM prices))",
    "rets": "rets AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices)",
    "brets": "brets AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY ts), 0) - 1 AS ret FROM bars)",
}


def expand(oracle: str) -> str:
    names, colon, body = oracle.partition(":")
    wanted = [n.strip() for n in names.split(",")]
    if not colon or not all(n in CTE for n in wanted):
        return oracle.strip()
    body = body.strip()
    needs = {"rets": "prices", "sessions": "prices", "brets": "bars"}
    wanted = list(dict.fromkeys(x for n in wanted for x in (needs.get(n, n), n)))
    ctes = ", ".join(CTE[n] for n in wanted)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
