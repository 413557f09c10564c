"""Stand-in tables of the deal model, derived from the given tables by column expressions.

Each table has the Spark form (``deals(spark, sf_dir)``) and the same in the SQL of the oracle (``SQL["deals"]``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PEND = "[pending parse]"

#: The expressions are plain SQL that both engines read alike.
_DEALS = [
    "o_orderkey AS id",
    "CASE o_custkey % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'IT' ELSE 'DE' END AS juridiction",
    "concat('REF-', CAST(o_orderkey AS VARCHAR(20))) AS regulator_ref",
    f"CASE WHEN o_custkey % 50 = 0 THEN '{PEND}' ELSE concat('Target ', CAST(o_custkey AS VARCHAR(20))) END AS target_name",
    f"CASE WHEN o_orderkey % 4 = 0 THEN '{PEND}' WHEN o_orderkey % 4 = 1 THEN concat('Bidder ', CAST(o_orderkey % 97 AS VARCHAR(20)), ' Holding') "
    "WHEN o_orderkey % 8 = 2 THEN concat('Maison ', CAST(o_orderkey % 97 AS VARCHAR(20))) WHEN o_orderkey % 8 = 6 THEN concat('Werk ', CAST(o_orderkey % 97 AS VARCHAR(20)), ' GmbH') "
    "WHEN o_orderkey % 8 = 3 THEN concat('Qatar Fund ', CAST(o_orderkey % 97 AS VARCHAR(20))) ELSE concat('North Sea Trading Group ', CAST(o_orderkey % 97 AS VARCHAR(20))) END AS acquirer_name",
    "CAST(o_orderdate AS DATE) AS announcement_date",
    "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'opa' WHEN '2' THEN 'opa_simplifiee' WHEN '3' THEN 'ope' WHEN '4' THEN 'opas' ELSE 'opr' END AS deal_type",
    "CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'failed' ELSE 'announced' END AS status",
    "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_totalprice / 1000 AS DECIMAL(18,6)) END AS offer_price",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'suspect_low_unverified' WHEN o_orderkey % 17 = 0 THEN 'manual_review' ELSE 'verified_cash' END AS offer_price_quality_flag",
    "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE NULL END AS completion_label",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST((o_orderkey % 401 - 80) AS DECIMAL(7,4)) / 100 END AS premium_pct",
    "CASE WHEN o_orderkey % 7 < 3 THEN NULL ELSE CAST(o_orderkey % 101 AS DECIMAL(7,4)) / 100 END AS min_acceptance_threshold",
    "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 900 - 20 AS INT)) END AS expected_close_date",
    "concat(CASE o_custkey % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'IT' ELSE 'DE' END, lpad(CAST(o_custkey AS VARCHAR(20)), 10, '0')) AS isin",
    "concat('T', CAST(o_custkey % 150 AS VARCHAR(20))) AS ticker",
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 < 6 THEN 'home_venue' WHEN o_orderkey % 9 = 6 THEN 'growth' ELSE 'no_match' END AS ticker_resolution_flag",
]

_TABLES = {
    "deals": ("orders", _DEALS, None),
    "ticks": ("events", ["concat('T', CAST(user_id AS VARCHAR(20))) AS ticker", "ts", "CAST(value AS DECIMAL(18,6)) AS close", "event_id", "1 + event_id % 7 AS volume"], None),
    "price_requests": (
        "orders",
        ["o_orderkey AS deal_id", "concat('T', CAST(o_custkey % 150 AS VARCHAR(20))) AS ticker", "date_add(DATE '2024-01-01', CAST(o_orderkey % 30 AS INT)) AS d", "CAST(o_totalprice / 1000 AS DECIMAL(18,6)) AS offer_price"],
        None,
    ),
    "filing_events": ("events", ["event_id AS id", "user_id AS deal_id", "ts", "event_type", "props AS raw_payload", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('https://feed.example/', CAST(event_id % 400 AS VARCHAR(20))) END AS source_url"], None),
    "fills": (
        "events",
        ["event_id AS trade_id", "user_id AS deal_id", "ts", "CASE WHEN event_id % 10 = 9 THEN 'SELL' ELSE 'BUY' END AS side", "CAST(value + 1 AS DECIMAL(18,6)) AS price", "CAST(1 + event_id % 7 AS INT) AS quantity"],
        None,
    ),
    "trades": (
        "events",
        [
            "event_id AS trade_id", "user_id AS deal_id", "ts AS created_at",
            "CASE event_id % 5 WHEN 0 THEN 'FILLED' WHEN 1 THEN 'SUBMITTED' WHEN 2 THEN 'PENDING' WHEN 3 THEN 'REJECTED' ELSE 'CANCELLED' END AS status",
            "CASE WHEN event_id % 10 = 9 THEN 'SELL' ELSE 'BUY' END AS side", "CAST(event_id % 7 AS INT) AS quantity",
            "CASE WHEN event_id % 5 = 0 THEN CAST((event_id % 200) - 90 AS DECIMAL(14,2)) ELSE NULL END AS pnl_realized",
        ],
        None,
    ),
    "positions": (
        "events",
        [
            "event_id AS id", "user_id AS deal_id", "ts AS open_ts", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS close_ts",
            "CASE WHEN event_id % 3 = 0 THEN 'open' ELSE 'closed' END AS status", "CAST(value + 1 AS DECIMAL(14,2)) AS size_eur",
            "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST((event_id % 300) - 140 AS DECIMAL(14,2)) END AS pnl_eur",
        ],
        None,
    ),
    "vendor_usage": ("events", ["event_id AS id", "concat('vendor', CAST(user_id % 3 AS VARCHAR(20))) AS vendor", "ts", "CAST(event_id % 26 AS INT) AS credits_cost", "concat('2024-0', CAST(1 + user_id % 6 AS VARCHAR(20))) AS year_month"], None),
    "nlv": ("events", ["event_id AS id", "user_id AS account", "ts", "100000 + value * 100 AS net_liquidation"], None),
}

#: The stand-in tables in the oracle's SQL.
SQL = {name: f"SELECT {', '.join(cols)} FROM {base}" + (f" WHERE {where}" if where else "") for name, (base, cols, where) in _TABLES.items()}
SQL["scores"] = (
    "SELECT (l_orderkey * 8 + l_linenumber) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) AS id, l_orderkey AS deal_id, l_shipdate AS ts, CAST(l_discount * 10 AS DECIMAL(6,5)) AS p_completion, "
    "CAST(1 + (l_partkey % 5) AS INT) AS score_stars, CASE WHEN l_linenumber % 2 = 0 THEN 'v2' ELSE 'v1' END AS model_version, "
    "concat('{\"acquirer_type\":\"', CASE WHEN l_returnflag = 'R' THEN 'pe' WHEN l_returnflag = 'A' THEN 'soe' ELSE 'family' END, '\"}') AS features FROM lineitem"
)


def with_tables(*names: str) -> str:
    """``WITH`` clause that defines stand-in tables for an oracle query."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table, or one of the given ones."""
    if name == "scores":
        return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
            "(l_orderkey * 8 + l_linenumber) * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) AS id", "l_orderkey AS deal_id", "l_shipdate AS ts", "CAST(l_discount * 10 AS DECIMAL(6,5)) AS p_completion",
            "CAST(1 + (l_partkey % 5) AS INT) AS score_stars", "CASE WHEN l_linenumber % 2 = 0 THEN 'v2' ELSE 'v1' END AS model_version",
            "concat('{\"acquirer_type\":\"', CASE WHEN l_returnflag = 'R' THEN 'pe' WHEN l_returnflag = 'A' THEN 'soe' ELSE 'family' END, '\"}') AS features",
        )
    if name not in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base, cols, where = _TABLES[name]
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    return (df.where(where) if where else df).selectExpr(*cols)
