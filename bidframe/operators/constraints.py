"""The constraints of the stored tables, checked in one pass over each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What enumerated columns may hold.
FLAGS = ["verified_cash", "verified_mixed", "suspect_mixed", "suspect_low_unverified", "failed_validation", "manual_review"]
PRICING_SOURCES = ["parser_only", "yfinance_enriched", "manual_override"]
JURISDICTIONS = ["FR", "IT", "DE"]
DEAL_TYPES = [
    "opa", "opa_simplifiee", "opa_obligatoire", "opa_volontaire_totalitaria", "opa_volontaire_parziale", "opa_consolidamento", "opa_volontaria_preventiva", "ope", "opas", "opra", "opr", "opr_ro", "garantie_de_cours",
    "pflichtangebot", "freiwilliges_uebernahmeangebot", "delisting_erwerbsangebot", "erwerbsangebot", "delisting_offer", "prohibition_ungenutzt",
]
DEAL_STATUSES = ["announced", "cleared", "open", "closed", "lapsed", "withdrawn"]
CURRENCIES = ["EUR", "CHF", "GBP", "USD"]
POSITION_STATUSES = ["open", "closed", "stopped"]
TRADE_STATUSES = ["PENDING", "SUBMITTED", "FILLED", "REJECTED", "CANCELLED"]


def _one_of(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


#: Per table the rules of a row, in SQL; a rule that comes out null holds.
RULES = {
    "deals": {
        "quality_flag": _one_of("offer_price_quality_flag", FLAGS), "pricing_source": _one_of("pricing_source", PRICING_SOURCES), "juridiction": _one_of("juridiction", JURISDICTIONS), "deal_type": _one_of("deal_type", DEAL_TYPES),
        "status": _one_of("status", DEAL_STATUSES), "currency": _one_of("currency", CURRENCIES), "has_ref": "regulator_ref IS NOT NULL", "has_target": "target_name IS NOT NULL", "has_acquirer": "acquirer_name IS NOT NULL", "has_date": "announcement_date IS NOT NULL",
    },
    "scores": {"p_completion": "p_completion BETWEEN 0 AND 1", "p_market_implied": "p_market_implied BETWEEN 0 AND 1", "has_probability": "p_completion IS NOT NULL", "has_version": "model_version IS NOT NULL"},
    "positions": {"size_eur": "size_eur > 0", "status": _one_of("status", POSITION_STATUSES), "has_opening": "open_ts IS NOT NULL"},
    "trades": {"quantity": "quantity > 0", "side": _one_of("side", ["BUY", "SELL"]), "status": _one_of("status", TRADE_STATUSES)},
    "vendor_usage": {"credits_cost": "credits_cost >= 0", "has_vendor": "vendor IS NOT NULL"},
}
#: Columns that identify a row, besides those of the rules.
UNIQUE = {"deals": ["juridiction", "regulator_ref"], "trades": ["trade_id"]}
#: Child columns and the parent's.
FOREIGN = {"scores": ("deal_id", "deals", "id"), "positions": ("deal_id", "deals", "id"), "trades": ("deal_id", "deals", "id")}


def row_report(df: DataFrame, table: str, rules: dict[str, str]) -> DataFrame:
    """(table_name, rule, n_rows, n_failed), a row for each rule, of one pass over the table and one partial sum a rule."""
    sums = df.agg(F.count("*").alias("n_rows"), *[F.count_if(~F.coalesce(F.expr(test), F.lit(True))).alias(name) for name, test in rules.items()])
    told = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_failed")) for name in rules]))
    return sums.select(F.lit(table).alias("table_name"), "n_rows", told.alias("told")).select("table_name", "told.rule", "n_rows", "told.n_failed")


def failed_rows(df: DataFrame, table: str, key: str, rules: dict[str, str]) -> DataFrame:
    """(table_name, key, rules): the rows that break a rule, each with the names of all it breaks, in one pass."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(test), F.lit(True)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("key"), broken.alias("rules")).filter(F.size("rules") > 0)


def key_report(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One row: how many keys without nulls more than one row has, as SQL's UNIQUE counts them."""
    keys = df.groupBy(*columns).agg(F.count("*").alias("n"))
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(whole & (F.col("n") > 1)).alias("n_failed")).select(F.lit(table).alias("table_name"), F.lit("unique").alias("rule"), "n_rows", "n_failed")


def parent_report(df: DataFrame, table: str, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """One row: how many rows name a parent that isn't there. Children are counted per parent before they meet the parents."""
    children = df.groupBy(F.col(column).alias("_key")).agg(F.count("*").alias("n"))
    known = parents.select(F.col(parent_column).alias("_key"), F.lit(True).alias("known")).distinct()
    lost = F.col("_key").isNotNull() & F.col("known").isNull()
    got = children.join(known, "_key", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("n_failed"))
    return got.select(F.lit(table).alias("table_name"), F.lit("foreign_key").alias("rule"), "n_rows", "n_failed")


def constraint_report(tables: dict[str, DataFrame], rules: dict[str, dict[str, str]] = RULES, unique: dict[str, list[str]] = UNIQUE, foreign: dict[str, tuple[str, str, str]] = FOREIGN) -> DataFrame:
    """(table_name, rule, n_rows, n_failed) of every rule of the given tables, those that nothing breaks among them. The rules of a table's rows are one scan of it; keys and parents need a shuffle and are scans of their own columns."""
    parts = [row_report(df, name, rules[name]) for name, df in tables.items() if rules.get(name)]
    parts += [key_report(tables[name], name, columns) for name, columns in unique.items() if name in tables]
    parts += [parent_report(tables[name], name, column, tables[parent], key) for name, (column, parent, key) in foreign.items() if name in tables and parent in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
