"""Reports, payloads and files written from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_number(col: Column) -> Column:
    """NaN and infinite values to null, as JSON needs it."""
    x = col.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), col)


def to_payload(**fields: Column) -> Column:
    """JSON of the fields that aren't null."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def describe_filing(kind: Column, target: Column, acquirer: Column) -> Column:
    """One line on a filing, with ``?`` for what isn't known."""
    some = lambda c: F.coalesce(F.nullif(c, F.lit("[pending parse]")), F.lit("?"))
    return F.concat(some(kind), F.lit(": "), some(acquirer), F.lit(" -> "), some(target))


def write_audit(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a fixed order of columns; quotes within values are doubled."""
    df.select(*columns).write.csv(path, header=True, escape='"')


def append_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("append").parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.json(path)


def money(col: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(col, 2), F.lit(" EUR")), F.lit("N/A"))


def percent(col: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(col * 100, 2), F.lit("%")), F.lit("N/A"))


def decision_report(decisions: DataFrame) -> DataFrame:
    """(file, day, body): a text report per decision. A share of cash under 1 makes the strategy a mixed one."""
    from bidframe.functions.names import slug

    strategy = F.when(F.coalesce("payment_cash_share", F.lit(1.0)) >= 1, "cash").when(F.col("payment_cash_share") > 0, "cash and shares").otherwise("shares")
    lines = [
        F.concat(F.lit("# "), F.coalesce("target_name", F.lit("N/A"))), F.concat(F.lit("- acquirer: "), F.coalesce("acquirer_name", F.lit("N/A"))), F.concat(F.lit("- strategy: "), strategy),
        F.concat(F.lit("- quantity: "), F.col("quantity").cast("string")), F.concat(F.lit("- limit: "), money(F.col("limit_price"))), F.concat(F.lit("- stop: "), money(F.col("stop_loss_price"))),
        F.concat(F.lit("- target: "), money(F.col("take_profit_price"))), F.concat(F.lit("- spread: "), percent(F.col("expected_return_pct"))), F.concat(F.lit("- p: "), percent(F.col("p_completion"))),
    ]
    name = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("_"), slug(F.col("target_name"), 40), F.lit("_"), F.col("deal_id").cast("string"), F.lit(".md"))
    return decisions.select(name.alias("file"), "day", F.concat_ws("\n", *lines).alias("body"))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select("body").write.text(path)
