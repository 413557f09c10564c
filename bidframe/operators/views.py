"""Scored-cluster views, their filters, and the aggregates shown beside them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.operators.ordering import number_rows


def latest_score(scores: DataFrame, by: str = "id") -> DataFrame:
    """One score per deal: the one with the largest ``id`` (as the view takes it) or ``ts`` (as the single lookup does; ties by id)."""
    key = F.struct("id") if by == "id" else F.struct(by, "id")
    cols = [c for c in scores.columns if c != "deal_id"]
    return scores.groupBy("deal_id").agg(F.max_by(F.struct(*cols), key).alias("s")).select("deal_id", "s.*")


def sibling_counts(deals: DataFrame) -> DataFrame:
    """Number of deals of each (target, jurisdiction), over all deals."""
    return deals.groupBy("target_name", "juridiction").agg(F.count("*").alias("events_count"))


def cluster_view(scores: DataFrame, deals: DataFrame) -> DataFrame:
    """Every deal's latest score with the deal's columns and its number of siblings."""
    s = latest_score(scores).withColumnRenamed("id", "score_id").withColumnRenamed("ts", "scored_at")
    d = deals.join(sibling_counts(deals), ["target_name", "juridiction"])
    return s.join(d, s.deal_id == d.id).drop("id").withColumnRenamed("deal_id", "cluster_id")


def placed(view: DataFrame, name: str = "pos") -> DataFrame:
    """The view from the latest announcement on, ties by cluster, undated last, with each row's place from 1: rows are numbered range by range, so no task holds them all."""
    key = F.concat_ws("|", F.lpad((2000000 - F.coalesce(F.unix_date("announcement_date"), F.lit(-1000000))).cast("string"), 8, "0"), F.lpad(F.col("cluster_id").cast("string"), 20, "0"))
    return number_rows(view.withColumn("_key", key), "_key", name=name).drop("_key").orderBy(name)


@dataclass(frozen=True)
class DealFilters:
    """Optional filters of the view; None filters nothing."""

    jurisdictions: tuple[str, ...] | None = None
    stars: tuple[int, ...] | None = None
    status: str = "all"
    date_from: date | None = None
    date_to: date | None = None
    acquirer_types: tuple[str, ...] | None = None
    deal_types: tuple[str, ...] | None = None

    def with_defaults(self, today: date) -> DealFilters:
        """The last 730 days and stars 3 to 5 where nothing is said."""
        from dataclasses import replace
        from datetime import timedelta

        return replace(self, date_from=self.date_from or today - timedelta(days=730), date_to=self.date_to or today, stars=self.stars or (3, 4, 5))


def json_field(col: str | Column, field: str, default: str = "unknown") -> Column:
    """A field of a JSON text, or the default."""
    return F.coalesce(F.get_json_object(col, f"$.{field}"), F.lit(default))


def apply_filters(view: DataFrame, f: DealFilters) -> DataFrame:
    label = {"pending": F.col("completion_label").isNull(), "closed": F.col("completion_label") == 1, "failed": F.col("completion_label") == 0}
    tests = [
        f.jurisdictions and F.col("juridiction").isin(*f.jurisdictions),
        f.stars and F.col("score_stars").isin(*f.stars),
        label.get(f.status),
        f.date_from and (F.col("announcement_date") >= F.lit(f.date_from)),
        f.date_to and (F.col("announcement_date") <= F.lit(f.date_to)),
        f.acquirer_types and json_field("features", "acquirer_type").isin(*f.acquirer_types),
        f.deal_types and F.col("deal_type").isin(*f.deal_types),
    ]
    for test in tests:
        if test is not None:
            view = view.filter(test)
    return view


def cluster_detail(deals: DataFrame) -> DataFrame:
    """Each cluster with its deals as an array, by date and id."""
    sibling = F.struct("announcement_date", "id", "deal_type", "offer_price")
    return deals.groupBy("target_name", "juridiction").agg(F.array_sort(F.collect_list(sibling)).alias("siblings"))


def cluster_events(deals: DataFrame, events: DataFrame, keys: DataFrame) -> DataFrame:
    """All events of every deal that shares the target and jurisdiction of a deal in ``keys(cluster_id)``."""
    heads = keys.join(deals.select(F.col("id").alias("cluster_id"), "target_name", "juridiction"), "cluster_id")
    members = heads.join(deals.select(F.col("id").alias("deal_id"), "target_name", "juridiction", "announcement_date", "deal_type", "regulator_ref"), ["target_name", "juridiction"])
    return members.join(events.withColumnRenamed("id", "event_id"), "deal_id")


def timeline(view: DataFrame) -> DataFrame:
    """Clusters per month of announcement."""
    return view.groupBy(F.trunc("announcement_date", "month").alias("month")).agg(F.count("*").alias("n"))


def calibration_bins(rows: DataFrame, p: str = "p_completion", label: str = "completion_label") -> DataFrame:
    """Edges 0, .2, .4, .6, .8, 1.01 over labelled rows: mid, observed rate and count of each bin that has rows."""
    k = F.least(F.floor(F.col(p) * 5), F.lit(4)).cast("int")
    mid = F.when(k == 4, F.lit(0.9)).otherwise(F.round(k * 0.2 + 0.1, 2))  # the last is (0.8 + 1.01) / 2 = 0.905, which rounds to even
    kept = rows.filter(F.col(label).isNotNull() & F.col(p).between(0, 1))
    return kept.groupBy(mid.alias("bin_mid")).agg(F.avg(F.col(label).cast("double")).alias("empirical_rate"), F.count("*").alias("n"))


def equal_bins(rows: DataFrame, p: str, label: str, bins: int = 5) -> DataFrame:
    """Bins of equal width with a closed last edge: mean prediction, observed rate and count of each bin that has rows."""
    k = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.filter(F.col(label).isNotNull()).groupBy(k.alias("bin")).agg(F.avg(F.col(p).cast("double")).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"), F.count("*").alias("n"))


def filter_options(view: DataFrame) -> DataFrame:
    """Distinct values of each filter, sorted, one row."""
    return view.agg(
        F.array_sort(F.collect_set("juridiction")).alias("jurisdictions"), F.array_sort(F.collect_set("deal_type")).alias("deal_types"),
        F.array_sort(F.collect_set(json_field("features", "acquirer_type"))).alias("acquirer_types"),
    )


def model_metadata(scores: DataFrame) -> DataFrame:
    return scores.agg(F.max("model_version").alias("model_version"), F.count("*").alias("n_scores"), F.max("ts").alias("last_ts"))


def trading_kpis(positions: DataFrame, trades: DataFrame) -> DataFrame:
    """Four headline numbers, one row: each table is reduced to a row of its own before the two meet."""
    p = positions.agg(F.count_if(F.col("status") == "open").alias("open_positions"))
    t = trades.agg(
        F.count_if(F.col("status") == "FILLED").alias("filled"), F.count_if(F.col("status") == "SUBMITTED").alias("submitted"),
        F.coalesce(F.sum("pnl_realized"), F.lit(0)).alias("realized_pnl_eur"),
    )
    return p.withColumn("k", F.lit(1)).join(t.withColumn("k", F.lit(1)), "k").drop("k")


def daily_pnl(positions: DataFrame) -> DataFrame:
    """Realised P&L per day of close and its running sum; days are few, so the running sum's one task is small."""
    days = positions.filter((F.col("status") == "closed") & F.col("close_ts").isNotNull()).groupBy(F.to_date("close_ts").alias("day")).agg(F.sum("pnl_eur").alias("realized"))
    return days.withColumn("cumulative", F.sum("realized").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)))


def credits_used(usage: DataFrame) -> DataFrame:
    return usage.groupBy("vendor", "year_month").agg(F.coalesce(F.sum("credits_cost"), F.lit(0)).alias("credits"))


def stars_pivot(view: DataFrame) -> DataFrame:
    """Jurisdiction by stars 1 to 5, with zeros."""
    wide = view.groupBy("juridiction").pivot("score_stars", [1, 2, 3, 4, 5]).count().na.fill(0)
    return wide.select("juridiction", *[F.col(str(k)).alias(f"stars_{k}") for k in range(1, 6)])


def score_histogram(view: DataFrame, width: float = 0.05) -> DataFrame:
    return view.groupBy(F.floor(F.col("p_completion") / width).cast("int").alias("bin"), "juridiction").agg(F.count("*").alias("n"))


def class_balance(deals: DataFrame) -> DataFrame:
    """Closed, failed and pending deals, and closed per failed (null without failed ones)."""
    label = F.col("completion_label")
    n = deals.agg(F.count_if(label == 1).alias("closed"), F.count_if(label == 0).alias("failed"), F.count_if(label.isNull()).alias("pending"))
    return n.withColumn("imbalance", F.round(F.try_divide("closed", "failed"), 6))


def overview(view: DataFrame) -> DataFrame:
    per = view.groupBy("juridiction").agg(F.count("*").alias("n"), F.sum("p_completion").alias("p"))
    entry = F.struct("juridiction", "n")
    return per.agg(F.sum("n").alias("total"), F.round(F.sum("p").cast("double") / F.sum("n"), 6).alias("mean_p"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_jurisdiction"))


def star_distribution(view: DataFrame) -> DataFrame:
    """Rows per star 1 to 5, zero where there are none."""
    n = view.groupBy("score_stars").agg(F.count("*").alias("n"))
    return view.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("score_stars")).join(n, "score_stars", "left").na.fill(0, ["n"])


def top_by(view: DataFrame, col: str, n: int, descending: bool = True, where: Column | None = None, skip: int = 0) -> DataFrame:
    """``n`` rows by a column, ties by cluster_id, after ``skip`` of them."""
    rows = view if where is None else view.filter(where)
    return rows.orderBy(F.desc(col) if descending else F.asc(col), "cluster_id").offset(skip).limit(n)


def open_positions(positions: DataFrame, deals: DataFrame) -> DataFrame:
    names = deals.select(F.col("id").alias("deal_id"), "target_name", "acquirer_name")
    return positions.filter("status = 'open'").join(names, "deal_id", "left")


def recent_trades(trades: DataFrame, deals: DataFrame, n: int = 50) -> DataFrame:
    """The newest trades with their deals' names; the limit comes before the join."""
    newest = trades.orderBy(F.desc("created_at"), "trade_id").limit(n)
    return newest.join(deals.select(F.col("id").alias("deal_id"), "target_name"), "deal_id", "left")


def candidates(scores: DataFrame, deals: DataFrame, min_stars: int = 3, jurisdictions: tuple[str, ...] | None = None, strict: tuple[str, ...] = (), latest_only: bool = False) -> DataFrame:
    """Unlabelled, tradable deals with a score of ``min_stars`` or more, one row per such score (or for the latest only). In a ``strict`` jurisdiction only deals resolved to their home venue count."""
    s = latest_score(scores) if latest_only else scores
    d = deals.filter(F.col("completion_label").isNull() & ~F.col("offer_price_quality_flag").isin("suspect_mixed", "failed_validation", "manual_review"))
    if jurisdictions:
        d = d.filter(F.col("juridiction").isin(*jurisdictions))
    if strict:
        d = d.filter(~F.col("juridiction").isin(*strict) | F.col("ticker_resolution_flag").eqNullSafe("home_venue"))
    return s.filter(F.col("score_stars") >= min_stars).withColumnRenamed("id", "score_id").join(d, F.col("deal_id") == F.col("id")).drop("id")


def deals_with_event_count(deals: DataFrame, events: DataFrame) -> DataFrame:
    n = events.groupBy(F.col("deal_id").alias("id")).agg(F.count("*").alias("n_events"))
    return deals.join(n, "id", "left").na.fill(0, ["n_events"])


def first_by_name(view: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (juridiction, part) of ``wanted``, the first cluster whose target contains the part, or nulls."""
    from bidframe.operators.substrings import contained

    pairs = contained(view.select(F.col("target_name").alias("text")), wanted).withColumnRenamed("text", "target_name")
    rows = view.select("juridiction", "target_name", "cluster_id", "p_completion").join(pairs, "target_name").join(wanted.select("juridiction", "part").distinct(), ["juridiction", "part"])
    first = rows.groupBy("juridiction", "part").agg(F.min_by(F.struct("cluster_id", "target_name", "p_completion"), "cluster_id").alias("x")).select("juridiction", "part", "x.*")
    return wanted.join(first, ["juridiction", "part"], "left")
