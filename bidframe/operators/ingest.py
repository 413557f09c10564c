"""Filings merged into deal and event tables; labels, corrections, invalidation.

Tables are snapshots: an upsert returns the whole new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.functions.names import PEND
from bidframe.operators.ordering import number_rows

KEY = ["juridiction", "regulator_ref"]
DEFAULT_FLAG = "suspect_low_unverified"


def latest_filings(filings: DataFrame, order: list[Column]) -> DataFrame:
    """One filing per key, the first by ``order``."""
    return filings.withColumn("_n", F.row_number().over(W.partitionBy(*KEY).orderBy(*order))).filter("_n = 1").drop("_n")


def fold_filings(filings: DataFrame, order: str) -> DataFrame:
    """Per key, what its filings, taken one after the other by ``order``, bring to a deal that is there: ``path`` and ``terms``.

    A filing with terms (a quality flag) sets price, flag, version and currency as long as the deal's flag is the
    default. So the first one with another flag is the last that counts, and without one the last does; of currency
    and version the last that is known among those that count. All of it is partial aggregates: a key may repeat at will.
    """
    said = F.col("offer_price_quality_flag")
    stops = filings.filter(said != DEFAULT_FLAG).groupBy(*KEY).agg(F.min(order).alias("_stop"))
    counts = said.isNotNull() & (F.col("_stop").isNull() | (F.col(order) <= F.col("_stop")))

    def last_known(c: str) -> Column:
        return F.max_by(c, F.when(counts & F.col(c).isNotNull(), F.col(order)))

    first_path = F.min_by("pdf_path", F.when(F.col("pdf_path").isNotNull(), F.col(order)))
    last = F.max_by(F.struct("offer_price", said.alias("flag")), F.when(counts, F.col(order)))
    return filings.join(stops, KEY, "left").groupBy(*KEY).agg(first_path.alias("_path"), last.alias("_terms"), last_known("currency").alias("_currency"), last_known("parser_version").alias("_version"))


def upsert_filings(deals: DataFrame, filings: DataFrame, today, order: str, fallback_type: str = "opa") -> tuple[DataFrame, DataFrame]:
    """(new deals, filing events): the tables after the filings were taken one after the other, by the unique column ``order``.

    The first filing with a new key inserts a deal with defaults, and one event. Every other one meets a deal that is
    there: it fills a missing document path, and sets price, currency, flag and version while the flag is still the
    default (``fold_filings``). All columns of ``deals`` come back, in their order; those that a filing has too are
    inserted with it. Where deals have an id and filings don't, new deals get the next ones in the order of their key.
    Filings without a key are left out.
    """
    filings = filings.filter(F.col(KEY[0]).isNotNull() & F.col(KEY[1]).isNotNull())
    firsts = filings.groupBy(*KEY).agg(F.min_by(F.struct(*[c for c in filings.columns if c not in KEY]), order).alias("_f")).join(deals.select(*KEY), KEY, "left_anti").select(*KEY, "_f.*")
    defaults = {
        "target_name": F.lit(PEND), "acquirer_name": F.lit(PEND), "announcement_date": F.lit(today).cast("date"), "deal_type": F.lit(fallback_type), "currency": F.lit("EUR"), "offer_price_quality_flag": F.lit(DEFAULT_FLAG), "parser_version": F.lit(1),
    }
    new = firsts.withColumns({c: F.coalesce(c, v) for c, v in defaults.items()}).withColumn("status", F.lit("announced"))
    events = new.select(*KEY, F.lit("filing").alias("event_type"), F.col("announcement_date").alias("day"))
    if "id" in deals.columns and "id" not in filings.columns:
        newest = deals.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_newest"))
        new = number_rows(new.withColumn("_key", F.concat_ws(" ", *KEY)), "_key", name="_n").crossJoin(F.broadcast(newest)).withColumn("id", F.col("_newest") + F.col("_n"))
    every = deals.unionByName(new.select(*[c for c in deals.columns if c in new.columns]), allowMissingColumns=True)
    open_ = (F.col("offer_price_quality_flag") == DEFAULT_FLAG) & F.col("_terms").isNotNull()
    now = {
        "offer_price": F.col("_terms.offer_price"), "offer_price_quality_flag": F.col("_terms.flag"), "currency": F.coalesce("_currency", "currency", F.lit("EUR")), "parser_version": F.coalesce("_version", "parser_version"),
    }
    changed = {c: F.when(open_, v).otherwise(F.col(c)) for c, v in now.items()} | {"pdf_path": F.coalesce("pdf_path", "_path")}
    return every.join(fold_filings(filings, order), KEY, "left").select(*[changed.get(c, F.col(c)).alias(c) for c in deals.columns]), events


def match_signals(signals: DataFrame, deals: DataFrame, events: DataFrame, event_type: str, order: str) -> DataFrame:
    """News (regulator_ref, link) matched to FR deals, one after the other by the unique column ``order``: no_ref, unmatched, duplicate, created.

    A duplicate has the deal, type and link of an event that is there or that an earlier one of the run created; a
    null link never is one, and an empty link or reference is none.
    """
    fr = deals.filter("juridiction = 'FR'").select("regulator_ref", F.col("id").alias("deal_id"))
    known = events.filter(F.col("event_type") == event_type).select("deal_id", F.col("source_url").alias("link")).filter("link IS NOT NULL").distinct().withColumn("known", F.lit(True))
    none = F.lit("")
    got = signals.withColumns({"regulator_ref": F.nullif("regulator_ref", none), "link": F.nullif("link", none)}).join(fr, "regulator_ref", "left")
    first = got.filter("deal_id IS NOT NULL AND link IS NOT NULL").groupBy("deal_id", "link").agg(F.min(order).alias("first"))
    got = got.join(first.join(known, ["deal_id", "link"], "left"), ["deal_id", "link"], "left")
    again = F.col("known") | (F.col(order) > F.col("first"))
    outcome = F.when(F.col("regulator_ref").isNull(), "no_ref").when(F.col("deal_id").isNull(), "unmatched").when(again, "duplicate").otherwise("created")
    return got.withColumn("outcome", outcome).drop("known", "first")


def before_first_known(feed: DataFrame, known: DataFrame, partition: list[str], order: list[str], key: str) -> DataFrame:
    """Rows of each feed, in its order, before the first whose key is known."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    hit = feed.join(known.select(key).distinct().withColumn("_k", F.lit(1)), key, "left")
    return hit.withColumn("_seen", F.max("_k").over(w)).filter("_seen IS NULL").drop("_k", "_seen")


def apply_labels(deals: DataFrame, labels: DataFrame, today) -> tuple[DataFrame, DataFrame]:
    """(deals, unknown ids). ``labels(line, id_cluster, label_y, label_source, label_notes)``: ids joined by ``_``.

    Lines whose label is neither 1 nor 0 are skipped. Of the others the last for a deal counts: it sets label, source
    (notes are added to it, or stand for it), and ``today`` as the label's date. Deals without such a line keep all
    three, or get null columns of them if they had none.
    """
    ids = F.transform(F.filter(F.split("id_cluster", "_"), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("bigint"))
    value = F.when(F.trim("label_y") == "1", 1).when(F.trim("label_y") == "0", 0)
    source, notes = (F.nullif(F.trim(c), F.lit("")) for c in ("label_source", "label_notes"))
    said = F.nullif(F.concat_ws(" | ", source, notes), F.lit(""))
    rows = labels.select("line", F.explode(ids).alias("id"), value.alias("y"), said.alias("said")).filter("y IS NOT NULL")
    last = rows.groupBy("id").agg(F.max_by(F.struct("y", "said"), "line").alias("l"))
    old = {c: F.col(c) if c in deals.columns else F.lit(None).cast(t) for c, t in (("label_source", "string"), ("label_date", "date"))}
    hit = F.col("l").isNotNull()
    got = deals.join(last, "id", "left").withColumns({
        "completion_label": F.when(hit, F.col("l.y")).otherwise(F.col("completion_label")), "label_source": F.when(hit, F.col("l.said")).otherwise(old["label_source"]),
        "label_date": F.when(hit, F.lit(today).cast("date")).otherwise(old["label_date"]),
    }).drop("l")
    return got, last.select("id").join(deals.select("id"), "id", "left_anti")


def apply_corrections(deals: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections (id, old_price, new_price) where nothing has drifted: the deal is still ``verified_cash`` at the old price. Returns all corrections with their status and price afterwards."""
    got = corrections.join(deals.select("id", "offer_price", "offer_price_quality_flag"), "id", "left")
    status = (
        F.when(F.col("offer_price_quality_flag").isNull(), "skipped_missing").when(F.col("offer_price_quality_flag") != "verified_cash", "skipped_flag")
        .when(~F.col("offer_price").eqNullSafe(F.col("old_price")), "skipped_price").otherwise("applied")
    )
    return got.withColumn("status", status).withColumn("price_after", F.when(F.col("status") == "applied", F.col("new_price")).otherwise(F.col("offer_price")))


def invalidate_scores(scores: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores that stay, number deleted as one row) for changed deals (deal_id)."""
    ids = changed.select("deal_id").distinct()
    return scores.join(ids, "deal_id", "left_anti"), scores.join(ids, "deal_id", "left_semi").agg(F.count("*").alias("n_deleted"))


def cascade_delete(deals: DataFrame, children: dict[str, DataFrame], pattern: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Delete deals by key pattern and their rows in the child tables. Returns deals, children and, per table, the numbers before and deleted, and the rows of deleted deals that are left in the result (which must be zero)."""
    gone = deals.filter(F.col("regulator_ref").like(pattern)).select(F.col("id").alias("deal_id"))
    kept = deals.filter(~F.coalesce(F.col("regulator_ref").like(pattern), F.lit(False)))
    after = {n: c.join(gone, "deal_id", "left_anti") for n, c in children.items()}
    counts = None
    for name, before, result in [("deals", deals, kept), *((n, c, after[n]) for n, c in children.items())]:
        key = F.col("id" if name == "deals" else "deal_id").alias("deal_id")
        tagged = before.select(key, F.lit(1).alias("then"), F.lit(0).alias("now")).unionByName(result.select(key, F.lit(0).alias("then"), F.lit(1).alias("now")))
        tagged = tagged.join(gone.withColumn("gone", F.lit(1)), "deal_id", "left")
        row = tagged.agg(F.sum("then").alias("before"), F.coalesce(F.sum(F.col("then") * F.col("gone")), F.lit(0)).alias("deleted"), F.coalesce(F.sum(F.col("now") * F.col("gone")), F.lit(0)).alias("left_over"))
        row = row.select(F.lit(name).alias("table_name"), F.coalesce("before", F.lit(0)).alias("before"), "deleted", "left_over")
        counts = row if counts is None else counts.unionByName(row)
    return kept, after, counts


def excluded_clusters(deals: DataFrame) -> DataFrame:
    """(target, jurisdiction) pairs with a labelled deal under manual review."""
    return deals.filter("offer_price_quality_flag = 'manual_review' AND completion_label IS NOT NULL").select("target_name", "juridiction").distinct()


def run_counters(outcomes: DataFrame, names: tuple[str, ...] = ("created", "duplicate", "unmatched", "no_ref")) -> DataFrame:
    return outcomes.agg(F.count("*").alias("discovered"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def days_open(deals: DataFrame, today) -> DataFrame:
    """Days since announcement, days past a jurisdiction's typical duration, and a guess at the label."""
    typical = F.when(F.col("juridiction") == "FR", 60).when(F.col("juridiction") == "IT", 75).when(F.col("juridiction") == "DE", 90)
    rows = deals.withColumn("days_open", F.datediff(F.lit(today).cast("date"), "announcement_date")).withColumn("past_close", F.col("days_open") - typical)
    guess = (
        F.when(typical.isNull(), "unknown_jurisdiction").when(F.col("days_open").isNull(), "missing_days_open")
        .when(F.col("past_close") > 90, "likely 1 if no failure news").when(F.col("past_close") >= 0, "verify").otherwise("likely pending NULL")
    )
    return rows.withColumn("label_guess", guess)


def populate_consideration(deals: DataFrame, texts: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(consideration rows, rejects) of ``suspect_mixed`` deals (id) from their texts (id, text): cash and share legs with the acquirer looked up in a hand-made registry. No text, no share clause and an unknown acquirer are rejects with a reason."""
    from bidframe.functions.filings import de_consideration
    from bidframe.functions.names import registry_match

    rows = deals.filter("offer_price_quality_flag = 'suspect_mixed'").select(F.col("id").alias("deal_id")).join(texts.withColumnRenamed("id", "deal_id"), "deal_id", "left").withColumn("c", de_consideration(F.col("text")))
    rows = registry_match(rows.withColumn("acquirer_name", F.col("c.acquirer")), registry)
    reason = F.when(F.col("text").isNull(), "no_text").when(F.col("c").isNull(), "no_share_clause").when(F.col("acquirer_ticker").isNull(), "unknown_acquirer")
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason IS NULL").select("deal_id", "c.cash_eur", "c.share_ratio", "acquirer_isin", "acquirer_ticker", F.col("c.excerpt").alias("source_clause_excerpt"))
    return good, rows.filter("reason IS NOT NULL").select("deal_id", "reason")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def dominant_key(df: DataFrame, group: str, key: str, pos: str) -> DataFrame:
    """The most frequent key of each group; of equally frequent ones the one seen first."""
    n = df.groupBy(group, key).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return n.groupBy(group).agg(F.max_by(key, F.struct("n", -F.col("first"))).alias(key))


def top_corrections(df: DataFrame, old: str, new: str, n: int = 20, key: str = "id") -> DataFrame:
    """The corrections with the largest change in percent of the old price."""
    pct = F.try_divide(F.col(new) - F.col(old), F.col(old)) * 100
    return df.withColumn("delta_pct", F.round(pct.cast("double"), 4)).filter("delta_pct IS NOT NULL").orderBy(F.desc(F.abs("delta_pct")), key).limit(n)
