"""Queries on constraints, distributions, parser regressions, samples, folds and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidframe.operators import constraints, metrics, quality
from bidframe.plans import text as texts
from bidframe.plans.registry import query
from bidframe.plans.standin import table, with_tables


@query(
    with_tables("deals", "scores", "trades", "positions") + "SELECT 'scores' AS table_name, 'p_range' AS rule, count(*) AS n FROM scores WHERE NOT (p_completion BETWEEN 0 AND 0.95) HAVING count(*) > 0 UNION ALL SELECT 'trades', 'quantity', count(*) FROM trades WHERE NOT quantity > 0 HAVING count(*) > 0 "
    "UNION ALL SELECT 'deals', 'deal_type', count(*) FROM deals WHERE deal_type NOT IN ('opa', 'opa_simplifiee', 'ope', 'opas') HAVING count(*) > 0 UNION ALL SELECT 'positions', 'foreign_key', count(*) FROM positions WHERE deal_id NOT IN (SELECT id FROM deals WHERE id % 2 = 0) HAVING count(*) > 0 "
    "UNION ALL SELECT 'deals', 'unique', count(*) FROM (SELECT target_name, announcement_date FROM deals GROUP BY 1, 2 HAVING count(*) > 1) HAVING count(*) > 0"
)
def quality_bounds(spark, d):
    deals, scores = table(spark, d, "deals"), table(spark, d, "scores")
    found = [
        quality.violations(scores, "scores", "id", {"p_range": F.col("p_completion").between(0, 0.95)}), quality.violations(table(spark, d, "trades"), "trades", "trade_id", {"quantity": F.col("quantity") > 0, "side": F.col("side").isin("BUY", "SELL")}),
        quality.violations(deals, "deals", "id", {"deal_type": F.col("deal_type").isin("opa", "opa_simplifiee", "ope", "opas"), "juridiction": F.col("juridiction").isin("FR", "IT", "DE")}),
        quality.orphans(table(spark, d, "positions"), "positions", "id", deals.filter("id % 2 = 0"), "id", "deal_id"), quality.duplicates(deals, "deals", ["target_name", "announcement_date"]),
    ]
    rows = found[0]
    for x in found[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("table_name", "rule").agg(F.count("*").alias("n"))


#: Columns of the checked tables that the stand-ins don't have.
_MORE = {
    "deals": ["CASE WHEN id % 9 = 0 THEN 'guess' WHEN id % 2 = 0 THEN 'parser_only' END AS pricing_source", "CASE WHEN id % 13 = 0 THEN 'JPY' ELSE 'EUR' END AS currency"],
    "scores": ["CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id % 7 AS DECIMAL(6,5)) / 5 END AS p_market_implied"],
}


def _checked_sql() -> str:
    names = list(constraints.RULES)
    tables = ", ".join(f"c_{n} AS (SELECT *{''.join(', ' + m for m in _MORE.get(n, []))} FROM {n})" for n in names)
    parts = [f"SELECT '{n}' AS table_name, '{rule}' AS rule, count(*) AS n_rows, count(*) FILTER (NOT coalesce({test}, true)) AS n_failed FROM c_{n}" for n in names for rule, test in constraints.RULES[n].items()]
    parts += [f"SELECT '{n}', 'unique', (SELECT count(*) FROM c_{n}), count(*) FROM (SELECT {', '.join(cols)} FROM c_{n} WHERE {' AND '.join(c + ' IS NOT NULL' for c in cols)} GROUP BY ALL HAVING count(*) > 1)" for n, cols in constraints.UNIQUE.items()]
    parts += [f"SELECT '{n}', 'foreign_key', count(*), count(*) FILTER ({c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM c_{p})) FROM c_{n}" for n, (c, p, k) in constraints.FOREIGN.items()]
    return with_tables(*names) + f", {tables} " + " UNION ALL ".join(parts)


@query(_checked_sql())
def constraint_report(spark, d):
    return constraints.constraint_report({n: table(spark, d, n).selectExpr("*", *_MORE.get(n, [])) for n in constraints.RULES})


@query(with_tables("deals") + "SELECT juridiction, offer_price_quality_flag, count(*) AS n FROM deals GROUP BY ALL")
def flag_counts(spark, d):
    return quality.counts_by(table(spark, d, "deals"), "juridiction", "offer_price_quality_flag")


@query(with_tables("deals") + "SELECT coalesce(ticker_resolution_flag, 'none') AS ticker_resolution_flag, count(*) AS n FROM deals GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM deals")
def flag_counts_rollup(spark, d):
    return quality.counts_with_total(table(spark, d, "deals"), "ticker_resolution_flag")


_DIST = ", s AS (SELECT x, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS n FROM v WHERE x IS NOT NULL) SELECT count(*) AS n, round(avg(x), 6) AS mean, min(x) AS min, median(x) AS median, max(x) AS max, round(stddev_samp(x), 6) AS stdev, max(x) FILTER (k = greatest(1, floor(n * 0.05))) AS p05, max(x) FILTER (k = greatest(1, least(n, floor(n * 0.95)))) AS p95 FROM s"


@query(with_tables("deals") + ", v AS (SELECT CAST(premium_pct AS DOUBLE) AS x FROM deals)" + _DIST)
def premium_distribution(spark, d):
    return quality.distribution(table(spark, d, "deals"), "premium_pct")


@query(with_tables("deals") + ", v AS (SELECT CAST(offer_price AS DOUBLE) AS x FROM deals)" + _DIST)
def price_distribution(spark, d):
    return quality.distribution(table(spark, d, "deals"), "offer_price")


@query(
    with_tables("deals") + ", c AS (SELECT target_name, juridiction, " + ", ".join(f"max(CAST({c} IS NOT NULL AS INT)) AS {c}" for c in ("premium_pct", "min_acceptance_threshold", "expected_close_date")) + " FROM deals GROUP BY 1, 2), u AS (UNPIVOT c ON premium_pct, min_acceptance_threshold, expected_close_date INTO NAME ingredient VALUE has) "
    "SELECT juridiction, ingredient, CAST(sum(has) AS BIGINT) AS populated, count(*) AS clusters, round(sum(has) / count(*), 6) AS share FROM u GROUP BY 1, 2"
)
def coverage_audit(spark, d):
    return quality.coverage(table(spark, d, "deals"), ["premium_pct", "min_acceptance_threshold", "expected_close_date"])


@query(
    with_tables("deals") + ", b AS (SELECT CASE WHEN offer_price IS NULL THEN 'null' WHEN offer_price < 5 THEN 'below_5' WHEN offer_price > 500 THEN 'above_500' ELSE 'normal' END AS bucket FROM deals) SELECT bucket, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 6) AS share FROM b GROUP BY 1"
)
def outlier_buckets(spark, d):
    return quality.outlier_audit(table(spark, d, "deals"))


@query(
    with_tables("deals") + ", s AS (SELECT juridiction, CAST(ticker_resolution_flag = 'home_venue' AS INT) AS ok FROM (SELECT juridiction, coalesce(ticker_resolution_flag, '') AS ticker_resolution_flag FROM deals)) "
    "SELECT coalesce(juridiction, 'TOTAL') AS juridiction, count(*) AS n, round(avg(ok), 6) AS rate, CASE WHEN avg(ok) >= 0.55 THEN 'GO' ELSE 'NO_GO' END AS verdict FROM s GROUP BY ROLLUP (juridiction)"
)
def success_rates(spark, d):
    probed = table(spark, d, "deals").withColumn("status", F.when(F.col("ticker_resolution_flag") == "home_venue", "ok").otherwise("no_match"))
    return quality.success_rates(probed, 0.55)


@query(
    with_tables("deals") + "SELECT juridiction, id FROM deals WHERE id % 10 <> 3 QUALIFY row_number() OVER (PARTITION BY juridiction ORDER BY id % 500 = 0 DESC, md5(concat(CAST(id AS VARCHAR), ':42')), id) <= 25"
)
def stratified_sample(spark, d):
    deals = table(spark, d, "deals")
    return quality.stratified_sample(deals, "juridiction", "id", 25, 42, F.col("id") % 500 == 0, deals.filter("id % 10 = 3")).select("juridiction", "id")


_OLD = "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(5 AS DECIMAL(18,6)) ELSE CAST({p} AS DECIMAL(18,6)) END"


@query(
    f"WITH x AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 3 THEN CAST({texts._EUROS} AS DOUBLE) WHEN 4 THEN NULL WHEN 5 THEN 1000 ELSE {texts._PRICE} END AS new, CASE WHEN o_orderkey % 6 IN (0, 1) THEN 1 ELSE 0 END AS trusted, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 5 ELSE {texts._PRICE} END AS old FROM orders) "
    ", y AS (SELECT id, CASE WHEN new IS NULL THEN CASE WHEN old IS NULL THEN 'UNCHANGED' ELSE 'PARSER_FAIL' END WHEN old IS NULL THEN 'NEW_EXTRACT' WHEN old = new THEN 'UNCHANGED' WHEN trusted = 1 THEN 'CORRECTED' ELSE 'NEW_DIFFERENT' END AS category, round(new - old, 2) AS delta_eur, round((new - old) / old * 100, 4) AS delta_pct FROM x) "
    "SELECT *, category IN ('NEW_DIFFERENT', 'PARSER_FAIL', 'NEW_EXTRACT') AS review FROM y"
)
def extraction_diff(spark, d):
    from bidframe.functions.filings import fr_offer_price

    rows = texts._orders(spark, d, text=texts._FR_TEXT, old=_OLD.format(p=texts._PRICE)).withColumn("x", fr_offer_price(F.col("text")))
    rows = rows.select("id", quality.extraction_diff(F.col("old"), F.col("x.amount"), F.col("x.source")).alias("y"))
    return rows.select("id", "y.category", F.col("y.delta_eur").cast("double").alias("delta_eur"), F.col("y.delta_pct").cast("double").alias("delta_pct"), "y.review")


@query(
    with_tables("deals")
    + f", f AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, CASE WHEN o_orderkey % 5 IN (2, 3) THEN NULL ELSE {texts._PRICE} END AS new, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 5 ELSE {texts._PRICE} END AS old FROM orders), n AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1), "
    "x AS (SELECT d.id, old, new, d.id % 7 = 0 AS lost, coalesce(n, 0) AS n, offer_price_quality_flag AS old_flag, CASE k WHEN 2 THEN 'suspect_mixed' WHEN 3 THEN 'suspect_low_unverified' ELSE 'verified_cash' END AS flag FROM deals d JOIN f USING (id) LEFT JOIN n USING (id) WHERE juridiction = 'DE' AND d.id % 9 > 0), "
    "a AS (SELECT *, CASE WHEN lost THEN 'skipped_no_pdf' WHEN flag = 'suspect_mixed' THEN flag WHEN new IS NULL THEN 'unchanged' WHEN old IS NULL THEN 'promoted' WHEN abs(new - old) / old > 0.01 THEN 'price_changed' WHEN flag <> old_flag THEN 'promoted' ELSE 'unchanged' END AS action FROM x) "
    "SELECT id, CASE WHEN action = 'suspect_mixed' THEN 'new_suspect_mixed' ELSE action END AS action, CASE WHEN NOT lost AND flag <> 'suspect_mixed' THEN round(abs(new - old) / old, 6) END AS delta, old AS old_price, CASE WHEN lost THEN old ELSE new END AS new_price, old_flag, CASE WHEN lost THEN old_flag ELSE flag END AS new_flag, "
    "CASE WHEN lost THEN 1 ELSE 2 END AS parser_version, CASE WHEN action = 'price_changed' THEN n ELSE 0 END AS scores_deleted FROM a"
)
def reparse_actions(spark, d):
    """Deals with a stored price of several kinds; every ninth was read by the newest parser already."""
    old = texts._orders(spark, d, offer_price=_OLD.format(p=texts._PRICE))
    deals = table(spark, d, "deals").drop("offer_price").join(old, "id").withColumn("parser_version", F.when(F.col("id") % 9 > 0, 1).otherwise(2))
    found = texts._orders(spark, d, text=texts._DE_TEXT).withColumn("text", F.when(F.col("id") % 7 != 0, F.col("text")))
    got = quality.reparse_de(deals, found, table(spark, d, "scores"))
    return got.withColumns({c: F.col(c).cast("double") for c in ("delta", "old_price", "new_price")})


@query(
    with_tables("deals")
    + f", f AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 3 THEN CAST({texts._EUROS} AS DOUBLE) WHEN 4 THEN NULL WHEN 5 THEN 1000 ELSE {texts._PRICE} END AS new, CASE WHEN o_orderkey % 3 = 0 THEN 'no_match' ELSE CASE o_orderkey % 6 WHEN 1 THEN 'surenchere_raised' WHEN 4 THEN 'no_match' ELSE 'fallback_first_match' END END AS source FROM orders), "
    "a AS (SELECT d.id, offer_price, new, source, CASE WHEN d.id % 7 = 0 THEN 'exception' WHEN d.id % 3 = 0 THEN 'skipped_no_pdf' WHEN d.id % 6 = 4 AND offer_price IS NULL THEN 'noop' ELSE 'applied' END AS action FROM deals d JOIN f USING (id) WHERE offer_price_quality_flag = 'suspect_low_unverified' AND d.id % 4 < 2) "
    "SELECT id, action, CASE WHEN action = 'applied' THEN new ELSE CAST(offer_price AS DOUBLE) END AS offer_price, CASE WHEN action = 'applied' AND new IS NOT NULL THEN 'verified_cash' ELSE 'suspect_low_unverified' END AS flag, CASE WHEN action = 'applied' THEN 2 ELSE 1 END AS parser_version, source FROM a"
)
def parser_backfill(spark, d):
    deals = table(spark, d, "deals").withColumn("parser_version", F.when(F.col("id") % 4 < 2, 1).otherwise(2))
    found = texts._orders(spark, d, text=texts._FR_TEXT).withColumn("failed", F.col("id") % 7 == 0).withColumn("text", F.when(F.col("id") % 3 != 0, F.col("text")))
    return quality.backfill_fr(deals, found).select("id", "action", F.col("offer_price").cast("double").alias("offer_price"), F.col("offer_price_quality_flag").alias("flag"), "parser_version", "source")


@query(
    with_tables("deals")
    + f", f AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k, CASE WHEN o_orderkey % 5 IN (2, 3) THEN NULL ELSE {texts._PRICE} END AS new FROM orders), "
    "a AS (SELECT id, k, CAST(offer_price AS DOUBLE) AS old_price, new, offer_price_quality_flag AS old_flag, CASE WHEN id % 7 = 0 THEN 'skipped_no_pdf' WHEN new IS NULL THEN CASE WHEN offer_price IS NULL THEN 'unchanged' ELSE 'nulled' END WHEN offer_price IS NULL OR new <> offer_price THEN 'corrected' ELSE 'unchanged' END AS action "
    "FROM deals JOIN f USING (id) WHERE juridiction = 'DE' AND id % 4 < 3 AND (offer_price IS NULL OR offer_price < 5 OR offer_price > 200)) "
    "SELECT id, old_price, CASE WHEN action = 'skipped_no_pdf' THEN old_price ELSE new END AS new_price, CASE WHEN action = 'skipped_no_pdf' THEN old_flag WHEN k = 2 THEN 'suspect_mixed' WHEN k = 3 THEN 'suspect_low_unverified' ELSE 'verified_cash' END AS flag, action, CASE WHEN action = 'skipped_no_pdf' THEN 1 ELSE 2 END AS parser_version FROM a"
)
def de_outlier_backfill(spark, d):
    deals = table(spark, d, "deals").withColumn("parser_version", F.when(F.col("id") % 4 < 3, 1).otherwise(2))
    found = texts._orders(spark, d, text=texts._DE_TEXT).withColumn("text", F.when(F.col("id") % 7 != 0, F.col("text")))
    return quality.backfill_de(deals, found, high=200).select("id", F.col("old_price").cast("double").alias("old_price"), F.col("new_price").cast("double").alias("new_price"), "flag", "action", "parser_version")


@query(
    with_tables("deals") + ", n AS (SELECT id, offer_price_quality_flag AS old_flag, CASE WHEN offer_price < 0.01 OR offer_price > 10000 THEN 'failed_validation' WHEN deal_type = 'opas' THEN 'suspect_mixed' WHEN offer_price IS NULL OR target_name = '[pending parse]' THEN 'manual_review' ELSE 'verified_cash' END AS new_flag, offer_price FROM deals WHERE juridiction = 'IT') "
    "SELECT id, old_flag, new_flag, coalesce(new_flag = 'verified_cash' AND offer_price > 107.19, false) AS statistical_outlier, CASE WHEN old_flag = new_flag THEN 'noop' ELSE 'applied' END AS action FROM n"
)
def it_flag_promotion(spark, d):
    return quality.promote_it_flags(table(spark, d, "deals"))


def _isins_found(spark, d):
    deals = table(spark, d, "deals")
    found = deals.filter("id % 3 > 0").select("id", F.when(F.col("id") % 3 == 1, F.concat(F.lit("code ISIN : "), "isin", F.lit(" (x)"))).otherwise("rien").alias("text"))
    return quality.isin_backfill(deals.withColumn("ticker", F.expr("CASE WHEN id % 4 = 0 THEN NULL ELSE ticker END")), found)


_FOUND = "SELECT id, juridiction, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN isin END AS found, CASE WHEN id % 3 = 0 THEN 'no_pdf' WHEN id % 3 = 2 THEN 'no_isin' ELSE 'ok' END AS status FROM deals WHERE id % 4 = 0"


@query(with_tables("deals") + f"SELECT id, found, status FROM ({_FOUND})")
def isin_backfill(spark, d):
    return _isins_found(spark, d).select("id", "found", "status")


@query(with_tables("deals") + f", s AS (SELECT juridiction, CAST(status = 'ok' AS INT) AS ok FROM ({_FOUND})) SELECT coalesce(juridiction, 'TOTAL') AS juridiction, count(*) AS n, round(avg(ok), 6) AS rate, CASE WHEN avg(ok) >= 0.33 THEN 'GO' ELSE 'NO_GO' END AS verdict FROM s GROUP BY ROLLUP (juridiction)")
def isin_success(spark, d):
    """The share of deals without a ticker whose filing gave an ISIN, per country and over all."""
    return quality.success_rates(_isins_found(spark, d), 0.33)


@query(
    f"SELECT CASE o_orderkey % 6 WHEN 4 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'match_none' ELSE 'miss' END ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'false_positive' WHEN o_orderkey % 6 IN (0, 1, 2) THEN 'match' WHEN o_orderkey % 6 = 3 AND o_orderkey % 100 = 0 THEN 'match' WHEN o_orderkey % 6 = 5 AND {texts._PRICE} = 1000 THEN 'match' ELSE 'mismatch' END END AS outcome, count(*) AS n FROM orders GROUP BY 1"
)
def extraction_accuracy(spark, d):
    from bidframe.functions.filings import fr_offer_price

    expected = f"CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST({texts._PRICE} AS DECIMAL(18,6)) END"
    rows = texts._orders(spark, d, text=texts._FR_TEXT, expected=expected).withColumn("got", fr_offer_price(F.col("text"))["amount"])
    return rows.groupBy(metrics.extraction_outcome(F.col("expected"), F.col("got")).alias("outcome")).agg(F.count("*").alias("n"))


_PRED = with_tables("deals", "scores") + ", r AS (SELECT d.id, d.juridiction, s.id AS score_id, CAST(s.p_completion AS DOUBLE) AS p, d.completion_label AS y FROM scores s JOIN deals d ON d.id = s.deal_id WHERE d.completion_label IS NOT NULL)"


def _predictions(spark, d):
    s = table(spark, d, "scores").select(F.col("id").alias("score_id"), "deal_id", F.col("p_completion").cast("double").alias("p"))
    deals = table(spark, d, "deals").filter("completion_label IS NOT NULL").select("id", "juridiction", F.col("completion_label").alias("y"))
    return s.join(deals, s.deal_id == deals.id)


@query(
    _PRED + ", k AS (SELECT *, rank() OVER (PARTITION BY juridiction ORDER BY p) + (count(*) OVER (PARTITION BY juridiction, p) - 1) / 2.0 AS rk FROM r) SELECT juridiction, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM k GROUP BY 1"
)
def exact_auc(spark, d):
    return metrics.auc_parts(_predictions(spark, d), "p", "y", ["juridiction"]).withColumn("auc", F.round("auc", 6))


@query(
    _PRED + "SELECT juridiction, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))), 4) AS log_loss, round(avg(CAST((p >= 0.5) = (y = 1) AS INT)), 6) AS accuracy, "
    "round(2 * count(*) FILTER (p >= 0.5 AND y = 1) / (2 * count(*) FILTER (p >= 0.5 AND y = 1) + count(*) FILTER (p >= 0.5 AND y = 0) + count(*) FILTER (p < 0.5 AND y = 1)), 6) AS f1 FROM r GROUP BY 1"
)
def brier_logloss_f1(spark, d):
    return metrics.losses(_predictions(spark, d), "p", "y", ["juridiction"]).select("juridiction", F.round("brier", 6).alias("brier"), F.round("log_loss", 4).alias("log_loss"), F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query(
    with_tables("deals") + ", l AS (SELECT id, announcement_date AS day, row_number() OVER (ORDER BY announcement_date, id) - 1 AS pos, count(*) OVER () AS n FROM deals WHERE completion_label IS NOT NULL), c AS (SELECT *, CAST(least(pos // (n // 4), 3) AS INT) AS chunk FROM l), b AS (SELECT chunk AS fold, min(day) AS v FROM c WHERE chunk >= 1 GROUP BY 1) "
    "SELECT id, fold, CASE WHEN chunk = fold THEN 'valid' ELSE 'train' END AS role FROM c JOIN b ON chunk = fold OR (chunk < fold AND day <= v - 90)"
)
def chronological_folds(spark, d):
    rows = table(spark, d, "deals").filter("completion_label IS NOT NULL").select("id", F.col("announcement_date").alias("day"))
    return metrics.chronological_folds(rows).select("id", "fold", "role")


@query(
    with_tables("deals") + ", l AS (SELECT id, completion_label AS y, row_number() OVER (PARTITION BY completion_label ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY completion_label) AS n FROM deals WHERE completion_label IS NOT NULL) "
    "SELECT id, CAST(CASE WHEN pos < (n % 3) * (n // 3 + 1) THEN pos // (n // 3 + 1) ELSE n % 3 + (pos - (n % 3) * (n // 3 + 1)) // (n // 3) END + 1 AS INT) AS fold FROM l"
)
def stratified_folds(spark, d):
    return metrics.stratified_folds(table(spark, d, "deals").filter("completion_label IS NOT NULL"), "completion_label").select("id", "fold")


@query(
    with_tables("scores") + ", a AS (SELECT deal_id, max(CAST(p_completion AS DOUBLE)) AS p FROM scores WHERE model_version = 'v1' GROUP BY 1), b AS (SELECT deal_id, max(CAST(p_completion AS DOUBLE)) AS p FROM scores WHERE model_version = 'v2' GROUP BY 1) "
    "SELECT round(avg(abs(a.p - b.p)), 8) AS mean_diff, round(max(abs(a.p - b.p)), 8) AS max_diff, count(*) FILTER (abs(a.p - b.p) > 1e-6) AS n_moved FROM a JOIN b USING (deal_id)"
)
def prediction_diff(spark, d):
    best = table(spark, d, "scores").groupBy("deal_id", "model_version").agg(F.max("p_completion").alias("p"))
    summary, _ = metrics.compare_models(best.filter("model_version = 'v1'"), best.filter("model_version = 'v2'"), ["deal_id"])
    return summary


@query(
    with_tables("scores") + ", a AS (SELECT deal_id, max(CAST(p_completion AS DOUBLE)) AS p_a FROM scores WHERE model_version = 'v1' GROUP BY 1), b AS (SELECT deal_id, max(CAST(p_completion AS DOUBLE)) AS p_b FROM scores WHERE model_version = 'v2' GROUP BY 1) "
    "SELECT deal_id, p_a, p_b, abs(p_a - p_b) AS diff FROM a JOIN b USING (deal_id) ORDER BY diff DESC, deal_id LIMIT 10"
)
def prediction_movers(spark, d):
    best = table(spark, d, "scores").groupBy("deal_id", "model_version").agg(F.max("p_completion").alias("p"))
    return metrics.compare_models(best.filter("model_version = 'v1'"), best.filter("model_version = 'v2'"), ["deal_id"])[1].select("deal_id", "p_a", "p_b", "diff")


@query(
    with_tables("scores") + ", r AS (SELECT CAST(id % 4 AS INT) AS run, deal_id, max(CAST(p_completion AS DOUBLE)) / 3 AS p FROM scores GROUP BY 1, 2) SELECT a.run AS run_a, b.run AS run_b, round(avg(abs(a.p - b.p)), 12) AS mean_diff, max(abs(a.p - b.p)) AS max_diff, count(*) AS n FROM r a JOIN r b ON a.deal_id = b.deal_id AND a.run < b.run GROUP BY 1, 2"
)
def refit_variance(spark, d):
    runs = table(spark, d, "scores").groupBy((F.col("id") % 4).cast("int").alias("run"), "deal_id").agg((F.max(F.col("p_completion").cast("double")) / 3).alias("p"))
    return metrics.refit_variance(runs, ["deal_id"])


@query(with_tables("deals") + "SELECT id, juridiction, CASE WHEN offer_price_quality_flag = 'manual_review' THEN 'train_only' ELSE 'train_and_test' END AS use FROM deals WHERE completion_label IS NOT NULL")
def split_audit(spark, d):
    return metrics.split_audit(table(spark, d, "deals"))


#: Parts in which scores and their deals meet; up to 200 are written without a sort.
PARTS = 192


@query(
    with_tables("deals", "scores")
    + ", r AS (SELECT s.deal_id, d.juridiction, s.model_version AS v, CAST(s.p_completion AS DOUBLE) AS p, d.completion_label AS y FROM scores s JOIN deals d ON d.id = s.deal_id WHERE d.completion_label IS NOT NULL AND s.model_version IN ('v1', 'v2')), "
    "k AS (SELECT *, rank() OVER (PARTITION BY juridiction, v ORDER BY p) + (count(*) OVER (PARTITION BY juridiction, v, p) - 1) / 2.0 AS rk FROM r), "
    "m AS (SELECT juridiction, v, round(avg((p - y) * (p - y)), 8) AS brier, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 8) AS auc FROM k GROUP BY 1, 2), "
    "x AS (SELECT deal_id, juridiction, v, max(p) AS p FROM r GROUP BY 1, 2, 3), g AS (SELECT a.juridiction, b.v, max(abs(a.p - b.p)) AS max_diff FROM x a JOIN x b ON a.deal_id = b.deal_id WHERE a.v = 'v1' GROUP BY 1, 2) "
    "SELECT a.juridiction, b.v AS against, round(g.max_diff, 8) AS max_diff, b.brier - a.brier AS d_brier, b.auc - a.auc AS d_auc, CASE WHEN g.max_diff <= 1e-10 THEN 'identical' WHEN abs(a.brier - b.brier) <= 0.005 AND abs(a.auc - b.auc) <= 0.01 THEN 'acceptable' ELSE 'regression' END AS verdict "
    "FROM m a JOIN m b ON a.juridiction = b.juridiction AND a.v = 'v1' JOIN g ON g.juridiction = a.juridiction AND g.v = b.v"
)
def no_regression_verdict(spark, d):
    """Each version against the first, the first itself among them. Scores and deals meet in a fixed number of parts, so that a task's share is small; a deal's versions are compared in one row."""
    s = table(spark, d, "scores").filter("model_version IN ('v1', 'v2')").select("deal_id", "model_version", F.col("p_completion").cast("double").alias("p"))
    deals = table(spark, d, "deals").filter("completion_label IS NOT NULL").select(F.col("id").alias("deal_id"), "juridiction", F.col("completion_label").alias("y"))
    rows = s.repartition(PARTS, "deal_id").join(deals.repartition(PARTS, "deal_id"), "deal_id")
    m = metrics.metrics(rows, "p", "y", ["juridiction", "model_version"])
    versions = ("v1", "v2")
    best = rows.groupBy("deal_id", "juridiction", "y").agg(*[F.max(F.when(F.col("model_version") == v, F.col("p"))).alias(v) for v in versions])
    most = best.groupBy("juridiction").agg(*[F.max(F.abs(F.col(v) - F.col("v1"))).alias(v) for v in versions])
    diff = most.unpivot("juridiction", list(versions), "against", "max_diff").filter("max_diff IS NOT NULL")
    one = m.filter("model_version = 'v1'").select("juridiction", F.col("brier").alias("brier_a"), F.col("auc").alias("auc_a"))
    both = m.select("juridiction", F.col("model_version").alias("against"), F.col("brier").alias("brier_b"), F.col("auc").alias("auc_b")).join(one, "juridiction").join(diff, ["juridiction", "against"])
    verdict = metrics.no_regression(F.col("max_diff"), F.col("brier_a"), F.col("brier_b"), F.col("auc_a"), F.col("auc_b"))
    return both.select("juridiction", "against", F.round("max_diff", 8).alias("max_diff"), (F.col("brier_b") - F.col("brier_a")).alias("d_brier"), (F.col("auc_b") - F.col("auc_a")).alias("d_auc"), verdict.alias("verdict"))
