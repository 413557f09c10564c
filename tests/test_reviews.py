"""Reviews of stored prices, second readings, and premiums from an ISIN on, against plain loops on small tables."""

import re
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from bidframe.functions import filings
from bidframe.operators import pricing, quality

AMOUNT = r"(\d{1,3}(?:[\s.]\d{3})*(?:[,.]\d{1,4})?)\s*(?:€|euros?)"
CLAUSE = r"s['’]\s*engage\s+(?:\w+\s+){0,3}[àa]\s+acqu[ée]rir[\s\S]{0,400}?prix\s+(?:unitaire\s+)?(?:relev[ée]\s+)?(?:modifi[ée]\s+)?de\s+" + AMOUNT
TEXTS = [
    None,
    "",
    "rien du tout",
    "12,50 € puis 12,50 € et 1 000 euros, encore 12,5 €",
    "Il s’engage à acquérir au prix de 10 €. " + "mot " * 60 + "Il s'engage irrévocablement à acquérir au prix unitaire relevé de 11,25 € et 10 € ou 3 €",
    " ".join(f"{k},00 €" for k in range(1, 30)),
    "x" * 5000 + " 7 € " + "y\n  y" * 5000,
]


def loop(text, pattern, reach=150):
    return [(Decimal(re.sub(r"\s", "", m.group(1)).replace(",", ".")), re.sub(r"\s+", " ", text[max(0, m.start() - reach) : m.end() + reach]).strip()) for m in re.finditer(pattern, text or "", re.IGNORECASE)]


def test_amount_candidates(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").select("id", filings.amount_candidates(F.col("text")).alias("x")).collect()
    for row in rows:
        own = loop(TEXTS[row.id], CLAUSE)
        other = {}
        for amount, context in loop(TEXTS[row.id], AMOUNT):
            if amount not in [a for a, _ in own] and len(other) < 12:
                other.setdefault(amount, context)
        assert [(v.amount, v.context) for v in row.x.principal] == own
        assert [(v.amount, v.context) for v in row.x.other] == list(other.items())
    assert len(rows) == len(TEXTS)


def test_guess_and_verdict_take_the_last_clause(spark):
    df = spark.createDataFrame([(TEXTS[4], Decimal("11.25")), (TEXTS[4], None), (TEXTS[3], Decimal(1)), (None, Decimal(1))], "text string, stored decimal(18,6)")
    got = df.select(filings.best_guess(F.col("text")).alias("g"), filings.clause_verdict(F.col("text"), F.col("stored")).alias("v")).collect()
    assert [(r.g.price, r.g.confidence) for r in got] == [(Decimal("11.25"), "MEDIUM")] * 2 + [(None, "LOW")] * 2
    assert [(r.v.verdict, r.v.status) for r in got] == [("MATCH", "multiple_engagement_clauses_match"), ("MISSING", "multiple_engagement_clauses"), ("NO_CLAUSE", "no_engagement_clause"), ("NO_CLAUSE", "no_engagement_clause")]
    assert got[0].v.excerpt == loop(TEXTS[4], CLAUSE, 120)[-1][1][-len(got[0].v.excerpt) :] and got[3].v.excerpt is None


def test_reparse(spark):
    schema = "id long, juridiction string, parser_version int, offer_price decimal(18,6), offer_price_quality_flag string"
    low, cash = "suspect_low_unverified", "verified_cash"
    deals = spark.createDataFrame(
        [(1, "DE", 1, Decimal(5), low), (2, "DE", 1, None, low), (3, "DE", 1, Decimal("10.05"), low), (4, "DE", 1, Decimal("10.05"), cash), (5, "DE", 1, Decimal(7), cash), (6, "DE", 1, Decimal(7), None), (7, "FR", 1, Decimal(7), cash), (8, "DE", 2, Decimal(7), cash), (9, "DE", 1, Decimal(0), low), (10, "DE", 1, Decimal(7), cash)],
        schema,
    )
    clause = "Angebotspreis: EUR 10,05 je Aktie"
    mixed = "Gewährung einer Gegenleistung von 0,4 Stückaktien A der MFE Media je Aktie"
    filings_ = spark.createDataFrame([(k, clause) for k in (1, 2, 3, 4, 7, 8, 9)] + [(5, "nichts"), (6, None), (10, mixed)], "id long, text string")
    scores = spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "deal_id long, n int")
    got = {r.id: r for r in quality.reparse_de(deals, filings_, scores).collect()}
    assert {k: r.action for k, r in got.items()} == {1: "price_changed", 2: "promoted", 3: "promoted", 4: "unchanged", 5: "unchanged", 6: "skipped_no_pdf", 9: "promoted", 10: "new_suspect_mixed"}
    assert got[1].scores_deleted == 2 and got[3].scores_deleted == 0 and got[5].new_price is None and got[5].new_flag == low and got[6].new_price == 7 and got[6].parser_version == 1
    again = deals.withColumn("parser_version", F.lit(2))
    assert quality.reparse_de(again, filings_, scores).count() == 0 and quality.reparse_de(deals.limit(0), filings_, scores).count() == 0


def _venue_tables(spark):
    listings = spark.createDataFrame(
        [("FR0000000001", 1, "AAA", "FP", "Common Stock", "Equity", "C1"), ("FR0000000002", 2, "BBB", "XS", "Common Stock", "Equity", "C2"), ("FR0000000003", 3, "CCC", "QQ", "Common Stock", "Equity", "C3")],
        "isin string, pos int, ticker string, exch string, security_type string, market_sector string, composite string",
    )
    closes = spark.createDataFrame([("AAA.PA", datetime(2024, 3, 8, 12), Decimal(10), 1), (None, datetime(2024, 3, 8, 12), Decimal(1), 2)], "ticker string, ts timestamp, close decimal(18,6), event_id int")
    return listings, closes


def test_premium_from_isin(spark):
    listings, closes = _venue_tables(spark)
    monday = date(2024, 3, 11)
    rows = [
        (1, "FR0000000001", monday, Decimal(12), 1, None), (2, "FR0000000002", monday, Decimal(12), 1, None), (3, "FR0000000003", monday, Decimal(12), 0, None), (4, "FR0000000009", monday, Decimal(12), 0, None), (5, "T1", monday, Decimal(12), 1, None),
        (6, None, monday, Decimal(12), 1, None), (7, "FR0000000001", monday, Decimal(12), None, None), (8, "FR0000000001", monday, Decimal(12), 1, "no_match"), (9, "FR0000000001", date(2024, 1, 9), Decimal(12), 1, None), (10, "FR0000000001", monday, Decimal(31), 1, None),
        (11, "FR0000000001", monday, None, 1, None), (12, "FR0000000001", None, Decimal(12), 1, None),
    ]
    deals = spark.createDataFrame(rows, "id int, isin string, announcement_date date, offer_price decimal(18,6), completion_label int, ticker_resolution_flag string")
    got = {r.deal_id: r for r in pricing.premium_from_isin(deals, listings, closes).collect()}
    assert {k: r.flag for k, r in got.items()} == {1: "home_venue", 2: "growth", 3: "unknown_exch", 4: "no_match", 5: "not_isin", 9: "no_price_data", 10: "premium_out_of_bounds", 11: "home_venue", 12: "no_price_data"}
    assert got[1].premium_pct == Decimal("0.2") and got[1].target_date == got[1].effective_date == date(2024, 3, 8)
    assert got[10].premium_pct is None and got[10].reference_price == 10 and got[11].premium_pct is None and got[11].reference_price == 10 and got[2].reference_price is None


def test_probe_statuses(spark):
    _, closes = _venue_tables(spark)
    day = date(2024, 3, 11)
    rows = [(1, None, None, None, day, 1), (2, "X", None, "no_match", day, 1), (3, "X", None, "unknown_exch", day, 1), (4, "X", "AAA.PA", "home_venue", None, 1), (5, "X", "ZZZ", "home_venue", day, 1), (6, "X", "AAA.PA", "home_venue", day, 40), (7, "X", "AAA.PA", "home_venue", day, None), (8, "X", None, None, day, 1)]
    sample = spark.createDataFrame([(*r[:5], r[5] and Decimal(r[5])) for r in rows], "deal_id int, isin string, ticker string, flag string, d date, offer_price decimal(18,6)")
    probed = pricing.price_probe(sample, closes)
    got = {r.deal_id: r for r in probed.collect()}
    assert {k: r.status for k, r in got.items()} == {1: "no_isin", 2: "no_match", 3: "unknown_exch", 4: "resolved_no_date", 5: "no_price", 6: "ok", 7: "ok", 8: "no_match"}
    assert got[6].outlier and got[6].premium_preview == 3 and not got[7].outlier and got[7].premium_preview is None
    rates = pricing.probe_rates(probed).first()
    assert rates.resolution_rate == round(4 / 7, 6) and rates.priced_rate == 0.25
    assert {r.status for r in pricing.price_probe(sample.drop("flag"), closes).collect()} >= {"no_ticker"}


def test_bounds(spark):
    sample = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    texts = spark.createDataFrame([(1, "prix offert : 5 EUR"), (2, "rien"), (3, "prix offert : 0,001 EUR")], "id int, text string")
    got = {r.id: (r.price, r.flag) for r in quality.validate_bounds(sample, texts).collect()}
    assert got == {1: (Decimal(5), "verified_cash"), 2: (None, "suspect_low_unverified"), 3: (Decimal("0.001"), "failed_validation"), 4: (None, "missing_pdf")}
