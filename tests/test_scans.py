"""Scans in segments equal plain loops: as-of closes, positions, chains; odd keys and busy ones."""

import datetime
import random

import pytest

from bidframe.operators import clusters, ledger, pricing

DAY = datetime.date(2024, 1, 1)


def at(n):
    return DAY + datetime.timedelta(days=n)


@pytest.mark.parametrize("days,strict", [(None, True), (None, False), (5, False), (40, True)])
def test_asof_of_a_busy_ticker(spark, days, strict):
    draw = random.Random(7)
    closes = [("A", at(n), float(n)) for n in range(900) if n < 20 or n % 37 == 0] + [("B", at(3), 1.0), (None, at(1), 9.0), ("A", at(40), None)]
    asks = [(k, "A", at(draw.randrange(-5, 1000))) for k in range(400)] + [(400, None, at(5)), (401, "B", at(2)), (402, "B", at(3)), (403, "B", at(300)), (404, "C", at(5)), (405, "A", None)] + [(500 + k, "A", at(77)) for k in range(50)]
    got = pricing.asof_close(spark.createDataFrame(asks, "id int, ticker string, d date"), spark.createDataFrame(closes, "ticker string, d date, close double"), days, strict)
    found = {r.id: (r.close, r.close_date) for r in got.collect()}
    assert len(found) == len(asks)
    for k, ticker, d in asks:
        seen = [(c, v) for t, c, v in closes if d and t is not None and t == ticker and v is not None and (c < d if strict else c <= d) and (days is None or (d - c).days <= days)]
        day, close = max(seen) if seen else (None, None)
        assert found[k] == (close, day), (k, ticker, d)


def test_positions_over_days(spark):
    draw = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    fills = [(draw.choice([1, 1, 1, 2, None]), start + datetime.timedelta(hours=draw.randrange(900)), k, draw.choice(["BUY", "BUY", "SELL"]), float(draw.randrange(1, 9)), draw.randrange(1, 5)) for k in range(400)]
    got = {(r.deal_id, r.epoch): (r.open_ts, r.close_ts, r.size_eur) for r in ledger.positions(spark.createDataFrame(fills, "deal_id long, ts timestamp, trade_id long, side string, price double, quantity int")).filter("deal_id IS NOT NULL").collect()}
    want = {}
    for deal in (1, 2):
        epoch, size, opened = 0, 0.0, None
        for _, ts, _, side, price, quantity in sorted((f for f in fills if f[0] == deal), key=lambda f: (f[1], f[2])):
            if side == "BUY":
                opened, size = opened or ts, size + price * quantity
                want[deal, epoch] = (opened, None, size)
            else:
                if size:
                    want[deal, epoch] = (opened, ts, size)
                epoch, size, opened = epoch + 1, 0.0, None
    assert got == want


def test_chains_over_years(spark):
    days = [0, 100, 800, 850, 2000, 2729, 3459, 3459, 9000]
    rows = [(k, "FR", "T", "x", at(d), "opa", None, None) for k, d in enumerate(days)] + [(100, "FR", "U", "x", at(5), "opa", None, None), (101, "IT", "T", "x", at(5), "opa", None, None)]
    deals = spark.createDataFrame(rows, "id long, juridiction string, target_name string, acquirer_name string, announcement_date date, deal_type string, expected_close_date date, offer_price double")
    got = sorted(r.id_cluster for r in clusters.collapse_chains(deals).collect())
    assert got == sorted(["0_1_2_3", "4_5", "6_7", "8", "100", "101"])


def test_audit_from_the_latest_date(spark):
    """Dates go by their number, however far off; undated rows come last in their jurisdiction."""
    rows = [("FR", datetime.date(9999, 12, 31), "1"), ("FR", datetime.date(9998, 12, 31), "2"), ("FR", datetime.date(2020, 5, 1), "3_4"), ("FR", datetime.date(2020, 5, 1), "10"), ("FR", None, "5"), ("DE", datetime.date(2001, 1, 1), "6")]
    got = clusters.audit_order(spark.createDataFrame(rows, "juridiction string, first_date date, id_cluster string").repartition(3)).collect()
    assert [(r.pos, r.id_cluster) for r in got] == [(1, "6"), (2, "1"), (3, "2"), (4, "10"), (5, "3_4"), (6, "5")]


def test_first_values_of_rows_alike(spark):
    """Of rows alike in date and id the least value comes first, whatever order they come in; a later row's value fills a gap."""
    rows = [(1, "FR", "T", "x", at(1), "opa", None, None, None, None), (1, "FR", "T", "b", at(1), "ope", None, 7, 3, 1), (1, "FR", "T", "a", at(1), "opa", at(9), 5, 2, 0), (2, "FR", "T", "c", at(0), "opr", None, None, None, None), (3, "IT", "T", None, None, None, None, None, None, None)]
    for some in (rows, rows[::-1]):
        deals = spark.createDataFrame(some, "id long, juridiction string, target_name string, acquirer_name string, announcement_date date, deal_type string, expected_close_date date, premium_pct int, min_acceptance_threshold int, completion_label int").coalesce(1)
        got = {r.juridiction: (r.representative_deal_id, r.earliest_announcement, r.deal_type, r.bid_premium_pct, r.min_acceptance_threshold, r.days_to_expected_close, r.events_count, r.label) for r in clusters.cluster_features(deals).collect()}
        assert got == {"FR": (2, at(0), "opr", 500.0, 2.0, 9.0, 4.0, 0), "IT": (3, None, "unknown", None, None, None, 1.0, None)}
