"""Substrings, likeness by bounds and constraints against plain loops."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from bidframe.functions import names as rules
from bidframe.functions.names import STOP_WORDS
from bidframe.operators import constraints, pricing, substrings


def test_contained_parts(spark):
    draw = random.Random(4)
    word = lambda k: "".join(draw.choices("abcABé ", k=k))
    texts = [word(draw.randrange(12)) for _ in range(300)] + [None, "", "aaaa", "The Qatar Fund", "ab", "a"] * 2
    parts = [word(draw.randrange(6)) for _ in range(200)] + [None, "", "aa", "zzz", "Qatar", "qatar", "a", "The Qatar Fund and more"]
    got = {(r.text, r.part) for r in substrings.contained(spark.createDataFrame([(t, 1) for t in texts], "text string, n int"), spark.createDataFrame([(p, 2) for p in parts], "part string, n int")).collect()}
    assert got == {(t, p) for t in texts for p in parts if t is not None and p is not None and p in t}
    assert substrings.contained(spark.createDataFrame([("x",)], "text string"), spark.createDataFrame([], "part string")).count() == 0


def test_likeness_by_bounds(spark):
    """Every verdict is the ratio's, whatever decided it."""
    import re

    draw = random.Random(8)
    names = ["Alpha Beta SA", "Alhpa Btea", "Société Générale", "Gamma", "Gamm", "Delta-Omega Group", "Omega Delta", "X", "", "SA", "AAAA BBBB", "BBBB AAAA CC", "K+S AG", "Aareal Bank", "Areal Banken", "Total", "Totale Energies"]
    rows = [(k, draw.choice([None, "T", "T", "T"]), draw.choice(names), draw.choice([*names, None])) for k in range(400)]
    got = {r.id: (r.verdict, r.decided_by, r.ratio) for r in pricing.identity_check(spark.createDataFrame(rows, "id int, key string, target_name string, listed_name string"), STOP_WORDS).collect()}
    assert len(got) == len(rows)
    for k, key, one, other in rows:
        if key is None or other is None:
            assert got[k][0] == ("no_ticker" if key is None else "no_data")
            continue
        a, b = ({w for w in re.split("[^a-z0-9]+", x.lower()) if w and w not in STOP_WORDS} for x in (one, other))
        ratio = SequenceMatcher(None, " ".join(sorted(a)), " ".join(sorted(b))).ratio()
        assert got[k][0] == ("CONFIRM" if ratio >= 0.6 or any(len(w) >= 5 for w in a & b) else "REJECT"), (one, other, ratio, got[k])
        assert got[k][2] is None or abs(got[k][2] - ratio) < 1e-4
    paths = [x[1] for x in got.values()]
    assert {"word", "bound", "ratio", "equal"} <= set(paths) and paths.count("ratio") < len(paths) / 3


def test_constraints_on_small_tables(spark):
    trades = spark.createDataFrame([("a", 1, "BUY", 1, "PENDING"), ("a", 1, "HOLD", 0, "PENDING"), (None, 2, None, -1, "x"), (None, 9, "SELL", 1, None)], "trade_id string, deal_id int, side string, quantity int, status string")
    deals = spark.createDataFrame([(1,), (2,)], "id int")
    got = {(r.table_name, r.rule): (r.n_rows, r.n_failed) for r in constraints.constraint_report({"trades": trades, "deals": deals}, {"trades": constraints.RULES["trades"]}, {"trades": ["trade_id"]}).collect()}
    assert got == {("trades", "quantity"): (4, 2), ("trades", "side"): (4, 1), ("trades", "status"): (4, 1), ("trades", "unique"): (4, 1), ("trades", "foreign_key"): (4, 1)}
    rows = {r.key: sorted(r.rules) for r in constraints.failed_rows(trades, "trades", "deal_id", constraints.RULES["trades"]).collect()}
    assert rows == {"1": ["quantity", "side"], "2": ["quantity", "status"]}
    assert constraints.constraint_report({"trades": trades.limit(0)}, {"trades": constraints.RULES["trades"]}, {}, {}).agg({"n_failed": "sum"}).first()[0] == 0
    plan = constraints.row_report(trades, "trades", constraints.RULES["trades"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_one_scan_of_a_table(spark, tmp_path):
    spark.createDataFrame([(1, 1)], "size_eur int, status int").write.parquet(f"file://{tmp_path}/t")
    plan = constraints.row_report(spark.read.parquet(f"file://{tmp_path}/t"), "t", {"size": "size_eur > 0", "state": "status = 1"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_words_in_names(spark):
    """Each word counts as it is written, marks included, and endings only at an end or before a space."""
    draw = random.Random(6)
    words = sorted({*rules.PE_WORDS, *rules.SOE_WORDS, *rules.CORPORATE_ENDS, *rules.FOREIGN_WORDS, *rules.FDI_WORDS, *rules.GROUP_WORDS})
    some = [x for w in words for x in (w, f"q{w}q", f"A{w} B", f"A{w.upper()}\n", w.replace(".", "x"))] + [""]
    rows = [(k, n, draw.choice([*some, None])) for k, n in enumerate([*some, None])]
    got = spark.createDataFrame(rows, "k int, n string, t string").select("k", rules.acquirer_class(F.col("n")).alias("kind"), rules.is_cross_border(F.col("t"), F.col("n")).alias("cross"), rules.is_fdi_risk(F.col("n")).alias("fdi")).collect()
    assert len(got) == len(rows)
    for (_, kind, cross, fdi), (_, n, t) in zip(sorted(got), rows):
        if n is None:
            assert (kind, fdi) == ("unknown", None)
            continue
        low = n.lower()
        has = lambda part, low=low: any(w in low for w in part)
        ends = any(low.endswith(w) or w + " " in low for w in rules.CORPORATE_ENDS)
        short = 1 <= len(n.split()) <= 3 and not has(rules.GROUP_WORDS)
        assert kind == ("soe" if has(rules.SOE_WORDS) else "pe" if has(rules.PE_WORDS) else "corporate" if ends else "family" if short else "unknown"), n
        assert fdi == has(rules.FDI_WORDS), n
        foreign = [w for w in rules.FOREIGN_WORDS if w in low]
        assert cross is ((None if foreign else False) if t is None else any(w not in t.lower() for w in foreign)), (n, t)
