"""Landed files, reports and odd rows."""

from pyspark.sql import functions as F

from bidframe.functions import filings
from bidframe.operators import ingest, pricing
from bidframe.sources import feeds, sinks

RSS = """<?xml version="1.0"?><rss><channel>
<item><title>OPA simplifiée sur Alpha</title><link>https://x.example/AMF-2024-C-0001</link><description>a</description><pubDate>Mon, 05 Feb 2024 10:00:00 +0100</pubDate></item>
<item><title>Assemblée générale</title><link>https://x.example/y</link><description>rien</description></item>
<item><title>Note</title><link>https://x.example/z</link><description>une offre publique</description></item>
</channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(RSS)
    got = {r.title: r for r in feeds.rss_items(spark, f"file://{tmp_path}/feed.xml").collect()}
    assert set(got) == {"OPA simplifiée sur Alpha", "Note"}
    assert got["OPA simplifiée sur Alpha"].regulator_ref == "AMF-2024-C-0001" and got["OPA simplifiée sur Alpha"].published_at.hour == 9
    assert got["Note"].regulator_ref is None and got["Note"].published_at is None


def test_feed_tolerates_gaps(spark):
    rows = spark.createDataFrame([('{"id": 1}',), ("not json",), ('{"id": 2, "datePublication": "soon", "documents": [{"path": ""}, {"path": "/a", "accessible": true}], "societes": null}',)], "value string")
    got = {r.id: r for r in feeds.item_terms(feeds.feed_items(rows)).collect()}
    assert set(got) == {1, 2} and got[1].target_name is None and got[2].announcement_date is None and got[2].pdf_path == "/a"


def test_label_file_and_sinks(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id_cluster,juridiction,target_name,label_y,label_source,label_notes\n1_2,FR,Alpha,1,manual,\n")
    labels = feeds.label_file(spark, f"file://{tmp_path}/l.csv")
    assert labels.first().id_cluster == "1_2"
    (tmp_path / "two.csv").write_text("id_cluster,juridiction,target_name,label_y,label_source,label_notes\n" + "".join(f"7,FR,\"Alpha \"\"A\"\", SA\",{y},s{k},\n" for k, y in enumerate(["1", "0", "?"])))
    deals = spark.createDataFrame([(7, None)], "id long, completion_label int")
    two = feeds.label_file(spark, f"file://{tmp_path}/two.csv")
    last = ingest.apply_labels(deals, two, "2026-01-31")[0].first()
    assert two.first().target_name == 'Alpha "A", SA' and (last.completion_label, last.label_source) == (0, "s1")
    sinks.write_audit(labels, f"file://{tmp_path}/out", ["label_y", "id_cluster"])
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).columns == ["label_y", "id_cluster"]
    sinks.append_scores(labels, f"file://{tmp_path}/scores")
    sinks.append_scores(labels, f"file://{tmp_path}/scores")
    assert spark.read.parquet(f"file://{tmp_path}/scores").count() == 2
    sinks.write_summary(labels, f"file://{tmp_path}/sum")
    assert spark.read.json(f"file://{tmp_path}/sum").first().label_y == "1"


def test_filing_records(spark):
    df = spark.createDataFrame([("OPA visant les actions de Alpha SA.", "Initiateur : Beta\nParis, le 3 mars 2024. s'engage à acquérir au prix de 12,50 €"), ("rien", None)], "title string, text string")
    got = df.select(filings.fr_filing(F.col("title"), F.col("text")).alias("r")).select("r", filings.has_minimum(F.col("r"), "FR").alias("m")).collect()
    assert got[0].m and got[0].r.target_name == "Alpha SA" and got[0].r.acquirer_name == "Beta" and float(got[0].r.offer_price) == 12.5 and str(got[0].r.announcement_date) == "2024-03-03"
    assert not got[1].m and got[1].r.offer_price is None
    de = spark.createDataFrame([("Bieterin: Gamma AG\nZielgesellschaft: Delta SE\nPflichtangebot. Angebotspreis: EUR 6,80 je Aktie",), (None,)], "text string")
    rows = de.select(filings.de_filing(F.col("text")).alias("r")).select("r", filings.has_minimum(F.col("r"), "DE").alias("m")).collect()
    assert rows[0].m and rows[0].r.offer_type == "Pflichtangebot" and rows[0].r.acquirer_name == "Gamma AG" and not rows[1].m
    it = spark.createDataFrame([("Comunicazione n. 01/2024 del 5 marzo 2024. Offerente: Epsilon",), ("",)], "text string")
    rows = it.select(filings.it_filing(F.col("text")).alias("r")).select("r", filings.has_minimum(F.col("r"), "IT").alias("m")).collect()
    assert rows[0].m and rows[0].r.visa == "Comunicazione n. 01/2024" and not rows[1].m


def test_exact_ratio(spark):
    df = spark.createDataFrame([("alpha beta", "alpha bet"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(pricing.exact_identity_ratio()(F.col("a"), F.col("b"))).collect()]
    assert got[0] > 0.9 and got[1] == 0.0
