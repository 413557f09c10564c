"""Landed regulator feeds, listing pages and filing texts as tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidframe.functions.filings import de_deal_type, it_deal_type, make_day, operation_type
from bidframe.functions.names import clean_isin, filing_key, offer_key, rss_key, trim_company_name, trim_offer_name

FEED_ITEM = (
    "struct<id:bigint,numero:string,domaine:string,dateInformation:string,datePublication:string,typesInformation:array<string>,typesDocument:array<string>,typesOperation:array<string>,"
    "societes:array<struct<jeton:string,raisonSociale:string,role:string>>,documents:array<struct<nomFichier:string,path:string,accessible:boolean>>>"
)


def feed_items(raw: DataFrame, col: str = "value") -> DataFrame:
    """Items of landed JSON, one text per item. Missing keys are null or empty; documents without a path go; names are trimmed; bad timestamps are null. A text that isn't JSON has only nulls and goes."""
    item = F.from_json(F.col(col), T._parse_datatype_string(FEED_ITEM))
    rows = raw.select(item.alias("i")).filter("i.id IS NOT NULL OR i.numero IS NOT NULL")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    named = F.transform("i.societes", lambda s: F.struct(F.trim(s["raisonSociale"]).alias("name"), s["role"].alias("role")))
    return rows.select(
        F.coalesce("i.id", F.lit(0)).alias("id"), F.trim("i.numero").alias("numero"), F.nullif("i.domaine", F.lit("")).alias("domaine"), empty(F.col("i.typesOperation")).alias("operations"),
        F.try_to_timestamp("i.dateInformation").alias("informed_at"), F.try_to_timestamp("i.datePublication").alias("published_at"), named.alias("companies"),
        F.filter("i.documents", lambda d: F.coalesce(d["path"], F.lit("")) != "").alias("documents"),
    )


def item_terms(items: DataFrame) -> DataFrame:
    """What the items say of a deal: target, acquirer, type, date and first accessible document."""

    def company(role: str) -> Column:
        return F.try_element_at(F.filter("companies", lambda c: c["role"] == role), F.lit(1))["name"]

    operation = F.try_element_at("operations", F.lit(1))
    document = F.try_element_at(F.filter("documents", lambda d: F.coalesce(d["accessible"], F.lit(False))), F.lit(1))["path"]
    return items.select(
        "id", "numero", F.coalesce(company("SocieteVisee"), company("SocieteConcernee")).alias("target_name"), company("Initiateur").alias("acquirer_name"), operation.alias("operation"),
        operation_type(operation).alias("deal_type"), F.to_date(F.coalesce("informed_at", "published_at")).alias("announcement_date"), document.alias("pdf_path"),
    )


def page_slice(items: DataFrame, order: list, page_size: int, max_items: int) -> DataFrame:
    """The first ``max_items`` in the feed's order, with the page each is on."""
    from pyspark.sql import Window as W

    top = items.orderBy(*order).limit(max_items)
    return top.withColumn("page", F.floor((F.row_number().over(W.orderBy(*order)) - 1) / page_size).cast("int"))


def _inner(html: Column) -> Column:
    """Text of an HTML fragment: tags to spaces, white space collapsed, the commonest entities decoded."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _group(text: Column, pattern: str, k: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def de_listing(pages: DataFrame, base: str = "https://www.bafin.de") -> DataFrame:
    """Rows of five cells in a listing's table. The header, rows without a link and rows with a bad date go."""
    rows = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<tr[ >].*?</tr>"), F.lit(0))).alias("pos", "tr"))
    cells = rows.withColumn("td", F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))).filter(F.size("td") == 5)
    href = _group(F.col("td")[3], r'(?is)<a[^>]*\shref="([^"]*)"')
    narrative = _inner(_group(F.col("td")[3], r"(?is)<a[^>]*>(.*?)</a>"))
    d = lambda k: _group(F.col("td")[4], r"(\d{2})\.(\d{2})\.(\d{4})", k)
    got = cells.select(
        "url", "pos", trim_company_name(_inner(F.col("td")[0])).alias("bidder_name"), trim_company_name(_inner(F.col("td")[1])).alias("target_name"), clean_isin(_inner(F.col("td")[2])).alias("target_isin"),
        narrative.alias("narrative"), de_deal_type(narrative).alias("deal_type"), F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base + "/"), F.ltrim(href, F.lit("/")))).alias("document_page"),
        make_day(d(3), d(2), d(1)).alias("published"), narrative.rlike("(?iu)änderung").alias("is_amendment"),
    ).filter("published IS NOT NULL AND document_page IS NOT NULL")
    return got.withColumn("regulator_ref", filing_key(F.col("target_isin"), F.col("published"), F.col("document_page")))


def it_listing(pages: DataFrame) -> DataFrame:
    """Items of a listing: period, bidder (first strong) and target (second), type, offer document and other links. Items without a usable key go."""
    rows = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<li[ >].*?</li>"), F.lit(0))).alias("pos", "li"))
    period, detail = _group(F.col("li"), r'(?is)<div class="div20">(.*?)</div>'), _group(F.col("li"), r'(?is)<div class="div80">(.*)</div>')
    rows = rows.select("url", "pos", period.alias("period"), detail.alias("detail")).filter("detail IS NOT NULL")
    strong = F.regexp_extract_all("detail", F.lit(r"(?is)<strong[^>]*>(.*?)</strong>"), F.lit(1))
    story = _inner(F.array_join(F.regexp_extract_all("detail", F.lit(r"(?is)<p[ >].*?</p>"), F.lit(0)), " "))
    days = F.filter(F.transform(F.regexp_extract_all("period", F.lit(r"\d{2}/\d{2}/\d{4}"), F.lit(0)), lambda x: F.try_to_date(x, "dd/MM/yyyy")), lambda x: x.isNotNull())
    anchors = F.regexp_extract_all(_group(F.col("detail"), r'(?is)<span class="pdf">(.*?)</span>'), F.lit(r'(?is)<a[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    links = F.transform(anchors, lambda a: F.struct(_inner(a).alias("text"), F.regexp_extract(a, r'href="([^"]*)"', 1).alias("href")))
    is_offer = lambda x: F.contains(F.lower(x["text"]), F.lit("documento d'offerta"))
    got = rows.select(
        "url", "pos", F.try_element_at(days, F.lit(1)).alias("period_start"), F.try_element_at(days, F.lit(2)).alias("period_end"), story.alias("description"),
        F.coalesce(trim_offer_name(_inner(F.try_element_at(strong, F.lit(1)))), trim_offer_name(_group(story, r"promossa da\s+([A-ZÀ-Ù][^,;.(]{2,80})"))).alias("bidder_name"),
        F.coalesce(trim_offer_name(_inner(F.try_element_at(strong, F.lit(2)))), trim_offer_name(_group(story, r"azioni (?:ordinarie )?(?:di|della)\s+([A-ZÀ-Ù][^,;.(]{2,80})"))).alias("target_name"),
        it_deal_type(story).alias("deal_type"), F.try_element_at(F.filter(links, is_offer), F.lit(1))["href"].alias("document_url"), F.filter(links, lambda x: ~is_offer(x)).alias("other_links"),
    )
    return got.withColumn("regulator_ref", offer_key(F.col("document_url"), F.col("target_name"), F.col("bidder_name"), F.col("period_start"))).filter("regulator_ref IS NOT NULL")


def recent(rows: DataFrame, day: str, since: date, keep_undated: bool = False) -> DataFrame:
    test = F.col(day) >= F.lit(since)
    return rows.filter(test | F.col(day).isNull() if keep_undated else test)


#: What makes a news item one about a bid.
BID_WORDS = r"(?i)(offre publique|garantie de cours|note d'information|OPA|OPE|OPRA|OPR)"


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files that speak of a bid."""
    schema = "title string, link string, description string, pubDate string, updated string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return bid_news(rows.select(F.trim("title").alias("title"), F.trim("link").alias("link"), F.trim("description").alias("summary"), F.coalesce("pubDate", "updated").alias("published")))


def bid_news(items: DataFrame) -> DataFrame:
    """Items whose title or summary has a bid word, with the reference they name and their time."""
    bare = F.regexp_replace("published", "^[A-Za-z]{3}, ", "")
    stamp = F.coalesce(*[F.try_to_timestamp(bare, F.lit(f"d MMM yyyy HH:mm:ss {zone}")) for zone in ("Z", "z")], F.try_to_timestamp("published"))
    rows = items.filter(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))).rlike(BID_WORDS))
    return rows.withColumn("published_at", stamp).withColumn("regulator_ref", rss_key(F.col("title"), F.col("link"), F.col("summary")))


def filing_text(pages: DataFrame, max_pages: int = 5, key: tuple[str, ...] = ("jurisdiction", "regulator_ref")) -> DataFrame:
    """The first pages of each filing as one text, joined by line feeds."""
    first = pages.filter(F.col("page_no") < max_pages).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return first.select(*key, F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def document_links(pages: DataFrame, pattern: str = r"/(\d{4})/([A-Za-z0-9-]+)/([0-9a-f]{8,})[^\"]*\.pdf") -> DataFrame:
    """Year, reference and hash in a page's first document address."""
    rows = pages.select("url", *[_group(F.col("html"), pattern, k).alias(n) for k, n in enumerate(("year", "reference", "hash"), 1)])
    return rows.filter("year IS NOT NULL")


def label_file(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a label file, numbered in their order, which ``apply_labels`` needs; several files have no order among each other."""
    lines = spark.read.schema("id_cluster string, juridiction string, target_name string, label_y string, label_source string, label_notes string").csv(path, header=True, escape='"')
    return lines.withColumn("line", F.monotonically_increasing_id())
