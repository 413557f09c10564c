"""URL filtering by association rules, with DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidframe.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled urls that rules are mined from, about.
FIT_URLS = 200_000
#: A combination must occur with the bad label in this share of them, and the label must be so many times as frequent
#: behind it as it is overall (a share of all urls can't be a threshold, as it depends on how many are bad).
MIN_SUPPORT = 0.002
MIN_LIFT = 1.5
#: Labelled urls that a rule must rest on, however few there are.
LEAST_ROWS = 20
BAD = "label=bad"

#: The given rules as (verdict, host, path).
GIVEN = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """A url's distinct tokens: labels of the host, directories (digits as 0) and query keys. None is implied by another, as itemsets grow with every token of a common template."""
    host, path = host_of(url), path_of(url)
    low = F.translate(path, UPPER, LOWER)
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    steps = F.transform(F.filter(F.split(low, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.translate(F.substring_index(x, "=", 1), UPPER, LOWER)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(labels, steps, keys)))


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = GIVEN) -> tuple[Column, Column]:
    """The longest given rule that fits, as text, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT, fit_urls: int = FIT_URLS) -> DataFrame:
    """Rules (tokens, confidence, support, lift) from ``labelled(url, bad)``: combinations of tokens that the bad label follows.

    Fitted on about ``fit_urls`` rows, drawn by a hash of the url. Confidence, the share of bad ones among the urls
    that hold a combination, must be ``min_lift`` times the share among all (or 1, if that is more than 1). A rule that another rule's tokens are a part of,
    with a confidence as high, is pruned. Without a bad row there are no rules.
    """
    rows = labelled.filter("bad IS NOT NULL AND url IS NOT NULL").select("url", "bad")
    n = rows.count()
    if n > fit_urls:
        rows = rows.filter(F.pmod(F.xxhash64("url"), F.lit(n)) < fit_urls)
    items = F.when(F.col("bad"), F.array_append(url_tokens(F.col("url")), F.lit(BAD))).otherwise(url_tokens(F.col("url")))
    baskets = rows.select(items.alias("items")).filter("size(items) > 0")
    held, bad = baskets.select(F.count("*"), F.count_if(F.array_contains("items", BAD))).first()
    if not bad:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double, lift double")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, LEAST_ROWS / held)), minConfidence=min(1.0, min_lift * bad / held)).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent")[0] == BAD).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support", "lift")
    rules = materialise(rules, "url-rules")
    # every proper part of a rule is looked up among the rules by one of its tokens
    other = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"), F.col("tokens")[0].alias("token"))
    wide = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    covered = wide.join(other, "token").filter((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("part_confidence") >= F.col("confidence")))
    return rules.join(covered.select("tokens").distinct(), "tokens", "left_anti")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls of ``pages`` that a rule matches, with the best confidence.

    Inverted index: each rule is filed under its rarest token among the rules, and looked up from every token of a
    url; the rule's other tokens are then checked in the row. The index is a written table, so Spark knows its size and
    broadcasts it where that is small; then no token is shuffled.
    """
    filed = rules.withColumn("rule", F.array_join("tokens", "\n")).withColumn("token", F.explode("tokens"))
    rare = filed.groupBy("token").agg(F.count("*").alias("uses"))
    key = filed.join(rare, "token").groupBy("rule").agg(F.min(F.struct("uses", "token"))["token"].alias("token"))
    index = filed.select("rule", "token", "tokens", "confidence").join(key, ["rule", "token"]).select("token", F.col("tokens").alias("wanted"), "confidence")
    index = materialise(index, "url-index")
    urls = pages.select("url").filter("url IS NOT NULL").distinct().withColumn("tokens", url_tokens(F.col("url")))
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("wanted", "tokens")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labelled: DataFrame, given: list[tuple[str, str, str]] = GIVEN, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence and mined_rules of every page.

    The longest given rule that fits decides; else the page is blocked if a mined rule matches its url, with that
    rule's confidence, and allowed if none does. mined_rules says how many rules were mined. A url that is null or has
    no ``://`` has an empty host and path and no tokens, so it's allowed; such pages take no part in the join.
    Repeated rows are judged alike, and repeated labels of a url each count; empty tables give an empty result, or no
    mined rules. Other columns aren't looked at.
    """
    rules = mine_rules(labelled, min_support, min_lift)
    rules = materialise(rules, "pruned-url-rules")
    n = rules.count()
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    named = F.coalesce(F.col("host") != "", F.lit(False))
    judged = rows.filter(named).join(match_rules(pages, rules), "url", "left") if n else rows.filter(named).withColumn("confidence", F.lit(None).cast("double"))
    judged = judged.unionByName(rows.filter(~named).withColumn("confidence", F.lit(None).cast("double")))
    rule, verdict = given_rule(F.col("host"), F.col("path"), given)
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "confidence", F.lit(n).cast("long").alias("mined_rules"))
