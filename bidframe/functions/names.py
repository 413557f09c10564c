"""Names of companies: classes, cleaning, keys, identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PEND = "[pending parse]"

#: Words that place an acquirer in a class or mark a risk.
PE_WORDS = ["bidco", "bid co", "holding", "holdings", "capital", "partners", "investment", "investments", "sarl", "s.à r.l", "luxembourg", "lux", "private equity", "kkr", "cinven", "cvc", "ardian", "warburg", "advent", "ep global", "ephios"]
SOE_WORDS = ["adnoc", "edf", "engie", "orano", "areva", "saudi", "qatar"]
CORPORATE_ENDS = [" ag", " se", " spa", " s.p.a", " sa", " s.a.", " nv", " n.v", " plc", " ltd", " gmbh", " inc"]
FOREIGN_WORDS = ["italien", "italy", "italia", "luxembourg", "lux ", "s.à r.l", "sarl", "germany", "uk ", "usa", "canada", "japan", "china", "saudi", "switzerland", "swiss", "abu dhabi", "qatar", "states", "international"]
FDI_WORDS = ["adnoc", "china", "chinese", "jd.com", "jingdong", "saudi", "qatar", "abu dhabi", "uae", "uzbek", "huawei", "alibaba"]
GROUP_WORDS = ["group", "company", "co.", "corp"]

#: Legal forms cut from the end of a name.
LEGAL_FORMS = ["AKTIENGESELLSCHAFT", "SPA", "S P A", "SE", "AG", "SA", "S A", "NV", "N V", "PLC", "ASA", "AB", "OYJ", "BV", "B V", "SAS", "SCA", "SIIQ", "SIM"]


def any_of(col: Column, words: list[str]) -> Column:
    """True if the text contains one of the words; one search, so the text is made once."""
    return col.rlike("|".join(map(re.escape, words)))


def acquirer_class(name: Column) -> Column:
    """soe, pe, corporate, family (up to 3 words, none of a group) or unknown; the first that fits."""
    low = F.lower(name)
    corporate = low.rlike(rf"(?:{'|'.join(map(re.escape, CORPORATE_ENDS))})(?: |\z)")
    words = F.size(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""))
    return F.when(any_of(low, SOE_WORDS), "soe").when(any_of(low, PE_WORDS), "pe").when(corporate, "corporate").when(words.between(1, 3) & ~any_of(low, GROUP_WORDS), "family").otherwise("unknown")


def is_cross_border(target: Column, acquirer: Column) -> Column:
    """Some foreign word is in the acquirer's name and not in the target's."""
    t, a = F.lower(target), F.lower(acquirer)
    foreign = F.exists(F.array(*[F.lit(w) for w in FOREIGN_WORDS]), lambda w: F.contains(a, w) & ~F.contains(t, w))
    return F.when(~any_of(a, FOREIGN_WORDS), False).otherwise(foreign)  # few names have such a word


def is_fdi_risk(acquirer: Column) -> Column:
    return any_of(F.lower(acquirer), FDI_WORDS)


def payment_type(deal_type: Column) -> Column:
    return F.when(deal_type.isin("ope", "opas"), "stock").otherwise("cash")


def normalise_name(name: Column) -> Column:
    """Upper case, only letters, digits and single spaces, legal forms cut from the end again and again."""
    s = F.trim(F.regexp_replace(F.upper(F.regexp_replace(name, "[^A-Za-z0-9 ]", " ")), r"\s+", " "))
    return F.regexp_replace(s, f"(?: (?:{'|'.join(LEGAL_FORMS)}))+$", "")


#: Marks and words with which the narrative begins after a name.
DE_NARRATIVE = r"(?isU)\s*(?:,|\(|\bz\.\s*Hd\.\b|\bvertreten\b|\bhandelnd\b).*$"
IT_NARRATIVE = r"(?isU)\s*(?:,|\.|;|:|\(|\bai sensi\b|\bavente\b|\brappresentative\b|\bad un\b|\bal prezzo\b).*$"


def trim_company_name(name: Column, most: int = 120) -> Column:
    """One-spaced, cut where the narrative begins, at most 120 characters."""
    s = F.regexp_replace(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), "[.,;: ]+$", "")
    head = F.regexp_replace(F.regexp_replace(s, DE_NARRATIVE, ""), "[.,;: ]+$", "")
    return F.when(F.length(head) > most, F.rtrim(F.substring(head, 1, most))).otherwise(head)


def trim_offer_name(name: Column, most: int = 120) -> Column:
    """As ``trim_company_name``, for Italian listings: cut at the first mark or word of the narrative."""
    s = F.regexp_replace(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), "[.,;:]+$", "")
    head = F.regexp_replace(F.regexp_replace(s, IT_NARRATIVE, ""), "[.,;:]+$", "")
    return F.when(F.length(head) > most, F.rtrim(F.substring(head, 1, most))).otherwise(head)


#: Words that don't tell companies apart.
STOP_WORDS = ["sa", "se", "spa", "ag", "nv", "plc", "ltd", "gmbh", "kgaa", "scs", "sca", "srl", "sas", "inc", "co", "the", "group", "groupe", "holding", "holdings", "company", "nom", "act", "regroupement", "et", "de", "du", "des", "la", "le"]


def safe_name(name: Column, width: int = 255) -> Column:
    """The name cut to a column's width, or the marker of an unknown one."""
    return F.coalesce(F.substring(F.nullif(F.trim(name), F.lit("")), 1, width), F.lit(PEND))


def slug(text: Column, most: int = 48) -> Column:
    """Lower-case letters and digits with single dashes between."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def name_tokens(name: Column, stop: list[str]) -> Column:
    """Distinct lower-case words without stop words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_except(words, F.array(*[F.lit(s) for s in stop]))


ISIN = "[A-Z]{2}[A-Z0-9]{9}[0-9]"


def is_isin(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^{ISIN}$"), F.lit(False))


def first_isin(*texts: Column) -> Column:
    """The first ISIN found in the texts, in their order."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, rf"\b({ISIN})\b", 1), F.lit("")) for t in texts])


def clean_isin(text: Column) -> Column:
    """Inner white space dropped, upper case; null if that is no ISIN."""
    s = F.upper(F.regexp_replace(text, r"(?U)\s+", ""))
    return F.when(is_isin(s), s)


def isin_of_key(ref: Column) -> Column:
    """The ISIN in a ``BAFIN-<ISIN>-<date>`` key."""
    part = F.try_element_at(F.split(ref, "-"), F.lit(2))
    return F.when(ref.startswith("BAFIN-") & is_isin(part), part)


def filing_key(isin: Column, day: Column, url: Column) -> Column:
    """``BAFIN-{ISIN, or the page's slug}-{yyyymmdd}``."""
    page = F.lower(F.nullif(F.regexp_extract(url, r"/([a-zA-Z0-9_\-]+)\.html", 1), F.lit("")))
    return F.concat_ws("-", F.lit("BAFIN"), F.coalesce(isin, page, F.lit("unknown")), F.date_format(day, "yyyyMMdd"))


def offer_key(pdf_url: Column, target: Column, bidder: Column, day: Column) -> Column:
    """``CONSOB-{name of the document}``, else of target, bidder and date; null if all are missing."""
    doc = F.nullif(F.regexp_extract(pdf_url, r"/([^/?#]+)\.pdf", 1), F.lit(""))
    parts = F.concat_ws("-", slug(F.nullif(target, F.lit(""))), slug(F.nullif(bidder, F.lit(""))), F.date_format(day, "yyyyMMdd"))
    return F.concat(F.lit("CONSOB-"), F.coalesce(doc, F.nullif(parts, F.lit(""))))


def rss_key(*texts: Column) -> Column:
    """The first ``AMF-YYYY-X-NNNN`` in title, link and summary."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, r"\bAMF-\d{4}-[A-Z]-\d{3,5}\b", 0), F.lit("")) for t in texts])


#: Venue codes, their ticker suffixes, and the order in which a country's venues are preferred.
VENUE_SUFFIX = {"FP": ".PA", "XS": ".PA", "XH": ".PA", "EO": ".PA", "IM": ".MI", "GR": ".DE", "GY": ".DE", "NA": ".AS", "BB": ".BR", "SM": ".MC", "LN": ".L"}
HOME_VENUES = {"FR": ["FP", "XS", "XH", "EO"], "IT": ["IM"], "DE": ["GR", "GY"], "NL": ["NA"], "BE": ["BB"], "ES": ["SM"], "GB": ["LN"]}
GROWTH_VENUES = ["XS", "XH", "EO"]


def lookup(mapping: dict, key: Column) -> Column:
    """A small fixed map's value, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def venue_ticker(ticker: Column, venue: Column) -> Column:
    """Ticker without a trailing currency code (two characters must be left), with the venue's suffix; null for an unknown venue."""
    return F.concat(F.regexp_replace(ticker, "(?<=..)(EUR|USD|GBP|CHF)$", ""), lookup(VENUE_SUFFIX, venue))


def broker_symbol(ticker: Column) -> Column:
    """What stands before the last dot."""
    return F.regexp_replace(ticker, r"\.[^.]*$", "")


def registry_match(names: DataFrame, registry: DataFrame, name: str = "acquirer_name") -> DataFrame:
    """Join each distinct name to the first entry (by ``pos``) of a hand-made registry(part, pos, ticker, isin) whose part it contains, letter case aside."""
    from bidframe.operators.substrings import contained

    low = names.select(F.lower(name).alias("text")).distinct()
    entries = registry.select(F.lower("part").alias("part"), "pos", "ticker", "isin")
    best = contained(low, entries).join(entries, "part").groupBy("text").agg(F.min_by(F.struct("ticker", "isin", "part"), "pos").alias("x"))
    best = best.select("text", F.col("x.ticker").alias("acquirer_ticker"), F.col("x.isin").alias("acquirer_isin"))
    return names.withColumn("_low", F.lower(name)).join(best.withColumnRenamed("text", "_low"), "_low", "left").drop("_low")
