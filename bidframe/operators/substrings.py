"""Which texts contain which parts, by an inverted index of short letter sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of an indexed sequence; shorter parts are indexed whole.
GRAM = 3


def grams(text: Column, n: int) -> Column:
    """The distinct sequences of ``n`` characters of a text."""
    if n == 0:
        return F.array(F.lit(""))
    every = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substring(text, k, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """All pairs (text, part) of ``texts(text)`` and ``parts(part)``, each taken once, where the text contains the part, letter case included.

    Texts are indexed by their sequences of three characters. A part asks under the rarest of its own only: a text
    that contains the part has all of them. What meets there is verified. So neither side is held against all of the
    other, and there may be as many parts as texts. Nulls contain nothing and are contained in nothing; an empty part
    is in every text, and parts of one or two characters ask under these.
    """
    texts, parts = (df.select(c).filter(F.col(c).isNotNull()).distinct() for df, c in ((texts, "text"), (parts, "part")))
    size = F.least(F.length("part"), F.lit(GRAM))
    sizes = sorted(r[0] for r in parts.select(size.alias("n")).distinct().collect())  # four numbers at most
    if not sizes:
        return texts.join(parts, F.lit(False)).select("text", "part")
    index = texts.select("text", F.explode(F.concat(*[grams(F.col("text"), n) for n in sizes])).alias("gram"))
    asked = None
    for n in sizes:
        some = parts.filter(size == n).select("part", F.explode(grams(F.col("part"), n)).alias("gram"))
        asked = some if asked is None else asked.unionByName(some)
    held = index.groupBy("gram").agg(F.count("*").alias("held"))
    rarest = asked.join(held, "gram", "left").groupBy("part").agg(F.min_by(F.struct("gram", "held"), F.struct(F.coalesce("held", F.lit(0)), "gram")).alias("rarest"))
    rarest = rarest.filter("rarest.held IS NOT NULL").select("part", F.col("rarest.gram").alias("gram"))  # a sequence that no text has rules its part out
    return index.join(rarest, "gram").filter(F.contains("text", "part")).select("text", "part")
