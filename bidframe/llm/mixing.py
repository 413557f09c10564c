"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from bidframe.llm.common import materialise, unit_hash

#: Ranks of a stratum are counted in this many bins; only the bin that holds the cut is put in order.
BINS = 512


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Target size of every source of ``sizes(source, source_size)``.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at
    ``most`` times its source's size and the excess is shared by weight among the rest. With the sources in the order
    of size per weight, the stopped ones come first, so one running sum finds the share of one weight.
    """
    n = len(weights)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("at") - 1) % n + 1).cast("int"))
    ranked = sizes.withColumn("at", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", pick.cast("long"))
    order = W.orderBy(F.col("source_size") / F.col("w"), F.col("at"))
    run = order.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy()
    step = ranked.select(
        "source", "source_size", "w",
        F.sum("source_size").over(run).alias("upto"), F.sum("w").over(run).alias("w_upto"),
        F.sum("source_size").over(whole).alias("total"), F.sum("w").over(whole).alias("w_total"),
    )
    # the share of one weight if this source and all before it are stopped, or only those before it
    here = (F.col("total") - F.lit(most) * (F.col("upto") - F.col("source_size"))).cast("double") / (F.col("w_total") - F.col("w_upto") + F.col("w"))
    step = step.withColumn("share", here).withColumn("free", F.col("share") * F.col("w") <= F.lit(most) * F.col("source_size"))
    level = F.min(F.when(F.col("free"), F.struct("w_upto", "share"))).over(whole)["share"]
    target = F.least((F.lit(most) * F.col("source_size")).cast("double"), level * F.col("w"))
    return step.select("source", "source_size", F.coalesce(target, (F.lit(most) * F.col("source_size")).cast("double")).alias("target"))


def size_class(size: Column) -> Column:
    """Sizes of one class differ by a quarter at most: four classes to each doubling. 0 for the size 0."""
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(size)) - 1)
    return F.when(size > 0, 4 * F.length(F.bin(size)) + (F.floor(size * 4 / low) - 4).cast("int")).otherwise(0)


def sampling_plan(strata: DataFrame, fraction: DataFrame) -> DataFrame:
    """How many documents of every stratum are sampled: source, class, n, held, mean, f (= n / held).

    ``strata`` has source, class and the number, sum and sum of squares of sizes; ``fraction`` has source and the share
    p of its words that is still wanted. From the largest class to the smallest, a stratum gets the whole number of
    documents nearest to its share; what rounding leaves over, or takes too much, goes on to the next class. A source
    has fewer than 4 * 64 classes, so the fold over them is bounded.
    """
    row = F.struct((-F.col("class")).alias("down"), F.col("held").cast("double").alias("held"), F.col("words").cast("double").alias("words"), F.col("squares").cast("double").alias("squares"))
    per = strata.filter("class > 0").groupBy("source").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    per = per.join(fraction.select(F.col("source").alias("s"), "p"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    kind = "array<struct<class:int,n:double,held:double,mean:double,f:double>>"

    def step(state: Column, x: Column) -> Column:
        wanted, mean = F.col("p") * x["words"] + state["carry"], x["words"] / x["held"]
        n = F.greatest(F.lit(0.0), F.least(x["held"], F.floor(wanted / mean + 0.5).cast("double")))
        f = n / x["held"]
        expected = f * x["words"] + f * (1 - f) * (x["squares"] / mean - x["words"])
        found = F.struct((-x["down"]).cast("int").alias("class"), n.alias("n"), x["held"].alias("held"), mean.alias("mean"), f.alias("f"))
        return F.struct((wanted - expected).alias("carry"), F.array_append(state["out"], found).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast(kind).alias("out"))
    return per.select("source", F.explode(F.aggregate("rows", start, step, lambda state: state["out"])).alias("x")).select("source", "x.*")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, text: str = "text") -> DataFrame:
    """How often the mix takes every document.

    The size of a document is its number of words. A source whose target is r times its size takes floor(r) whole
    copies of each document for certain. The words still wanted come from a Pareto order sample of fixed size: within
    a source, documents of like size are a stratum, which ``sampling_plan`` gives a number n of its N documents. With
    f = n / N, a document has the inclusion probability p = f + f (1 - f) (size / mean size - 1), so longer ones are
    taken more often and the p of a stratum sum up to n. Documents are ranked by (u / (1 - u)) / (p / (1 - p)), u
    being a number in [0, 1) that doc_id and seed decide, and the n first are taken. Counts of 512 rank bins give
    the bin in which the n-th lies, so that no task sorts a stratum.

    A null text has size 0 and is in no sample. A null source is a source of its own, after the others. Rows that
    repeat a doc_id share its u and are ordered by size. An empty table gives an empty result. Other columns aren't
    looked at. Returns doc_id, size, source, source_size, target, inclusion (p), copies, taken.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col("source").alias("source"), size.alias("size"))
    rows = materialise(rows.withColumn("class", size_class(F.col("size"))), "mix-sizes")
    big = F.col("size").cast("decimal(19,0)")
    strata = materialise(rows.groupBy("source", "class").agg(F.count("*").alias("held"), F.sum("size").alias("words"), F.sum((big * big).cast("decimal(38,0)")).alias("squares")), "mix-strata")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    targets = materialise(targets.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.col("whole")), "mix-targets")
    # one row per stratum: as a written table its size is known, so Spark broadcasts it if it is small
    sample = sampling_plan(strata, targets)
    plan = strata.select(F.col("source").alias("s"), F.col("class").alias("c")).join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    plan = plan.join(sample, F.col("s").eqNullSafe(F.col("source")) & (F.col("c") == F.col("class")), "left").drop("source", "class", "p", "held")
    plan = materialise(plan.na.fill(0.0, ["n", "mean", "f"]), "mix-plan")
    ranked = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")), "left").drop("s", "c")
    f, u = F.col("f"), unit_hash("doc_id", seed=seed)
    p = F.when((f > 0) & (f < 1), f + f * (1 - f) * (F.col("size") / F.col("mean") - 1)).otherwise(f)
    # the rank as a number in [0, 1): x / (1 + x) of the ranking quotient x keeps its order
    x = F.when((f > 0) & (f < 1), u * (1 - F.col("inclusion")) / (u * (1 - F.col("inclusion")) + (1 - u) * F.col("inclusion"))).otherwise(u)
    ranked = ranked.withColumn("inclusion", p).withColumn("rank", x).withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int"))
    stratum = ["source", "class"]
    bins = ranked.filter("n > 0").groupBy(*stratum, "n", "bin").agg(F.count("*").alias("in_bin"))
    bins = bins.withColumn("upto", F.sum("in_bin").over(W.partitionBy(*stratum).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
    # the first bin that reaches the wanted number holds the cut
    cut = bins.filter((F.col("upto") >= F.col("n")) & (F.col("upto") - F.col("in_bin") < F.col("n")))
    cut = materialise(cut.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("bin").alias("cut"), (F.col("n") - F.col("upto") + F.col("in_bin")).alias("more")), "mix-cuts")
    placed = ranked.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")), "left").drop("s", "c")
    inside = placed.filter(F.col("bin") == F.col("cut")).withColumn("place", F.row_number().over(W.partitionBy(*stratum).orderBy("rank", "doc_id", "size")))
    inside = inside.withColumn("extra", F.when(F.col("place") <= F.col("more"), 1).otherwise(0)).drop("place")
    rest = placed.filter(F.col("cut").isNull() | (F.col("bin") != F.col("cut"))).withColumn("extra", F.when(F.col("bin") < F.col("cut"), 1).otherwise(0))
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return inside.unionByName(rest).select(
        "doc_id", "size", "source", "source_size", "target", "inclusion", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )
