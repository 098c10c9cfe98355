"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. Its documents get floor(target / size) certain whole copies each; the rest of the
target is a sample without replacement with unequal probabilities. A document's inclusion probability is proportional to its
words, rest * words / (sum of the source's squared words), so that the words expected in the sample are the rest; a document whose
probability would reach 1 is certain. The sample is a Pareto order sample: documents are ranked by their random
odds divided by their inclusion odds, certain ones first, and the sample is the n of lowest rank, with the n at which
the words taken come nearest to the rest (at most half a document away from it).

The random number of a document is a digest of its id and text, so reruns and retried tasks agree, and a document's
fate depends on one threshold of its source: taking is row-local and no text is moved.

Defined results: null or blank texts have size 0, rank last and take 0 words; null sources are one source, the last; rows alike in
id and text share one random number and are taken or left together; a source without words has target 0; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from transmuta.functions.materialize import Written
from transmuta.llm.tables import word_count

#: Ranks are first summed in this many classes per source, so that no task has to order a whole source.
CLASSES = 65536
LAST = 1e300  # the rank of a document without words


def random_number(seed: str, *parts: Column) -> Column:
    """In (0, 1), from the first 52 bits of a digest."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def source_targets(sized: DataFrame, weights: Sequence[int], share: Fraction, most: int) -> DataFrame:
    """named, src, source_size, squares (sum of squared words), target: weighted shares of share * all words, none above most * its source's words.

    The water level (words per unit of weight) is the first at which every source that reaches its ceiling lies below
    it; sources are ordered by the level at which they reach their ceiling. One row per source.
    """
    totals = sized.groupBy("named", "src").agg(F.sum("size").alias("source_size"),
                                                F.sum(F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")).cast("double").alias("squares"))
    by_name = Window.orderBy(F.desc("named"), "src")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    ranked = totals.withColumn("weight", weight.cast("long")).withColumn("full_at", F.col("source_size") * most / F.col("weight"))
    order = Window.orderBy("full_at", F.desc("named"), "src")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = ranked.withColumn("level", level)
    fits = F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", (~F.col("named")).alias("o"), "src", "level"))
    water = F.min(fits).over(everything)["level"]
    ceiling = (F.col("source_size") * most).cast("double")
    return levels.select("named", "src", "source_size", "squares", F.least(ceiling, F.coalesce(F.col("weight") * water, ceiling)).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole copies, what inclusion odds follow from, and the last class and rank that the sample takes."""
    plan = targets.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)) \
        .withColumn("whole", F.floor("ratio")).withColumn("part", F.col("ratio") - F.col("whole")) \
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("ratio")
    ranked = sized.join(plan.filter("part > 0").select("named", "src", "squares", "rest"), ["named", "src"]) \
        .withColumn("rank", rank("u", "size", "rest", "squares")).withColumn("class", rank_class(F.col("rank")))
    sums = ranked.groupBy("named", "src", "rest", "class").agg(F.sum("size").alias("words"))
    by_class = Window.partitionBy("named", "src").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    cut_class = sums.withColumn("before", F.coalesce(F.sum("words").over(by_class), F.lit(0))) \
        .filter("before <= rest").groupBy("named", "src").agg(F.max(F.struct("class", "before")).alias("at")) \
        .select("named", "src", F.col("at.class").alias("last_class"), "at.before")
    near = ranked.join(cut_class, ["named", "src"]).filter("class = last_class")
    by_rank = Window.partitionBy("named", "src").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    last = near.withColumn("upto", F.col("before") + F.sum("size").over(by_rank)) \
        .groupBy("named", "src", "last_class").agg(F.max(F.when(F.expr("2 * upto - size <= 2 * rest"), F.col("rank"))).alias("last_rank"))
    return plan.join(last, ["named", "src"], "left")


def inclusion(size: Column, rest: Column, squares: Column) -> Column:
    """Probability of being sampled; 1 or more is certain."""
    return F.when(size > 0, rest * size.cast("double") / squares).otherwise(0.0)


def rank(u: str, size: str, rest: str, squares: str) -> Column:
    """Random odds over inclusion odds."""
    p = inclusion(F.col(size), F.col(rest), F.col(squares))
    return F.when(p >= 1, 0.0).when(p <= 0, LAST).otherwise((F.col(u) / (1 - F.col(u))) / (p / (1 - p)))


def rank_class(r: Column) -> Column:
    """The cut lies near rank 1, the middle class, whatever the inclusion probabilities."""
    return F.floor(r / (1 + r) * CLASSES)


def drawn(docs: DataFrame, seed: str) -> DataFrame:
    """row (all columns of docs) and _mix: what the plan needs to know of a document."""
    return docs.select(F.struct("*").alias("row"), F.struct(
        F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("src"), word_count(F.col("text")).alias("size"),
        random_number(seed, F.col("doc_id"), F.col("text")).alias("u")).alias("_mix"))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with _mix) with _plan: source_size, target and copies of each document."""
    p = plan.select(*(F.col(c).alias(f"_p_{c}") for c in plan.columns))
    joined = rows.join(p, (F.col("_mix.named") == F.col("_p_named")) & (F.col("_mix.src") == F.col("_p_src")))
    own = rank("_mix.u", "_mix.size", "_p_rest", "_p_squares")
    group = rank_class(own)
    sampled = (F.col("_p_part") > 0) & ((group < F.col("_p_last_class")) | ((group == F.col("_p_last_class")) & (own <= F.col("_p_last_rank"))))
    copies = (F.col("_p_whole") + F.coalesce(sampled, F.lit(False)).cast("long")).cast("long")
    return joined.withColumn("_plan", F.struct(F.col("_p_source_size").alias("source_size"), F.col("_p_target").alias("target"), copies.alias("copies"))) \
        .drop(*(f"_p_{c}" for c in plan.columns))


def make_plan(drawn_rows: DataFrame, weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """One row per source, from rows with _mix; written once."""
    sized = drawn_rows.select("_mix.*")
    return Written(thresholds(sized, source_targets(sized, weights, share, most)), "mix-plan").df


def mix(docs: DataFrame, seed: str = "pareto", **targets) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (words the mix takes, repeats counted); one row per document."""
    rows = Written(drawn(docs, seed).select(F.col("row.doc_id").alias("doc_id"), "_mix"), "mix-sizes").df
    return with_plan(rows, make_plan(rows, **targets)).select(
        "doc_id", "_mix.size", "_plan.source_size", "_plan.target", "_plan.copies", (F.col("_plan.copies") * F.col("_mix.size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "pareto", **targets) -> DataFrame:
    """The documents the mix takes, each as often as it takes them; columns of docs. Texts are not moved."""
    sizes = Written(drawn(docs, seed).select("_mix"), "mix-sizes")
    plan = make_plan(sizes.df, **targets)
    sizes.drop()
    taken = with_plan(drawn(docs, seed), plan).withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.col("_plan.copies").cast("int"))))
    return taken.select("row.*")
