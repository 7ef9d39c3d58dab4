"""Does each line fit its slot? Budgets, reports, rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.functions import text as T

RATE, TOLERANCE = 6.0, 1.10


def budget(slot_ms: Column, rate: float = RATE) -> Column:
    """Syllables a slot holds at a rate, two at least."""
    return F.greatest(F.lit(2), F.floor(slot_ms * rate / 1000).cast("int"))


def analyse(cues: DataFrame, text: str = "source_text", rate: float = RATE, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds slot_ms, syllables, budget, ratio, digits, over, target to cues."""
    out = cues.withColumn("slot_ms", F.col("end_ms") - F.col("start_ms")).withColumn("syllables", T.syllables(F.col(text))).withColumn("budget", budget(F.col("slot_ms"), rate))
    out = out.withColumn("ratio", F.col("syllables") / F.col("budget")).withColumn("digits", T.has_digit(F.col(text))).withColumn("over", F.col("ratio") > tolerance)
    return out.withColumn("target", F.col("over") | F.col("digits"))


def report(fit: DataFrame) -> DataFrame:
    return fit.groupBy("job_id").agg(F.count(F.lit(1)).alias("cues"), F.count_if("over").alias("over_budget"), F.count_if("digits").alias("with_digits"), F.count_if("target").alias("targets"), F.max("ratio").alias("worst_ratio"))


def best_rewrite(original: Column, candidate: Column, limit: Column) -> Column:
    """The text that oversteps the budget less; the candidate wins ties."""
    over = lambda t: F.greatest(F.lit(0), T.syllables(t) - limit)
    return F.when(over(candidate) <= over(original), candidate).otherwise(original)


def adapt_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per job: lines, over budget before and after, rewritten, worst ratios."""
    b = before.groupBy("job_id").agg(F.count(F.lit(1)).alias("lines_considered"), F.count_if("over").alias("lines_over_budget"), F.max("ratio").alias("worst_ratio_before"))
    a = after.groupBy("job_id").agg(F.count_if(F.col("final_text") != F.col("source_text")).alias("lines_rewritten"), F.max("ratio").alias("worst_ratio_after"), F.count_if("over").alias("still_over_budget"))
    return b.join(a, "job_id")
