"""Accuracy of predicted tags: counts, breakdowns and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import opened, sums_before


def right(gold: Column, found: Column) -> Column:
    """Equal tags; two proper-noun tags count as equal whatever else they say."""
    return (gold == found) | (gold.startswith("Np") & found.startswith("Np"))


def accuracy(rows: DataFrame) -> DataFrame:
    """One row of counts over ``gold, found, n_entries`` (dictionary entries of the word), and their percentages."""
    good, unknown = right(F.col("gold"), F.col("found")), F.col("n_entries") == 0
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_entries") == 1).alias("unambiguous"), F.count_if(unknown).alias("guesses"),
        F.count_if(good).alias("correct"), F.count_if(good & unknown).alias("correct_guesses"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b))
    return counts.withColumn("percent", share("correct", "total")).withColumn("percent_guesses", share("correct_guesses", "guesses"))


def failures_by(rows: DataFrame, column: str) -> DataFrame:
    """``column, total, failed``."""
    failed = ~right(F.col("gold"), F.col("found"))
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"))


def failures_in(sentences: DataFrame, words: str = "words") -> DataFrame:
    """``doc_id, sid, tid, char_start`` and the word's fields, as ``failures`` gives them, from sentences whose ``words`` are an array of ``form, gold, found``: no shuffle."""
    placed = sentences.select("doc_id", "sid", words, sums_before(F.transform(words, lambda w: F.length(w["form"]) + 1)).alias("starts"))
    both = F.arrays_zip(F.col(words).alias("w"), F.col("starts").alias("char_start"))
    rows = opened(placed, ("doc_id", "sid"), both, "r", at="tid").select("doc_id", "sid", "tid", "r.w.*", "r.char_start")
    return rows.where(~right(F.col("gold"), F.col("found")))


def failures(rows: DataFrame, order: str = "tid") -> DataFrame:
    """Failed rows with the place of their word in the line: words before it, one blank after each."""
    before = Window.partitionBy("doc_id", "sid").orderBy(order)
    at = F.sum(F.length("form") + 1).over(before) - F.length("form") - 1
    return rows.withColumn("char_start", at).where(~right(F.col("gold"), F.col("found")))
