"""Scoring answers against expected strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.constants import ABSTAIN_LABEL, ABSTAIN_MARK
from shardloom.functions.text import strip


def clean_answer(got: Column) -> Column:
    return strip(F.replace(got, F.lit("<|im_end|>"), F.lit("")))


def answer_hit(expected: Column, got: Column) -> Column:
    """Abstaining is a hit when the refusal shows, else the expected text must appear; any case."""
    low = F.lower(clean_answer(got))
    return F.when(expected == ABSTAIN_LABEL, F.contains(low, F.lit(ABSTAIN_MARK))).otherwise(
        F.contains(low, F.lower(expected))
    )


def with_hits(cases: DataFrame) -> DataFrame:
    return cases.withColumn("hit", answer_hit(F.col("expected"), F.col("got")))


def score_by_class(cases: DataFrame) -> DataFrame:
    """Hits and cases per class and in total, in one rollup."""
    classed = with_hits(cases).withColumn(
        "class", F.when(F.col("expected") == ABSTAIN_LABEL, "abstain").otherwise("answerable")
    )
    scores = classed.rollup("class").agg(
        F.grouping("class").alias("is_total"), F.count_if("hit").alias("n_hits"), F.count("*").alias("n_cases")
    )
    label = F.when(F.col("is_total") == 1, "total").otherwise(F.col("class"))
    return scores.select(label.alias("class"), "n_hits", "n_cases")
