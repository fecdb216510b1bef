"""Question-answering sets: field rules, answers, class balance, seeded order."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.constants import (
    ABSTAIN_TEXT,
    GROUNDED_SYSTEM,
    PREVIEW_CHARS,
    QA_SYSTEM,
    SEED,
    SUPPORT_CHARS,
    UNANSWERABLE_FRACTION,
)
from shardloom.functions.text import before_last, fixed1, is_filled, strip
from shardloom.operators.ordering import first_by_hash


def messages(system: str, user: Column, assistant: Column) -> Column:
    turns = [("system", F.lit(system)), ("user", user), ("assistant", assistant)]
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns])


def require_qa_fields(rows: DataFrame, answer: str = "correct_answer") -> DataFrame:
    """Question and answer must be there before any stripping; an answer list must not be empty."""
    is_list = dict(rows.dtypes)[answer].startswith("array")
    has_answer = F.size(F.coalesce(answer, F.array().cast("array<string>"))) > 0 if is_list else is_filled(F.col(answer))
    return rows.where(is_filled(F.col("question")) & has_answer)


def require_grounded_fields(rows: DataFrame) -> DataFrame:
    """Context and question are stripped first, then must be there."""
    stripped = rows.withColumn("context", strip(F.col("context"))).withColumn("question", strip(F.col("question")))
    return stripped.where(is_filled(F.col("context")) & is_filled(F.col("question")))


def compose_qa_answer(answer: Column, support: Column) -> Column:
    """The answer, then the support cut to its first characters and back to its last full stop."""
    passage = strip(F.coalesce(support, F.lit("")))
    short = F.concat(answer, F.lit("."))
    explained = F.concat(short, F.lit("\n\n"), before_last(F.left(passage, F.lit(SUPPORT_CHARS)), "."), F.lit("."))
    return F.when(passage == "", short).otherwise(explained)


def join_answers(answers: Column) -> Column:
    return F.array_join(answers, ", ")


def qa_explanatory(rows: DataFrame, keep: list[str]) -> DataFrame:
    kept = require_qa_fields(rows)
    answer = compose_qa_answer(F.col("correct_answer"), F.col("support"))
    return kept.select(*keep, messages(QA_SYSTEM, strip(F.col("question")), answer).alias("messages"))


def qa_terse(rows: DataFrame, keep: list[str]) -> DataFrame:
    kept = require_qa_fields(rows, "answers")
    return kept.select(
        *keep, messages(QA_SYSTEM, strip(F.col("question")), join_answers(F.col("answers"))).alias("messages")
    )


def union_qa(
    spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]], allow_missing: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows of all readable sources, report). A missing source fails unless allowed."""
    frames, report = [], []
    for name, read in sources.items():
        try:
            frames.append(read().withColumn("origin", F.lit(name)))
            report.append((name, True, None))
        except AnalysisException as error:
            if not allow_missing:
                raise
            report.append((name, False, str(error).splitlines()[0]))
    if not frames:
        raise ValueError("no source could be read")
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows, spark.createDataFrame(report, "origin string, available boolean, message string")


def sample_n(rows: DataFrame, n: int, key: list[str], seed: int = SEED) -> DataFrame:
    """The first n rows of a seeded shuffle, without one task ever holding all n."""
    everything = rows.withColumn("__all", F.lit(0))
    quota = lambda counts: counts.withColumn("quota", F.lit(n).cast("bigint"))
    return first_by_hash(everything, seed, key, quota, ["__all"]).drop("__all")


def answerable_or_abstain(rows: DataFrame, answers: str = "answers") -> DataFrame:
    """Adds ``answer`` and ``answerable`` from the first answer text."""
    first = strip(F.get(F.col(answers)["text"], F.lit(0)))
    answerable = F.coalesce(first != "", F.lit(False))
    return rows.withColumn("answerable", answerable).withColumn(
        "answer", F.when(answerable, first).otherwise(ABSTAIN_TEXT)
    )


def grounded_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)


def grounded_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
    kept = answerable_or_abstain(require_grounded_fields(rows))
    prompt = grounded_prompt(F.col("context"), F.col("question"))
    return kept.select(
        *keep, "answerable", messages(GROUNDED_SYSTEM, prompt, F.col("answer")).alias("messages")
    )


def class_quotas(counts: DataFrame, n: int, fraction: float) -> DataFrame:
    """(answerable, n_rows) -> (answerable, quota): unanswerable rows are capped at a fraction of n,
    answerable ones fill the rest."""
    both = Window.partitionBy(F.lit(0))  # two rows
    missing = F.sum(F.when(~F.col("answerable"), F.col("n_rows"))).over(both)
    unanswerable = F.least(F.coalesce(missing, F.lit(0)), F.lit(int(n * fraction)))
    answerable = F.least(F.col("n_rows"), F.lit(n) - unanswerable)
    quota = F.when(F.col("answerable"), answerable).otherwise(unanswerable)
    return counts.select("answerable", quota.cast("bigint").alias("quota"))


def stratified_cap(
    rows: DataFrame, n: int, key: list[str], fraction: float = UNANSWERABLE_FRACTION, seed: int = SEED
) -> DataFrame:
    return first_by_hash(rows, seed, key, lambda counts: class_quotas(counts, n, fraction), ["answerable"])


def union_grounded(
    rows: DataFrame, n: int, key: list[str], fraction: float = UNANSWERABLE_FRACTION, seed: int = SEED
) -> DataFrame:
    """Both capped classes in one seeded order (``pos``)."""
    from shardloom.operators.ordering import seeded_permutation

    return seeded_permutation(stratified_cap(rows, n, key, fraction, seed), seed + 1, key)


def class_share(rows: DataFrame) -> DataFrame:
    """Examples per class and their percentage with one decimal."""
    counts = rows.groupBy("answerable").agg(F.count("*").alias("n_rows"))
    everything = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # two rows
    return counts.withColumn("percent", fixed1(F.col("n_rows") / everything * 100.0))


def preview(ordered: DataFrame, order: str) -> DataFrame:
    """The turns of the first row, cut for display."""
    first = ordered.orderBy(order).limit(1)
    turns = first.select(F.posexplode("messages").alias("turn", "message"))
    return turns.select(
        "turn", F.col("message.role").alias("role"), F.left("message.content", F.lit(PREVIEW_CHARS)).alias("content")
    )
