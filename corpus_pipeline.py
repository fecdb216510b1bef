"""From documents to token files: five stages, each a written table that the next one reads."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shardloom.llm import decontaminate, grammar, mixing, simhash, toxicity  # noqa: E402
from shardloom.llm.common import documents, table  # noqa: E402
from shardloom.llm.queries import TOKENIZER  # noqa: E402
from shardloom.session import materialize  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the fitted field doesn't predict as toxic."""
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    # The document in one column, so that no name of its own can clash.
    scored = docs.select(F.struct(*docs.columns).alias("doc"), toxicity.toxicity(spark, model, docs["text"]).alias("found"))
    return scored.where("found.predicted = 0").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the smallest id."""
    return simhash.one_per_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark windows."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate's rounding says."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of each document's ids in the compressed files."""
    return grammar.encoded_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token files", encode),
]

# The field and the fingerprints' hash are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
