import re

import pytest
from pyspark.sql import functions as F

from shardloom.llm import mixing
from shardloom.llm.common import documents
from shardloom.llm.queries import QUERIES


def wanted_targets(sizes, weights=(5, 2, 1), percent=150):
    """Shares by weight, cut at twice the size, the excess dealt again until nobody is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values()) * percent / 100
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def check(spark, docs):
    got = mixing.mix(docs).collect()
    sizes, taken, largest = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
    target = wanted_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] + 1, s
    return got


def test_whole_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = check(spark, docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")) for r in got)
    rows = lambda: sorted(map(tuple, QUERIES["op8_mixing"](spark, sf_dir).collect()))
    assert rows() == rows()


def test_odd_rows(spark):
    rows = [(i, "w " * (i % 9), None if i % 4 == 0 else f"s{i % 4}", 3, "x") for i in range(80)]
    rows += [(None, None, None, None, None), (7, "", "only empty", 1, "y"), (8, "a b", "s1", 1, "z"), (8, "a b", "s1", 1, "z"), (9, "w " * 30000, "s2", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, _h string")
    check(spark, docs)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_documents_as_often_as_their_copies(spark, sf_dir):
    docs = documents(spark, sf_dir)
    copies = mixing.mix(docs).where("copies > 0").agg(F.sum("copies")).first()[0]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == copies
