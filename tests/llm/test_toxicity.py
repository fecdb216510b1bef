"""The field against exhaustive sums, and held-out accuracy."""

import itertools
import pickle
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import toxicity as T
from shardloom.llm.common import documents, table
from shardloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _t int"


def brute(emission, moves):
    """Marginals and expected transitions by summing over every labelling."""
    n = len(emission)
    total, p, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for state in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(e * s for e, s in zip(emission, state)) + sum(moves[a, b] for a, b in zip(state, state[1:])))
        total += w
        p += w * np.array(state)
        for a, b in zip(state, state[1:]):
            pairs[a, b] += w
    return p / total, pairs / total


def test_marginals_equal_exhaustive_sums():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 1, 6, 6, 2])
    emission, moves = rng.normal(size=lengths.sum()) * 2, rng.normal(size=(2, 2))
    p, pairs = T.Chains(lengths).marginals(emission, moves, pairs=True)
    wanted, wanted_pairs = [], np.zeros((2, 2))
    for chunk in np.split(emission, np.cumsum(lengths)[:-1]):
        q, c = brute(chunk, moves)
        wanted.append(q)
        wanted_pairs += c
    assert np.allclose(p, np.concatenate(wanted))
    assert np.allclose(pairs, wanted_pairs)


def test_shared_passages_are_no_evidence():
    copies = [{"alpha", "beta", f"x{i}"} for i in range(30)]  # one passage in many toxic documents
    others = [{"vile", f"a{i}", f"b{i}"} for i in range(12)]
    clean = [{f"c{i}", f"d{i}", "beta"} for i in range(200)]
    toxic = np.array([True] * 42 + [False] * 200)
    assert "vile" in T.label_words(copies + others + clean, toxic, 1.0)
    assert "beta" not in T.label_words(copies + others + clean, toxic, 1.0)


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.01"
    return T.fit(spark, documents(spark, sf), table(spark, sf, "labels"))


def test_planted_words_are_found_at_their_offsets(spark, model):
    toxic = "Thon the pathetic moron was ofthe, and trash"
    rows = spark.createDataFrame(
        [(1, toxic, "en", "s", 1, "x", 5), (None, None, None, None, None, None, None), (2, "", "en", "s", 0, "x", 5), (2, "", "en", "s", 0, "x", 5),
         (3, "Thon the was ofthe " * 20000, "en", "s", 1, "x", 5), (4, " \n\t ", "en", "s", 1, "x", 5)], SCHEMA)
    got = T.score_documents(rows, model).collect()
    assert len(got) == 6
    by = {r["doc_id"]: r for r in got}
    assert by[1]["predicted"] == 1
    assert [toxic[s["start"] : s["end"]] for s in by[1]["spans"]] == ["pathetic moron", "trash"]
    for key in (None, 2, 3, 4):
        assert by[key]["predicted"] == 0 and 0 <= by[key]["score"] <= 1 and by[key]["spans"] == []


def test_empty_tables_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = T.fit(spark, docs, labels)
    assert [r["predicted"] for r in T.score_documents(docs, model).collect()] == [0, 0]
    assert T.score_documents(docs.limit(0), T.fit(spark, docs.limit(0), labels.limit(0))).count() == 0


def test_word_scores_ignore_batches(spark, model):
    field = pickle.loads(model)
    texts = ["one two\nthree scum", None, "", "four " * 50, "scum"]
    whole = T.score_texts(field, texts, {})
    alone = [T.score_texts(field, [t], {}).iloc[0] for t in texts]
    assert [a["score"] for a in alone] == pytest.approx(list(whole["score"]))


def traced(work):
    """Peak MB that some work takes, and what it still holds at its end."""
    tracemalloc.start()
    kept = work()
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return peak / 1e6, held / 1e6, kept


def test_fit_holds_numbers_not_words():
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"word{i}" for i in range(3000)])
    texts = [" ".join(rng.choice(vocabulary, 1000)) + "\nvile scum" * (d % 2) for d in range(200)]
    peak, _, model = traced(lambda: T.fit_field(texts, np.arange(200) % 2 == 1, 1.0))
    assert T.score_texts(model, [texts[0], texts[1]], {})["predicted"].tolist() == [0, 1]
    assert peak < 40  # 200,000 words; 51 with a string for each


def test_words_kept_are_few():
    model = T.fit_field([], np.zeros(0, dtype=bool), 1.0)
    cache = {}
    peak, held, _ = traced(lambda: [T.score_texts(model, [" ".join(f"w{i}" for i in range(a, a + 20_000))], cache)["score"][0] for a in range(0, 400_000, 20_000)])
    assert held < 40 and len(cache) <= T.CACHED_WORDS


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op1_toxicity"](spark, sf).join(table(spark, sf, "labels"), "doc_id")
    right = scored.groupBy("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"))
    assert {r["held_out"]: r["right"] > 0.95 for r in right.collect()} == {True: True, False: True}
