import random
import re
from collections import Counter

from shardloom.llm import decontaminate as D
from shardloom.llm.queries import QUERIES, SQL
from tests.compare import connect, difference

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(doc, items, window):
    w, hit, found = words(doc), set(), set()
    for item_id, text in items:
        v = words(text)
        n = min(window, len(v))
        wanted = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wanted:
                hit |= set(range(i, i + n))
                found.add(item_id)
    return len(w), len(hit), sorted(str(i) for i in found)


def test_equals_sql(spark, sf_dir):
    assert difference(QUERIES["op7_decontamination"](spark, sf_dir), SQL["op7_decontamination"], connect(sf_dir)) is None


def test_equals_brute_force(spark):
    items = [(1, "a b c d e f"), (2, "A, b! C"), (2, "x y"), (3, ""), (4, None), (5, "the the the the the"), (6, "x y"), (7, "é É z")]
    docs = [
        (1, "q a b c d q a b c d e f g"), (2, "the the the the the the the"), (2, "x y x y"), (2, "x y x y"), (None, "a B c"),
        (None, None), (4, ""), (5, "É z é É z"), (6, "a-b-c d " * 3000), (7, "no match here"), (8, "a b c x d e f"),
    ]
    rows = [(d, t, "k", 1) for d, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, item string, pos int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(frame, bench, 4).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=key) == sorted(
        [(d, *brute(t, items, 4)) for d, t in docs], key=key
    )
    clean = D.clean_documents(frame, bench, 4)
    assert clean.columns == frame.columns
    assert sorted((r["doc_id"] or 0) for r in clean.collect()) == [0, 4, 7]


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r["n_hit"] for r in D.contamination(docs, bench.limit(0)).collect()] == [0]
    assert D.contamination(docs.limit(0), bench).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    text = QUERIES["op7_decontamination"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "p q gamma x beta y alpha z"), (2, "alpha " + "u " * 40 + "beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string")
    got = {tuple(r) for r in D.near_matches(docs, bench, terms=3, slop=8).collect()}
    assert got == {(1, 9, 2, 7)}


def test_near_matches_equal_a_window_search(spark):
    """The second item has a word that no document has; the third has only two of its three."""
    items = [(1, "alpha beta gamma delta"), (2, "alpha absent beta gamma epsilon"), (3, "alpha beta missing"), (4, "zeta zeta")]
    rng = random.Random(3)
    pool = "alpha beta gamma delta epsilon zeta u v w x y z".split()
    docs = [(i, " ".join(rng.choices(pool, weights=[3, 4, 5, 2, 1, 1, 9, 9, 9, 9, 9, 9], k=40))) for i in range(30)] + [(30, None)]
    terms, slop = 3, 6
    corpus = Counter(w for _, t in docs for w in words(t))
    wanted = {}
    for item_id, text in items:
        distinct = set(words(text))
        ranked = sorted((w for w in distinct if corpus[w]), key=lambda w: corpus[w])
        if len(ranked) >= min(terms, len(distinct)):
            assert len({corpus[w] for w in ranked}) == len(ranked)  # no ties
            wanted[item_id] = set(ranked[:terms])
    assert sorted(wanted) == [1, 2, 4]
    spans = set()
    for doc_id, text in docs:
        w = words(text)
        for item_id, need in wanted.items():
            for stop in range(1, len(w) + 1):
                starts = [s for s in range(max(0, stop - slop), stop) if need <= set(w[s:stop])]
                if starts and w[stop - 1] in need:
                    spans.add((doc_id, item_id, max(starts), stop))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in D.near_matches(frame, bench, terms, slop).collect()} == spans
    assert {i for _, i, _, _ in spans} == {1, 2, 4}
    near = {r["doc_id"]: r["n_near_items"] for r in D.contamination(frame, bench, 4, (terms, slop)).collect()}
    assert near == {d: len({i for e, i, _, _ in spans if e == d}) for d, _ in docs}


def test_equally_rare_terms_are_ranked_by_word(spark):
    """Four terms occur twice each: the three lesser ones count, wherever the fourth stands."""
    far = "u " * 40
    docs = [(1, f"gamma {far} delta beta alpha"), (2, f"delta {far} gamma beta alpha")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(9, "gamma delta beta alpha")], "item_id long, text string")
    assert {tuple(r)[:2] for r in D.near_matches(frame, bench).collect()} == {(1, 9)}


def test_clashing_names_and_ids_of_any_kind(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [("a", text, 1, 2, "x"), ("b", "other words", 3, 4, "y"), (None, text, 5, 6, "z"), ("b", text, 7, 8, "w")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _k1 int, _k2 int, word string")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    kept = D.clean_documents(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [rows[1]]
    found = {(r["doc_id"], r["n_hit"]) for r in D.contamination(docs, items).collect()}
    assert found == {("a", 13), ("b", 0), (None, 13), ("b", 13)}
