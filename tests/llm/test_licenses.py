import random
import re

import pytest

from shardloom.llm import licenses
from shardloom.llm.common import documents
from shardloom.llm.queries import QUERIES, SQL
from tests.compare import connect, difference


def found_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(licenses.GAPS, low) if w]


def brute_blocks(text, templates, threshold):
    """(first word, template, containment) of every block that holds a template."""
    ws, out = found_words(text), set()
    sets = [set(found_words(t)) for _, t in templates]
    for start in range(0, max(len(ws) - (licenses.BLOCK - licenses.STRIDE), 0) + 1, licenses.STRIDE):
        block = set(ws[start : start + licenses.BLOCK])
        share = {t: len(s & block) / len(s) for t, s in enumerate(sets)}
        good = {t for t, c in share.items() if c >= threshold - 1e-12}
        out |= {(start, t, share[t]) for t in good if not any(sets[t] < sets[o] for o in good)}
    return out


def brute(text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    ws = found_words(text)
    base = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    blocks = brute_blocks(text, templates, threshold)
    names, at = {label for _, label in base}, [i for i, _ in base]
    score = 1.0 if base else max((c for *_, c in blocks), default=0.0)
    every = sorted(names | {templates[t][0] for _, t, _ in blocks})
    return len(ws), len(at), min(at, default=None), max(at, default=None), sorted(names), every, score


def corpus():
    random.seed(3)
    common = ["the", "of", "software", "license", "under", "to", "and", "this", "work", "is"] + [f"w{i}" for i in range(40)]
    prose = lambda n: " ".join(random.choices(common, k=n))
    texts = [None, "", "  \n", "MIT", "mit license", "The MIT-License; Apache License. GNU General Public License!", "License " * 300]
    for label, text in licenses.TEMPLATES:
        own = text.split()
        for drop in (0, 1, 2, 5):
            left = [w for i, w in enumerate(own) if i not in random.sample(range(len(own)), min(drop, len(own) - 1))]
            texts.append(f"{prose(random.randrange(200))}\n{' '.join(left).title()}, {prose(random.randrange(200))}")
    return [*texts, prose(30_000) + " licensed under cc by-nc-sa 4.0 " + prose(5000), "é Licensed under CC BY 4.0. é"]


def test_equals_brute_force(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(corpus())] + [(None, "MIT license", "", ""), (3, "mit license", "", "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, _row string").repartition(5)
    got = licenses.licenses(docs).collect()
    key = lambda r: repr(r)
    assert sorted([tuple(r) for r in got], key=key) == sorted([(d, *brute(t)) for d, t, *_ in rows], key=key)


@pytest.mark.parametrize("threshold", [0.5, 0.7, 1.0])
def test_every_block_is_found(spark, threshold):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.license_blocks(docs, threshold=threshold).collect()
    wanted = {(i, *b) for i, t in enumerate(texts) for b in brute_blocks(t, licenses.TEMPLATES, threshold)}
    assert {(r["doc_id"], r["first_word"], r["template"], r["containment"]) for r in got} == wanted and len(got) == len(wanted)


def test_no_rows_and_no_templates(spark):
    assert licenses.licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="no words"):
        licenses.licenses(spark.createDataFrame([(1, "a")], "doc_id long, text string"), [("x", "--")])


def test_notices(spark, sf_dir):
    docs = spark.createDataFrame(
        [(1, "Licensed under CC BY-NC 4.0."), (2, "Released under the MIT License."), (3, "Licensed under CC BY 4.0")], "doc_id long, text string"
    )
    assert {r["doc_id"]: r["labels"] for r in licenses.licenses(docs).collect()} == {1: ["cc-by-nc"], 2: ["mit"], 3: ["cc-by"]}


def test_query(spark, sf_dir):
    got = QUERIES["op12_licenses"](spark, sf_dir)
    assert difference(got, SQL["op12_licenses"], connect(sf_dir)) is None
    plain = lambda r: (r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])
    want = [(r["doc_id"], *brute(r["text"])) for r in documents(spark, sf_dir).collect()]
    want = [(*w[:5], ",".join(w[5]), ",".join(w[6]), w[7]) for w in want]
    assert sorted(map(plain, got.collect()), key=repr) == sorted(want, key=repr)
