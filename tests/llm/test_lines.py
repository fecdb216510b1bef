import random

import pytest

from shardloom.llm import lines as L
from shardloom.llm.common import documents
from shardloom.llm.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    base = ["".join(r.choice("abé") for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 14, 20]))) for _ in range(120)]
    out = set(base)
    for b in base * 2:
        s = list(b)
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(s))
            s[at : at + r.randint(0, 1)] = r.choice(["", "a", "x"])
        out.add("".join(s))
    return sorted(out - {""})


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_every_close_pair_shares_a_key(texts, tau):
    keys = {t: tuple(map(set, L.line_keys(t, tau))) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            close = distance(a, b) <= tau
            assert L.within(a, b, tau) == close
            if close:
                assert keys[a][0] & (keys[b][0] | keys[b][1]) or keys[a][1] & keys[b][0]
                (s, d), (t, e) = L.signature(a), L.signature(b)
                assert ((s ^ t) % (1 << 64)).bit_count() <= 2 * tau
                assert ((d ^ e) % (1 << 64)).bit_count() <= 4 * tau


@pytest.mark.parametrize("group", [2048, 5])
def test_links_equal_brute_force(spark, texts, group):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go on over batches
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, line string").repartition(3)
    got = {tuple(sorted((texts[r["a"]], texts[r["b"]]))) for r in L.links(frame, 2, group).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if distance(a, b) <= 2}


def test_classes_and_deduplicated_texts(spark):
    rows = [
        (4, "first line here\nsecond one\nfirst line hers"), (2, "second onee\n\nalone in the text"), (None, "second one"),
        (7, None), (8, ""), (8, ""), (9, "x" * 60000 + "\n" + "x" * 59999), (1, "second one"), (1, "second one"),
    ]
    docs = spark.createDataFrame([(d, t, 5, 6) for d, t in rows], "doc_id long, text string, line int, id int")
    got = {r["line"][:30]: r for r in L.classes(docs).where("length(line) < 100").collect()}
    assert len(got) == 5
    assert (got["second one"]["copies"], got["second one"]["n_links"], got["second one"]["doc_id"]) == (4, 1, 1)
    assert {(r["class_doc_id"], r["class_line_no"]) for k, r in got.items() if k.startswith("second")} == {(1, 0)}
    assert (got["first line hers"]["class_doc_id"], got["first line hers"]["class_line_no"]) == (4, 0)
    assert got["alone in the text"]["n_links"] == 0
    kept = sorted(((r["doc_id"], r["text"][:20]) for r in L.deduplicated(docs).collect()), key=str)
    assert kept == sorted(
        [(4, "first line here"), (2, "\nalone in the text"), (None, ""), (7, ""), (8, ""), (8, ""), (9, "x" * 20), (1, "second one"), (1, "second one")],
        key=str,
    )
    assert L.classes(docs.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    rows = documents(spark, sf_dir).collect()
    places = {}
    for r in rows:
        for at, line in enumerate((r["text"] or "").split("\n")):
            if line:
                places.setdefault(line, []).append((r["doc_id"], at))
    every = sorted(places, key=len)
    near = {t: set() for t in every}
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if len(b) - len(a) > 2:
                break
            if L.within(a, b, 2):
                near[a].add(b)
                near[b].add(a)
    wanted = sorted((*min(places[t]), len(places[t]), len(near[t])) for t in every)
    found = QUERIES["op9_line_dedup"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["line_no"], r["copies"], r["n_links"]) for r in found) == wanted
