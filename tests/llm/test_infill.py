import hashlib
import random
import re

import numpy as np
import pytest

from shardloom.llm import infill
from shardloom.llm.common import documents
from shardloom.llm.queries import QUERIES, SQL
from tests.compare import connect, difference


def brute(doc_id, text, unit="code_points", rate=90, spm=20):
    text = text or ""
    starts = {
        "code_points": lambda: list(range(len(text))),
        "words": lambda: [m.start() for m in re.finditer(r"[^ \t-\r]+", text)],
        "lines": lambda: [0, *[i + 1 for i, c in enumerate(text[:-1]) if c == "\n"]] if text else [],
    }[unit]()
    n = len(starts)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= rate:
        return doc_id, "plain", n, None, None, text
    a, b = (0 if u == 0 else len(text) if u == n else starts[u] for u in sorted(x % (n + 1) for x in h[:2]))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return doc_id, "spm", n, len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, "psm", n, len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    random.seed(4)
    alphabet = ["a", "é", "漢", "🙂", " ", "\n", "\t", "<", ">", "S"]
    made = ["".join(random.choices(alphabet, k=random.choice([1, 5, 255, 256, 257, 1000, 3000]))) for _ in range(150)]
    return [*made, None, "", "x<P>y", "<M>", "   ", "\n\n", "🙂" * 200_000, "a b " * 100_000, "w" * 300]


@pytest.mark.parametrize("unit", infill.UNITS)
def test_equals_brute_force(spark, unit):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "of no id", "y", 2), (7, "a twin of seven", "y", 3)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(5)
    got = infill.infill(docs, unit=unit)
    key = lambda r: (str(r[0]), r[5])
    assert sorted(map(tuple, got.collect()), key=key) == sorted([brute(d, t, unit) for d, t, *_ in rows], key=key)
    back = got.select("doc_id", infill.restore(got["output"], got["form"]).alias("text")).collect()
    assert sorted((str(d), t) for d, t in back) == sorted((str(d), t or "") for d, t, *_ in rows)


def test_forms_and_no_rows(spark):
    docs = spark.createDataFrame([(f"d{i}", "some text") for i in range(400)], "doc_id string, text string")
    count = {r["form"]: r["count"] for r in infill.infill(docs, rate=50, spm=50).groupBy("form").count().collect()}
    assert count["plain"] > 150 and count["psm"] > 70 and count["spm"] > 70
    assert set(r["form"] for r in infill.infill(docs, rate=0).collect()) == {"plain"}
    assert infill.infill(docs.limit(0)).collect() == []


def test_trees_hold_prefix_counts():
    random.seed(1)
    lengths = np.array([0, 1, 256, 5000, 0, 100_000])
    data = np.frombuffer(random.randbytes(int(lengths.sum())), np.uint8)
    marks = data < 90
    trees = infill.Trees(lengths, [marks, marks])
    for t, size in enumerate(lengths.tolist()):
        begin = int(trees.begins[t])
        own = np.flatnonzero(marks[begin : begin + size])
        for unit in {1, len(own) // 3, len(own) - 1, len(own)} - {0, -1}:
            if unit <= len(own):
                place, before = trees.locate(np.array([t]), np.array([unit]))
                assert place[0] == (own[unit] if unit < len(own) else size) and before[0] == unit


def test_query_equals_sql(spark, sf_dir):
    assert difference(QUERIES["op13_infill"](spark, sf_dir), SQL["op13_infill"], connect(sf_dir)) is None
    assert QUERIES["op13_infill"](spark, sf_dir).count() == documents(spark, sf_dir).count()
