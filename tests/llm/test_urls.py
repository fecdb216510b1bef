import random
import re

import pytest
from pyspark.sql import functions as F

from shardloom.llm import urls as U
from shardloom.llm.queries import QUERIES, SQL
from tests.compare import connect, difference

LABELS = "doc_id long, quality int"


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_equals_sql(spark, folder):
    sf = f"/root/testdata/{folder}"
    assert difference(QUERIES["op3_url_filters"](spark, sf), SQL["op3_url_filters"], connect(sf)) is None


def judged(spark, pages, labels):
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, host string, good int")
    return U.judge(frame, spark.createDataFrame(labels, LABELS)).collect()


def test_parts_and_rules(spark):
    urls = [
        ("HTTP://A.Example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://example.net/EN/x", "example.net", "/EN/x", "net/", "block"),
        ("https://notexample.net", "notexample.net", "", None, "allow"),
        ("//x.org/fr/", "", "", None, "allow"),
        ("x://É.ORG/fr/a#b/c", "É.org", "/fr/a", "org/fr/", "allow"),
        ("x://example.com/de/?", "example.com", "/de/", "example.com/de/", "block"),
        ("x://fake-example.com/de/", "fake-example.com", "/de/", None, "allow"),
        ("x://a://net/b", "a:", "//net/b", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ]
    got = {r["page_id"]: r for r in judged(spark, [(i, u[0]) for i, u in enumerate(urls)], [(0, 1)])}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict)


def test_templates_wildcards_and_purity(spark):
    pages, labels = [], []
    for i in range(60):
        for k, (section, quality) in enumerate((("news", 1), ("blog", 1), ("spam", 0))):
            pages.append((i * 3 + k, f"http://h.test/{section}/{1000 + i}.html"))
            if i < 40:
                labels.append((i * 3 + k, quality))
    pages += [(900, "http://h.test/a/b/c/d/e/f"), (None, "http://h.test/news/1.html"), (901, "http://h.test/" + "y" * 50000)]
    got = {r["page_id"]: r for r in judged(spark, pages, labels)}
    assert got[2]["template"] == "/spam/<num>.html" and got[2]["verdict"] == "block"
    assert {got[i]["verdict"] for i in range(2, 180, 3)} == {"block"}  # unlabelled ones of the template too
    assert got[0]["verdict"] == got[1]["verdict"] == got[None]["verdict"] == "allow"
    assert got[900]["template"] == "/*/b/c/d/e/f" and got[901]["verdict"] == "allow"


def brute_templates(paths):
    """Templates of {path: (pages, labelled, good)} of one host, a level at a time."""
    out, nodes = {}, [("", 0, list(paths))]
    parts = {p: [] if p == "" else p.removeprefix("/").split("/") for p in paths}

    def form(s):
        if re.fullmatch("[0-9]+", s):
            return "<num>"
        if re.fullmatch(r"[0-9]+\.[a-z]+", s):
            return "<num>" + s.lstrip("0123456789")
        if re.fullmatch("[0-9a-fA-F-]{8,}", s):
            return "<id>"
        return "<mixed>" if re.search("[0-9]", s) else "<word>"

    while nodes:
        template, level, below = nodes.pop()
        kids = {}
        for p in below:
            if len(parts[p]) == level:
                out[p] = template
            else:
                kids.setdefault(parts[p][level], []).append(p)
        counts = {s: [sum(paths[p][i] for p in ps) for i in range(3)] for s, ps in kids.items()}
        forms = {}
        for s in kids:
            forms.setdefault(form(s), []).append(s)
        variable = {f for f, ss in forms.items() if len(ss) >= U.MANY and sum(counts[s][0] for s in ss) <= U.RARE * len(ss)}
        literal = [s for s in kids if form(s) not in variable]
        n, g = sum(counts[s][1] for s in literal), sum(counts[s][2] for s in literal)
        groups = {}
        for s, ps in kids.items():
            token = form(s)
            if token not in variable:
                _, labelled, good = counts[s]
                apart = False
                if labelled and n - labelled:
                    rate = g / n
                    error = (rate * (1 - rate) * (1 / labelled + 1 / (n - labelled))) ** 0.5
                    apart = abs(good / labelled - (g - good) / (n - labelled)) > U.Z * error
                token = s if len(literal) == 1 or apart else "*"
            groups.setdefault(token, []).extend(ps)
        nodes += [(f"{template}/{t}", level + 1, ps) for t, ps in groups.items()]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_deep_templates_equal_brute_force(spark, seed):
    """Paths of up to nine levels and one of thousands, branching anywhere, some ending inside others."""
    rng = random.Random(seed)
    paths = {"": (1, 1, 1), "/": (2, 0, 0), "//": (1, 0, 0), "/" + "d/" * 3000 + "x": (1, 1, 0), "/" + "d/" * 3000 + "y": (3, 2, 2)}
    names = ["news", "blog", "spam", "en", "", "v2", "*"]
    for _ in range(500):
        parts = [rng.choice(names[: rng.choice([1, 2, 7])]) for _ in range(rng.randint(0, 7))]
        tail = rng.choice([[], [str(rng.randint(0, 99))], [f"{rng.randint(0, 999)}.html"], ["deadbeef%02x" % rng.randint(0, 40), "end"]])
        labelled = rng.randint(0, 9)
        good = 0 if "spam" in parts else rng.randint(labelled // 2, labelled)
        paths["/" + "/".join(parts + tail)] = (labelled + rng.randint(1, 3), labelled, good)
    rows = spark.createDataFrame([("h", p, *c) for p, c in paths.items()], "host string, path string, pages long, labelled long, good long")
    got = {r["path"]: r["template"] for r in U.templates(rows).collect()}
    assert got == brute_templates(paths)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    labels = spark.createDataFrame([], LABELS)
    assert [r["verdict"] for r in U.judge(pages, labels).collect()] == ["allow"]
    assert U.judge(pages.where(F.lit(False)), labels).count() == 0
