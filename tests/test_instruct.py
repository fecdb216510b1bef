import pytest
from pyspark.sql import functions as F

from shardloom.constants import ABSTAIN_TEXT, GROUNDED_SYSTEM
from shardloom.functions.text import before_last, fixed1, hours_minutes, python_number, shard_name, strip
from shardloom.operators import evals
from shardloom.operators import instruct as ins

QA = [
    (1, "What? ", "iron", " One. Two and more"),
    (2, "Q", "gold", None),
    (3, "", "x", "s"),
    (4, "Q", None, "s"),
    (5, " ", "kept", "no full stop " * 60),
    (6, "Q", "long", ("word. " * 100)),
]


# What each kept question's answer must read, written out.
ANSWERS = {1: "iron.\n\nOne.", 2: "gold.", 5: "kept.\n\n" + "no full stop " * 30 + "no full st.", 6: "long.\n\n" + "word. " * 65 + "word."}


def test_explanatory_rows(spark):
    df = spark.createDataFrame(QA, "k int, question string, correct_answer string, support string")
    found = {r.k: r.messages for r in ins.qa_explanatory(df, ["k"]).collect()}
    assert {k: m[2].content for k, m in found.items()} == ANSWERS
    assert {k: m[1].content for k, m in found.items()} == {1: "What?", 2: "Q", 5: "", 6: "Q"}
    assert all([m.role for m in messages] == ["system", "user", "assistant"] for messages in found.values())


def test_terse_rows(spark):
    rows = [(1, "q", ["a", "b"]), (2, "q", []), (3, "q", None), (4, None, ["a"])]
    df = spark.createDataFrame(rows, "k int, question string, answers array<string>")
    assert {r.k: r.messages[2].content for r in ins.qa_terse(df, ["k"]).collect()} == {1: "a, b"}


GROUNDED = [
    (1, " ctx ", "q?", (["  yes "],)),
    (2, "ctx", "q?", ([],)),
    (3, "ctx", "q?", None),
    (4, "ctx", "q?", (["  ", "second"],)),
    (5, "　", "q?", (["a"],)),
    (6, "ctx", None, (["a"],)),
    (7, "ctx", "q?", (None,)),
]


def test_grounded_rows(spark):
    df = spark.createDataFrame(GROUNDED, "k int, context string, question string, answers struct<text:array<string>>")
    found = {r.k: r for r in ins.grounded_rows(df, ["k"]).collect()}
    assert {k: (r.answerable, r.messages[2].content) for k, r in found.items()} == {
        1: (True, "yes"),
        **{k: (False, ABSTAIN_TEXT) for k in (2, 3, 4, 7)},
    }
    assert found[1].messages[0].content == GROUNDED_SYSTEM
    assert found[1].messages[1].content == "Context:\nctx\n\nQuestion: q?"


@pytest.mark.parametrize("n,n_ans,n_un,want", [(50, 100, 100, (40, 10)), (50, 10, 3, (10, 3)), (7, 100, 100, (6, 1)), (50, 0, 30, (0, 10))])
def test_class_caps(spark, n, n_ans, n_un, want):
    rows = [(i, i < n_ans) for i in range(n_ans + n_un)]
    df = spark.createDataFrame(rows, "k bigint, answerable boolean")
    kept = ins.union_grounded(df, n, ["k"]).collect()
    assert (sum(r.answerable for r in kept), sum(not r.answerable for r in kept)) == want
    assert sorted(r.pos for r in kept) == list(range(len(kept)))


def test_missing_sources(spark):
    good = lambda: spark.createDataFrame([(1,)], "k int")
    gone = lambda: spark.read.parquet("/tmp/no-such-corpus")
    with pytest.raises(Exception):
        ins.union_qa(spark, {"good": good, "gone": gone})
    rows, report = ins.union_qa(spark, {"good": good, "gone": gone}, allow_missing=True)
    assert [(r.k, r.origin) for r in rows.collect()] == [(1, "good")]
    assert {r.origin: r.available for r in report.collect()} == {"good": True, "gone": False}


def test_sample_is_stable_under_partitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = {r.k for r in ins.sample_n(df.repartition(1), 37, ["k"]).collect()}
    many = {r.k for r in ins.sample_n(df.repartition(64), 37, ["k"]).collect()}
    assert one == many and len(one) == 37


def values(spark, column, rows, dtype):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {dtype}")
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_text_functions_equal_python(spark):
    texts = [" a ", "\x1ca\x85", " x y　", "", "\t\n"]
    assert values(spark, strip(F.col("v")), texts, "string") == [t.strip() for t in texts]
    cuts = ["a.b.c", "abc", ".", "", "x."]
    assert values(spark, before_last(F.col("v"), "."), cuts, "string") == [t.rsplit(".", 1)[0] for t in cuts]


def test_one_decimal_equals_python(spark):
    numbers = [i / n * 100 for n in range(1, 90) for i in range(n + 1)] + [0.05, 0.15, 0.25, 12.45, 99.95]
    assert values(spark, fixed1(F.col("v")), numbers, "double") == [f"{v:.1f}" for v in numbers]


def test_numbers_print_like_python(spark):
    numbers = [1.0, -3.0, 0.1, 2.5e-7, 1e-4, 0.00123, 1234567.5, 123456789.25, -98765432.125, 1e15, 3e17, 2.0**70, 7e-5]
    want = [str(int(v)) if v.is_integer() else str(v) for v in numbers]
    assert values(spark, python_number(F.col("v")), numbers, "double") == want


def test_durations_and_names(spark):
    assert values(spark, hours_minutes(F.col("v")), [0.0, 59.9, 3600.0, 86399.0, None], "double") == [
        "0h00m", "0h00m", "1h00m", "23h59m", None,
    ]
    assert values(spark, shard_name(F.lit("code"), F.lit("val"), F.col("v")), [0, 1234567], "bigint") == [
        "code_val_000000", "code_val_1234567",
    ]


def test_scores(spark):
    cases = [("330", "It is 330 m<|im_end|>"), ("Paris", "paris."), ("x", "no"), ("ABSTAIN", " I DON'T KNOW."), ("ABSTAIN", "330")]
    scores = evals.score_by_class(spark.createDataFrame(cases, "expected string, got string")).collect()
    assert {r["class"]: (r.n_hits, r.n_cases) for r in scores} == {"total": (3, 5), "answerable": (2, 3), "abstain": (1, 2)}
