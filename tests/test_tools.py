import re
import time

import pytest
from pyspark.sql import functions as F

from shardloom.constants import END_TOOL_RESULT, TOOL_RESULT
from shardloom.functions.pieces import encode_examples
from shardloom.functions.vocab import encoder
from shardloom.operators import tools as t
from shardloom.operators.quality import mask_audit

# Expression -> result.
RESULTS = {
    "47*89": "4183",
    "2**10 + 3": "1027",
    "-7%3": "2",
    "-7//2": "-4",
    "7 // -2": "-4",
    "7 % -3": "-2",
    "-6%3": "0",
    "6/3": "2",
    "7/2": "3.5",
    "-7/2": "-3.5",
    "True": "True",
    "True + 1": "2",
    "(1+2)*-3": "-9",
    "+5": "5",
    "-2**2": "-4",
    "  8 - -2 ": "10",
    "999999999999999*999999999999999": "999999999999998000000000000001",
    "1e3": "1000",
    "0.1+0.2": "0.30000000000000004",
    "00": "0",
}
ERRORS = ["1/0", "1//0", "5%0", "open('x')", "__import__('os')", "x", "1+", "", "007+1", "'a'*3", "1 if 1 else 2", "9**9**9", "[1]"]


def test_expressions(spark):
    rows = [(e,) for e in [*RESULTS, *ERRORS]] + [(None,)]
    found = {r.expr: r for r in t.evaluate_tool_calls(spark.createDataFrame(rows, "expr string")).collect()}
    assert {e: found[e].result for e in RESULTS} == RESULTS
    for e in ERRORS:
        assert found[e].result is None and found[e].error
    assert found["x"].error == "not a plain arithmetic expression"
    assert found["1/0"].error == "division by zero"


def test_native_and_python_paths_agree(spark):
    ints = [0, 1, -1, 7, -7, 12, 999, -1000]
    exprs = [f"{a}{op}{b}" for a in ints for b in ints for op in ("+", "-", "*", "/", "//", "%")]
    df = spark.createDataFrame([(e,) for e in exprs], "expr string")
    for r in df.select("expr", t.evaluate_simple(F.col("expr")).alias("s")).collect():
        if r.s is not None:
            assert r.s == t.calculate(r.expr)[0], r.expr


def test_plain_calls_are_matched_once(spark):
    """Operands by the operator's place are the pattern's; blanks, signs and ends of lines included."""
    numbers = ["0", "-0", "7", "-7", "999999999999999", "-999999999999999"]
    between = [f"{a}{op}{b}" for a in numbers for b in numbers for op in ("+", "-", " - ", "*", "\t*", "/", "//", " // ", "%")]
    exprs = [f"{led}{e}{end}" for e in between for led, end in (("", ""), (" \t", "\t "), ("", "\n"))]
    exprs += ["", " ", "7", "-7", "7-", "-7-", "--7", "7---7", "+7+7", "7**7", "7///7", "07-7", "7-07", "7 7-7", "1000000000000000-7", "\n7-7", "7-7\r\n", "7-7\u2028", "٧-7"]
    frame = spark.createDataFrame([(i, e) for i, e in enumerate(exprs)], "i int, e string")
    parsed = frame.select("i", t.parse_simple(F.col("e")).alias("p"))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract(") + plan.count("rlike") == 1
    found = {r.i: r.p and (r.p.a, r.p.op, r.p.b) for r in parsed.collect()}
    for i, e in enumerate(exprs):
        m = re.search(t.SIMPLE_CALL, e)
        wanted = m and (int(m[1]), m[2], int(m[3]))
        # The JVM's end of line is wider than Python's; such an operand may be left to Python.
        assert found[i] == wanted or (wanted is None and e.strip() == "7-7" and found[i] in [(7, "-", 7), (7, "-", None)]), e
    ends = spark.createDataFrame([("7-7\r\n",), ("7-7\u2028",), ("-7--7\n",)], "expr string")
    assert [r.result for r in t.evaluate_tool_calls(ends).collect()] == ["0"] * 3


@pytest.mark.parametrize(
    "text,exprs,last",
    [
        ("a <tool_call>1+1</tool_call> b", ["1+1"], "1+1"),
        ("<tool_call>1</tool_call><tool_call>2</tool_call>", ["1", "2"], "2"),
        ("<tool_call>x <tool_call>3</tool_call>", ["3"], "3"),
        ("no calls", [], None),
        ("odd</tool_call> <tool_call>4</tool_call>", [None, "4"], "4"),
        ("<tool_call>open", [], None),
    ],
)
def test_extraction(spark, text, exprs, last):
    row = spark.createDataFrame([(text,)], "t string").select(
        t.call_expressions(F.col("t")).alias("all"), t.extract_tool_call(F.col("t")).alias("last")
    ).first()
    assert row["all"] == exprs and row["last"] == last


def test_injection(spark):
    rows = [
        ("Sum: <tool_call>6/3</tool_call> then <tool_call>bad</tool_call>.",),
        ("plain",),
        ("<tool_call>(2+3)*4</tool_call>",),
        ("x</tool_call>",),
    ]
    found = {r.text: r.injected for r in t.inject_tool_result(spark.createDataFrame(rows, "text string")).collect()}
    out = [found[text] for text, in rows]
    assert out[0] == (
        "Sum: <tool_call>6/3</tool_call>\n<tool_result>2</tool_result>\n then "
        "<tool_call>bad</tool_call>\n<tool_result>ERROR: not a plain arithmetic expression</tool_result>\n."
    )
    assert out[1] == "plain"
    assert out[2].endswith("<tool_result>20</tool_result>\n")
    assert "ERROR" in out[3]


def _calls(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(t.call_expressions(F.col("t"))).first()[0]


def test_hard_calls_reach_python_whole(spark):
    """Calls Python decides, among plain, empty and unopened ones; pieces of tags are no tags."""
    text = (
        "a</tool_call><tool_call>1/0</tool_call><tool_call></tool_call><tool_call>2+2</tool_call>"
        "<tool_call>7/2</tool_</tool_call>b</tool_call><tool_call>9/4</tool_call><tool_call>tool_call></tool_call>"
    )
    row = t.inject_tool_result(spark.createDataFrame([(text,), (None,)], "text string")).where("text IS NOT NULL").first()
    found = [part.split("</tool_result>")[0] for part in row.injected.split("<tool_result>")[1:]]
    wanted = [t.calculate(e) if e is not None else (None, "no open call") for e in _calls(spark, text)]
    assert found == [result if error is None else f"ERROR: {error}" for result, error in wanted]
    assert found[0] == "ERROR: no open call" and found[3] == "4" and found[6] == "2.25"


def test_time_of_plain_texts_does_not_grow_with_the_batch(spark):
    """Python gets null for them; a batch is sized after each row, which must not go through the rows before."""
    n, conf = 200_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.range(0, n, 1, 1).select(F.format_string("<tool_call>%d+1</tool_call>", "id").alias("text"))
    old, seconds = spark.conf.get(conf), {}
    try:
        for size in (1_000, 1_000, n):
            spark.conf.set(conf, size)
            began = time.perf_counter()
            t.inject_tool_result(rows).write.format("noop").mode("overwrite").save()
            seconds[size] = time.perf_counter() - began
    finally:
        spark.conf.set(conf, old)
    assert seconds[n] < 3 * seconds[1_000], seconds


def test_worked_example(spark):
    rows = [("Length of the fence?", "Twelve posts apart by 7.", "12*7", "84", "84 metres.")]
    df = spark.createDataFrame(rows, "question string, reasoning string, expr string, result string, answer string")
    row = encode_examples(df, ["expr"], t.example_pieces()).first()
    enc = encoder()
    learned = enc.decode([i for i, m in zip(row.ids, row.mask) if m])
    unlearned = enc.decode([i for i, m in zip(row.ids, row.mask) if not m])
    assert learned == "Twelve posts apart by 7.\n<tool_call>12*7</tool_call>\n84 metres.<|im_end|>\n"
    assert unlearned == (
        "<|im_start|>user\nLength of the fence?<|im_end|>\n<|im_start|>assistant\n<tool_result>84</tool_result>\n"
    )


def test_mask_audit_finds_leaks(spark):
    a, z = TOOL_RESULT, END_TOOL_RESULT
    rows = [
        (0, [1, a, 5, z, 2], [1, 0, 0, 0, 1]),
        (1, [1, a, 5, z, 2], [1, 0, 1, 0, 1]),
        (2, [1, a, 5, z, 2], [1, 0, 0, 1, 1]),
        (3, [1, 2], [1]),
        (4, [1, 2], [1, 2]),
        (5, [a, 5, z, 1, a, 6, z], [0, 0, 0, 1, 0, 1, 0]),
        (6, [], []),
    ]
    df = spark.createDataFrame(rows, "k int, ids array<int>, mask array<int>")
    assert sorted(r.k for r in mask_audit(df, a, z).where("violation").collect()) == [1, 2, 3, 4, 5]


def test_synthetic_examples(spark):
    rows = t.synth_tool_examples(spark.range(3000).withColumnRenamed("id", "k"), F.col("k")).collect()
    ops = set()
    for r in rows:
        value, error = t.calculate(r.expr)
        assert error is None and r.result == value and r.answer == f"The answer is {value}."
        a, op, b = r.question.removeprefix("What is ").removesuffix("?").split()
        assert 2 <= int(a) <= 999 and 2 <= int(b) <= 99
        ops.add(op)
    assert ops == {"+", "-", "*"}


def test_mixing(spark):
    slots = spark.range(2000).withColumnRenamed("id", "slot")
    chats = spark.createDataFrame([(i, f"c{i}") for i in range(7)], "idx bigint, conv string")
    rows = t.mix_bernoulli(slots, chats, 0.15).orderBy("slot").collect()
    assert len(rows) == 2000 and 0.10 < sum(r.synthetic for r in rows) / 2000 < 0.20
    n = 0
    for r in rows:
        if r.synthetic:
            assert r.conv is None
        else:
            assert r.conv == f"c{n % 7}"
            n += 1
    only = t.mix_bernoulli(slots, chats, 1.0)
    assert only.columns == t.mix_bernoulli(slots, chats, 0.15).columns
    assert all(r.synthetic and r.conv is None for r in only.collect())
    with pytest.raises(ValueError, match="chat rows"):
        t.mix_bernoulli(slots, chats.limit(0), 0.5)


def test_long_powers_and_the_leftmost_fault():
    assert t.calculate("2**20000000 % 7") == ("4", None)
    assert t.calculate("-(3**100000) % 10") == ("9", None)
    assert "digits" in t.calculate("2**20000000")[1]
    assert t.calculate("2**100000 // 2**99998") == ("4", None)
    assert "zero" in t.calculate("1/0 + open(1)")[1]
    assert t.calculate("open(1) + 1/0") == (None, t.NOT_ARITHMETIC)


def test_plans_evaluate_once_and_compile(spark):
    """Generated code compiles (no fallback), the input is read once, and each pattern stands once."""
    texts = [f"so <tool_call>{e}</tool_call> and <tool_call>7*6</tool_call>" for e in ("1+2", "(1+2)*3", "2 // 0", "oops", "9/4")] * 20
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(texts)], "id long, text string").repartition(2)
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        calls = rows.select("id", t.extract_tool_call(F.split("text", " and ")[0]).alias("expr"))
        found = {(r["expr"], r["result"]) for r in t.evaluate_tool_calls(calls).collect()}
        assert {("1+2", "3"), ("(1+2)*3", "9"), ("9/4", "2.25")} <= found
        injected = t.inject_tool_result(rows)
        assert injected.count() == len(texts) and all("<tool_result>42</tool_result>" in r["injected"] for r in injected.collect())
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.factoryMode")
    for df in (t.evaluate_tool_calls(calls), injected):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1 and "Union" not in plan
        assert plan.count("RLIKE") <= 1 and plan.count("ArrowEvalPython") == 1
