"""The JVM's arithmetic against the calculator: equal where it answers, null only where it may be."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shardloom.functions.arithmetic import DEEPEST, LONGEST, evaluate_whole
from shardloom.operators import tools


def native(spark, exprs):
    frame = spark.createDataFrame([(i, e) for i, e in enumerate(exprs)], "i int, e string")
    found = {r.i: r.v for r in frame.select("i", evaluate_whole(F.col("e")).alias("v")).collect()}
    return [found[i] for i in range(len(exprs))]


# Expression -> result.
WORKED = {
    "(1+2)*-3": "-9",
    "-2**2": "-4",
    "2**3**2": "512",
    "(2**3)**2": "64",
    "-(2)**2*3": "-12",
    "10-4-3": "3",
    "100//7//2": "7",
    "-7//2*2+-7%2": "-7",
    "2*(3+4*(5-6))%7": "5",
    "8/(2/1)*3": "12",
    "(0/5)": "0",
    "((((7))))": "7",
    "--+-5": "-5",
    " ( 12 -\t5 )*7 + 12**2 ": "193",
    "1-(2-(3-(4-5)))": "3",
    "0**0": "1",
    "999999999999999*9000+1": "8999999999999991001",
}
LEFT = [
    None, "", " ", "()", "(", ")", "1)", "(1", "1 2", "1+", "*1", "1**", "1* *2", "1///2", "(1)(2)", "1(2)", "2(", "007", "1.5", "1e3", "x",
    "True", "1,2", "1/0", "1//0", "1%(2-2)", "7/2", "(7/2)*2", "2**-1", "2**(0-1)", "9**9**9", "10**16", "1\n+2", "٣+1", "1_000",
    "9223372036854775807", "999999999999999*999999999999999", "-(999999999999999*9223)-999999999999999*9", "2**(3/2)",
    "(" * (DEEPEST + 1) + "1" + ")" * (DEEPEST + 1), "1+" * (LONGEST // 2) + "1",
]


def test_worked(spark):
    assert dict(zip(WORKED, native(spark, WORKED))) == WORKED
    assert all(tools.calculate(e)[0] == v for e, v in WORKED.items())


def test_left_to_python(spark):
    assert {e: v for e, v in zip(LEFT, native(spark, LEFT)) if v is not None} == {}


def test_limits(spark):
    deep = "(" * DEEPEST + "1" + ")" * DEEPEST
    long = "-" * (LONGEST - 1) + "1"
    chain = "1+" * (LONGEST // 2 - 1) + "12"
    assert native(spark, [deep, long, chain]) == [tools.calculate(e)[0] for e in (deep, long, chain)]
    assert None not in native(spark, [deep, long, chain])


def made(rng, depth):
    """An expression of the grammar; exponents are small."""
    if depth == 0 or rng.random() < 0.2:
        return str(rng.choice([0, 1, 2, 3, 7, 10, 12, 64, 999, 123456789, 999999999999999]))
    kind = rng.random()
    if kind < 0.15:
        return rng.choice("+-") + made(rng, depth - 1)
    if kind < 0.45:
        return f"({made(rng, depth - 1)})"
    blank = rng.choice(["", " ", "\t "])
    if kind < 0.55:
        return made(rng, depth - 1) + blank + "**" + blank + str(rng.choice([0, 1, 2, 3]))
    return made(rng, depth - 1) + blank + rng.choice(["+", "-", "*", "/", "//", "%", "+", "-", "*"]) + blank + made(rng, depth - 1)


@pytest.mark.parametrize("seed", range(3))
def test_equals_calculator(spark, seed):
    rng = random.Random(seed)
    exprs = [e for e in (made(rng, rng.randint(1, 5)) for _ in range(3000)) if e.count("**") < 3 and not re.search(r"\*\*\s*\d\s*\*\*", e)]
    wrong, silent = [], []
    for e, v in zip(exprs, native(spark, exprs)):
        result, _ = tools.calculate(e)
        if v is not None and v != result:
            wrong.append((e, v, result))
        if v is None and result is not None and "/" not in e.replace("//", "") and "**" not in e and len(result) < 14:
            silent.append(e)  # small whole results without powers
    assert not wrong, wrong[:5]
    # Only those whose intermediate results are above 53 bits stay silent.
    assert all("999999999999999" in e or "123456789" in e for e in silent), silent[:5]


def test_mixed_signs_and_noise(spark):
    rng = random.Random(7)
    exprs = ["".join(rng.choice("0123 +-*/%()") for _ in range(rng.randint(1, 7))) for _ in range(5000)]
    wrong = []
    for e, v in zip(exprs, native(spark, exprs)):
        if v is not None and v != tools.calculate(e)[0]:
            wrong.append((e, v))
    assert not wrong, wrong[:5]


def test_python_gets_null_for_whole_numbers(spark, monkeypatch):
    """Nested calls of whole numbers reach no Python function: one that fails on any input is never asked."""

    @F.pandas_udf(tools.calculate_column.returnType)
    def fail(exprs):
        if exprs.notna().any():
            raise ValueError("Python was asked")
        import pandas as pd

        return pd.DataFrame({"result": [None] * len(exprs), "error": [None] * len(exprs)}, dtype=object)

    monkeypatch.setattr(tools, "calculate_column", fail)
    exprs = [*WORKED, None]
    found = tools.evaluate_tool_calls(spark.createDataFrame([(e,) for e in exprs], "expr string")).collect()
    assert {r.expr: r.result for r in found} == WORKED | {None: None}
    assert all(r.error is None for r in found)


def test_no_array_holds_a_single_value(spark):
    """Values used twice are bound without an array of one; a frame is copied for brackets, not for every token."""
    frame = spark.createDataFrame([("1+1",)], "expr string")
    plan = frame.select(tools.evaluate_native(F.col("expr")))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(" not in plan and "concat(slice(" not in plan


def test_brackets_must_match_in_order(spark):
    faults = ["1)+(2", "(1)+2)", "((1)+(2)", "(1))+((2)", "1)*(2)", ")1(", "-(2**(-1))", "2**(3-4)", "2**(+3)**-1"]
    assert native(spark, faults) == [None] * len(faults)
    deep = {"((1)+(2))*(3)": "9", "2**(+3)": "8", "-(-(2)**2)": "4", "1-(7//2*2)": "-5", "(2**3)**2-(2**3**2)": "-448", "-(2**52)*2048": str(-(1 << 63))}
    assert dict(zip(deep, native(spark, deep))) == deep == {e: tools.calculate(e)[0] for e in deep}


def test_injection_of_nested_calls(spark, monkeypatch):
    @F.pandas_udf("array<string>")
    def fail(lists):
        if lists.notna().any():
            raise ValueError("Python was asked")
        return lists

    monkeypatch.setattr(tools, "calculate_lists", fail)
    text = "a <tool_call>(2+3)*4</tool_call> b <tool_call>6-1</tool_call>"
    row = tools.inject_tool_result(spark.createDataFrame([(text,)], "text string")).first()
    assert row.injected == (
        "a <tool_call>(2+3)*4</tool_call>\n<tool_result>20</tool_result>\n b <tool_call>6-1</tool_call>\n<tool_result>5</tool_result>\n"
    )
