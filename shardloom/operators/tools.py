"""Calculator calls in text: find, evaluate, inject, synthesise, mix into chat."""

from __future__ import annotations

import ast
import operator
import sys

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.constants import SEED
from shardloom.functions.arithmetic import bound, evaluate_whole
from shardloom.functions.pieces import tool_pieces
from shardloom.operators.ordering import order_hash, prefix_scan
from shardloom.session import ship_package

# The call syntax and messages.
OPEN_CALL, CLOSE_CALL = "<tool_call>", "</tool_call>"
OPEN_RESULT, CLOSE_RESULT = "<tool_result>", "</tool_result>"
NOT_ARITHMETIC = "not a plain arithmetic expression"
# The wording and ranges of synthetic examples.
QUESTION = "What is %s?"
REASONING = "I'll compute %s."
ANSWER = "The answer is %s."
OPERATORS = ["+", "-", "*"]
A_RANGE, B_RANGE = (2, 999), (2, 99)

_INT = r"(-?(?:0|[1-9][0-9]{0,14}))"
SIMPLE_CALL = rf"^[ \t]*{_INT}[ \t]*(//|[-+*/%])[ \t]*{_INT}[ \t]*$"


def _call_heads(parts: Column) -> Column:
    """From the pieces between closing tags: the expression each tag closes, null if none was open."""
    heads = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        heads, lambda p: F.when(F.contains(p, F.lit(OPEN_CALL)), F.substring_index(p, OPEN_CALL, -1))
    )


def call_expressions(text: Column) -> Column:
    """One expression per closing tag, in order; null where no call was open."""
    return _call_heads(F.split(text, CLOSE_CALL))


def extract_tool_call(text: Column) -> Column:
    """Expression of the text's last call, null if that call was never opened."""
    return F.try_element_at(call_expressions(text), F.lit(-1))


def parse_simple(expr: Column) -> Column:
    """(a, op, b) of a call with two integers and one of + - * / // %; nulls for anything else.

    The pattern is matched once, for the operator. A first operand has a digit, so the operator is the
    first of its kind from the second character on.
    """

    def parsed(op: Column) -> Column:
        led = F.ltrim(expr, F.lit(" \t"))
        at = F.position(op, led, F.lit(2))
        a, b = led.substr(F.lit(1), at - 1), F.substr(led, at + F.length(op))
        return F.when(op != "", F.struct(a.try_cast("bigint").alias("a"), op.alias("op"), b.try_cast("bigint").alias("b")))

    return bound(F.regexp_extract(expr, SIMPLE_CALL, 2), parsed)


def simple_value(call: Column) -> Column:
    """Result text of a parsed call, wholly in the JVM; null where Python must decide.

    Operands have at most 15 digits, so sums fit and quotients are exact; products are guarded.
    Floor division and modulo go toward minus infinity; true division only when it is exact.
    """
    a, op, b = call["a"], call["op"], call["b"]
    remainder = F.try_mod(a, b)
    floored = F.when((remainder != 0) & ((remainder < 0) != (b < 0)), remainder + b).otherwise(remainder)
    quotient = F.try_divide(a - floored, b).cast("bigint").cast("string")
    return (
        F.when(op == "+", (a + b).cast("string"))
        .when(op == "-", (a - b).cast("string"))
        .when(op == "*", F.try_multiply(a, b).cast("string"))
        .when(op == "//", quotient)
        .when(op == "%", floored.cast("string"))
        .when((op == "/") & (remainder == 0), quotient)
    )


def evaluate_simple(expr: Column) -> Column:
    return simple_value(parse_simple(expr))


def evaluate_native(expr: Column) -> Column:
    """Result text of a plain call or of nested whole-number arithmetic; null where Python must decide.

    The expression and the parsed call are bound by lambdas, so that each is worked out once a row
    wherever it is used.
    """
    return bound(expr, lambda e: F.coalesce(bound(parse_simple(e), simple_value), evaluate_whole(e)))


class _LongPower:
    """A power of two whole numbers with more digits than Python prints, not computed yet: under a
    remainder it never has to be, and as a result it cannot be written."""

    def __init__(self, base: int, exponent: int):
        self.base, self.exponent = base, exponent

    def value(self) -> int:
        return self.base**self.exponent


def _power(a, b):
    whole = isinstance(a, int) and isinstance(b, int)
    return _LongPower(a, b) if whole and abs(a) > 1 and b > 0 and a.bit_length() * b > 1 << 16 else a**b


def _remainder(a, b):
    if isinstance(a, _LongPower):
        if isinstance(b, int) and b:
            return pow(a.base, a.exponent, b)
        a = a.value()
    return a % b


# The allowed operators.
_BINARY = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv,
    ast.Mod: _remainder,
    ast.Pow: _power,
}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def _plain(value):
    return value.value() if isinstance(value, _LongPower) else value


def calculate(text: str) -> tuple[str | None, str | None]:
    """(result, error) of one arithmetic expression; literals and operators only, never code.

    Operands are worked out from the left, so of several faults the leftmost is reported.
    """
    try:
        todo, values = [(ast.parse(text.strip(), mode="eval").body, False)], []
        while todo:
            node, ready = todo.pop()
            if ready:
                apply = _BINARY[type(node.op)] if isinstance(node, ast.BinOp) else _UNARY[type(node.op)]
                operands = [values.pop() for _ in range(2 if isinstance(node, ast.BinOp) else 1)][::-1]
                if apply is _remainder:
                    values.append(_remainder(operands[0], _plain(operands[1])))
                else:
                    values.append(apply(*map(_plain, operands)))
            elif isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
                values.append(node.value)
            elif isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
                todo += [(node, True), (node.right, False), (node.left, False)]
            elif isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
                todo += [(node, True), (node.operand, False)]
            else:
                raise ValueError(NOT_ARITHMETIC)
        value = values.pop()
        if isinstance(value, _LongPower):
            limit = sys.get_int_max_str_digits()
            if limit:
                raise ValueError(f"Exceeds the limit ({limit} digits) for integer string conversion")
            value = value.value()
        whole = isinstance(value, float) and value.is_integer()
        return str(int(value) if whole else value), None
    except (ValueError, SyntaxError, ArithmeticError, RecursionError, MemoryError, TypeError) as error:
        return None, str(error) or type(error).__name__


def _outcome(text: str | None, cache: dict[str, str]) -> str | None:
    if text is None:
        return None
    if text not in cache:
        result, error = calculate(text)
        cache[text] = result if error is None else f"ERROR: {error}"
    return cache[text]


@F.pandas_udf(T.StructType([T.StructField("result", T.StringType()), T.StructField("error", T.StringType())]))
def calculate_column(exprs: pd.Series) -> pd.DataFrame:
    distinct = {e: calculate(e) for e in exprs.dropna().unique()}
    empty = (None, None)
    return pd.DataFrame([distinct.get(e, empty) for e in exprs], columns=["result", "error"])


def _joined(exprs: Column) -> Column:
    """A text's expressions as one string, for ``calculate_lists``.

    No expression holds a closing tag, or an opening tag, which stands for null here. Not an array: Spark
    sizes a batch for Python after each row, and goes through a run of null arrays from its start each time.
    """
    return F.array_join(exprs, CLOSE_CALL, OPEN_CALL)


@F.arrow_udf(T.ArrayType(T.StringType()))
def calculate_lists(joined: pa.Array) -> pa.Array:
    cache: dict[str, str] = {}

    def outcomes(text: str | None) -> list[str | None] | None:
        if text is None:
            return None
        return [_outcome(None if e == OPEN_CALL else e, cache) for e in text.split(CLOSE_CALL)]

    return pa.array([outcomes(text) for text in joined.to_pylist()], pa.list_(pa.string()))


def evaluate_tool_calls(rows: DataFrame, expr: str = "expr") -> DataFrame:
    """Adds ``result`` and ``error``; a bad expression is an error row, not a failed job.

    Plain calls and nested whole-number arithmetic are worked out in the JVM, and Python gets null for
    them. No shuffle, so a popular expression is no hot key; repeats are evaluated once per Arrow batch.
    """
    ship_package(rows.sparkSession)
    staged = rows.withColumn("__simple", evaluate_native(F.col(expr)))
    hard = calculate_column(F.when(F.col("__simple").isNull(), F.col(expr)))
    staged = staged.withColumn("__hard", hard)
    result = F.coalesce("__simple", F.col("__hard.result"))
    return staged.withColumn("result", result).withColumn("error", F.col("__hard.error")).drop("__simple", "__hard")


def inject_tool_result(rows: DataFrame, text: str = "text", out: str = "injected") -> DataFrame:
    """After every call insert its result line; the text stays one row, so nothing is regrouped."""
    ship_package(rows.sparkSession)
    # One projection per stage: each is used more than once below. One branch: Python gets null for a
    # text of calls the JVM can work out, so every text is read and split once.
    staged = (
        rows.withColumn("__parts", F.split(text, CLOSE_CALL))
        .withColumn("__exprs", _call_heads(F.col("__parts")))
        .withColumn("__simple", F.transform("__exprs", evaluate_native))
    )
    todo = F.zip_with("__exprs", "__simple", lambda e, s: F.when(s.isNull(), e))
    is_hard = F.exists(todo, lambda e: e.isNotNull())
    joined = F.when(F.exists("__simple", lambda s: s.isNull()), F.when(is_hard, _joined(todo)))
    staged = staged.withColumn("__hard", calculate_lists(joined))

    def line(index: Column) -> Column:
        outcome = F.coalesce(
            F.get("__simple", index), F.get("__hard", index), F.lit("ERROR: no open call")
        )
        return F.concat(F.lit(f"{CLOSE_CALL}\n{OPEN_RESULT}"), outcome, F.lit(f"{CLOSE_RESULT}\n"))

    last = F.size("__parts") - 1
    injected = F.transform(
        "__parts", lambda p, i: F.when(i < last, F.concat(p, line(i))).otherwise(p)
    )
    helpers = ["__parts", "__exprs", "__simple", "__hard"]
    return staged.withColumn(out, F.array_join(injected, "")).drop(*helpers)


def synth_tool_examples(keys: DataFrame, key: Column, seed: int = SEED) -> DataFrame:
    """One arithmetic example per key: a in 2..999, b in 2..99, one of + - *, drawn from md5."""
    draw = lambda name: order_hash(seed, F.lit(name), key)
    between = lambda name, low, high: F.lit(low) + draw(name) % (high - low + 1)
    symbols = F.array(*[F.lit(o) for o in OPERATORS])
    drawn = (
        keys.withColumn("a", between("a", *A_RANGE))
        .withColumn("b", between("b", *B_RANGE))
        .withColumn("op", F.get(symbols, (draw("op") % len(OPERATORS)).cast("int")))
    )
    a, b, op = F.col("a").cast("string"), F.col("b").cast("string"), F.col("op")
    value = F.when(op == "+", F.col("a") + F.col("b")).when(op == "-", F.col("a") - F.col("b")).otherwise(
        F.col("a") * F.col("b")
    )
    spaced = F.concat(a, F.lit(" "), op, F.lit(" "), b)
    return drawn.select(
        *keys.columns,
        F.format_string(QUESTION, spaced).alias("question"),
        F.format_string(REASONING, spaced).alias("reasoning"),
        F.concat(a, op, b).alias("expr"),
        value.cast("string").alias("result"),
        F.format_string(ANSWER, value.cast("string")).alias("answer"),
    )


def example_pieces(system: str | None = None):
    """Pieces of the columns question, reasoning, expr, result, answer."""
    names = ["question", "reasoning", "expr", "result", "answer"]
    return tool_pieces(*[F.col(n) for n in names], system=None if system is None else F.lit(system))


def mix_slots(slots: DataFrame, fraction: float, seed: int = SEED) -> DataFrame:
    """Adds ``synthetic`` (true with probability ``fraction``) and ``ordinal`` among slots of its kind."""
    unit = order_hash(seed, F.lit("slot"), F.col("slot")) / F.lit(float(1 << 60))
    flagged = slots.withColumn("synthetic", unit < fraction)
    return prefix_scan(flagged, ["synthetic"], "slot", {"ordinal": ("sum", F.lit(1))}, inclusive=False).withColumn(
        "ordinal", F.col("ordinal").cast("bigint")
    )


def mix_bernoulli(slots: DataFrame, chats: DataFrame, fraction: float, seed: int = SEED) -> DataFrame:
    """Each slot is a synthetic example, or the next chat row of an endlessly repeated source.

    ``chats`` has a dense ``idx`` from 0 and must have rows if ``fraction`` is below 1. Returns all
    slots with synthetic, ordinal and the chat columns, which are null for synthetic slots; those
    never take part in the join.
    """
    mixed = mix_slots(slots, fraction, seed)
    added = [f for f in chats.schema if f.name != "idx"]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in added]
    idx = F.lit(None).cast(chats.schema["idx"].dataType).alias("idx")
    synthetic = mixed.where("synthetic").select("*", idx, *empty)
    if fraction >= 1.0:
        return synthetic
    n_chats = chats.count()  # one number, from a materialised table
    if not n_chats:
        raise ValueError("chat slots need chat rows")
    wanted = mixed.where(~F.col("synthetic")).withColumn("idx", F.col("ordinal") % F.lit(n_chats))
    return synthetic.unionByName(wanted.join(chats, "idx"))
