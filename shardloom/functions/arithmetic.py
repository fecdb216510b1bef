"""Nested arithmetic of whole numbers as one expression of the JVM: a fold over an expression's operands.

A regular expression settles all of the syntax but whether brackets match. The fold takes a number and
the operators that follow it at a time; its state is what waits for a right side (the sum so far, the
product so far, signs and powers if there are any), with a frame per open bracket. Anything it can't
settle exactly is null, never a guess.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Longer or deeper texts are null: a parser's own limits decide about those.
LONGEST, DEEPEST = 400, 50
EXACT = 1 << 53  # whole numbers up to here are exact doubles

_NUMBER = r"(?:0|[1-9][0-9]{0,14})(?![0-9])"
# Signs before an exponent are left out. No part is ever tried twice.
_OPERATOR = r"(?:\*\*(?![ \t]*+[-+])|//|[-+*/%])"
_WHOLE = rf"\A[-+( \t]*+{_NUMBER}[) \t]*+(?:{_OPERATOR}[-+( \t]*+{_NUMBER}[) \t]*+)*+\z"
_POWER, _FLOOR = "^", ":"  # one character each


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once and written once in the plan, however often it is used.

    A fold over nothing: its start is the value. An array of one value costs several times as much.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


def _power(base: Column, exponent: Column) -> Column:
    """Exact where the result is an exact double, else null."""
    found = F.pow(base.cast("double"), exponent.cast("double"))
    return bound(found, lambda v: F.when((exponent >= 0) & (F.abs(v) < EXACT), v.cast("bigint")))


def _quotient(sign: Column, a: Column, b: Column) -> Column:
    """``a sign b`` of a division; floors go toward minus infinity, and a true quotient must be whole."""
    small = a.between(-EXACT, EXACT) & b.between(-EXACT, EXACT)
    quotient = lambda left: F.when(small, F.try_divide(a - left, b).cast("bigint"))
    floored = lambda r: F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)
    divided = lambda r: F.when(sign == "%", r).when((sign == _FLOOR) | (r == 0), quotient(r))
    return bound(bound(F.try_mod(a, b), floored), divided)


def evaluate_whole(expr: Column) -> Column:
    """Value of an expression of whole numbers with + - * / // % ** and brackets, as text.

    Null for everything else: other literals, names, faults of syntax, division by zero, quotients that
    are not whole, intermediate results above 63 bits (53 for powers, for the sides of a division, and for
    all results of an expression with a true division), signs before an exponent, and texts above
    ``LONGEST`` characters or ``DEEPEST`` brackets.
    """
    short = F.replace(F.replace(expr, F.lit("**"), F.lit(_POWER)), F.lit("//"), F.lit(_FLOOR))
    found = F.when(F.length(expr) <= LONGEST, F.regexp_extract(expr, _WHOLE, 0))
    # Led by a number, so that each number has what follows it, even if nothing does.
    text = F.when(found != "", F.concat(F.lit("0+"), F.translate(short, " \t", "")))
    return bound(text, lambda t: bound(F.contains(t, F.lit("/")), lambda true: _fold(t, true)))


def _fold(text: Column, true_division: Column) -> Column:
    nothing, no = F.lit(None).cast("bigint"), F.lit(False)
    empty = F.array().cast("array<bigint>")
    no_sign, plain = F.lit(None).cast("string"), F.lit(None).cast("struct<neg:boolean,powers:array<bigint>>")
    outer = ["total", "minus", "term", "sign", "mods"]

    def state(total: Column, minus: Column, term: Column, sign: Column, mods: Column, stack: Column, base: Column) -> Column:
        values = {"total": total, "minus": minus, "term": term, "sign": sign, "mods": mods, "stack": stack, "base": base}
        return F.struct(*[value.alias(name) for name, value in values.items()])

    def modified(neg: Column, powers: Column) -> Column:
        return F.struct(neg.alias("neg"), powers.alias("powers"))

    def within(value: Column) -> Column:
        # A true quotient is a double, and so is all that is made of it.
        return bound(value, lambda v: F.when(~true_division | v.between(-EXACT, EXACT), v))

    def settled(now: Column, base: Column) -> Column:
        """The product with the operand just read: powers from the right, then the sign."""
        mods, sign, term = now["mods"], now["sign"], now["term"]
        raised = F.aggregate(F.reverse(mods["powers"]), base, lambda value, below: _power(below, value))
        signed = bound(raised, lambda v: F.when(mods["neg"], F.try_subtract(F.lit(0).cast("bigint"), v)).otherwise(v))
        operand = F.when(mods.isNull(), base).otherwise(within(signed))
        product = F.when(sign == "*", F.try_multiply(term, operand)).otherwise(bound(operand, lambda v: _quotient(sign, term, v)))
        return F.when(sign.isNull(), operand).otherwise(within(product))

    def closed(now: Column, base: Column) -> Column:
        added = lambda v: F.when(now["minus"], F.try_subtract(now["total"], v)).otherwise(F.try_add(now["total"], v))
        return within(bound(settled(now, base), added))

    def operated(now: Column, base: Column, sign: Column) -> Column:
        """An operator after an operand."""
        total, minus, term, before, mods, stack = (now[name] for name in [*outer, "stack"])
        powers = F.array_append(F.coalesce(mods["powers"], empty), base)
        return (
            F.when(sign.isin("+", "-"), state(closed(now, base), sign == "-", nothing, no_sign, plain, stack, nothing))
            .when(sign == _POWER, state(total, minus, term, before, modified(F.coalesce(mods["neg"], no), powers), stack, nothing))
            .otherwise(state(total, minus, settled(now, base), sign, plain, stack, nothing))
        )

    def character(now: Column, sign: Column) -> Column:
        """Brackets, and signs before an operand; a null state is a fault."""
        total, minus, term, before, mods, stack, base = (now[name] for name in [*outer, "stack", "base"])
        pushed = F.array_append(stack, F.struct(*[now[name].alias(name) for name in outer]))
        negated = modified(~F.coalesce(mods["neg"], no), F.coalesce(mods["powers"], empty))

        def popped(value: Column) -> Column:
            rest = F.slice(stack, F.lit(1), F.size(stack) - 1)
            under = lambda top: state(*[top[name] for name in outer], rest, value)
            return F.when(value.isNotNull(), bound(F.try_element_at(stack, F.lit(-1)), under))

        opened = state(F.lit(0).cast("bigint"), no, nothing, no_sign, plain, pushed, nothing)
        return (
            F.when(now.isNull() | (sign == ""), now)
            .when(sign == "(", F.when(F.size(stack) < DEEPEST, opened))
            .when(sign == ")", F.when(F.size(stack) > 0, bound(closed(now, base), popped)))
            .when(base.isNotNull(), operated(now, base, sign))
            .when(sign == "-", state(total, minus, term, before, negated, stack, nothing))
            .otherwise(now)
        )

    def step(now: Column, read: Column) -> Column:
        base, signs = read["number"], read["signs"]
        given = state(*[now[name] for name in [*outer, "stack"]], base)
        return (
            F.when(now.isNull(), now)
            .when((F.length(signs) == 1) & (signs != ")"), operated(now, base, signs))
            .otherwise(F.aggregate(F.split(signs, ""), given, character))
        )

    none_open = F.array().cast("array<struct<total:bigint,minus:boolean,term:bigint,sign:string,mods:struct<neg:boolean,powers:array<bigint>>>>")
    start = state(F.lit(0).cast("bigint"), no, nothing, no_sign, plain, none_open, nothing)
    numbers = F.split(F.rtrim(text, F.lit(")")), "[^0-9]+").cast("array<bigint>")  # of 15 digits at most
    signs = F.slice(F.split(text, "[0-9]+"), 2, LONGEST)
    read = F.zip_with(numbers, signs, lambda number, after: F.struct(number.alias("number"), after.alias("signs")))
    finish = lambda end: F.when(F.size(end["stack"]) == 0, closed(end, end["base"]).cast("string"))
    return F.aggregate(read, start, step, finish)
