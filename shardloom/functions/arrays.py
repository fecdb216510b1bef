"""Array expressions on token ids and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardloom.constants import EOT, MAX_ID, PAD

EMPTY = "array<int>"


def whole_div(a: Column, b: Column | int) -> Column:
    """Exact bigint division (``floor(a / b)`` would go through doubles); truncates toward 0."""
    return F.call_function("div", a.cast("bigint"), (F.lit(b) if isinstance(b, int) else b).cast("bigint"))


def char_ids(text: Column) -> Column:
    """The native vocabulary: one id per character, its code point."""
    chars = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    return F.when(text == "", F.array().cast(EMPTY)).otherwise(chars)


def filled(value: Column | int, count: Column) -> Column:
    item = F.lit(value) if isinstance(value, int) else value
    return F.array_repeat(item, F.greatest(count, F.lit(0)).cast("int"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def occurrences(ids: Column, value: int) -> Column:
    """How often ``value`` is among the ids. They are filtered, which boxes every id, only if it is there
    more than once."""
    first = F.array_position(ids, value)
    again = F.array_contains(F.slice(ids, (first + 1).cast("int"), F.size(ids)), value)
    return F.when(first == 0, 0).when(~again, 1).otherwise(F.size(F.filter(ids, lambda t: t == value)))


def ids_in_range(ids: Column, limit: int = MAX_ID) -> Column:
    return F.forall(ids, lambda t: (t >= 0) & (t <= limit))


def widen(ids: Column) -> Column:
    return ids.cast("array<bigint>")


def inputs_of(seq: Column) -> Column:
    return F.slice(seq, 1, F.greatest(F.size(seq) - 1, F.lit(0)))


def labels_of(seq: Column) -> Column:
    return F.slice(seq, 2, F.greatest(F.size(seq) - 1, F.lit(0)))


def pad_to(values: Column, length: Column, fill: int = PAD) -> Column:
    return F.concat(values, filled(fill, length - F.size(values)))


def joined(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), " ")


def digest(values: Column) -> Column:
    """A short comparable form of a long id array."""
    return F.md5(joined(values))


def document_runs(ids: Column) -> Column:
    """Runs of one document inside a sequence: array of (doc, first, last), 0-based positions.

    ``doc`` is the running count of separators including the position itself, so a sequence that
    starts inside a document begins with run 0.
    """
    n = F.size(ids)
    marks = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(ids, i) == EOT)
    starts = F.concat(F.array(F.lit(0)), marks)
    ends = F.concat(F.transform(marks, lambda m: m - 1), F.array(n - 1))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("first"), e.alias("last")))
    numbered = F.transform(runs, lambda r, i: F.struct(i.alias("doc"), r["first"].alias("first"), r["last"].alias("last")))
    return F.filter(numbered, lambda r: r["last"] >= r["first"])


def document_ids(ids: Column) -> Column:
    """Running separator count per position, from the runs (linear, no per-token rows)."""
    return F.flatten(
        F.transform(document_runs(ids), lambda r: F.array_repeat(r["doc"], r["last"] - r["first"] + 1))
    )
