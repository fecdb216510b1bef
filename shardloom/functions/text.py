"""String expressions (all native, inside codegen where Spark allows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shardloom.constants import WHITESPACE


def strip(text: Column) -> Column:
    """Unicode-aware strip; Spark's plain ``trim`` removes spaces only."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_filled(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def before_last(text: Column, mark: str) -> Column:
    """Everything before the last ``mark``; the whole text if there is none."""
    tail = F.substring_index(text, mark, -1)
    cut = F.length(text) - F.length(tail) - len(mark)
    return F.when(F.contains(text, F.lit(mark)), F.left(text, cut)).otherwise(text)


def fixed1(x: Column) -> Column:
    """``x`` with one decimal, rounded as C and Python do (exact value, ties to even).

    Java's ``%.1f`` rounds the shortest decimal text half up, so 6.25 would become 6.3. Here
    10x = 8x + 2x with both terms exact; the rounding error of their sum decides near-ties.
    """
    a, b = x * 8.0, x * 2.0
    s = a + b
    other = s - a
    error = (a - (s - other)) + (b - other)
    low = F.floor(s)
    rest = s - low
    up = (rest > 0.5) | ((rest == 0.5) & (error > 0)) | ((rest == 0.5) & (error == 0) & (low % 2 == 1))
    tenths = F.when(up, low + 1).otherwise(low).cast("bigint")
    return F.concat(F.floor(tenths / F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def hours_minutes(seconds: Column) -> Column:
    whole = F.floor(seconds)
    text = F.format_string(
        "%dh%02dm",
        F.floor(whole / F.lit(3600)).cast("bigint"),
        F.floor((whole % 3600) / F.lit(60)).cast("bigint"),
    )
    return F.when(seconds.isNotNull(), text)  # format_string prints nulls


def shard_name(prefix: Column, split: Column, shard_id: Column) -> Column:
    return F.format_string("%s_%s_%06d", prefix, split, shard_id)


def python_number(x: Column) -> Column:
    """A double as the text Python prints, whole numbers in full and without ``.0``.

    Whole numbers from 2**59 to 2**116 are split at 2**53 and put together as exact decimals; a
    cast would go through the shortest text and end in zeros.
    """
    text = x.cast("string")
    size = F.abs(x)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    plain = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    step = float(2**53)
    high = F.floor(size / step)
    low = (size - high.cast("double") * step).cast("bigint")
    wide = high.cast("decimal(20,0)") * F.lit(2**53).cast("decimal(16,0)") + low.cast("decimal(16,0)")
    big = F.concat(F.when(x < 0, "-").otherwise(""), wide.cast("string"))
    return (
        F.when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when((size >= 2.0**59) & (size < 2.0**116), big)
        .when((size < 2.0**59) & (x == F.floor(x)), x.cast("bigint").cast("string"))
        .when(size < 1e-4, F.concat(mantissa, F.format_string("e-%02d", -exponent)))
        .when(F.contains(text, F.lit("E")) & (size < 1e16), plain)
        .otherwise(text)
    )
