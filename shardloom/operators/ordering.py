"""Ordered operators that never need a single-task window.

Order is semantic in this engine: token offsets, batch numbers and consecutive-sample counts all
depend on everything that came before. A plain ``Window.orderBy`` would put a whole source (or
one hot run) into one task. The functions here work on blocks of the order key instead: block
totals are aggregated map-side, a running window goes over the totals only, and each block then
runs its own window in parallel. Blocks are value ranges of a *unique* bigint key, so a block of
``2**k`` key values holds at most ``2**k`` rows whatever the skew, and the result does not depend
on partitioning or on task retries.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.arrays import whole_div

# Bits of the order key below which rows (first) and block totals (then) share a window: at most
# 1,024 rows, then 2**20 totals, then 2**20 more for keys below 2**50.
DENSE_LEVELS = (10, 30)
# For an order key shared by many groups, whose rows lie thin in it: longer blocks keep the totals
# few, and a block of the busiest group still has at most 2**20 rows.
SHARED_LEVELS = (20, 40)
# For keys spread evenly over 60 bits (hashes): 2**20 blocks of equal expected size.
HASH_LEVELS = (40,)

_FOLD = {"sum": F.sum, "max": F.max}


def prefix_scan(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    outputs: Mapping[str, tuple[str, Column]],
    *,
    tie: Sequence[str] = (),
    levels: Sequence[int] = DENSE_LEVELS,
    inclusive: bool = True,
    together: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add running ``sum`` / ``max`` columns per ``keys`` in the order of a bigint column.

    Each block starts with a row that carries the fold of everything before it, so the rows are
    shuffled once and never joined. ``together`` names the level whose blocks share a task (its
    output is then contiguous in key order); by default every finest block may go anywhere. They go to
    as many ``partitions``; by default adaptive execution decides, which weighs only what is shuffled.

    ``rows`` is evaluated twice (totals, then rows): pass something cheap or materialised.
    Keys must not be null. Keys above 2**50 need a third level, ``levels=(10, 30, 50)``.
    """
    keys = list(keys)
    blocks = [f"__block{i}" for i in range(len(levels))]
    values = {name: f"__value_{name}" for name in outputs}
    fold = {name: _FOLD[spec[0]] for name, spec in outputs.items()}
    numbered = rows.select(
        "*",
        F.col(order).cast("bigint").alias("__order"),
        F.lit(1).alias("__is_row"),
        *[F.shiftright(F.col(order).cast("bigint"), bits).alias(b) for bits, b in zip(levels, blocks)],
        *[spec[1].alias(values[name]) for name, spec in outputs.items()],
    )
    group = lambda names: names or [F.lit(0)]

    # Totals per block, finest level first; then what lies before each block, coarsest first.
    totals, current = [], numbered
    for i in range(len(blocks)):
        current = current.groupBy(*keys, *blocks[i:]).agg(*[fold[n](values[n]).alias(values[n]) for n in outputs])
        totals.append(current)
    start = None
    for i in reversed(range(len(blocks))):
        step = totals[i].select("*", F.col(blocks[i]).alias("__order"), F.lit(1).alias("__is_row"))
        if start is not None:
            step = step.unionByName(start, allowMissingColumns=True)
        before = (
            Window.partitionBy(*group([*keys, *blocks[i + 1 :]]))
            .orderBy(*(["__order"] if start is None else ["__is_row", "__order"]))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        start = (
            step.select("*", *[fold[n](values[n]).over(before).alias(f"__before_{n}") for n in outputs])
            .where("__is_row = 1")
            .select(
                *keys,
                *blocks[i:],
                F.lit(0).alias("__is_row"),
                *[F.col(f"__before_{n}").alias(values[n]) for n in outputs],
            )
        )

    everything = numbered.unionByName(start, allowMissingColumns=True)
    if together is not None:
        dealt = [] if partitions is None else [partitions]
        everything = everything.repartition(*dealt, *[F.col(c) for c in (*keys, *blocks[together:])])
    frame = (
        Window.partitionBy(*keys, *blocks)
        .orderBy("__is_row", "__order", *tie)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    found = {n: fold[n](values[n]).over(frame) for n in outputs}
    found = {n: F.coalesce(c, F.lit(0)) if outputs[n][0] == "sum" else c for n, c in found.items()}
    return (
        everything.select("*", *[c.alias(f"__out_{n}") for n, c in found.items()])
        .where("__is_row = 1")
        .select(*rows.columns, *[F.col(f"__out_{n}").alias(n) for n in outputs])
    )


def dense_index(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str = "idx",
    *,
    tie: Sequence[str] = (),
    levels: Sequence[int] = DENSE_LEVELS,
) -> DataFrame:
    """0-based position of each row within ``keys``, in key order."""
    scanned = prefix_scan(rows, keys, order, {out: ("sum", F.lit(1))}, tie=tie, levels=levels)
    return scanned.withColumn(out, F.col(out).cast("bigint") - 1)


def order_hash(seed: int, *key: Column) -> Column:
    """60 bits of md5("seed:key"): a seeded order that any engine can recompute."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def seeded_permutation(
    rows: DataFrame, seed: int, key: Sequence[str], keys: Sequence[str] = (), out: str = "pos"
) -> DataFrame:
    """Seeded shuffle: ``out`` is each row's place in the permutation (per ``keys``)."""
    hashed = rows.withColumn("__hash", order_hash(seed, *[F.col(k) for k in key]))
    return dense_index(hashed, keys, "__hash", out, tie=key, levels=HASH_LEVELS).drop("__hash")


def first_by_hash(
    rows: DataFrame,
    seed: int,
    key: Sequence[str],
    quota: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
) -> DataFrame:
    """The first rows per class in seeded order, as many as ``quota`` grants.

    ``keys`` name classes, a handful of values; ``quota`` turns (keys, n_rows) into (keys, quota).
    Hashes of the keys alone give each class its cutoff: rows are counted per hash block, and the
    block that holds the last wanted row is ranked. The wide rows are then read once and compared
    with their class's cutoff; nothing is written, and no wide row is shuffled.
    """
    keys = list(keys)
    hashed = rows.withColumn("__hash", order_hash(seed, *[F.col(k) for k in key]))
    narrow = hashed.select(*{k: None for k in (*keys, *key)}, "__hash", F.shiftright("__hash", HASH_LEVELS[0]).alias("__block"))
    counts = narrow.groupBy(*keys, "__block").agg(F.count("*").alias("n_rows"))
    granted = quota(counts.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"))).select(*keys, "quota").where("quota > 0")
    through = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    last_block = (
        counts.withColumn("__upto", F.sum("n_rows").over(through))
        .join(F.broadcast(granted), keys)  # one row per class
        .where("__upto >= quota AND __upto - n_rows < quota")
        .select(*keys, "__block", (F.col("quota") - F.col("__upto") + F.col("n_rows")).alias("__nth"))
    )
    place = F.struct("__hash", *key)
    within = Window.partitionBy(*keys).orderBy("__hash", *key)
    cutoff = (
        narrow.join(F.broadcast(last_block), [*keys, "__block"])  # one row per class
        .withColumn("__rank", F.row_number().over(within))
        .where("__rank = __nth")
        .select(*keys, place.alias("__cutoff"))
    )
    # A class that is granted all its rows or more may have no cutoff.
    limits = granted.select(*keys).join(cutoff, keys, "left")
    return (
        hashed.join(F.broadcast(limits), keys)  # one row per class
        .where(F.col("__cutoff").isNull() | (place <= F.col("__cutoff")))
        .select(*rows.columns)
    )


def with_halo(rows: DataFrame, index: str, reach: int, block_rows: int) -> DataFrame:
    """Copy the last ``reach`` rows of each index block into the next block.

    Adds ``__window_block`` (where the copy is evaluated) and ``__home`` (false for copies), so that a
    sliding frame of ``reach`` preceding rows is complete inside every block.
    """
    if reach >= block_rows:
        raise ValueError("the frame must be shorter than a block")
    home = whole_div(F.col(index), block_rows)
    tail = F.col(index) % block_rows >= F.lit(block_rows - reach)
    targets = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    return rows.withColumn("__window_block", F.explode(targets)).withColumn(
        "__home", F.col("__window_block") == home
    )


def newest(rows: DataFrame, keys: Sequence[str], order: str, n: int, *, tie: Sequence[str] = ()) -> DataFrame:
    """Last ``n`` rows per key. Spark limits each map partition first (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(t) for t in tie])
    return rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")
