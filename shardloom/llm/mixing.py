"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and ``cap`` whose taken words meet each source's target, the
method picks those of least relative entropy to a rate of one half of the cap. The convex dual has
one multiplier per source and the rates are exponentially tilted by size:
``rate = cap / (1 + exp(-multiplier * size / mean size))``. Newton's steps run as Spark jobs over
the histogram of sizes per source; sums are taken over scaled integers, so they don't depend on the
order in which tasks end and reruns agree.

Rates become whole copies: everyone gets the whole part, and what is missing to a source's target
is filled with one more copy of documents in the order of (hash / fractional part), which favours
large fractions. The cut is found over totals per coarse block of that order, then per fine block
within the one that holds it; rows are ordered only within that fine block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import WORD, bounded, text_or_empty
from shardloom.session import materialize

WEIGHTS = (5, 2, 1)
CAP = 2
SCALE = 1024  # fractions of a word kept in a histogram row's share of a sum
BLOCKS = 1 << 20  # of the order in which fractions are filled up, per unit of it
COARSE = 12  # bits of blocks that are summed together first
MAX_STEPS = 60


def n_words(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int], percent: int) -> DataFrame:
    """Adds weight and target to (source, source_size), one row per source.

    Sources are ranked by code point, null last. A source is full at ``CAP`` times its size. In the
    order of that limit per weight, full sources come first; the others share the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("_weight", weight.cast("bigint")).withColumn("_limit", F.col("source_size") * CAP)
    by_limit = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, whole = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest_weight = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    rest_words = F.sum("source_size").over(whole) * percent / 100 - F.coalesce(F.sum("_limit").over(before), F.lit(0))
    rows = rows.withColumn("_level", rest_words / rest_weight)
    rows = rows.withColumn("_full", F.col("_limit") <= F.col("_weight") * F.col("_level"))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(whole)
    share = F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(F.col("_weight") * level)
    return rows.select("*", share.alias("target"))


def rate(multiplier: Column, size: Column, mean: Column) -> Column:
    return F.lit(float(CAP)) / (1 + F.exp(-multiplier * size / mean))


def solve(histogram: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds the dual multiplier to every source with a target strictly between 0 and its limit.

    Newton's step is kept inside the bracket of the earlier steps (halved or doubled otherwise), so
    the iteration cannot run away for sources whose target lies near a limit.
    """
    open_ended = (F.col("target") > 0) & (F.col("target") < F.col("_limit"))
    state = sources.select(
        "*",
        F.lit(0.0).alias("_m"),
        F.lit(None).cast("double").alias("_low"),
        F.lit(None).cast("double").alias("_high"),
        open_ended.alias("_open"),
        F.lit(None).cast("double").alias("_gap"),
    )
    state = materialize(state, "mix-state")
    size, mean = F.col("size"), F.col("_mean")
    for _ in range(MAX_STEPS):
        joined = histogram.join(state.where("_open").select("_s", "_m", "_mean"), "_s")
        r = rate(F.col("_m"), size, mean)
        taken = F.round(F.col("_n") * size * r * SCALE).cast("bigint")
        slope = F.round(F.col("_n") * size * size / mean * r * (1 - r / CAP) * SCALE).cast("bigint")
        sums = joined.groupBy("_s").agg((F.sum(taken) / SCALE).alias("_taken"), (F.sum(slope) / SCALE).alias("_slope"))
        stepped = state.drop("_gap").join(sums, "_s", "left").withColumn("_gap", F.col("_taken") - F.col("target"))
        stepped = stepped.withColumn("_low", F.when(F.col("_gap") < 0, F.col("_m")).otherwise(F.col("_low")))
        stepped = stepped.withColumn("_high", F.when(F.col("_gap") > 0, F.col("_m")).otherwise(F.col("_high")))
        newton = F.when(F.col("_slope") > 0, F.col("_m") - F.col("_gap") / F.col("_slope"))
        low, high = F.col("_low"), F.col("_high")
        within = newton.isNotNull() & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        # Without a border on one side, at most one unit or a doubling at a time.
        far = F.abs(newton) > 2 * F.abs(F.col("_m")) + 1
        move = (
            F.when(F.col("_gap").isNull() | (F.col("_gap") == 0), F.col("_m"))
            .when(within & ~far, newton)
            .when(low.isNotNull() & high.isNotNull(), (low + high) / 2)
            .when(F.col("_gap") > 0, F.col("_m") - F.abs(F.col("_m")) - 1)
            .otherwise(F.col("_m") + F.abs(F.col("_m")) + 1)
        )
        still = F.col("_open") & (F.abs(F.col("_gap")) > F.greatest(F.lit(0.5), F.col("target") * 1e-9))
        stepped = stepped.withColumn("_next", F.when(still, move).otherwise(F.col("_m"))).withColumn("_open", still)
        state = materialize(
            stepped.drop("_m", "_taken", "_slope").withColumnRenamed("_next", "_m").select(*state.columns), "mix-state"
        )
        if state.where("_open").isEmpty():
            break
    return state


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150) -> tuple[DataFrame, DataFrame]:
    """Narrow rows of ``docs`` (doc_id, source, size, _s, _h) and, per source, what decides copies.

    A null text has size 0; documents of size 0 keep one copy, which takes no words. A null source
    is a source of its own. Rows equal in id and text get the same place in the order; should the
    cut fall among them, some get one copy more than others.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), *placing())
    rows = materialize(rows, "mix-rows")
    histogram = materialize(rows.groupBy("_s", "source", "size").agg(F.count("*").alias("_n")), "mix-sizes")
    sizes = histogram.groupBy("_s", "source").agg(
        F.sum(F.col("size") * F.col("_n")).alias("source_size"),
        (F.sum(F.col("size") * F.col("_n")) / F.sum(F.when(F.col("size") > 0, F.col("_n")))).alias("_mean"),
    )
    state = solve(histogram.drop("source"), targets(sizes, weights, percent))
    state = state.select("_s", "source_size", "target", "_limit", "_m", "_mean")
    fractional = rows.join(small(state, "mix-solved"), "_s").select("_s", "size", "_h", *rated())
    more = F.sum(F.when(F.col("_part") > 0, F.col("size"))).alias("_more")
    coarse = F.shiftright("_block", COARSE).alias("_block")
    totals = fractional.groupBy("_s", coarse).agg(F.sum(F.col("size") * F.col("_whole")).alias("_sure"), more)
    totals = materialize(totals, "mix-blocks")
    sure = totals.groupBy("_s").agg(F.sum("_sure").alias("_sure"))
    missing = state.join(sure, "_s").select("_s", (F.col("target") - F.col("_sure")).alias("_missing"), F.lit(0).cast("bigint").alias("_start"))
    found = cut(totals, missing).join(missing.drop("_start"), "_s")
    found = found.select("_s", "_missing", F.col("_before").alias("_start"), F.col("_block").alias("_coarse"))
    found = small(found, "mix-coarse")
    inside = fractional.join(found.select("_s", "_coarse"), "_s").where(F.shiftright("_block", COARSE) == F.col("_coarse"))
    found = cut(inside.groupBy("_s", "_block").agg(more), found).join(found.select("_s", "_missing"), "_s")
    # No block reaches the target: only by rounding, and then every fraction is filled up.
    return rows, state.join(found.withColumnRenamed("_block", "_cut_block"), "_s", "left")


def cut(totals: DataFrame, missing: DataFrame) -> DataFrame:
    """(_s, _block, _before): the block of (_s, _block, _more) in which a source's running sum, begun at
    ``_start``, reaches what is missing, and the sum before it. A level has few blocks per source."""
    before = Window.partitionBy("_s").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    lead = totals.select("_s", "_block", F.coalesce("_more", F.lit(0)).alias("_more"), F.sum("_more").over(before).alias("_lead"))
    placed = lead.join(missing, "_s").withColumn("_before", F.col("_start") + F.coalesce("_lead", F.lit(0)))
    reached = (F.col("_before") < F.col("_missing")) & (F.col("_before") + F.col("_more") >= F.col("_missing"))
    first = placed.where(reached).groupBy("_s").agg(F.min(F.struct("_block", "_before")).alias("_cut"))
    return first.select("_s", "_cut.*")


def placing() -> list[Column]:
    """A non-null key of the source, and a hash that orders documents."""
    return [
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("_s"),
        F.xxhash64(F.lit("mix"), "doc_id", "text").alias("_h"),
    ]


def small(state: DataFrame, name: str) -> DataFrame:
    """The table of sources, broadcast while it is below 8 MB."""
    return bounded(state, name, 8 << 20, 200)


def rated() -> list[Column]:
    """Whole copies, the fraction left, and the order in which fractions are filled up."""
    at = (
        F.when(F.col("target") >= F.col("_limit"), F.lit(float(CAP)))
        .when(F.col("size") == 0, F.lit(1.0))
        .otherwise(rate(F.col("_m"), F.col("size"), F.col("_mean")))
    )
    whole, part = F.floor(at), at - F.floor(at)
    chance = (F.shiftrightunsigned(F.col("_h"), 11) + 0.5) / float(1 << 53)
    order = F.when(part > 0, chance / part)
    block = F.least(F.coalesce(F.floor(order * BLOCKS), F.lit(0)), F.lit(16 * BLOCKS))
    return [whole.alias("_whole"), part.alias("_part"), order.alias("_order"), block.cast("bigint").alias("_block")]


def with_copies(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Adds copies to rows that have size, _s and _h."""
    state = small(state, "mix-cuts")
    joined = rows.join(state, "_s").select(*rows.columns, "source_size", "target", "_cut_block", "_before", "_missing", *rated())
    columns = [*rows.columns, "source_size", "target"]
    has_part = F.col("_part") > 0
    at_cut = has_part & F.col("_cut_block").isNotNull() & (F.col("_block") == F.col("_cut_block"))
    below = has_part & (F.col("_cut_block").isNull() | (F.col("_block") < F.col("_cut_block")))
    sure = joined.where(~at_cut).select(*columns, (F.col("_whole") + below.cast("int")).cast("int").alias("copies"))
    order = Window.partitionBy("_s").orderBy("_order", "_h", "size").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("_before") + F.sum("size").over(order) - F.col("size") / 2
    edge = joined.where(at_cut).select(*columns, (F.col("_whole") + (reached <= F.col("_missing")).cast("int")).cast("int").alias("copies"))
    return sure.unionByName(edge)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken words of every document."""
    rows, state = mixture(docs, weights, percent)
    return with_copies(rows, state).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150) -> DataFrame:
    """``docs`` with each row as often as its copies say, in the columns of ``docs``."""
    _, state = mixture(docs, weights, percent)
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), n_words(F.col("text")).alias("size"), *placing())
    copied = with_copies(keyed, state).where("copies > 0")
    return copied.select("_doc", F.explode(F.sequence(F.lit(1), "copies"))).select("_doc.*")
