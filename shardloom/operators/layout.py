"""Training layout: sequences, batches per rank, weighted mixing, resumable position."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.functions.arrays import document_ids, document_runs, inputs_of, labels_of, whole_div
from shardloom.session import folders_done, materialize, ship_package


def shard_lengths(segments: DataFrame) -> DataFrame:
    return segments.groupBy("source", "split", "shard_id").agg(
        F.max(F.col("seg_start") + F.col("n_tok")).alias("shard_len")
    )


def assemble_sequences(segments: DataFrame, T: int) -> DataFrame:
    """Windows of T+1 tokens at multiples of T inside each shard: (source, split, shard_id, seq, tokens).

    The token at a multiple of T belongs to two windows (last label of one, first input of the
    next). Each group holds at most T+1 tokens, however large the shard.
    """
    start = F.col("seg_start")
    end = start + F.size("tokens")
    first = whole_div(F.greatest(start - 1, F.lit(0)), T)
    last = whole_div(end - 1, T)

    def part(seq):
        low = F.greatest(start, seq * T)
        high = F.least(end, seq * T + (T + 1))
        ids = F.slice("tokens", (low - start + 1).cast("int"), (high - low).cast("int"))
        return F.struct(seq.alias("seq"), low.alias("at"), ids.alias("part"))

    parts = segments.select(
        "source", "split", "shard_id", F.inline(F.transform(F.sequence(first, last), part))
    )
    grouped = parts.groupBy("source", "split", "shard_id", "seq").agg(
        F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts")
    )
    return grouped.select(
        "source", "split", "shard_id", "seq", F.flatten(F.col("parts.part")).alias("tokens")
    )


def batch_positions(lengths: DataFrame, B: int, T: int, ranks: int) -> DataFrame:
    """Where every rank reads: (source, split, shard_id, seq, rank, shard_k, b), from shard lengths alone.

    Rank r reads its batch k of a shard at B*T*(r + k*ranks). The first is always read; a later one
    only if a whole round still fits after its own start, so higher ranks may leave a shard a
    round earlier than rank 0. Windows cut off by the shard end are not batches and stay out.
    """
    step = B * T
    whole = whole_div(F.col("shard_len") - 1, step)
    slots = lengths.where(whole > 0).select(
        "source", "split", "shard_id", "shard_len", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("slot")
    )
    another_round = F.col("slot") * step + (step * ranks + 1) <= F.col("shard_len")
    shard_k = whole_div(F.col("slot"), ranks)
    return (
        slots.where((shard_k == 0) | another_round)
        .select(
            "source",
            "split",
            "shard_id",
            (F.col("slot") % ranks).cast("int").alias("rank"),
            shard_k.alias("shard_k"),
            "slot",
            F.explode(F.sequence(F.lit(0), F.lit(B - 1))).alias("b"),
        )
        .withColumn("seq", F.col("slot") * B + F.col("b"))
        .drop("slot")
    )


def with_tokens(positions: DataFrame, segments: DataFrame, T: int) -> DataFrame:
    """Adds the T+1 tokens of each (source, split, shard_id, seq). Segments are dealt by those four,
    once; the positions, which may repeat, come to them.

    The join is named: the planner sizes exploded positions as the few shards they come from, and
    would collect a row per sequence on the driver to broadcast it. A merge join can spill both sides.
    """
    keys = ["source", "split", "shard_id", "seq"]
    return positions.hint("merge").join(assemble_sequences(segments, T), keys)


def deal_batches(segments: DataFrame, B: int, T: int, ranks: int, lengths: DataFrame | None = None) -> DataFrame:
    """``batch_positions`` with their tokens. ``lengths`` may come from a manifest; otherwise they are
    counted from the segments' places, without reading tokens."""
    # Written, so the planner knows its size: a row per shard, broadcast only while it is small.
    lengths = materialize(shard_lengths(segments) if lengths is None else lengths, "shard-lengths")
    return with_tokens(batch_positions(lengths, B, T, ranks), segments, T).drop("seq")


def number_batches(dealt: DataFrame) -> DataFrame:
    """Add ``k``: the rank's batch number over all shards of a source and split, in shard order.

    Batches per (shard, rank) are counted first, so the running window sees one row per shard.
    """
    per_shard = dealt.groupBy("source", "split", "rank", "shard_id").agg(
        (F.max("shard_k") + 1).alias("n_batches")
    )
    before = (
        Window.partitionBy("source", "split", "rank")
        .orderBy("shard_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_shard.select(
        "source", "split", "rank", "shard_id", F.coalesce(F.sum("n_batches").over(before), F.lit(0)).alias("k0")
    )
    offsets = materialize(offsets, "batch-offsets")
    return dealt.join(offsets, ["source", "split", "rank", "shard_id"]).withColumn(
        "k", (F.col("k0") + F.col("shard_k")).cast("bigint")
    ).drop("k0")


def shift_labels(sequences: DataFrame, ids: str = "tokens") -> DataFrame:
    """x is all but the last token, y all but the first."""
    return sequences.withColumn("x", inputs_of(F.col(ids))).withColumn("y", labels_of(F.col(ids))).drop(ids)


def with_document_ids(sequences: DataFrame, ids: str = "x") -> DataFrame:
    return sequences.withColumn("doc_ids", document_ids(F.col(ids)))


def attention_runs(sequences: DataFrame, ids: str = "x") -> DataFrame:
    """Allowed (query, key) pairs in interval form: inside a run, position p sees [first, p].

    The pairs are never emitted; a run of n positions stands for n(n+1)/2 of them.
    """
    others = [c for c in sequences.columns if c != ids]
    runs = sequences.select(*others, F.inline(document_runs(F.col(ids))))
    n = (F.col("last") - F.col("first") + 1).cast("bigint")
    return runs.withColumn("n_pairs", (n * (n + 1) / 2).cast("bigint"))


STRETCH = 1 << 20  # picks between two states


def _walk(weights: Sequence[float], credit: list[float], used: list[int], n: int, picked: list[int] | None = None) -> list[float]:
    """Credits after n picks: everyone earns its weight, the richest (first on ties) pays 1.

    ``used`` is advanced in place, and ``picked`` collects the sources' numbers. Each addition is
    rounded as it would be alone, since ties depend on it.
    """
    for _ in range(n):
        credit = [c + w for c, w in zip(credit, weights)]
        best = credit.index(max(credit))
        credit[best] -= 1.0
        used[best] += 1
        if picked is not None:
            picked.append(best)
    return credit


STATE = "mix string, weights array<double>, pick bigint, n_picks bigint, credit array<double>, used array<bigint>"


def mix_states(mixes: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The state before every ``stretch``-th pick, and after the last: one row each, written.

    (mix, weights, pick, n_picks, credit, used): ``n_picks`` are to be made from this state before the
    next one; the closing state has 0. Each pick depends on the rounding of all before it, so this walk
    over a few doubles is sequential per mix; it emits states only. Any row with the picks wanted as
    ``n_picks`` is a schedule to be continued. ``mixes`` may carry such a state (pick, credit, used).
    """
    ship_package(mixes.sparkSession)
    zero = F.transform("weights", lambda w: F.lit(0.0))
    saved = set(mixes.columns)
    rows = mixes.select(
        "mix",
        "weights",
        (F.col("pick") if "pick" in saved else F.lit(0)).cast("bigint").alias("pick"),
        F.col("n_picks").cast("bigint").alias("n_picks"),
        (F.col("credit") if "credit" in saved else zero).alias("credit"),
        (F.col("used") if "used" in saved else zero).cast("array<bigint>").alias("used"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in STATE.split(", ")]
        for batch in batches:
            for row in batch.itertuples(index=False):
                weights, credit, used = list(row.weights), list(row.credit), list(row.used)
                for low in [*range(0, row.n_picks, stretch), row.n_picks]:
                    n = min(stretch, row.n_picks - low)
                    yield pd.DataFrame([(row.mix, weights, row.pick + low, n, credit, used)], columns=names)
                    used = list(used)
                    credit = _walk(weights, credit, used, n)

    return materialize(rows.mapInPandas(run, STATE), "mix-states")


def expand_states(states: DataFrame) -> DataFrame:
    """(mix, pick, source_no, ordinal) of all stretches, each a row of ``states`` and a partition of
    its own, so stretches run side by side and none emits more than its picks."""
    ship_package(states.sparkSession)
    chunk = 1 << 17

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                weights, credit, used = list(row.weights), list(row.credit), [0] * len(row.weights)
                before = np.array(row.used, dtype=np.int64)
                for low in range(0, row.n_picks, chunk):
                    picked: list[int] = []
                    credit = _walk(weights, credit, used, min(chunk, row.n_picks - low), picked)
                    source = np.array(picked)
                    ordinal = np.empty(len(source), np.int64)
                    for i in range(len(weights)):
                        own = source == i
                        ordinal[own] = before[i] + np.arange(np.count_nonzero(own))
                        before[i] += np.count_nonzero(own)
                    pick = row.pick + low + np.arange(len(source))
                    yield pd.DataFrame({"mix": row.mix, "pick": pick, "source_no": source.astype(np.int32), "ordinal": ordinal})

    open_ = states.where("n_picks > 0")
    # A number of states, from a written table; a partition each, dealt round.
    return open_.repartition(max(open_.count(), 1)).mapInPandas(run, "mix string, pick bigint, source_no int, ordinal bigint")


def mix_schedule(mixes: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Weighted round-robin: (mix, weights array<double>, n_picks) -> (mix, pick, source_no, ordinal).

    First the states at every ``stretch``-th pick, then all stretches in parallel. A saved state
    (``mix_cursor``) continues where it stopped. The result is written, so that the join to the
    batches (on source and ordinal) is planned with its real size.
    """
    return materialize(expand_states(mix_states(mixes, stretch)), "mix-schedule")


def mix_cursor(mixes: DataFrame) -> DataFrame:
    """The state after ``n_picks``: (mix, weights, pick, credit, used), one row per schedule."""
    return mix_states(mixes).where("n_picks = 0").drop("n_picks")


CURSOR = (
    "mix string, weights array<double>, pick bigint, credit array<double>, used array<bigint>, source string, "
    "source_no int, rank int, next_shard bigint, next_pos bigint, epoch bigint"
)


def mixed_cursor(state: DataFrame, numbered: DataFrame, sources: Sequence[str], B: int, T: int, ranks: int) -> DataFrame:
    """Where a mixed schedule stands: its state, and per source and rank the batch read next.

    ``state`` is ``mix_cursor``'s, ``numbered`` the numbered positions of one split. A source read n
    times has its rank at batch n modulo its batches, in epoch n divided by them.
    """
    names = F.array(*[F.lit(s) for s in sources])
    read = state.select("*", F.posexplode("used").alias("source_no", "reads")).withColumn("source", F.get(names, F.col("source_no")))
    heads = numbered.where("b = 0").select("source", "rank", "shard_id", "shard_k", "k")
    sizes = heads.groupBy("source", "rank").agg(F.count("*").alias("n_all"))
    # A row per mix, source and rank.
    wanted = read.join(F.broadcast(sizes), "source").withColumn("k", F.col("reads") % F.col("n_all"))
    at = (F.col("rank") + F.col("shard_k") * ranks) * (B * T)
    placed = heads.join(F.broadcast(wanted), ["source", "rank", "k"])
    return placed.select(
        "mix", "weights", "pick", "credit", "used", "source", F.col("source_no").cast("int").alias("source_no"), "rank",
        F.col("shard_id").alias("next_shard"), at.alias("next_pos"), whole_div(F.col("reads"), F.col("n_all")).alias("epoch"),
    )


def save_cursor(cursor: DataFrame, path: str, version: int) -> None:
    """Write a cursor as a version of its own; saving a version again replaces it. A version counts
    once its success marker stands, so a save that dies leaves the one before in force."""
    cursor.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version:012d}")


def load_cursor(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest complete version, or the one named; without any it is an error."""
    done = sorted(folders_done(spark, path, "version="))
    if version is not None:
        done = [d for d in done if d == version]
    if not done:
        raise FileNotFoundError(f"no complete cursor in {path}")
    return spark.read.schema(CURSOR).parquet(f"{path}/version={done[-1]:012d}")


def resumed_schedule(cursor: DataFrame, n_picks: int, sources: Sequence[str]) -> DataFrame:
    """(pick, source, ordinal) of the next ``n_picks`` of a saved cursor's schedule."""
    state = cursor.select("mix", "weights", "pick", "credit", "used").distinct().withColumn("n_picks", F.lit(n_picks))
    names = F.array(*[F.lit(s) for s in sources])
    return mix_schedule(state).select("pick", F.get(names, F.col("source_no")).alias("source"), "ordinal")


def pruned_segments(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """``segments`` of the shards that ``wanted`` positions lie in: a condition on their numbers per
    source and split (a few rows), which written shards answer from folder names and file footers."""
    spans = wanted.groupBy("source", "split").agg(F.collect_set("shard_id").alias("ids")).collect()
    if not spans:
        return segments.limit(0)
    of = lambda r: (F.col("source") == r["source"]) & (F.col("split") == r["split"]) & _in_runs(sorted(r["ids"]))
    condition = of(spans[0])
    for r in spans[1:]:
        condition = condition | of(r)
    return segments.where(condition)


def _in_runs(ids: list[int]) -> Column:
    """Membership in sorted shard numbers, as ranges of neighbours."""
    runs: list[list[int]] = []
    for i in ids:
        if runs and i == runs[-1][1] + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    found = F.lit(False)
    for low, high in runs:
        found = found | F.col("shard_id").between(low, high)
    return found


def scheduled_batches(schedule: DataFrame, batches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The i-th pick of a source takes its i-th batch.

    The key holds the ordinal, so a source with most of the weight is no hot key; whether the
    schedule is small enough to broadcast is left to AQE's measured sizes.
    """
    return schedule.join(batches, ["source", *by, "ordinal"])


def repeat_epochs(rows: DataFrame, epochs: int, index: str, n_rows: str) -> DataFrame:
    """Start again from the first row: adds ``epoch`` and the position in the endless stream."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn(
        "stream_pos", F.col("epoch") * F.col(n_rows) + F.col(index)
    )


def step_limit(max_steps: int, epochs: int, steps_per_epoch: int) -> int:
    return max_steps if max_steps else steps_per_epoch * epochs


def step_cap(batches: DataFrame, max_steps: int, epochs: int, steps_per_epoch: int, batch: str = "batch") -> DataFrame:
    return batches.where(F.col(batch) < step_limit(max_steps, epochs, steps_per_epoch))


def loader_cursor(dealt: DataFrame, B: int, T: int, ranks: int, reads: int) -> DataFrame:
    """Where each rank stands after ``reads`` batches: (source, split, rank, next_shard, next_pos).

    The position of the batch that would be read next; past the last one it wraps to the start.
    """
    heads = number_batches(dealt.where("b = 0").select("source", "split", "rank", "shard_id", "shard_k", "b"))
    sizes = heads.groupBy("source", "split", "rank").agg(F.count("*").alias("n_all"))
    at = (F.col("rank") + F.col("shard_k") * ranks) * (B * T)
    return (
        heads.join(sizes, ["source", "split", "rank"])
        .where(F.col("k") == F.lit(reads) % F.col("n_all"))
        .select("source", "split", "rank", F.col("shard_id").alias("next_shard"), at.alias("next_pos"))
    )


def resume_after(dealt: DataFrame, cursor: DataFrame, B: int, T: int, ranks: int) -> DataFrame:
    """Batches at or behind the saved position, the rest of the running epoch.

    A cursor has one row per source, split and rank; the planner decides how to join it.
    """
    keys = ["source", "split", "rank"]
    at = (F.col("rank") + F.col("shard_k") * ranks) * (B * T)
    later = (F.col("shard_id") > F.col("next_shard")) | (
        (F.col("shard_id") == F.col("next_shard")) & (at >= F.col("next_pos"))
    )
    return dealt.join(cursor, keys).where(later).drop("next_shard", "next_pos")
