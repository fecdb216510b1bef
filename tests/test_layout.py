import random

import pytest
from pyspark.sql import functions as F

from shardloom.constants import EOT
from shardloom.operators import layout as lay
from shardloom.operators import quality


def segments_of(spark, shards):
    """Shards as lists of ids, cut into uneven segments."""
    rng = random.Random(1)
    rows = []
    for (source, split, shard), ids in shards.items():
        at = 0
        while at < len(ids):
            n = rng.randrange(1, 9)
            rows.append((source, split, shard, at, at, len(ids[at : at + n]), ids[at : at + n]))
            at += n
    return spark.createDataFrame(
        rows, "source string, split string, shard_id bigint, seg_start bigint, ord bigint, n_tok int, tokens array<int>"
    )


def reads(lengths, B, T, ranks, rank):
    """What a rank reads in one pass over the shards: (shard, position), skipping windows past the end."""
    out, size = [], B * T
    for shard, length in enumerate(lengths):
        at = size * rank
        while True:
            if at + size + 1 <= length:
                out.append((shard, at))
            at += size * ranks
            if at + size * ranks + 1 > length:
                break
    return out


@pytest.mark.parametrize("ranks", [1, 2, 3])
@pytest.mark.parametrize("base", [24, 36, 48])
def test_deal_batches_equals_sequential_readers(spark, ranks, base):
    B, T = 2, 3
    lengths = [base + d for d in range(-2, 4)]
    shards = {("s", "train", i): list(range(1000 * i, 1000 * i + n)) for i, n in enumerate(lengths)}
    dealt = lay.number_batches(lay.deal_batches(segments_of(spark, shards), B, T, ranks))
    found = {}
    for r in lay.shift_labels(dealt).collect():
        found.setdefault((r["rank"], r.k), {})[r.b] = (r.x, r.y)
    want = {}
    for rank in range(ranks):
        for k, (shard, at) in enumerate(reads(lengths, B, T, ranks, rank)):
            ids = shards["s", "train", shard]
            want[rank, k] = {
                b: (ids[at + b * T : at + b * T + T], ids[at + b * T + 1 : at + b * T + T + 1]) for b in range(B)
            }
    assert found == want


def test_resume_reads_what_is_left(spark):
    B, T, ranks, lengths = 2, 3, 2, [40, 31, 55]
    shards = {("s", "train", i): list(range(n)) for i, n in enumerate(lengths)}
    dealt = lay.deal_batches(segments_of(spark, shards), B, T, ranks)
    for done in (0, 1, 3, 5):
        cursor = lay.loader_cursor(dealt, B, T, ranks, done)
        rest = lay.resume_after(dealt, cursor, B, T, ranks).where("b = 0").collect()
        for rank in range(ranks):
            order = reads(lengths, B, T, ranks, rank)
            mine = sorted((r.shard_id, (rank + r.shard_k * ranks) * B * T) for r in rest if r["rank"] == rank)
            assert mine == order[done % len(order) :]


def picks_of(spark, weights, n):
    mixes = spark.createDataFrame([("m", weights, n)], "mix string, weights array<double>, n_picks bigint")
    rows = sorted((r.pick, r.source_no, r.ordinal) for r in lay.mix_schedule(mixes).collect())
    assert [pick for pick, _, _ in rows] == list(range(n))
    return rows


def test_mix_schedule(spark):
    assert picks_of(spark, [1.0], 3) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]
    assert picks_of(spark, [0.5, 0.5], 0) == []
    # Ties go to the first source; every fourth pick the pattern starts again.
    assert [j for _, j, _ in picks_of(spark, [0.25, 0.25, 0.5], 8)] == [2, 0, 1, 2, 2, 0, 1, 2]
    rows = picks_of(spark, [0.82, 0.18], 2000)
    for n in (50, 100, 1000, 2000):  # whole periods hold each source exactly by weight
        assert sum(j for _, j, _ in rows[:n]) == n * 18 // 100
    for source in (0, 1):
        assert [o for _, j, o in rows if j == source] == list(range(sum(j == source for _, j, _ in rows)))


def test_a_saved_schedule_continues(spark):
    whole = picks_of(spark, [0.82, 0.18], 1500)
    start = spark.createDataFrame([("m", [0.82, 0.18], 700)], "mix string, weights array<double>, n_picks bigint")
    cursor = lay.mix_cursor(start).withColumn("n_picks", F.lit(800))
    rest = sorted((r.pick, r.source_no, r.ordinal) for r in lay.mix_schedule(cursor).collect())
    assert rest == whole[700:]


def test_document_runs(spark):
    rows = [(0, [EOT, 1, 2, EOT, EOT, 3]), (1, [5, 6, EOT]), (2, [7, 8]), (3, [EOT])]
    df = spark.createDataFrame(rows, "seq int, x array<int>")
    ids = {r.seq: r.doc_ids for r in lay.with_document_ids(df).collect()}
    for seq, x in rows:
        assert ids[seq] == [sum(t == EOT for t in x[: i + 1]) for i in range(len(x))]
    pairs = {}
    for r in lay.attention_runs(df).collect():
        pairs[r.seq] = pairs.get(r.seq, 0) + r.n_pairs
    for seq, x in rows:
        d = ids[seq]
        assert pairs[seq] == sum(d[k] == d[q] for q in range(len(x)) for k in range(q + 1))


def test_layout_must_divide(spark):
    params = spark.createDataFrame([(64, 2, 4, 2), (65, 2, 4, 2)], "total_batch bigint, B int, T int, ranks int")
    assert [(r.divides, r.accumulation) for r in quality.check_layout(params).orderBy("total_batch").collect()] == [
        (True, 4),
        (False, None),
    ]
    assert quality.require_layout(params.where("total_batch = 64")).first().accumulation == 4
    with pytest.raises(Exception, match="multiple"):
        quality.require_layout(params).collect()


def test_epochs_and_step_caps(spark):
    rows = spark.range(3).select(F.col("id").alias("i"), F.lit(3).alias("n"))
    assert sorted((r.stream_pos, r.i) for r in lay.repeat_epochs(rows, 2, "i", "n").collect()) == [
        (i, i % 3) for i in range(6)
    ]
    assert lay.step_limit(0, 2, 5000) == 10_000 and lay.step_limit(7, 2, 5000) == 7
    assert lay.step_cap(rows.withColumnRenamed("i", "batch"), 2, 1, 5000).count() == 2


def sequential(weights, n):
    credit, used, out = [0.0] * len(weights), [0] * len(weights), []
    for pick in range(n):
        credit = [c + w for c, w in zip(credit, weights)]
        best = max(range(len(weights)), key=lambda i: (credit[i], -i))
        credit[best] -= 1.0
        out.append((pick, best, used[best]))
        used[best] += 1
    return out


def test_a_schedule_goes_on_from_every_state(spark):
    weights = [0.5, 0.3, 0.2]
    mixes = spark.createDataFrame([("m", weights, 100)], "mix string, weights array<double>, n_picks bigint")
    states = lay.mix_states(mixes, 7)
    assert [r.n_picks for r in states.orderBy("pick", F.desc("n_picks")).collect()] == [7] * 14 + [2, 0]
    want = sequential(weights, 100)
    for pick in (0, 7, 49, 98):
        rest = states.where(f"pick = {pick} AND n_picks > 0").withColumn("n_picks", F.lit(100 - pick))
        assert sorted(tuple(r)[1:] for r in lay.mix_schedule(rest, 11).collect()) == want[pick:]
    two = mixes.union(mixes.withColumn("mix", F.lit("o")).withColumn("n_picks", F.lit(0)))
    assert sorted(tuple(r)[1:] for r in lay.mix_schedule(two, 13).collect()) == want
    assert lay.mix_schedule(mixes.limit(0)).count() == 0


def test_no_task_emits_more_than_a_stretch(spark):
    n, stretch = 1_500_000, 1 << 18
    mixes = spark.createDataFrame([("m", [0.82, 0.18], n)], "mix string, weights array<double>, n_picks bigint")
    rows = lay.expand_states(lay.mix_states(mixes, stretch))
    per_task = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("pick").alias("low"), F.max("pick").alias("high"))
    found = per_task.collect()
    assert max(r.n for r in found) == stretch and sum(r.n for r in found) == n
    assert all(r.high - r.low == r.n - 1 for r in found)
    totals = rows.groupBy("source_no").agg(F.count("*").alias("n"), F.max("ordinal").alias("top"), F.count_distinct("ordinal").alias("d")).collect()
    assert {r.source_no: r.n for r in totals} == {0: n * 82 // 100, 1: n * 18 // 100}
    assert all(r.top == r.n - 1 == r.d - 1 for r in totals)


def test_cursor_versions(spark, tmp_path):
    B, T, ranks, names = 2, 3, 2, ["base", "extra"]
    lengths = {("base", 0): 60, ("base", 1): 45, ("extra", 0): 30}
    shards = {(s, "train", i): list(range(n)) for (s, i), n in lengths.items()}
    segments = segments_of(spark, shards)
    train = lay.number_batches(lay.batch_positions(lay.shard_lengths(segments), B, T, ranks))
    mix = spark.createDataFrame([("m", [0.7, 0.3], 0)], "mix string, weights array<double>, n_picks bigint")
    whole = sequential([0.7, 0.3], 40)
    path = str(tmp_path / "cursor")
    with pytest.raises(FileNotFoundError):
        lay.load_cursor(spark, path)
    for stop in (0, 9, 23):
        state = lay.mix_cursor(mix.withColumn("n_picks", F.lit(stop)))
        lay.save_cursor(lay.mixed_cursor(state, train, names, B, T, ranks), path, stop)
    (tmp_path / "cursor" / "version=000000000099").mkdir()  # a save that died
    for version, stop in ((None, 23), (9, 9)):
        cursor = lay.load_cursor(spark, path, version)
        rest = lay.resumed_schedule(cursor, 40 - stop, names).collect()
        assert sorted((r.pick, names.index(r.source), r.ordinal) for r in rest) == whole[stop:]
        for r in cursor.collect():  # where each rank's reader stands
            order = reads([n for (s, _), n in lengths.items() if s == r.source], B, T, ranks, r["rank"])
            read = sum(j == names.index(r.source) for _, j, _ in whole[:stop])
            assert (r.next_shard, r.next_pos, r.epoch) == (*order[read % len(order)], read // len(order))
    assert {r.shard_id for r in lay.pruned_segments(segments, train.where("source = 'base' AND shard_id = 1")).collect()} == {1}
    assert lay.pruned_segments(segments, train.limit(0)).count() == 0


def test_tokens_move_once(spark):
    """Placing, numbering and scheduling batches shuffles narrow rows; tokens go through one exchange."""
    shards = {("s", "train", i): list(range(100)) for i in range(3)}
    segments = segments_of(spark, shards)
    placed = lay.number_batches(lay.batch_positions(lay.shard_lengths(segments), 2, 3, 2))
    picks = spark.range(20).select(F.lit("s").alias("source"), (F.col("id") % 5).alias("ordinal"), F.col("id").alias("pick"))
    found = lay.with_tokens(lay.scheduled_batches(picks, placed.withColumnRenamed("k", "ordinal")), segments, 3)
    assert found.count() == 20 * 2 * 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert physical.split("Initial Plan")[-1].count("partial_collect_list") == 1
