"""Adding to a tokenised corpus against rebuilding it."""

import random

from shardloom.operators import packing as p
from shardloom.session import new_scratch_path
from shardloom.sources import blocks
from shardloom.sources.corpus import scan_corpus_stream

DOCS = "source string, ord bigint, text string"
BITS = 3


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def rebuilt(spark, state):
    rows = [(source, ord_, text) for (source, ord_), text in state.items()]
    return p.token_offsets(p.tokenize_corpus(frame(spark, rows), "char"))


def placed(df):
    return sorted((r.source, r.ord, r.start, tuple(r.tokens)) for r in df.collect())


def segments(df):
    return sorted((r.source, r.shard_id, r.split, r.seg_start, r.ord, tuple(r.tokens)) for r in df.collect())


def rounds(seed, n=3):
    """Late, corrected and removed documents at random places, the first and last block included."""
    rng = random.Random(seed)
    for k in range(n):
        keys = {(rng.choice("ab"), rng.randrange(60)) for _ in range(40 if k == 0 else 6)}
        yield [(s, o, rng.choice([None, "", "x" * rng.randrange(1, 30), f"text {o} {k}"])) for s, o in sorted(keys)]


def test_adding_equals_a_rebuild_and_reads_changed_blocks_only(spark):
    path, state = new_scratch_path(spark, "test-blocks"), {}
    before = []
    for g, rows in enumerate(rounds(3)):
        assert blocks.add_documents(frame(spark, rows), path, "char", BITS) == g
        state |= {(s, o): t for s, o, t in rows}
        whole = rebuilt(spark, state)
        assert placed(blocks.placed_documents(spark, path)) == placed(whole)
        # The versions written are those of the blocks that rows fell into.
        touched = {(s, o >> BITS) for s, o, _ in rows}
        versions = {(r.source, r.block) for r in blocks.block_starts(spark, path).where(f"generation = {g}").collect()}
        assert versions == touched
        # Shards from the first change on replace the old ones; the others are as they were.
        now = segments(p.pack_shards(whole, 50))
        changed = segments(blocks.changed_shards(spark, path, g, 50))
        starts = {r.source: r.changed_at // 50 for r in blocks.first_change(spark, path, g).collect()}
        stay = [s for s in before if s[0] not in starts or s[1] < starts[s[0]]]
        assert sorted(stay + changed) == now
        before = now


def test_a_generation_written_again_gives_the_same_rows(spark):
    path, state = new_scratch_path(spark, "test-blocks"), {}
    for g, rows in enumerate(rounds(5, 2)):
        blocks.add_documents(frame(spark, rows), path, "char", BITS, g)
        state |= {(s, o): t for s, o, t in rows}
    blocks.add_documents(frame(spark, rows), path, "char", BITS, 1)
    assert placed(blocks.placed_documents(spark, path)) == placed(rebuilt(spark, state))


def test_unpublished_generations_do_not_count(spark):
    path = new_scratch_path(spark, "test-blocks")
    blocks.add_documents(frame(spark, [("a", 1, "one"), ("a", 9, "nine")]), path, "char", BITS)
    want = placed(blocks.placed_documents(spark, path))
    # A run that died after its tokens: no totals.
    spark.createDataFrame([(1, 2, 0, [7, 8], "a", 0)], "ord bigint, n_tok int, inner bigint, tokens array<int>, source string, block bigint").write.partitionBy(
        "source", "block"
    ).parquet(f"{path}/tokens/generation=1")
    assert placed(blocks.placed_documents(spark, path)) == want
    assert blocks.add_documents(frame(spark, [("a", 2, "two")]), path, "char", BITS) == 1
    assert [r[:2] for r in placed(blocks.placed_documents(spark, path))] == [("a", 1), ("a", 2), ("a", 9)]


def test_repeated_rows_empty_input_and_removal(spark):
    path = new_scratch_path(spark, "test-blocks")
    blocks.add_documents(frame(spark, []), path, "char", BITS)
    assert placed(blocks.placed_documents(spark, path)) == []
    rows = [("a", 1, "b"), ("a", 1, "c"), ("a", 1, ""), ("a", 1, None), ("a", 1, "c"), ("a", 20, "z")]
    blocks.add_documents(frame(spark, rows), path, "char", BITS)
    assert [(r[1], r[3][1:]) for r in placed(blocks.placed_documents(spark, path))] == [(1, (ord("c"),)), (20, (ord("z"),))]
    blocks.add_documents(frame(spark, [("a", 1, None), ("b", 5, None)]), path, "char", BITS)
    assert [(r[0], r[1], r[2]) for r in placed(blocks.placed_documents(spark, path))] == [("a", 20, 0)]


def test_only_folders_of_touched_blocks_are_opened(spark):
    path = new_scratch_path(spark, "test-blocks")
    blocks.add_documents(frame(spark, [("a", i, f"text {i}") for i in range(80)]), path, "char", BITS)
    known = blocks._totals(spark, path).where("block = 4")
    read = blocks._read(spark, path, known.select("source", "block", "generation", "n_docs"))
    assert read.count() == 8
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_stream_places_late_and_corrected_documents(spark):
    path, out, state = (new_scratch_path(spark, f"test-blocks-{n}") for n in ("in", "out", "state"))
    last = {}
    for rows in rounds(7, 3):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(path)
        stream = scan_corpus_stream(spark, path, DOCS, order_col="ord", files_per_trigger=1)
        blocks.add_stream(stream, out, state, "char", BITS).awaitTermination()
        last |= {(s, o): t for s, o, t in rows}
    assert placed(blocks.placed_documents(spark, out)) == placed(rebuilt(spark, last))
