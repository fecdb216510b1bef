"""Plan shape: what must hold at any scale."""

import re

from pyspark.sql import functions as F

from shardloom.operators import packing, telemetry
from shardloom.plans import fixtures as fx
from shardloom.plans import layout

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_tokens_stay_in_the_jvm(spark, sf_dir):
    text = plan_of(packing.tokenize_corpus(fx.corpus(spark, sf_dir), "char"))
    assert "Python" not in text and "MapInArrow" not in text


def test_empty_texts_leave_at_the_scan(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.lit("a").alias("source"), F.col("doc_id").alias("ord"), "text")
    text = plan_of(packing.tokenize_corpus(docs))
    assert "PushedFilters: [IsNotNull(text), Not(EqualTo(text,))]" in text
    assert text.index("MapInArrow") < text.index("Filter")


def test_offsets_window_only_over_blocks(spark, sf_dir):
    tokens = fx.char_tokens(spark, sf_dir).select("source", "ord", "n_tok")
    text = plan_of(packing.token_offsets(tokens))
    windows = re.findall(r"windowspecdefinition\((.*?) ASC", text)
    assert len(windows) >= 3
    # Over rows: source and both blocks. Over block totals: what is left after each level.
    assert {re.sub(r"#\d+L?", "", w) for w in windows} == {
        "source, __block0, __block1, __is_row",
        "source, __block1, __is_row",
        "source, __order",
    }
    # The last one goes over the totals of 2**30 keys each, not over rows.
    assert "__block1#" in text.split("windowspecdefinition(source#")[-1]
    assert "Join" not in text


def test_a_corpus_build_shuffles_tokens_once(spark, sf_dir):
    tokens = fx.char_tokens(spark, sf_dir)
    placed = packing.token_offsets(tokens, together_bits=12)
    text = plan_of(packing.pack_shards(placed, fx.SHARD).sortWithinPartitions("source", "split", "shard_id"))
    # Down from the root, the rows (with their tokens) pass one exchange: source and coarse blocks.
    rows_side = text.split("Union")[0]
    exchanges = re.findall(r"Exchange hashpartitioning\((.*?), \d+\), (\w+)", rows_side)
    assert [(re.sub(r"#\d+L?", "", keys), why) for keys, why in exchanges] == [
        ("source, __block1, __block2", "REPARTITION_BY_COL")
    ]


def test_step_numbers_do_not_need_a_whole_run_in_a_task(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("order"))
    windows = re.findall(r"windowspecdefinition\((.*?) ASC", plan_of(telemetry.with_steps(events)))
    assert windows and all("__block" in w or w == "run, __order" for w in (re.sub(r"#\d+L?", "", w) for w in windows))
    assert [w for w in windows if "__block0" in w]


def test_shards_are_written_where_their_documents_are(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(fx, "write_shards", lambda segments, path, **kw: seen.append((segments, kw)))
    fx.shard_folder(spark, sf_dir)
    segments, options = seen[0]
    assert options == {"in_order": True, "shard_size": fx.SHARD}
    placed = segments.select("source", F.shiftright("ord", fx.TASK_BITS).alias("range"), F.spark_partition_id().alias("task")).collect()
    assert len({(r.source, r.range) for r in placed}) == len({tuple(r) for r in placed}) > 0


def test_texts_are_placed_and_become_tokens_there(spark, sf_dir):
    text = plan_of(fx.char_placed(spark, sf_dir, fx.TASK_BITS))
    above, below = text.split("Exchange", 1)
    assert "split(text" in above and "split(text" not in below  # no token is shuffled for its place
    assert "documents.parquet" in below and "tokens" not in below  # nor written before


def test_placed_texts_go_to_tasks_by_their_number(spark, sf_dir):
    text = plan_of(fx.char_placed(spark, sf_dir, fx.TASK_BITS))
    most = 4 * spark.sparkContext.defaultParallelism
    wanted = max(most, fx.table(spark, sf_dir, "documents").count() >> fx.TASK_BITS)
    assert re.findall(r"Exchange hashpartitioning\(source.*?, (\d+)\), REPARTITION_BY_NUM", text)[:1] == [str(wanted)]


def test_positions_are_not_broadcast(spark, sf_dir):
    """The planner takes positions for as small as the shards that they are exploded from."""
    for query in (layout.same_doc_pairs, layout.scheduled_batches):
        found = query(spark, sf_dir)
        assert found.collect()
        joins = re.findall(r"(\w+Join) \[[^]]*\bseq#", plan_of(found))
        assert joins and set(joins) == {"SortMergeJoin"}
