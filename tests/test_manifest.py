import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shardloom.constants import EOT
from shardloom.operators import layout as lay
from shardloom.operators import quality
from shardloom.session import new_scratch_path
from shardloom.sources import shards as S
from tests.test_layout import segments_of


def built(spark, seed=2):
    random.seed(seed)
    ids = lambda n: [random.choice([EOT, *range(50)]) for _ in range(n)]
    tokens = {("a", "val", 0): ids(40), ("a", "train", 1): ids(40), ("a", "train", 2): ids(7), ("b", "train", 0): ids(25)}
    path = new_scratch_path(spark, "manifest-shards")
    S.write_shards(segments_of(spark, tokens), path)
    return path, tokens


def test_manifest_equals_a_full_scan(spark):
    path, tokens = built(spark)
    found = {(r.source, r.split, r.shard_id): r for r in S.require_manifest(spark, path).collect()}
    assert set(found) == set(tokens)
    for key, ids in tokens.items():
        r = found[key]
        assert (r.n_tokens, r.shard_len, r.min_id, r.max_id, r.n_separators) == (len(ids), len(ids), min(ids), max(ids), ids.count(EOT))
    scanned = S.scan_shards(spark, path)
    from_scan = sorted(map(tuple, quality.shard_stats(scanned).collect()))
    assert sorted(map(tuple, quality.manifest_stats(S.shard_manifest(spark, path)).collect())) == from_scan


def test_only_the_manifest_is_read(spark):
    path, _ = built(spark)
    manifest = S.shard_manifest(spark, path)
    stages = spark.createDataFrame([("a", "train", 2), ("b", "val", 1)], "source string, split string, need bigint")
    for df in (quality.manifest_stats(manifest), quality.complete_stages(stages, manifest), S.list_shards(manifest)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "/manifest" in plan and "/builds" not in plan
    assert sorted(map(tuple, quality.complete_stages(stages, manifest).collect())) == [("a", "train", True), ("b", "val", False)]


def test_missing_and_stale_manifests_are_errors(spark):
    with pytest.raises(FileNotFoundError):
        S.shard_manifest(spark, new_scratch_path(spark, "nothing"))
    path, _ = built(spark)
    rows = spark.read.schema(S.SCHEMA).parquet(f"{path}/builds")
    build = rows.where("source = 'a'").first()["build"]
    assert S.stale_shards(spark, path).count() == 0
    shutil.rmtree(f"{path}/builds/build={build}/source=a/split=train/shard_id=2")
    gone = S.stale_shards(spark, path).collect()
    assert [(r.source, r.shard_id, r.found) for r in gone] == [("a", 2, 0)]
    with pytest.raises(ValueError, match="stale"):
        S.require_manifest(spark, path)


def test_newest_build_counts(spark):
    path, tokens = built(spark)
    again = segments_of(spark, {("a", "train", 0): list(range(9))})
    S.write_shards(again, path)
    found = {(r.source, r.split, r.shard_id): r.n_tokens for r in S.require_manifest(spark, path).collect()}
    assert found == {("a", "train", 0): 9, ("b", "train", 0): 25}
    assert S.scan_shards(spark, path).agg(F.sum("n_tok")).first()[0] == 34
    with pytest.raises(FileNotFoundError):
        S.scan_shards(spark, path, "val")


def test_small_shards_share_folders(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_SIZE", 100)
    ids = {("a", "train", i): [EOT, *range(9)] for i in range(1, 40)} | {("a", "val", 0): [EOT] * 10}
    path = new_scratch_path(spark, "small-shards")
    build = S.write_shards(segments_of(spark, ids), path, shard_size=10)
    folders = {tuple(p.parts[-2:]) for p in Path(path, "builds", f"build={build}", "source=a").glob("*/shard_id=*")}
    assert folders == {("split=val", "shard_id=0"), *(("split=train", f"shard_id={i}") for i in (0, 10, 20, 30))}
    assert {(r.split, r.shard_id): r.n_tokens for r in S.require_manifest(spark, path).collect()} == {k[1:]: 10 for k in ids}
    rows = S.scan_shards(spark, path, "train").orderBy("shard_id", "seg_start").collect()
    assert [t for r in rows for t in r.tokens] == [EOT, *range(9)] * 39
    one = lay.pruned_segments(S.scan_shards(spark, path), spark.createDataFrame([("a", "train", 17)], "source string, split string, shard_id bigint"))
    assert {r.shard_id for r in one.collect()} == {17}
    assert "PushedFilters: [" in (plan := one._jdf.queryExecution().toString()) and "GreaterThanOrEqual(shard,17)" in plan
