"""Prefix scans against brute force, whatever the keys, skew or partitioning."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shardloom.operators import ordering as o


def keyed_rows(seed):
    rng = random.Random(seed)
    keys = set()
    for top in (50, 5_000, 2**34, 2**49):
        keys |= {rng.randrange(-top, top) for _ in range(60)}
    rows = []
    for k in sorted(keys):
        source = "hot" if rng.random() < 0.6 else f"s{rng.randrange(3)}"
        rows.append((source, k, rng.randrange(0, 9)))
    return rows


def expected(rows, inclusive):
    out, sums, tops = {}, {}, {}
    for source, k, v in sorted(rows, key=lambda r: r[1]):
        before = sums.get(source, 0), tops.get(source)
        sums[source] = before[0] + v
        tops[source] = v if before[1] is None else max(before[1], v)
        out[source, k] = (sums[source], tops[source]) if inclusive else before
    return out


@pytest.mark.parametrize("parts", [1, 7, 64])
@pytest.mark.parametrize("inclusive", [True, False])
def test_prefix_scan(spark, parts, inclusive):
    rows = keyed_rows(parts)
    df = spark.createDataFrame(rows, "source string, k bigint, v bigint").repartition(parts)
    outputs = {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}
    found = o.prefix_scan(df, ["source"], "k", outputs, inclusive=inclusive)
    assert found.columns == ["source", "k", "v", "total", "top"]
    assert {(r.source, r.k): (r.total, r.top) for r in found.collect()} == expected(rows, inclusive)


@pytest.mark.parametrize("levels", [(10, 30), (4,), (3, 9, 30), (10, 30, 50)])
def test_levels_do_not_change_the_result(spark, levels):
    rows = keyed_rows(3)
    df = spark.createDataFrame(rows, "source string, k bigint, v bigint")
    found = o.prefix_scan(df, [], "k", {"total": ("sum", F.col("v"))}, levels=levels).collect()
    want = expected([("all", k, v) for _, k, v in rows], True)
    assert {r.k: r.total for r in found} == {k: t[0] for (_, k), t in want.items()}


def test_dense_index_counts_from_zero(spark):
    rows = keyed_rows(5)
    found = o.dense_index(spark.createDataFrame(rows, "source string, k bigint, v bigint"), ["source"], "k")
    by_source = {}
    for source, k, _ in sorted(rows, key=lambda r: r[1]):
        by_source.setdefault(source, []).append(k)
    assert {(r.source, r.k): r.idx for r in found.collect()} == {
        (s, k): i for s, ks in by_source.items() for i, k in enumerate(ks)
    }


def md5_order(seed, *key):
    text = ":".join([str(seed), *map(str, key)])
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_seeded_permutation_is_a_permutation_of_md5_order(spark):
    df = spark.range(500).withColumnRenamed("id", "k").repartition(7)
    found = {r.pos: r.k for r in o.seeded_permutation(df, 9, ["k"]).collect()}
    assert [found[i] for i in range(500)] == sorted(range(500), key=lambda k: (md5_order(9, k), k))


@pytest.mark.parametrize("quota", [0, 1, 17, 300, 1000])
def test_first_by_hash(spark, quota):
    df = spark.range(400).select((F.col("id") % 2 == 0).alias("c"), F.col("id").alias("k"))
    quotas = spark.createDataFrame([(True, quota), (False, 3)], "c boolean, quota bigint")
    found = o.first_by_hash(df, 1, ["k"], lambda counts: counts.join(quotas, "c"), ["c"]).collect()
    for c, n in ((True, quota), (False, 3)):
        members = sorted((k for k in range(400) if (k % 2 == 0) == c), key=lambda k: (md5_order(1, k), k))
        assert sorted(r.k for r in found if r.c == c) == sorted(members[:n])


def test_newest_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("t"))
    found = o.newest(df, ["g"], "t", 3)
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
    assert sorted(r.t for r in found.collect()) == [994, 995, 996, 997, 998, 999]


def test_halo_refuses_frames_longer_than_a_block(spark):
    with pytest.raises(ValueError):
        o.with_halo(spark.range(3), "id", 8, 8)
