import zlib

from shardloom.llm import sharding
from shardloom.llm.common import documents
from shardloom.llm.queries import QUERIES


def brute(rows, n, overhead=16):
    sized = sorted(
        ((d is not None, d or 0, len((t or "").encode()) + overhead, zlib.crc32((t or "").encode())) for d, t in rows)
    )
    total, start, out, slots = sum(r[2] for r in sized), 0, [], {}
    for known, d, size, crc in sized:
        shard = (2 * start + size) * n // (2 * total)
        slot = slots.get(shard, 0)
        slots[shard] = slot + 1
        out.append((d if known else None, size, crc, shard, slot))
        start += size
    return out


def check(spark, rows, n):
    df = spark.createDataFrame([(d, t, 9, "x") for d, t in rows], "doc_id long, text string, size int, _part string")
    got = [tuple(r) for r in sharding.byte_shards(df.repartition(3), n).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute(rows, n), key=key)


def test_equals_brute_force(spark):
    rows = [(i * 7 % 101, "é" * (i % 13)) for i in range(101)] + [(None, None), (None, "x"), (5, ""), (5, ""), (3, "y" * 5000)]
    check(spark, rows, 7)
    check(spark, [(1, None)], 40)


def test_no_rows(spark):
    assert sharding.byte_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect()]
    got = {(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in QUERIES["op2_sharding"](spark, sf_dir).collect()}
    assert got == set(brute(rows, 40))
