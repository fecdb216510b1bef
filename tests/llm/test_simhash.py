import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from shardloom.llm import simhash as S
from shardloom.llm.common import documents
from shardloom.llm.queries import QUERIES


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints, radius=4):
    top = list(range(len(prints)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    array = np.array(prints, dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(array[:i] ^ array[i]) <= radius).tolist():
            top[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(ids))]


def test_whole_table(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text").collect()
    prints = [slow_fingerprint(r["text"]) for r in rows]
    found = slow_components([r["doc_id"] for r in rows], prints)
    wanted = {(r["doc_id"], f"{p:016x}", c) for r, p, c in zip(rows, prints, found)}
    assert {tuple(r) for r in QUERIES["op5_simhash"](spark, sf_dir).collect()} == wanted


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (None, base.upper()), (3, base + " tail"), (9, None), (8, ""), (8, ""), (7, " \n"), (2, "one two"), (None, "é " * 30000)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp int, root int")
    got = S.near_duplicates(docs).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    wanted = slow_components([d for d, _ in rows], prints)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or -1)
    assert sorted([(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got], key=key) == sorted(
        zip([d for d, _ in rows], prints, wanted), key=key
    )
    kept = S.one_per_component(docs)
    assert kept.columns == docs.columns and kept.count() == len({(p if c is None else c) for p, c in zip(prints, wanted)})
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_tree_follows_every_edge_it_must():
    rng = np.random.default_rng(1)
    centre = rng.integers(-(2**62), 2**62, 20)
    values = np.unique(np.concatenate([c ^ (1 << rng.integers(0, 62, 40)) ^ (1 << rng.integers(0, 62, 40)) for c in centre]))
    rng.shuffle(values)
    found = {(int(values[n]), int(values[q])) for n, qs in S.BKTree(values).search(values, 4) for q in qs}
    near = np.bitwise_count((values[:, None] ^ values[None, :]).view(np.uint64)) <= 4
    assert found == {(int(values[i]), int(values[j])) for i, j in zip(*np.nonzero(near))}


def test_split_shards_lose_no_link(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(20)]
    values = {b ^ sum({1 << rng.randrange(63) for _ in range(rng.randint(0, 4))}) for b in base for _ in range(40)}
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    both = []
    for shard_rows in (4096, 3):
        found = S.components(S.links(frame, 4, shard_rows)).collect()
        both.append({(r["node"], r["root"]) for r in found})
    assert both[0] == both[1]
    order = sorted(values)
    wanted = dict(zip(order, slow_components(order, order)))
    assert {(v, r) for v, r in wanted.items() if r != v} <= both[0]


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    got = S.components(edges).agg(F.count("*"), F.max("root")).first()
    assert tuple(got) == (300, 0)
