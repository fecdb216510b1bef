"""SimHash near-duplicates, linked through BK-trees over shards of the distinct fingerprints.

A tree over all fingerprints would have to be broadcast whole and a search within a small radius
would still walk much of it. The shards are therefore the buckets of a banding: the 64 bits are cut
into six bands, and fingerprints that differ in up to four bits agree on at least two of them, so
each fingerprint joins the shards of its fifteen band pairs and none of its links is lost. Each
shard gets a BK-tree: children hang under their parent by their Hamming distance to it, and a
search follows only edges within the radius of its own distance. A shard above ``SHARD_ROWS`` is
split in blocks; its fingerprints then meet block by block.

Shards give one link per fingerprint at most (to its local representative), never all pairs.
Components come from those links by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import bounded
from shardloom.session import materialize, ship_package

SHINGLE = 4
RADIUS = 4
SEED = 42
BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # shift, width
SHARD_ROWS = 4096
CHUNK = 1 << 16


def fingerprint_bits(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer. Text without words: zero."""
    # bytes.lower and bytes.split know exactly A-Z and the six ASCII spaces.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        starts, stops = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        stops = ends[shingle - 1 :].tolist()
    del words
    digest, total, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(64, dtype=np.int64)
    for at in range(0, total, CHUNK):
        pairs = zip(starts[at : at + CHUNK], stops[at : at + CHUNK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column) -> Column:
    """64-bit SimHash of whole texts, as a bigint."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_bits(t) for t in batch], dtype="int64")

    return run(text)


def differing_bits(xored: np.ndarray) -> np.ndarray:
    """Bits set, as unsigned: numpy counts those of the absolute value otherwise."""
    return np.bitwise_count(xored.view(np.uint64)).astype(np.int64)


class BKTree:
    """A BK-tree over distinct 64-bit values. ``edges[i]`` maps a Hamming distance to the child."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.edges: list[dict[int, int]] = [{} for _ in values]
        # Building from the top: whatever lies at one distance from a node forms that child's subtree.
        pending = [np.arange(len(values))] if len(values) else []
        while pending:
            members = pending.pop()
            root, rest = int(members[0]), members[1:]
            distance = differing_bits(values[rest] ^ values[root])
            for d in np.unique(distance).tolist():
                below = rest[distance == d]
                self.edges[root][d] = int(below[0])
                if len(below) > 1:
                    pending.append(below)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, indexes of the queries within the radius of it), for all queries at once."""
        pending = [(0, np.arange(len(queries)))] if len(self.values) else []
        while pending:
            node, active = pending.pop()
            distance = differing_bits(queries[active] ^ self.values[node])
            near = distance <= radius
            if near.any():
                yield node, active[near]
            for d, child in self.edges[node].items():
                inside = np.abs(distance - d) <= radius
                if inside.any():
                    pending.append((child, active[inside]))


def local_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smaller value) that join the values of one shard into its components."""
    if len(values) == 2:
        if differing_bits(values[:1] ^ values[1:])[0] > radius:
            return values[:0], values[:0]
        return values.max(keepdims=True), values.min(keepdims=True)
    parent = np.arange(len(values))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    for node, found in BKTree(values).search(values, radius):
        if len(found) > 1:
            tops = {root(i) for i in set(parent[found].tolist())} | {root(node)}
            top = min(tops)
            for i in tops:
                parent[i] = top
            parent[found] = top
    tops = np.array([root(i) for i in range(len(values))])
    low = values.copy()
    np.minimum.at(low, tops, values)
    low = low[tops]
    moved = low != values
    return values[moved], low[moved]


def shard_links(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b), a > b, from rows (shard, fp) that arrive sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_shard, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            begin = np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1 if len(shard) else 0))
            size = np.diff(np.append(begin, len(shard)))
            found = [local_links(fp[s : s + n], radius) for s, n in zip(begin[size > 1].tolist(), size[size > 1].tolist())]
            a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            shard = np.concatenate([held_shard, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(shard):
                continue
            # The last shard may go on in the next batch. It has 2 * SHARD_ROWS values at most.
            last = int(np.searchsorted(shard != shard[-1], False)) if shard[0] == shard[-1] else int(np.flatnonzero(shard != shard[-1])[-1]) + 1
            yield links(shard[:last], fp[:last])
            held_shard, held = shard[last:], fp[last:]
        yield links(held_shard, held)

    return keyed.mapInArrow(run, "a bigint, b bigint")


def band_keys(fp: Column) -> Column:
    """The fifteen shard keys of a fingerprint: which two bands, and their bits."""
    band = [F.shiftrightunsigned(fp, shift).bitwiseAND((1 << width) - 1) for shift, width in BANDS]
    pairs = combinations(range(len(BANDS)), 2)
    return F.array(*[F.lit(n << 22) + band[i] * (1 << 11) + band[j] for n, (i, j) in enumerate(pairs)])


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links between fingerprints (column fp, distinct) within the radius, enough to connect them.

    ``radius`` may be at most four, what six bands taken in pairs can promise.
    """
    if radius > len(BANDS) - 2:
        raise ValueError("fingerprints further apart may share no pair of bands")
    ship_package(distinct.sparkSession)
    keyed = distinct.select("fp", F.explode(band_keys(F.col("fp"))).alias("_key"))
    large = keyed.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > shard_rows)
    large = bounded(large.select("_key", F.ceil(F.col("_n") / shard_rows).cast("int").alias("_blocks")), "large-shards", 8 << 20, 24)
    blocks = F.coalesce("_blocks", F.lit(1))
    home = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    # Block pairs (i, j), i <= j, that a fingerprint of block h takes part in; one pair if not split.
    meets = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda o: F.least(home, o).cast("bigint") * (1 << 16) + F.greatest(home, o),
    )
    placed = keyed.join(large, "_key", "left").select("fp", "_key", F.explode(meets).alias("_meet"))
    # One number per shard; blocks of a split shard stay apart by their own pair.
    shard = F.when(F.col("_meet") == 0, F.col("_key")).otherwise(F.xxhash64("_key", "_meet").bitwiseOR(F.lit(-(1 << 63)).cast("bigint")))
    placed = placed.select(shard.alias("shard"), "fp").repartition("shard").sortWithinPartitions("shard", "fp")
    return shard_links(placed, radius).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the links (a, b) but the roots.

    Rounds of large-star (everyone larger than me hangs under my smallest neighbour) and small-star
    (everyone smaller than me too) until nothing changes. Minima are combined before the shuffle and
    written, so that the join to them is planned by size: without a shuffle while they are small, and
    with adaptive splitting of a node with very many neighbours beyond.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_low")).select("a", F.least("a", "_low").alias("_low"))
        low = materialize(low, "minima")
        star = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("_low").alias("b"))
        star = materialize(star.where("a <> b").distinct(), "links")
        low = materialize(star.groupBy("a").agg(F.min("b").alias("_low")), "minima")
        hung = star.join(low, "a").where("b <> _low").select(F.col("b").alias("a"), F.col("_low").alias("b"))
        edges = materialize(hung.unionByName(low.select("a", F.col("_low").alias("b"))).distinct(), "links")
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every row, written once."""
    ship_package(docs.sparkSession)
    return materialize(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "fingerprints")


def roots(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) for the fingerprints that have links to others; the rest are their own root."""
    distinct = materialize(rows.select("fp").distinct(), "distinct-fingerprints")
    return materialize(components(links(distinct, radius)).withColumnRenamed("node", "fp"), "roots")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id of the component) of every document.

    Equal fingerprints are linked; null, empty and wordless texts have fingerprint zero and are
    linked like any other. Null ids don't count for the smallest, unless a component has no other.
    """
    rows = fingerprints(docs)
    # The smallest id per fingerprint first, so that copies leave one row each before the join.
    per_fp = rows.groupBy("fp").agg(F.min("doc_id").alias("_first"))
    per_fp = per_fp.join(roots(rows, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = per_fp.groupBy("root").agg(F.min("_first").alias("component_id"))
    by_fp = per_fp.select("fp", "root").join(first, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_per_component(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row per component: its smallest id (null last), and of equal rows one."""
    ship_package(docs.sparkSession)
    # Written with a row number, which is only stable in a table.
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), fingerprint(F.col("text")).alias("fp"))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "fingerprinted")
    narrow = rows.select("fp", "_row", F.col("_doc.doc_id").alias("doc_id"))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_row").alias("r"))
    best = narrow.groupBy("fp").agg(F.min(rank).alias("_best"))
    best = best.join(roots(rows, radius), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
    kept = best.agg(F.min("_best").alias("_best")).select(F.col("_best.r").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select("_doc.*")
