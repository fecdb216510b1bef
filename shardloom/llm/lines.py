"""Line dedup within a small edit distance by segment partitioning.

A line is cut into ``tau + 1`` segments. Lines within ``tau`` edits share at least one segment, at
a place that the lengths bound. So each distinct line is indexed under its segments (length, which
segment, text), and probes, for every length from its own down to ``tau`` shorter, the substrings
that could be such a segment: only start positions within the multi-match window.

Keys that one line holds alone are dropped before anything is joined. Lines that share a key are
compared through two 64-bit signatures (parities of characters and of character pairs, which one
edit changes in few bits); what passes is a candidate pair, and each pair is verified once with a
banded bit-parallel edit distance. A key held by more than ``GROUP`` lines is compared block by
block. Repeated lines are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import bounded, text_or_empty
from shardloom.llm.simhash import components, differing_bits
from shardloom.session import materialize, ship_package

TAU = 2
GROUP = 2048
BROADCAST_BYTES = 64 << 20


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, size) of the tau + 1 segments of a line: even, the longer ones last."""
    size, longer = divmod(length, tau + 1)
    sizes = [size + (i > tau - longer) for i in range(tau + 1)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(tau + 1)]


def window(length: int, shorter: int, i: int, start: int, size: int, tau: int) -> range:
    """Where segment ``i`` of a line of ``shorter`` characters may lie in one of ``length``: at most i
    edits lie before it, and at most tau - i after it."""
    delta = length - shorter
    low = max(start - i, start + delta - (tau - i), 0)
    high = min(start + i, start + delta + (tau - i), length - size)
    return range(low, high + 1)


@lru_cache(maxsize=100_000)
def plan(length: int, tau: int) -> tuple[list[tuple[bytes, int, int]], list[tuple[bytes, int, int]]]:
    """(prefix, start, stop) of every substring a line of this length is indexed by, and probes."""
    own = [(b"%d,%d," % (length, i), s, s + k) for i, (s, k) in enumerate(segments(length, tau))]
    probes = [
        (b"%d,%d," % (shorter, i), at, at + k)
        for shorter in range(max(length - tau, 1), length + 1)
        for i, (s, k) in enumerate(segments(shorter, tau))
        for at in window(length, shorter, i, s, k, tau)
    ]
    return own, probes


def line_keys(line: str, tau: int) -> tuple[list[int], list[int]]:
    """Hashes a line is indexed under, and the other ones it probes."""
    digest = xxhash.xxh64_intdigest
    own, probes = plan(len(line), tau)
    held = [digest(p + line[a:b].encode("utf-8", "surrogatepass")) for p, a, b in own]
    asked = {digest(p + line[a:b].encode("utf-8", "surrogatepass")) for p, a, b in probes}
    return held, list(asked.difference(held))


def keyed(lines: DataFrame, tau: int) -> DataFrame:
    """key, id, own of every line (id, line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            counts, owned = [], []
            for line in batch.column(1).to_pylist():
                held, asked = line_keys(line, tau)
                keys += held
                keys += asked
                counts.append(len(held) + len(asked))
                owned.append(len(held))
            counts, owned = np.array(counts, dtype=np.int64), np.array(owned, dtype=np.int64)
            first = np.repeat(np.cumsum(counts) - counts, counts)
            own = np.arange(len(keys)) - first < np.repeat(owned, counts)
            ids = np.repeat(batch.column(0).to_numpy(), counts)
            key = np.array(keys, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(own)], ["key", "id", "own"])

    return lines.select("id", "line").mapInArrow(run, "key bigint, id bigint, own boolean")


def shared(rows: DataFrame) -> DataFrame:
    """The rows whose key is held by two lines at least, one of which is indexed under it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by key, owners first. What may go on in the next batch is only the last
        # key's first row (held back) and whether the key is live already.
        key0, row0, live = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            own = batch.column(2).to_numpy(zero_copy_only=False)
            head = np.diff(key, prepend=key[0] - 1) != 0
            if key0 is not None and key[0] == key0:
                head[0] = False
            group = np.cumsum(head)  # 0: goes on from the batch before
            size, first = np.bincount(group, minlength=group[-1] + 1), np.zeros(group[-1] + 1, dtype=bool)
            first[group[head]] = own[head]
            going_on = size[0] > 0
            alive = first & (size > 1)
            out = []
            if going_on:
                alive[0] = live or row0 is not None
                if row0 is not None and not live:
                    out.append(row0)
            else:
                alive[0] = False
            keep = alive[group]
            out.append(batch.filter(pa.array(keep)))
            yield from out
            at_end = group[-1]
            if at_end == 0:
                live = bool(alive[0])
            else:
                live = bool(alive[at_end])
                row0 = batch.slice(int(np.flatnonzero(head)[-1]), 1) if first[at_end] and size[at_end] == 1 else None
            if live:
                row0 = None
            key0 = key[-1]

    sorted_rows = rows.repartition("key").sortWithinPartitions("key", F.desc("own"))
    return sorted_rows.mapInArrow(run, "key bigint, id bigint, own boolean")


def signature(line: str) -> tuple[int, int]:
    """Parities of characters and of adjacent pairs, hashed to 64 bits each. One edit changes at most
    two characters and four pairs."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    single = np.bincount((points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(np.int64), minlength=64) & 1
    ends = np.concatenate([[np.uint64(1 << 21)], points, [np.uint64(1 << 21)]])
    both = (ends[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (ends[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    double = np.bincount((both * np.uint64(0x165667B19E3779F9) >> np.uint64(58)).astype(np.int64), minlength=64) & 1
    pack = lambda bits: int(np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")[0])
    return pack(single), pack(double)


def with_signatures(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [signature(line) for line in batch["line"]]
            yield batch.assign(single=[f[0] for f in found], double=[f[1] for f in found])

    return lines.select("id", "line").mapInPandas(run, "id bigint, line string, single bigint, double bigint")


def candidates(rows: DataFrame, tau: int) -> DataFrame:
    """(a, b), a < b, of rows (group, id, own, single, double) sorted by group: an owner and another
    line of a group whose signatures allow ``tau`` edits."""

    def pairs(ids: np.ndarray, own: np.ndarray, single: np.ndarray, double: np.ndarray):
        for o in np.flatnonzero(own):
            near = differing_bits(single ^ single[o]) <= 2 * tau
            near &= differing_bits(double ^ double[o]) <= 4 * tau
            near &= ids != ids[o]
            near &= ~own | (ids > ids[o])
            found = ids[near]
            if len(found):
                yield np.minimum(found, ids[o]), np.maximum(found, ids[o])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def found(table: pa.Table) -> pa.RecordBatch:
            group, ids, own, single, double = (c.to_numpy() for c in table.columns)
            own = own.astype(bool)
            begin = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(group)]):
                if e - s > 1:
                    for x, y in pairs(ids[s:e], own[s:e], single[s:e], double[s:e]):
                        a.append(x)
                        b.append(y)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=schema)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            group = table.column(0).to_numpy()
            other = np.flatnonzero(group != group[-1])
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield found(table.slice(0, last))
            held = table.slice(last)  # one group of 2 * GROUP rows at most
        if held is not None and held.num_rows:
            yield found(held)

    return rows.mapInArrow(run, "a bigint, b bigint")


def within(a: str, b: str, tau: int) -> bool:
    """Whether ``tau`` edits turn one line into the other.

    Common ends are taken off. Then a bit vector per number of edits holds the cells reachable in
    the band of 2 * tau + 1 diagonals; a character of the longer line moves all of them at once.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > tau:
        return False
    head = common_prefix(a, b)
    a, b = a[head:], b[head:]
    tail = common_prefix(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    full = (1 << (2 * tau + 1)) - 1
    reach = [((1 << (e + 1)) - 1) << tau for e in range(tau + 1)]
    for i, c in enumerate(b):
        low = i - tau
        band = a[max(low, 0) : i + tau + 1]
        match, bit = 0, 1 << max(-low, 0)
        for x in band:
            if x == c:
                match |= bit
            bit <<= 1
        fresh = [reach[0] & match]
        for e in range(1, tau + 1):
            old = reach[e - 1]
            fresh.append(((reach[e] & match) | old | (old >> 1) | (fresh[e - 1] << 1)) & full)
        reach = fresh
        if not reach[tau]:
            return False
    return bool(reach[tau] >> (len(a) - len(b) + tau) & 1)


def common_prefix(a: str, b: str) -> int:
    """Length of the common prefix, by doubling and halving slices."""
    n, done, step = min(len(a), len(b)), 0, 8
    while done < n and a[done : done + step] == b[done : done + step]:
        done += step
        step *= 2
    done = min(done, n)
    while step and done < n:
        if done + step <= n and a[done : done + step] == b[done : done + step]:
            done += step
        else:
            step //= 2
    return done


def verified(pairs: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = pa.array([within(p, q, tau) for p, q in zip(x, y)], pa.bool_())
            yield batch.select([0, 1]).filter(good)

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a bigint, b bigint")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """id, line, copies, first (doc_id, line_no) of every distinct non-empty line."""
    rows = docs.select("doc_id", F.posexplode(F.split(text_or_empty(F.col("text")), "\n", -1)).alias("line_no", "line"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("line_no").alias("line_no"))
    found = rows.where("line <> ''").groupBy("line").agg(F.count("*").alias("copies"), F.min(place).alias("first"))
    return materialize(found.withColumn("id", F.monotonically_increasing_id()), "lines")


def links(lines: DataFrame, tau: int = TAU, group: int = GROUP) -> DataFrame:
    """(a, b), a < b: ids of different lines within ``tau`` edits, each pair once."""
    ship_package(lines.sparkSession)
    live = materialize(shared(keyed(lines, tau)), "line-keys")
    # The lines are wide and the live ids few: without moving the lines while the ids fit.
    ids = bounded(live.select("id").distinct(), "line-ids", BROADCAST_BYTES, 16)
    texts = materialize(with_signatures(lines.join(ids, "id", "left_semi")), "line-texts")
    large = live.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > group)
    large = bounded(large.select("key", F.ceil(F.col("_n") / group).cast("int").alias("_blocks")), "line-groups", 8 << 20, 24)
    blocks = F.coalesce("_blocks", F.lit(1))
    home = F.pmod(F.xxhash64("id"), blocks).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda o: F.least(home, o).cast("bigint") * (1 << 20) + F.greatest(home, o)
    )
    rows = live.join(large, "key", "left").select("key", "id", "own", F.explode(meets).alias("_meet"))
    rows = rows.join(texts.drop("line"), "id")
    rows = rows.select(F.xxhash64("key", "_meet").alias("group"), "id", "own", "single", "double")
    rows = rows.repartition("group").sortWithinPartitions("group", "id")
    pairs = materialize(candidates(rows, tau).distinct(), "line-pairs")
    return materialize(verified(pairs, texts, tau), "line-links")


def classes(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row per distinct line: line, doc_id and line_no of its first place, copies, n_links (other
    lines within ``tau`` edits), class_doc_id and class_line_no (first place of its class).

    Lines are the parts between line feeds, whole and as they are; empty ones don't count, so null
    and empty texts have none. Null ids come after all others. Rows that share an id share places;
    a line there twice at the same place counts twice in copies.
    """
    lines = distinct_lines(docs)
    found = links(lines, tau)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "id")
    top = components(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("node", "id")
    linked = degree.join(top, "id", "left").withColumn("root", F.coalesce("root", "id"))
    linked = materialize(linked, "line-classes")
    narrow = lines.select("id", "first")
    first = linked.join(narrow, "id").groupBy("root").agg(F.min("first").alias("_class"))
    linked = linked.join(first, "root").select("id", "n_links", "_class")
    linked = bounded(linked, "line-linked", BROADCAST_BYTES, 64)
    every = lines.join(linked, "id", "left").withColumn("_class", F.coalesce("_class", "first"))
    return every.select(
        "line",
        F.col("first.doc_id").alias("doc_id"),
        F.col("first.line_no").alias("line_no"),
        "copies",
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.col("_class.doc_id").alias("class_doc_id"),
        F.col("_class.line_no").alias("class_line_no"),
    )


def deduplicated(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs`` (doc_id, text) without the lines that are not the first of their class.

    A document all of whose lines go keeps an empty text; empty lines stay.
    """
    found = classes(docs, tau)
    first = (F.col("doc_id").eqNullSafe(F.col("class_doc_id"))) & (F.col("line_no") == F.col("class_line_no"))
    kept = found.where(first).select("line", F.col("doc_id").alias("_d"), F.col("line_no").alias("_n"))
    rows = materialize(docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "line-docs")
    parts = rows.select("_row", "doc_id", F.posexplode(F.split(text_or_empty(F.col("text")), "\n", -1)).alias("_at", "line"))
    joined = parts.join(kept, "line", "left")
    stays = (F.col("line") == "") | (F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_at") == F.col("_n")))
    rebuilt = (
        joined.where(F.coalesce(stays, F.lit(False)))
        .groupBy("_row")  # the lines of one document
        .agg(F.array_sort(F.collect_list(F.struct("_at", "line"))).alias("_lines"))
    )
    text = F.coalesce(F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"), F.lit(""))
    return rows.select("_row", "doc_id").join(rebuilt, "_row", "left").select("doc_id", text.alias("text"))
