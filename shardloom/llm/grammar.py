"""Token ids in grammar-compressed files with random access.

Documents are range-partitioned and sorted by id, encoded, and cut into shards of about
``SHARD_IDS`` ids at document borders. Each shard is Re-Pair compressed on its own: every round
counts the adjacent pairs exactly, gives the most frequent ones a nonterminal each and replaces them
from left to right, until no pair is left that stands ``LEAST_COUNT`` times. Pairs never reach across
documents.

A shard is one row of a Parquet folder (written by Spark, so it commits as a whole and lands in any
store Spark can reach): document ids, symbols and ids per document, the rules, each rule's
expansion length, and the symbols, in two to four bytes each as the shard needs. The lengths let a
reader find the k-th id of a document without expanding what lies before it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.llm.common import slices, text_or_empty
from shardloom.session import new_scratch_path, ship_package

SHARD_IDS = 1 << 20
LEAST_COUNT = 16
FEWER = 16  # a round takes all pairs at least one FEWER-th as frequent as the most frequent one
BYTES_AT_ONCE = 4_000_000
CACHE_BYTES = 80_000_000
PART_BYTES = 180  # of a cached part, its ids apart: the string, its slot and its place
TOGETHER = 128  # new parts encoded in one string
END = 0
# A space after any white space: there, pieces cut at spaces are not always encoded apart.
UNSAFE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "

# Letters that a piece may be cut behind, if a character of ASCII that is no letter follows.
CUT = r"(?s)^(?P<word>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+)(?P<rest>[\x00-\x40\x5B-\x60\x7B-\x7F].*)?$"

SHARD_SCHEMA = (
    "part int, shard int, n_docs long, n_ids long, doc_ids array<bigint>, doc_symbols binary, doc_lengths binary, "
    "base int, width int, left binary, right binary, expansion binary, symbols binary"
)
FILE_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_symbols", pa.binary()), ("doc_lengths", pa.binary()),
        ("base", pa.int32()), ("width", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("expansion", pa.binary()),
        ("symbols", pa.binary()),
    ]
)

_encoders: dict[tuple[str, bool], Encoder] = {}


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Ids of whole texts, with a bounded memory of parts already encoded.

    The vocabulary's pre-tokenizer always cuts where a space follows something that isn't white
    space, so a text's ids are those of its space-led pieces, one after the other. It also cuts between
    a run of letters and any ASCII character that isn't one, so most pieces are a word and a rest.
    Words, rests and other pieces are encoded once per worker, many to a string, and told apart by
    the tokens that hold a space. Texts with a space after white space are encoded as they are, and
    their ids are not kept.

    With ``special``, the string of a special token in a text becomes that token, as by the library's
    plain ``encode``; otherwise it is ordinary text. Texts that hold such a string are encoded as they
    are too, so pieces never see one.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.special = Tokenizer.from_file(path), special
        self.tokenizer.encode_special_tokens = True
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.leads = np.zeros(max(self.tokenizer.get_vocab_size(), 1 + max(vocabulary.values())), dtype=bool)
        self.leads[[i for t, i in vocabulary.items() if "Ġ" in t]] = True
        self.clear()

    def clear(self) -> None:
        # Codes of parts by whether they follow a space. Code 0 is the end id, code 1 nothing.
        self.led: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.int32), 1
        self.start, self.length, self.known = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32), 2
        self.flat[0], self.length[0] = END, 1
        self.turn = np.zeros(1 << 18, np.int32)  # the batch that last used a code
        self.batch = 0

    def trim(self) -> None:
        """Keep the parts that the last batch used, or none if they are the most of the memory."""
        led, bare, flat, start, length, turn = self.led, self.bare, self.flat, self.start, self.length, self.turn
        recent, batch = turn[: self.known] >= self.batch, self.batch
        self.clear()
        self.batch = batch
        recent[:2] = False
        codes = np.flatnonzero(recent)
        if PART_BYTES * len(codes) > CACHE_BYTES // 2:
            return
        first = self.store(flat[ranges(start[codes], length[codes])], length[codes])
        renamed = np.zeros(len(recent), np.int64)
        renamed[codes] = first + np.arange(len(codes))
        self.led = {p: int(renamed[c]) for p, c in led.items() if recent[c]}
        self.bare = {p: int(renamed[c]) for p, c in bare.items() if recent[c]}

    def ids(self, text: str) -> list[int]:
        self.tokenizer.encode_special_tokens = not self.special
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        self.tokenizer.encode_special_tokens = True
        return found

    def store(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Code of the first of new entries, whose ids follow each other."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(lengths) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.turn = np.concatenate([self.turn, np.zeros_like(self.turn)])
        first = self.known
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first : first + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[first : first + len(lengths)] = lengths
        self.used += len(ids)
        self.known += len(lengths)
        return first

    def learn_led(self, parts: list[str]) -> range:
        """Parts that follow a space."""
        strings = [" " + " ".join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)]
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.int32) for e in found])
        begins = np.flatnonzero(self.leads[ids])
        if len(begins) != len(parts):
            raise ValueError("the vocabulary joins pieces across spaces")
        first = self.store(ids, np.diff(np.append(begins, len(ids))))
        return range(first, first + len(parts))

    def learn_bare(self, parts: list[str]) -> range:
        """Parts that follow none: rests, and what a text begins with."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        first = self.store(np.array([i for f in found for i in f], dtype=np.int32), np.array([len(f) for f in found]))
        return range(first, first + len(parts))

    def part_codes(self, parts: pa.Array, led: bool) -> np.ndarray:
        """A code per part; null is nothing."""
        coded = parts.dictionary_encode()
        values = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.led if led else self.bare
        found = list(map(known.get, values))
        new = [v for v, f in zip(values, found) if f is None]
        if new:
            codes = self.learn_led(new) if led else self.learn_bare(new)
            known.update(zip(new, codes))
            following = iter(codes)
            found = [next(following) if f is None else f for f in found]
        table = np.array([*found, 1], dtype=np.int32)
        self.turn[table] = self.batch
        return table[pc.fill_null(coded.indices, len(values)).to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and how many each has."""
        if 4 * self.used + PART_BYTES * self.known > CACHE_BYTES:
            self.trim()
        self.batch += 1
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        for mark in self.marks:
            unsafe = unsafe | pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        safe = pc.if_else(pa.array(unsafe), pa.scalar("", texts.type), texts) if unsafe.any() else texts
        split = pc.split_pattern(safe, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        pieces = split.flatten().dictionary_encode()
        place, heads = pieces.indices.to_numpy(), offsets[:-1]
        cut = pc.extract_regex(pieces.dictionary, CUT)
        whole = cut.is_null()
        word = pc.if_else(whole, pieces.dictionary, cut.field("word"))
        rest = cut.field("rest")
        rest = pc.if_else(pc.or_kleene(whole, pc.equal(rest, "")), pa.scalar(None, rest.type), rest)
        needed = np.zeros(len(word), dtype=bool)
        led = np.ones(len(place), dtype=bool)
        led[heads] = False
        needed[place[led]] = True
        # Per piece the word, then the rest; then, at a text's end, the end id.
        words = np.ones(len(word), np.int32)
        at = pa.array(np.flatnonzero(needed))
        words[needed] = self.part_codes(word.take(at), True)
        rests = self.part_codes(rest, False)
        codes = np.empty(2 * len(place) + len(heads), np.int32)
        text_of = np.repeat(np.arange(len(heads)), np.diff(offsets))
        spot = 2 * np.arange(len(place)) + text_of
        codes[spot], codes[spot + 1] = words[place], rests[place]
        codes[spot[heads]] = self.part_codes(word.take(pa.array(place[heads])), False)
        borders = 2 * offsets + np.arange(len(offsets))
        codes[borders[1:] - 1] = 0
        kept = self.used, self.known
        for i in np.flatnonzero(unsafe):
            ids = self.ids(texts[int(i)].as_py())
            codes[borders[i]] = self.store(np.array(ids, dtype=np.int32), np.array([len(ids)]))
        lengths = self.length[codes]
        ids = self.flat[ranges(self.start[codes], lengths)]
        self.used, self.known = kept
        per_text = np.diff(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[borders])
        return ids, per_text


def frequent_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs that stand ``LEAST_COUNT`` times or more, the number of each place's pair
    among those, and their counts, all exact: pairs are sorted with their places."""
    n = len(left)
    bits, place_bits = (int(max(left.max(), right.max())).bit_length() if n else 1), n.bit_length()
    pair = (left.astype(np.uint64) << np.uint64(bits)) | right
    if 2 * bits + place_bits <= 64:
        pair = (pair << np.uint64(place_bits)) | np.arange(n, dtype=np.uint64)
        pair.sort()
        order = (pair & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        pair >>= np.uint64(place_bits)
    else:
        order = np.argsort(pair)
        pair = pair[order]
    first = np.flatnonzero(np.concatenate([[n > 0], pair[1:] != pair[:-1]]))
    counts = np.diff(np.append(first, n))
    enough = counts >= LEAST_COUNT
    number = np.where(enough, np.cumsum(enough) - 1, -1).astype(np.int32)
    of_place = np.empty(n, np.int32)
    of_place[order] = np.repeat(number, counts)
    at = np.flatnonzero(of_place >= 0)
    return at, of_place[at], counts[enough]


def repair(ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last, left, right): the compressed sequence, its document ends, and the rules.

    The rule for symbol ``base + i`` is (left[i], right[i]), with base = largest id + 1. A pair that is
    too rare never becomes frequent again, because replacing only takes places from it: later rounds
    count the pairs that are still frequent and those with a new symbol.
    """
    symbols, base = ids.astype(np.uint32), int(ids.max()) + 1
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    following = base
    open_ = ~last
    while True:
        at = np.flatnonzero(open_[:-1] & ~last[:-1])
        kept, number, counts = frequent_pairs(symbols[at], symbols[at + 1])
        if not len(kept):
            break
        at = at[kept]
        open_ = np.zeros(len(symbols), dtype=bool)
        open_[at] = True
        taken = np.flatnonzero(counts[number] * FEWER >= counts.max())
        where, which = at[taken], number[taken]
        # Overlapping places form runs; every other place of a run is taken, from the left.
        head = np.diff(where, prepend=-2) != 1
        turn = np.arange(len(where)) - np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))
        mine = turn % 2 == 0
        where, which = where[mine], which[mine]
        uses = np.bincount(which, minlength=len(counts))
        worth = uses[which] >= 2  # a pair whose places its neighbours took waits
        where, which = where[worth], which[worth]
        rule = np.zeros(len(counts), np.uint32)
        used = np.zeros(len(counts), dtype=bool)
        used[which] = True
        rule[used] = following + np.arange(np.count_nonzero(used))
        example = np.zeros(len(counts), np.int64)
        example[which] = where
        example = example[used]
        left.append(symbols[example])
        right.append(symbols[example + 1])
        following += len(example)
        symbols[where] = rule[which]
        last[where] |= last[where + 1]
        open_[where] = True  # with what follows, and so is what lies before
        open_[where[where > 0] - 1] = True
        stay = np.ones(len(symbols), dtype=bool)
        stay[where + 1] = False
        # What lies before a pair's end is before the new symbol once the end is gone.
        symbols, last, open_ = symbols[stay], last[stay], open_[stay]
    none = [np.zeros(0, np.uint32)]
    return symbols, last, np.concatenate(none + left), np.concatenate(none + right)


def rule_steps(base: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rules that only use ids and the rules of earlier runs."""
    newest, start = np.maximum(left, right).astype(np.int64) - base, 0
    while start < len(newest):
        later = np.flatnonzero(newest[start:] >= start)
        stop = start + int(later[0]) if len(later) else len(newest)
        yield start, stop
        start = stop


def expansion_lengths(base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    length = np.ones(base + len(left), np.int64)
    for a, b in rule_steps(base, left, right):
        length[base + a : base + b] = length[left[a:b]] + length[right[a:b]]
    return length[base:]


def to_bytes(symbols: np.ndarray, width: int) -> bytes:
    return symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def from_bytes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u4")


def pack(part: int, shard: int, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> dict:
    """A shard's row from its documents' ids."""
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(lengths) - 1] = True
    base = int(ids.max()) + 1
    symbols, last, left, right = repair(ids, last)
    per_doc = np.diff(np.flatnonzero(last), prepend=-1)
    width = max(2, -(-(base + len(left) - 1).bit_length() // 8))
    return {
        "part": part, "shard": shard, "n_docs": len(doc_ids), "n_ids": len(ids), "doc_ids": doc_ids,
        "doc_symbols": per_doc.astype("<i8").tobytes(), "doc_lengths": lengths.astype("<i8").tobytes(), "base": base, "width": width,
        "left": to_bytes(left, width), "right": to_bytes(right, width),
        "expansion": expansion_lengths(base, left, right).astype("<i8").tobytes(), "symbols": to_bytes(symbols, width),
    }


class Shard:
    """A packed shard, opened for reading."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        symbols = lambda name: from_bytes(row[name], row["width"])
        self.base = row["base"]
        self.left, self.right = symbols("left").astype(np.int64), symbols("right").astype(np.int64)
        self.length = np.concatenate([np.ones(self.base, np.int64), read("expansion", "<i8")])
        self.symbols = symbols("symbols")
        self.per_doc, self.lengths = read("doc_symbols", "<i8"), read("doc_lengths", "<i8")
        self.begin = np.cumsum(self.per_doc) - self.per_doc
        self.doc_ids = row["doc_ids"]

    def all_ids(self) -> np.ndarray:
        """Every id of the shard: each rule is expanded once, then symbols copy their expansion."""
        start = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.length[self.base :]) - self.length[self.base :]])
        flat = np.zeros(self.base + int(self.length[self.base :].sum()), dtype="<u4")
        flat[: self.base] = np.arange(self.base)
        for a, b in rule_steps(self.base, self.left, self.right):
            sides = np.stack([self.left[a:b], self.right[a:b]], axis=1).reshape(-1)
            begin, sizes = int(start[self.base + a]), self.length[sides]
            flat[begin : begin + int(sizes.sum())] = flat[ranges(start[sides], sizes)]
        return flat[ranges(start[self.symbols], self.length[self.symbols])]

    def ids_of(self, doc: int, start: int, stop: int) -> list[int]:
        """Ids [start, stop) of one document. Only symbols that overlap the range are expanded, and
        of those only the rules on the way to it."""
        symbols = self.symbols[self.begin[doc] : self.begin[doc] + self.per_doc[doc]].astype(np.int64)
        ends = np.cumsum(self.length[symbols])
        stop = min(stop, int(self.lengths[doc]))
        out: list[int] = []
        if start >= stop:
            return out
        first = int(np.searchsorted(ends, start, side="right"))
        last = int(np.searchsorted(ends, stop, side="left"))
        pending = [(int(s), int(e - self.length[s])) for s, e in zip(symbols[first : last + 1], ends[first : last + 1])][::-1]
        while pending:
            symbol, begin = pending.pop()
            size = int(self.length[symbol])
            if begin >= stop or begin + size <= start:
                continue
            if symbol < self.base:
                out.append(symbol)
            else:
                a, b = int(self.left[symbol - self.base]), int(self.right[symbol - self.base])
                pending += [(b, begin + int(self.length[a])), (a, begin)]
        return out


def write_ids(docs: DataFrame, tokenizer: str, path: str, shard_ids: int = SHARD_IDS, special: bool = False) -> None:
    """Encode and compress ``docs`` into the folder ``path``, in ascending order of doc_id.

    Null texts are empty (one end id); null ids come first; equal ids are ordered by a hash of the
    text. A document longer than a shard is a shard of its own. No rows write an empty folder.
    ``special``: strings of special tokens in a text become those tokens.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = text_or_empty(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(1)).to_numpy(), BYTES_AT_ONCE):
                yield batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        key = (tokenizer, special)
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(*key))
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            row = pack(part, shard, doc_ids, np.concatenate(ids), np.concatenate(lengths))
            return pa.RecordBatch.from_pylist([row], schema=FILE_ARROW)

        for batch in small(batches):
            names, found, counts = batch.column(0).to_pylist(), *encoder.encode(batch.column(1))
            ends = np.cumsum(counts)
            begin = 0
            while begin < len(names):
                before = int(ends[begin - 1]) if begin else 0
                # As many documents as fill the shard, one at least.
                stop = max(begin + 1, int(np.searchsorted(ends, before + shard_ids - held, side="right")))
                doc_ids += names[begin:stop]
                ids.append(found[before : int(ends[stop - 1])])
                lengths.append(counts[begin:stop])
                held += len(ids[-1])
                begin = stop
                if begin < len(names) or held >= shard_ids:
                    yield flush()
                    shard, held, doc_ids, ids, lengths = shard + 1, 0, [], [], []
        if doc_ids:
            yield flush()

    rows.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files.

    ``start`` counts the ids of all documents before it: totals per part meet in one place (a row
    per written partition), totals per shard within their part.
    """
    ship_package(spark)
    files = spark.read.schema(SHARD_SCHEMA).parquet(path)
    shards = files.select("part", "shard", "n_ids")
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_shard_start"))
    starts = starts.join(F.broadcast(parts), "part")  # a row per written partition
    starts = starts.select("part", "shard", (F.col("_part_start") + F.col("_shard_start")).alias("_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                ids = shard.all_ids()
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist())]
                n = len(crc)
                columns = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()),
                    pa.array(begins, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "shard", "_begin", "n_tokens", "ids_crc32"])

    decoded = files.mapInArrow(run, "doc_id bigint, part int, shard int, _begin bigint, n_tokens bigint, ids_crc32 bigint")
    return decoded.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("_start") + F.col("_begin")).alias("start"), "n_tokens", "ids_crc32"
    )


def encoded_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files to the shared folder and read every document back. The ids are those of the
    library's plain ``encode(text, add_special_tokens=False)``."""
    path = new_scratch_path(docs.sparkSession, "token-files")
    write_ids(docs, tokenizer, path, special=True)
    return read_ids(docs.sparkSession, path)
