"""Fill-in-the-middle: prefix, middle and suffix of every text in a new order.

A text is bytes in fixed blocks. Per block two Fenwick trees hold how many units and how many code
points start in it; a binary-lifting descent on the units finds the block of a cut and counts the
code points before it on the way, and only that block is searched for the exact place. The trees of
all texts of a slice lie in one array and are built and descended together.

Where a text is cut and in what form it is written depends on its id and the seed alone, so any
partitioning and any task retry give the same rows. Rows are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import slices, text_or_empty
from shardloom.session import ship_package

BLOCK = 256  # bytes
BYTES_AT_ONCE = 4_000_000
# The marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("code_points", "words", "lines")
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def unit_starts(data: np.ndarray, begins: np.ndarray, unit: str) -> np.ndarray:
    """Where units start in the bytes of texts that follow each other; no text begun is empty.

    A word starts at a byte that is no ASCII white space and follows one, a line behind a line feed.
    """
    if unit == "code_points":
        return (data & 0xC0) != 0x80
    starts = np.zeros(len(data), dtype=bool)
    if unit == "lines":
        starts[1:] = data[:-1] == 10
        starts[begins] = True
        return starts
    if unit != "words":
        raise ValueError(f"unit {unit} is none of {UNITS}")
    solid = ~WHITE[data]
    starts[1:] = solid[1:] & ~solid[:-1]
    starts[begins] = solid[begins]
    return starts


class Trees:
    """Fenwick trees over the blocks of many texts, each with one count per kind of start.

    ``data`` holds the texts one after the other, ``lengths`` their bytes. Node i (from 1) of a text
    stands for the blocks (i - lowest bit of i, i].
    """

    def __init__(self, lengths: np.ndarray, kinds: list[np.ndarray]):
        self.begins = np.cumsum(lengths) - lengths
        self.lengths, self.kinds = lengths, kinds
        self.blocks = -(-lengths // BLOCK)
        self.base = np.cumsum(self.blocks) - self.blocks
        owner = np.repeat(np.arange(len(lengths)), self.blocks)
        node = np.arange(len(owner)) - self.base[owner] + 1
        edges = self.begins[owner] + (node - 1) * BLOCK
        self.nodes = [np.add.reduceat(kind, edges, dtype=np.int64) if len(edges) else np.zeros(0, np.int64) for kind in kinds]
        self.totals = [np.bincount(owner, counts, len(lengths)).astype(np.int64) for counts in self.nodes]
        self.top = 1 << (int(self.blocks.max(initial=0))).bit_length() >> 1
        lowest, step = node & -node, 1
        while step <= self.top:
            child = np.flatnonzero((lowest == step) & (node + step <= self.blocks[owner]))
            for counts in self.nodes:
                counts[child + step] += counts[child]
            step *= 2

    def locate(self, text: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte in its text at which unit number ``unit`` (from 0) starts, and how many starts of the
        second kind lie before it. Unit 0 counts as starting with the text; the number of units is
        the text's end."""
        left, block, before = unit.copy(), np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        step = self.top
        while step:
            ahead = block + step
            fits = ahead <= self.blocks[text]
            at = np.where(fits, self.base[text] + ahead - 1, 0)
            fits &= self.nodes[0][at] <= left
            left -= np.where(fits, self.nodes[0][at], 0)
            before += np.where(fits, self.nodes[1][at], 0)
            block = np.where(fits, ahead, block)
            step //= 2
        place = np.minimum(block * BLOCK, self.lengths[text])
        inside = np.flatnonzero(block < self.blocks[text])
        for low in range(0, len(inside), 4096):
            cut = inside[low : low + 4096]
            first = self.begins[text[cut]] + place[cut]
            span = np.minimum(BLOCK, self.lengths[text[cut]] - place[cut])
            window = np.minimum(first[:, None] + np.arange(BLOCK), len(self.kinds[0]) - 1)
            own = np.arange(BLOCK) < span[:, None]
            reached = np.cumsum(self.kinds[0][window] & own, axis=1, dtype=np.int32) > left[cut][:, None]
            offset = np.argmax(reached, axis=1)
            earlier = own & (np.arange(BLOCK) < offset[:, None])
            before[cut] += np.count_nonzero(self.kinds[1][window] & earlier, axis=1)
            place[cut] += offset
        whole = unit == 0
        place[whole], before[whole] = 0, 0
        return place, before


def cut_texts(texts: pa.Array, draws: np.ndarray, forms: list[str], unit: str, marks: tuple[str, str, str]) -> list[pa.Array]:
    """n, prefix_chars, middle_chars and output of every text; ``draws`` has two columns."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    raw = memoryview(buffer)[offsets[0] : offsets[-1]] if buffer is not None else memoryview(b"")
    data, lengths = np.frombuffer(raw, np.uint8), np.diff(offsets)
    starts = offsets[:-1] - offsets[0]
    points = unit_starts(data, starts, "code_points")
    units = points if unit == "code_points" else unit_starts(data, starts[lengths > 0], unit)
    trees = Trees(lengths, [units, points])
    n = trees.totals[0]
    text = np.arange(len(lengths))
    bounds = np.sort(draws % (n[:, None] + 1), axis=1)
    (low, before_low), (high, before_high) = (trees.locate(text, bounds[:, i]) for i in (0, 1))
    p, s, m = (mark.encode() for mark in marks)
    outputs = []
    for form, begin, size, a, b in zip(forms, starts.tolist(), lengths.tolist(), low.tolist(), high.tolist()):
        prefix, middle, suffix = raw[begin : begin + a], raw[begin + a : begin + b], raw[begin + b : begin + size]
        if form == "plain":
            outputs.append(bytes(raw[begin : begin + size]))
        elif form == "psm":
            outputs.append(b"".join([p, prefix, s, suffix, m, middle]))
        else:
            outputs.append(b"".join([s, suffix, p, prefix, m, middle]))
    plain = np.array([f == "plain" for f in forms], dtype=bool)
    return [
        pa.array(n, pa.int64()),
        pa.array(before_low, pa.int64(), mask=plain),
        pa.array(before_high - before_low, pa.int64(), mask=plain),
        pa.array(outputs, pa.string()),
    ]


def drawn(doc_id: Column, seed: int, group: int) -> Column:
    """The group-th eight hexadecimal digits (from 0) of sha256("seed:doc_id") as a number."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 8 * group + 1, 8), 16, 10).cast("bigint")


def infill(
    docs: DataFrame,
    seed: int = 1,
    unit: str = "code_points",
    rate: int = 90,
    spm: int = 20,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """doc_id, form, n (units), prefix_chars, middle_chars and output of every document.

    Two of the n + 1 places between units, drawn from the id, bound the middle. ``rate`` of 100
    texts are rearranged, of those ``spm`` of 100 with the suffix first (form ``spm``), the others
    with the prefix first (``psm``). Texts that are empty or hold a mark stay ``plain``, as do the
    rest of the hundred; their two character counts are null. Null texts are empty. A null id draws as
    an empty one; rows with the same id draw alike, and every row is kept. Other columns are left out.
    No rows give no rows.
    """
    ship_package(docs.sparkSession)
    text = text_or_empty(F.col("text"))
    marked = F.contains(text, F.lit(marks[0])) | F.contains(text, F.lit(marks[1])) | F.contains(text, F.lit(marks[2]))
    h = [drawn(F.col("doc_id"), seed, i) for i in range(4)]
    form = (
        F.when((text == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    )
    rows = docs.select("doc_id", text.alias("text"), h[0].alias("low"), h[1].alias("high"), form.alias("form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column("text")).to_numpy(), BYTES_AT_ONCE):
                part = batch.slice(a, b - a)
                draws = np.stack([part.column(c).to_numpy() for c in ("low", "high")], axis=1)
                found = cut_texts(part.column("text"), draws, part.column("form").to_pylist(), unit, marks)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("form"), *found], names)

    names = ["doc_id", "form", "n", "prefix_chars", "middle_chars", "output"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {id_type}, form string, n bigint, prefix_chars bigint, middle_chars bigint, output string"
    )


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text an output was made of. Each mark stands in a rearranged output once, because no text
    with a mark is rearranged and no mark begins as another one ends."""
    p, s, m = marks
    between = lambda first, last: F.substring_index(F.substring_index(output, first, -1), last, 1)
    middle = F.substring_index(output, m, -1)
    return (
        F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), middle, between(s, p)))
        .otherwise(output)
    )
