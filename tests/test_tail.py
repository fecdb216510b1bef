"""Files that grow between triggers against one read of the whole files."""

import os
import random

import pyarrow as pa
import pytest

from shardloom.session import new_scratch_path
from shardloom.sources import tail


def add(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "ab") as file:
        file.write(data)


def follow(spark, folder, out, state):
    tail.number_lines(tail.tail_lines(spark, folder, ".log", span=16), out, state).awaitTermination()
    return sorted((os.path.basename(r.path), r.line_no, r.at, r.value) for r in tail.read_numbered(spark, out).collect())


def whole(folder):
    found = []
    for name in sorted(os.listdir(folder)):
        data, at = open(os.path.join(folder, name), "rb").read(), 0
        for i, line in enumerate(data.split(b"\n")[:-1]):
            found.append((name, i, at, line.decode("utf-8", "replace")))
            at += len(line) + 1
    return found


def test_growing_files_equal_one_read(spark):
    folder, out, state = (new_scratch_path(spark, f"test-tail-{n}") for n in ("in", "out", "state"))
    add(folder, "a.log", b"one\n\ntwo with many words that cross spans\nunfin")
    add(folder, "b.log", b"")
    assert follow(spark, folder, out, state) == whole(folder)
    # The unfinished line ends, a file begins, another one has no whole line yet, one stays as it is.
    add(folder, "a.log", b"ished\n\xff\xc3\xa9\r\n")
    add(folder, "b.log", b"no end yet")
    add(folder, "c.log", "é".encode() * 40 + b"\nnext\n")
    got = follow(spark, folder, out, state)
    assert got == whole(folder) and ("a.log", 3, 42, "unfinished") in got
    add(folder, "c.log", b"last\n")
    assert follow(spark, folder, out, state) == whole(folder)


def test_every_split_gives_each_line_once():
    rng = random.Random(2)
    for _ in range(200):
        data = b"".join(b"x" * rng.choice([0, 1, 2, 9]) + b"\n" for _ in range(rng.randrange(1, 12)))
        file, span = pa.BufferReader(data), rng.randrange(1, 8)
        cuts = range(0, len(data), span)
        got = [row for low in cuts for rows in tail.lines_within(file, 0, low, min(low + span, len(data)), len(data)) for row in rows]
        want, at = [], 0
        for line in data.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert got == want


def test_last_line_end():
    for data, end in ((b"", 0), (b"abc", 0), (b"a\nb", 2), (b"\n", 1), (b"a\n" + b"x" * 200_000, 2)):
        assert tail.last_line_end(pa.BufferReader(data), len(data)) == end


def test_a_shorter_file_is_an_error():
    reader = tail.TailReader({"path": "/none"})
    with pytest.raises(ValueError, match="only grow"):
        reader.partitions({"f": 10}, {"f": 4})
    assert reader.partitions({"f": 10, "gone": 3}, {"f": 10}) == []
