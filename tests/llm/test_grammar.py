import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shardloom.llm import grammar as G
from shardloom.llm.common import documents
from shardloom.llm.queries import QUERIES, TOKENIZER
from shardloom.session import new_scratch_path

ODD = [
    "", " ", "  a", "a  b", "a b ", "x\n y", "é  ü\n\n z", "don't  stop", "a \t b", "a\t \tb", "  ", "\n", " a", "a \n", "a \n ",
    "a  b", "a　　 b", "123 45!? ok", "A\n B\n\nC d", "<|endoftext|> x", "日本 語  k", "! ! !!!!", "\x1c a",
]


def plain():
    found = Tokenizer.from_file(TOKENIZER)
    found.encode_special_tokens = True
    return found


def wanted(rows):
    tokenizer, out, start = plain(), [], 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_encoder_equals_the_tokenizer(spark, sf_dir):
    texts = ODD + [r["text"] for r in documents(spark, sf_dir).select("text").collect()]
    ids, counts = G.Encoder(TOKENIZER).encode(pa.array(texts))
    tokenizer = plain()
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0], text[:40]


def test_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    lengths = np.array([1, 400, 1, 3000, 50, 2])
    ids = np.concatenate([rng.integers(0, 6, 3000), np.zeros(454, np.int64)]).astype(np.int32)
    row = G.pack(0, 0, [None, 1, 2, 2, 3, 9], ids, lengths)
    assert len(row["left"]) > 0 and len(row["symbols"]) // 2 < len(ids) // 2
    shard = G.Shard(row)
    assert shard.all_ids().tolist() == ids.tolist()
    for doc, (a, n) in enumerate(zip(np.cumsum(lengths) - lengths, lengths)):
        whole = ids[a : a + n].tolist()
        for s, e in ((0, n), (0, 1), (n // 2, n // 2 + 7), (n - 1, n + 5), (n, n + 1), (3, 3)):
            assert shard.ids_of(doc, s, e) == whole[s:e]
    # Rules never join the ids of two documents, and every length is that of its expansion.
    assert shard.per_doc.sum() == len(shard.symbols)
    assert [int(shard.length[shard.symbols[b : b + k]].sum()) for b, k in zip(shard.begin, shard.per_doc)] == lengths.tolist()


def test_whole_table(spark, sf_dir):
    rows = sorted((r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect())
    assert sorted(map(tuple, QUERIES["op4_token_files"](spark, sf_dir).collect())) == wanted(rows)


def test_odd_rows_and_small_shards(spark):
    rows = [(3, "a b"), (1, None), (7, "long words " * 20000), (4, "")] + [(100 + i, t) for i, t in enumerate(ODD)] + [(9, "same"), (9, "same")]
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, _h string, start int")
    path = new_scratch_path(spark, "small-shards")
    G.write_ids(docs.repartition(3), TOKENIZER, path, shard_ids=64)
    assert sorted(map(tuple, G.read_ids(spark, path).collect())) == wanted(sorted(rows, key=lambda r: r[0]))
    nothing = new_scratch_path(spark, "no-shards")
    G.write_ids(docs.limit(0), TOKENIZER, nothing)
    assert G.read_ids(spark, nothing).count() == 0


def test_null_ids_come_first(spark):
    docs = spark.createDataFrame([(1, "b"), (None, "a a")], "doc_id long, text string")
    got = {r["doc_id"]: r["start"] for r in G.encoded_documents(docs, TOKENIZER).collect()}
    assert got == {None: 0, 1: 3}


def test_special_strings_as_by_the_unmodified_tokenizer(spark):
    texts = ODD + ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endof text|> <|endoftext|", "one two"]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    found = [tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert 50256 in found[len(ODD)]
    ids, counts = G.Encoder(TOKENIZER, special=True).encode(pa.array(texts))
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == found
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    starts = np.cumsum([0] + [len(f) for f in found]).tolist()
    rows = [(i, starts[i], len(f), zlib.crc32(np.array(f, dtype="<u4").tobytes())) for i, f in enumerate(found)]
    assert sorted(map(tuple, G.encoded_documents(docs, TOKENIZER).collect())) == rows


def test_wide_ids_come_back():
    for top in (65_535, 65_536, 1 << 22):
        ids = np.array([5, top, 0, *[7, top] * 40, 0], dtype=np.int64)
        row = G.pack(0, 0, [1, 2], ids, np.array([3, len(ids) - 3]))
        assert len(row["left"]) > 0 and G.Shard(row).all_ids().tolist() == ids.tolist()


def count_pairs(symbols, last):
    found = {}
    for i in range(len(symbols) - 1):
        if not last[i]:
            found.setdefault((int(symbols[i]), int(symbols[i + 1])), []).append(i)
    return found


@pytest.mark.parametrize("kinds", [2, 40, 3000])
def test_no_frequent_pair_stays(kinds):
    rng = np.random.default_rng(kinds)
    lengths = rng.integers(1, 300, 200)
    ids = (rng.zipf(1.3, int(lengths.sum())) % kinds).astype(np.int32)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum(lengths) - 1] = True
    symbols, ends, left, right = G.repair(ids, last.copy())
    assert len(left) == len(right) > 0 and ends.sum() == len(lengths)
    assert max(map(len, count_pairs(symbols, ends).values()), default=0) < G.LEAST_COUNT
    base = int(ids.max()) + 1
    assert G.expansion_lengths(base, left, right).min() >= 2
    assert len({(int(a), int(b)) for a, b in zip(left, right)}) == len(left)


def test_exact_counts_of_pairs():
    rng = np.random.default_rng(0)
    for top in (50, 1 << 31):
        symbols = rng.choice(rng.integers(0, top, 60), 5000).astype(np.uint32)
        at, number, counts = G.frequent_pairs(symbols[:-1], symbols[1:])
        wanted = {p: w for p, w in count_pairs(symbols, np.zeros(len(symbols), bool)).items() if len(w) >= G.LEAST_COUNT}
        assert sorted(counts.tolist()) == sorted(map(len, wanted.values()))
        assert at.tolist() == sorted(i for w in wanted.values() for i in w)
        assert all(counts[n] == len(wanted[int(symbols[i]), int(symbols[i + 1])]) for i, n in zip(at, number))


def test_texts_encoded_whole_are_not_kept():
    encoder, tokenizer = G.Encoder(TOKENIZER), plain()
    texts = [f"def f{i}():\n    return  {i}  # two  spaces" for i in range(5000)]
    encoder.encode(pa.array(["some words"]))
    before = encoder.used, encoder.known, len(encoder.led), len(encoder.bare)
    for low in range(0, len(texts), 500):
        ids, counts = encoder.encode(pa.array(texts[low : low + 500]))
    assert ids[: counts[0]].tolist() == tokenizer.encode(texts[4500], add_special_tokens=False).ids + [0]
    first = encoder.encode(pa.array([""]))
    assert (encoder.used - before[0] < 50, encoder.known - before[1] < 5) == (True, True) and first[0].tolist() == [0]


def test_pieces_cut_behind_letters():
    texts = ["don't isn't l'été x'S", "abc123 déjà-vu, naïve. Ünï", "word.\nNext line\n\nlast\n", "Привет, мир! abcпривет", "aªb ǅx ẞ! ſs.", "a\tb c\x1cd é\u0301. x²y"]
    ids, counts = G.Encoder(TOKENIZER).encode(pa.array(texts))
    tokenizer = plain()
    for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert part.tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0], text


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(G, "CACHE_BYTES", 40_000)
    encoder, tokenizer = G.Encoder(TOKENIZER), plain()
    for n in range(20):
        text = " ".join(f"w{n}x{i}!" for i in range(100))
        assert encoder.encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0]
    assert 4 * encoder.used + G.PART_BYTES * encoder.known < 80_000


def test_trimming_keeps_recent_parts(monkeypatch):
    encoder, tokenizer = G.Encoder(TOKENIZER), plain()
    same = lambda text: encoder.encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [0]
    assert same(" ".join(f"old{'x' * (i % 50)}é, " for i in range(300)).replace(", ", ",")) and same("begin new words, here's some; more")
    before = len(encoder.led)
    monkeypatch.setattr(G, "CACHE_BYTES", 4 * encoder.used + G.PART_BYTES * encoder.known - 1)
    assert same("new words, again here's some") and 0 < len(encoder.led) < before and "new" in encoder.led and "words" in encoder.led
    assert same("begin old oldx oldxxé, new words")
