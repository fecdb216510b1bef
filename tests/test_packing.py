import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.constants import EOT, SPECIAL_TOKENS
from shardloom.functions.arrays import occurrences
from shardloom.functions.pieces import Piece, encode_examples
from shardloom.functions.vocab import decode_column, encoder, list_sizes, small_batches, text_sizes
from shardloom.operators import packing as p
from shardloom.operators import quality
from shardloom.plans.corpus import build_corpus
from shardloom.session import new_scratch_path
from shardloom.sources.corpus import scan_corpus
from shardloom.sources.shards import scan_shards, write_shards

DOCS = [
    ("a", 0, "first text"),
    ("a", 1, None),
    ("a", 2, ""),
    ("a", 3, "  \n "),
    ("a", 4, "long " * 90),
    ("a", 5, "special <|im_end|> stays text"),
    ("a", 900_000_007, "naïve café 日本 😀"),
    ("b", 6, "x" * 29),  # exactly one shard of 30 with its separator
    ("b", 7, "tail"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "source string, ord bigint, text string")


def streams(vocab):
    enc = encoder()
    out = {}
    for source, ord_, text in DOCS:
        if text:
            ids = [ord(c) for c in text] if vocab == "char" else enc.encode_ordinary(text)
            out.setdefault(source, []).extend([EOT, *ids])
    return out


def by_shard(segments):
    shards = {}
    for r in sorted(segments.collect(), key=lambda r: (r.source, r.shard_id, r.seg_start)):
        cell = shards.setdefault((r.source, r.split, r.shard_id), [])
        assert r.seg_start == len(cell), "gap or overlap"
        cell.extend(r.tokens)
    return shards


def brute(vocab, size, total=None, val_shards=1):
    shards = {}
    for source, ids in streams(vocab).items():
        if total is not None:
            ids = ids[: -(-total // size) * size]
        for i in range(0, len(ids), size):
            split = "val" if i // size < val_shards else "train"
            shards[source, split, i // size] = ids[i : i + size]
    return shards


@pytest.mark.parametrize("vocab", ["char", "byte_bpe_50k.tiktoken"])
@pytest.mark.parametrize("size,total,val", [(30, None, 1), (30, 70, 0), (7, 100, 3), (1000, None, 1)])
def test_shards_equal_the_concatenated_stream(docs, vocab, size, total, val):
    placed = p.token_offsets(p.tokenize_corpus(docs, vocab))
    assert by_shard(p.pack_shards(placed, size, total, val)) == brute(vocab, size, total, val)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitioning_does_not_matter(docs, parts):
    placed = p.token_offsets(p.tokenize_corpus(docs.repartition(parts), "char"))
    assert by_shard(p.pack_shards(placed, 30)) == brute("char", 30)


def test_bpe_equals_the_library_row_by_row(docs):
    enc = encoder()
    rows = {r.ord: r for r in p.tokenize_corpus(docs).collect()}
    for _, ord_, text in DOCS:
        if text:
            assert rows[ord_].tokens == [EOT, *enc.encode_ordinary(text)]
            assert rows[ord_].n_tok == len(rows[ord_].tokens)
        else:
            assert ord_ not in rows
    assert not set(rows[5].tokens) & set(SPECIAL_TOKENS.values())


def test_decoding_gives_the_text_back(docs):
    tokens = p.tokenize_corpus(docs).select("ord", F.expr("slice(tokens, 2, size(tokens))").alias("tokens"))
    assert {r.ord: r.text for r in decode_column(tokens).collect()} == {o: t for _, o, t in DOCS if t}


def test_tokens_in_place_are_those_placed_afterwards(docs):
    rows = lambda df: sorted(tuple(r) for r in df.select("source", "ord", "start", "n_tok", "tokens").collect())
    wanted = rows(p.token_offsets(p.tokenize_corpus(docs, "char")))
    assert len(wanted) == 7 and rows(p.tokenize_in_place(docs)) == wanted == rows(p.tokenize_in_place(docs, 12))


def test_occurrences(spark):
    cases = [[], [7], [EOT], [EOT, 1, 2], [1, EOT], [EOT, EOT], [1, EOT, 2, EOT, EOT, 3], [None, EOT], [EOT, None], [EOT, None, EOT], [None], None]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ids array<int>")
    found = {r.i: r.n for r in frame.select("i", occurrences(F.col("ids"), EOT).alias("n")).collect()}
    assert [found[i] for i in range(len(cases))] == [None if c is None else c.count(EOT) for c in cases]


def test_char_ids_hold_any_code_point(docs):
    rows = {r.ord: r.tokens for r in p.tokenize_corpus(docs, "char").collect()}
    assert rows[900_000_007][1:] == [ord(c) for c in DOCS[6][2]]


def test_id_range(spark, docs):
    tokens = p.tokenize_corpus(docs, "char")
    good, bad = p.split_by_id_range(tokens)
    assert [r.ord for r in bad.collect()] == [900_000_007]
    assert good.count() == 6
    with pytest.raises(Exception, match="token id outside"):
        p.check_id_range(tokens).agg(F.sum(F.size("tokens"))).collect()
    assert p.check_id_range(good).count() == 6


@pytest.mark.parametrize("total", [20, 100, 10_000])
def test_budgeted_tokenisation_equals_the_full_one(docs, total):
    tokens = p.tokenize_to_budget(docs, total, 30, "char", tokens_per_doc=300.0)
    assert by_shard(p.pack_shards(p.token_offsets(tokens), 30, total)) == brute("char", 30, total)


def test_budget_leaves_documents_beyond_it_unencoded(spark):
    many = spark.range(2000).select(F.lit("a").alias("source"), F.col("id").alias("ord"), F.lit("word " * 20).alias("text"))
    assert p.tokenize_to_budget(many, 500, 100, "char", tokens_per_doc=90.0).count() < 50


def test_written_shards(spark, docs):
    path = new_scratch_path(spark, "test-shards")
    segments = p.pack_shards(p.token_offsets(p.tokenize_corpus(docs, "char")), 30)
    write_shards(segments, path)
    write_shards(segments, path)  # published anew
    assert by_shard(scan_shards(spark, path)) == brute("char", 30)
    val = scan_shards(spark, path, "val")
    assert "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().toString()
    assert {r.split for r in val.select("split").collect()} == {"val"}
    with pytest.raises(FileNotFoundError):
        scan_shards(spark, path, "test")
    assert quality.already_complete(scan_shards(spark, path), "a", "val", 1)
    assert not quality.already_complete(scan_shards(spark, path), "a", "val", 2)


def test_builds_never_mix(spark, docs):
    path = new_scratch_path(spark, "test-builds")
    placed = p.token_offsets(p.tokenize_corpus(docs, "char"))
    write_shards(p.pack_shards(placed, 30, None, 1), path)
    write_shards(p.pack_shards(placed, 30, 60, 2), path)
    assert by_shard(scan_shards(spark, path)) == brute("char", 30, 60, 2)
    # A build of one source leaves the others as they are.
    write_shards(p.pack_shards(placed, 30, None, 1).where("source = 'a'"), path)
    wanted = {k: v for k, v in brute("char", 30, None, 1).items() if k[0] == "a"}
    wanted |= {k: v for k, v in brute("char", 30, 60, 2).items() if k[0] != "a"}
    assert by_shard(scan_shards(spark, path)) == wanted


def test_gaps_overlaps_and_missing_shards_are_found(spark):
    segment = lambda shard, start, n: ("s", "train", shard, start, 0, n, [50256] + [1] * (n - 1))
    schema = "source string, split string, shard_id bigint, seg_start bigint, ord bigint, n_tok int, tokens array<int>"
    verdict = lambda rows: [r.ok for r in quality.validate_shards(spark.createDataFrame(rows, schema), 30).orderBy("shard_id").collect()]
    assert verdict([segment(0, 0, 10), segment(0, 10, 20), segment(1, 0, 7)]) == [True, True]
    # An overlap of five and a gap of five cancel out in every sum.
    assert verdict([segment(0, 0, 10), segment(0, 5, 10), segment(0, 20, 10), segment(1, 0, 7)]) == [False, True]
    assert verdict([segment(0, 0, 30), segment(2, 0, 7)]) == [False, False]


def test_whole_build(spark, docs):
    built = build_corpus(docs, 30, None, 1, "char", new_scratch_path(spark, "test-build"))
    assert by_shard(built) == brute("char", 30)
    checked = {(r.source, r.shard_id): r for r in quality.validate_shards(built, 30).collect()}
    for (source, _, shard), ids in brute("char", 30).items():
        row = checked[source, shard]
        assert row.n_tokens == len(ids) and row.n_separators == ids.count(EOT)
        assert row.ok == (max(ids) < 50257 and EOT in ids)
    stats = {(r.source, r.split): r for r in quality.shard_stats(built).collect()}
    assert stats["a", "val"].n_tokens == 30 and stats["a", "val"].n_shards == 1


def test_missing_tokens_are_found(spark, docs):
    segments = p.pack_shards(p.token_offsets(p.tokenize_corpus(docs, "char")), 30)
    broken = segments.where("NOT (source = 'a' AND shard_id = 0 AND seg_start = 0)")
    bad = quality.validate_shards(broken, 30).where("source = 'a' AND shard_id = 0").first()
    assert not bad.ok


def test_scan_reads_only_its_columns(spark, sf_dir):
    df = scan_corpus(spark, f"{sf_dir}/documents.parquet", source="web")
    plan = df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert set(df.columns) == {"source", "ord", "text"}


def test_scan_json(spark):
    path = new_scratch_path(spark, "test-json")
    spark.createDataFrame([(1, "é"), (2, None)], "n bigint, content string").write.json(path)
    df = scan_corpus(spark, path, "content", "n", "code", "json", "n bigint, content string")
    assert sorted(map(tuple, df.collect())) == [("code", 1, "é"), ("code", 2, None)]


def test_preflight_and_weights(spark, docs):
    shards = p.pack_shards(p.token_offsets(p.tokenize_corpus(docs, "char")), 30)
    need = spark.createDataFrame([("a", "train", 3), ("b", "train", 9), ("c", "val", 1)], "source string, split string, need int")
    assert {(r.source, r.found > 0, r.ok) for r in quality.preflight(need, shards).collect()} == {
        ("a", True, True),
        ("b", True, False),
        ("c", False, False),
    }
    with pytest.raises(Exception, match="required"):
        quality.require_preflight(need, shards).collect()
    weights = spark.createDataFrame([("a", 0.82), ("b", 0.18), ("c", 0.5)], "source string, weight double")
    with pytest.raises(Exception, match="no train shards"):
        quality.resolve_weights(weights, shards, "train").collect()
    shares = quality.resolve_weights(weights, shards, "train", allow_missing=True).collect()
    assert {r.source: round(r.share, 9) for r in shares} == {"a": 0.82, "b": 0.18}
    val, overlap = quality.val_isolation(shards, "a")
    assert [(r.source, r.shard_id) for r in val.collect()] == [("a", 0)] and overlap.count() == 0
    twice = shards.unionByName(shards.withColumn("split", F.lit("val")))
    assert quality.val_isolation(twice, "a")[1].count() > 0


def test_scratch_must_be_shared_on_a_cluster(spark, monkeypatch):
    from shardloom import session

    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        session.scratch_root(Fake())
    assert os.path.isdir(session.scratch_root(spark))


def test_workers_hold_little_of_a_batch(spark):
    lengths = [3, 0, None, 90, 400, 1, 1, 99, 100, 250, 5]
    batch = pa.RecordBatch.from_arrays([pa.array([None if n is None else "é" * n for n in lengths])], names=["text"])
    slices = list(small_batches(iter([batch, batch.slice(0, 0), batch.slice(3, 4)]), lambda b: text_sizes(b.column(0)), 200))
    values = batch.column(0).to_pylist()
    assert [v for s in slices for v in s.column(0).to_pylist()] == values + values[3:7]
    for s in slices:  # all but the last row of a slice fit
        assert sum(2 * len(v or "") for v in s.column(0).to_pylist()[:-1]) <= 200
    lists = pa.array([[1, 2], None, [], [3] * 7])
    assert list_sizes(lists).tolist() == [2, 0, 0, 7] and list_sizes(lists.slice(1, 3)).tolist() == [0, 0, 7]


def test_long_texts_encode_as_short_ones(spark):
    text = "one two, three. " * 5000  # above a tenth of what a worker takes at a time
    rows = spark.range(40).select(F.lit("a").alias("source"), F.col("id").alias("ord"), F.concat(F.lit(text), "id").alias("text"))
    tokens = p.tokenize_corpus(rows.coalesce(1))
    back = {r.ord: r.text for r in decode_column(tokens.select("ord", F.slice("tokens", 2, 1 << 30).alias("tokens"))).collect()}
    assert back == {i: f"{text}{i}" for i in range(40)}
    pieces = [Piece((F.col("text"),), F.lit(0)), Piece((F.lit("x"), F.col("text")), F.col("ord").cast("int"))]
    for r in encode_examples(rows.coalesce(1), ["ord"], pieces).collect():
        enc = encoder()
        ids = [enc.encode_ordinary(f"{text}{r.ord}"), enc.encode_ordinary(f"x{text}{r.ord}")]
        assert r.ids == ids[0] + ids[1] and r["mask"] == [0] * len(ids[0]) + [r.ord] * len(ids[1])
