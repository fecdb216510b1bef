"""The stages against brute force on the smallest table, and the guard around them."""

import os
import subprocess
import sys
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from shardloom.llm.common import documents
from shardloom.llm.queries import TOKENIZER
from shardloom.session import materialize
from tests.llm.test_decontaminate import brute
from tests.llm.test_mixing import wanted_targets
from tests.llm.test_simhash import slow_components, slow_fingerprint


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir)
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        assert out.columns == columns, name
        kept[name] = (docs.collect(), out.collect())
        docs = out
    # The smallest table has too few toxic documents to learn from; clean ones must stay all the same.
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before, after = kept["toxicity"]
    left = {r["doc_id"] for r in after}
    assert {r["doc_id"] for r in before if labels.get(r["doc_id"]) == 0} <= left

    before, after = kept["simhash"]
    ids = [r["doc_id"] for r in before]
    assert {r["doc_id"] for r in after} == set(slow_components(ids, [slow_fingerprint(r["text"]) for r in before]))
    assert len(after) == len({r["doc_id"] for r in after})

    before, after = kept["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = lambda n, hit, _: not (hit and 20 * hit >= n)
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if clean(*brute(r["text"], items, 13))}

    before, after = kept["mixing"]
    words = lambda rows: {s: sum(len((r["text"] or "").encode().split()) for r in rows if r["source"] == s) for s in {r["source"] for r in before}}
    target, taken = wanted_targets(words(before)), words(after)
    longest = max(len((r["text"] or "").split()) for r in before)
    assert all(abs(taken[s] - target[s]) <= longest + 1 for s in target)

    tokenizer = Tokenizer.from_file(TOKENIZER)
    wanted, start = [], 0
    for r in sorted(after, key=lambda r: (r["doc_id"], r["text"])):
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [0]
        wanted.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, P.STAGES[-1][1](spark, docs, sf_dir).collect())) == wanted


def test_toxic_documents_go(spark):
    sf = "/root/testdata/sf0.1"
    left = {r["doc_id"] for r in P.drop_toxic(spark, documents(spark, sf), sf).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    toxic, clean = ({r["doc_id"] for r in labels if r["toxic"] == t} for t in (1, 0))
    # Rare insults of the smaller languages lack the four groups a word needs here; 36 of 449 stay.
    assert len(toxic & left) <= 0.1 * len(toxic) and len(clean - left) <= 0.01 * len(clean)


def test_entry_without_the_operators(tmp_path):
    """A copy of the repository without this subpackage still imports and lists the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for top, folders, files in os.walk(os.path.join(root, "shardloom")):
        folders[:] = [f for f in folders if f not in ("llm", "__pycache__")]
        for f in files:
            where = tmp_path / os.path.relpath(os.path.join(top, f), root)
            where.parent.mkdir(parents=True, exist_ok=True)
            where.write_bytes(open(os.path.join(top, f), "rb").read())
    (tmp_path / "__spark_entry__.py").write_bytes(open(os.path.join(root, "__spark_entry__.py"), "rb").read())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_odd_documents(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and extra columns whose names the stages use."""
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf).limit(40)
    names = ["_toxicity", "_k1", "_row", "_doc", "found", "size", "fp"]
    odd = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    empty = docs.limit(6).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "doc_id" else f.name for f in docs.schema])
    blank = docs.limit(2).withColumn("text", F.lit("")).withColumn("doc_id", F.lit(None).cast("long"))
    both = odd.unionByName(empty.unionByName(blank), allowMissingColumns=True).unionByName(odd.limit(3))
    both = materialize(both, "odd-documents")
    for rows in (both, both.limit(0)):
        for name, stage in P.STAGES[:-1]:
            out = materialize(stage(spark, rows, sf), f"odd-{name}")
            assert out.columns == both.columns, name
            rows = out
        encoded = P.STAGES[-1][1](spark, rows, sf)
        assert encoded.count() == rows.count()
