"""Question-answering sets from ``documents`` and ``labels``.

Question is a document's first line, the answer its first sentence (missing where the label says
low quality), support or context the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.constants import ABSTAIN_TEXT, GROUNDED_SYSTEM, QA_SYSTEM, SEED, WHITESPACE
from shardloom.functions.arrays import total
from shardloom.operators import chat as chat_ops
from shardloom.operators import evals
from shardloom.operators import instruct as ops
from shardloom.operators.ordering import seeded_permutation
from shardloom.plans import fixtures as fx
from shardloom.plans.registry import query
from shardloom.sources.chat import chat_json

WANTED = 200  # rows asked of the sampling operators
KEY = ["origin", "doc_id"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.spread(fx.table(spark, sf_dir, "documents"), "doc_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return docs.join(fx.table(spark, sf_dir, "labels"), "doc_id")


def explanatory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    answer = F.when(F.col("quality") == 1, F.substring_index("text", ".", 1)).otherwise("")
    return rows.select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("question"),
        answer.alias("correct_answer"),
        F.when(F.col("toxic") == 0, F.col("text")).alias("support"),
    )


def terse_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n")
    return documents(spark, sf_dir).select(
        "doc_id",
        F.get(lines, F.lit(0)).alias("question"),
        F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda t: t != "").alias("answers"),
    )


def grounded_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    first = F.struct(F.array(F.substring_index("text", ".", 1)).alias("text"))
    none = F.struct(F.array().cast("array<string>").alias("text"))
    return rows.select(
        "doc_id",
        "toxic",
        F.col("text").alias("context"),
        F.substring_index("text", "\n", 1).alias("question"),
        F.when(F.col("quality") == 1, first).otherwise(none).alias("answers"),
    )


def qa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = ops.union_qa(
        spark,
        {
            "explanatory": lambda: ops.qa_explanatory(explanatory_source(spark, sf_dir), ["doc_id"]),
            "terse": lambda: ops.qa_terse(terse_source(spark, sf_dir), ["doc_id"]),
        },
    )
    return rows


def grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.grounded_rows(grounded_source(spark, sf_dir), ["doc_id", "toxic"])


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SPACES = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def sql_strip(text: str) -> str:
    return f"trim({text}, {SPACES})"


def sql_hash(seed: int, *keys: str) -> str:
    text = f"'{seed}:' || " + " || ':' || ".join(keys)
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


QA_SQL = f"""
labelled AS (SELECT doc_id, text, quality, toxic FROM documents JOIN labels USING (doc_id)),
expl AS (SELECT doc_id, split_part(text, chr(10), 1) AS question,
                CASE WHEN quality = 1 THEN split_part(text, '.', 1) ELSE '' END AS correct_answer,
                {sql_strip("CASE WHEN toxic = 0 THEN text ELSE '' END")} AS support FROM labelled),
terse AS (SELECT doc_id, string_split(text, chr(10))[1] AS question,
                 list_filter(string_split(text, chr(10))[2:], lambda t: t <> '') AS answers FROM documents),
qa AS (SELECT 'explanatory' AS origin, doc_id, {sql_strip("question")} AS question,
              correct_answer || '.' || CASE WHEN support = '' THEN '' ELSE chr(10) || chr(10) ||
                regexp_replace(left(support, 400), '\\.[^.]*$', '', 's') || '.' END AS answer
       FROM expl WHERE question <> '' AND correct_answer <> ''
       UNION ALL
       SELECT 'terse', doc_id, {sql_strip("question")}, array_to_string(answers, ', ')
       FROM terse WHERE question <> '' AND len(answers) > 0),
qa_rows AS (SELECT origin, doc_id, [{{'role': 'system', 'content': {sql_text(QA_SYSTEM)}}},
                    {{'role': 'user', 'content': question}}, {{'role': 'assistant', 'content': answer}}] AS messages
            FROM qa)"""

GROUNDED_SQL = f"""
labelled AS (SELECT doc_id, text, quality, toxic FROM documents JOIN labels USING (doc_id)),
src AS (SELECT doc_id, toxic, {sql_strip("text")} AS context, {sql_strip("split_part(text, chr(10), 1)")} AS question,
               CASE WHEN quality = 1 THEN {sql_strip("split_part(text, '.', 1)")} ELSE '' END AS first_text
        FROM labelled),
gr AS (SELECT doc_id, toxic, first_text <> '' AS answerable, context, question,
              CASE WHEN first_text <> '' THEN first_text ELSE {sql_text(ABSTAIN_TEXT)} END AS answer
       FROM src WHERE context <> '' AND question <> ''),
gr_rows AS (SELECT doc_id, answerable, toxic, answer, context, question,
                   'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question AS prompt FROM gr),
counts AS (SELECT sum(CASE WHEN answerable THEN 1 ELSE 0 END)::BIGINT AS n_an,
                  sum(CASE WHEN answerable THEN 0 ELSE 1 END)::BIGINT AS n_un FROM gr_rows),
quotas AS (SELECT least(n_un, {int(WANTED * 0.2)}) AS q_un,
                  least(n_an, {WANTED} - least(n_un, {int(WANTED * 0.2)})) AS q_an FROM counts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY answerable ORDER BY {sql_hash(SEED, "doc_id")}, doc_id) AS rn
           FROM gr_rows),
capped AS (SELECT ranked.* EXCLUDE (rn) FROM ranked, quotas WHERE rn <= CASE WHEN answerable THEN q_an ELSE q_un END)"""


@query(
    "B2",
    f"""WITH {QA_SQL} SELECT 'explanatory' AS kind, doc_id FROM expl WHERE question <> '' AND correct_answer <> ''
        UNION ALL SELECT 'terse', doc_id FROM terse WHERE question <> '' AND len(answers) > 0
        UNION ALL SELECT 'grounded', doc_id FROM labelled
        WHERE {sql_strip("text")} <> '' AND {sql_strip("split_part(text, chr(10), 1)")} <> ''""",
)
def require_qa_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        ("explanatory", ops.require_qa_fields(explanatory_source(spark, sf_dir))),
        ("terse", ops.require_qa_fields(terse_source(spark, sf_dir), "answers")),
        ("grounded", ops.require_grounded_fields(grounded_source(spark, sf_dir))),
    ]
    kept = [df.select(F.lit(kind).alias("kind"), "doc_id") for kind, df in parts]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query(
    "C11",
    f"WITH {QA_SQL} SELECT doc_id, length(answer) AS n_chars, md5(answer) AS digest FROM qa WHERE origin = 'explanatory'",
)
def compose_qa_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.require_qa_fields(explanatory_source(spark, sf_dir))
    answer = ops.compose_qa_answer(F.col("correct_answer"), F.col("support"))
    return kept.select("doc_id", F.length(answer).cast("bigint").alias("n_chars"), F.md5(answer).alias("digest"))


@query("C12", f"WITH {QA_SQL} SELECT doc_id, md5(answer) AS digest FROM qa WHERE origin = 'terse'")
def join_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.require_qa_fields(terse_source(spark, sf_dir), "answers")
    return kept.select("doc_id", F.md5(ops.join_answers(F.col("answers"))).alias("digest"))


@query(
    "H1",
    f"WITH {QA_SQL} SELECT origin, doc_id, md5(question) AS question, md5(answer) AS answer FROM qa",
)
def union_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = lambda i: F.md5(F.col("messages")[i]["content"])
    return qa_rows(spark, sf_dir).select("origin", "doc_id", content(1).alias("question"), content(2).alias("answer"))


@query(
    "C14",
    f"""WITH {QA_SQL}, js AS (SELECT origin, doc_id, to_json({{'messages': messages}})::VARCHAR AS j FROM qa_rows)
        SELECT origin, doc_id, length(j) AS n_chars, md5(j) AS digest FROM js""",
)
def to_chat_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa_rows(spark, sf_dir).withColumn("json", chat_json(F.col("messages")))
    return rows.select(*KEY, F.length("json").cast("bigint").alias("n_chars"), F.md5("json").alias("digest"))


@query(
    "F16",
    f"""WITH {QA_SQL} SELECT origin, doc_id,
        row_number() OVER (ORDER BY {sql_hash(SEED, "origin", "doc_id")}, origin, doc_id) - 1 AS pos FROM qa""",
)
def order_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_permutation(qa_rows(spark, sf_dir).select(*KEY), SEED, KEY)


@query(
    "G2",
    f"""WITH {QA_SQL} SELECT origin, doc_id, md5(answer) AS answer FROM qa
        ORDER BY {sql_hash(SEED, "origin", "doc_id")}, origin, doc_id LIMIT {WANTED}""",
)
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = ops.sample_n(qa_rows(spark, sf_dir), WANTED, KEY)
    return sampled.select(*KEY, F.md5(F.col("messages")[2]["content"]).alias("answer"))


@query(
    "C23",
    f"""WITH {QA_SQL}, first AS (SELECT messages FROM qa_rows ORDER BY {sql_hash(SEED, "origin", "doc_id")} LIMIT 1),
        t AS (SELECT unnest(messages) AS m, generate_subscripts(messages, 1) - 1 AS turn FROM first)
        SELECT turn::BIGINT AS turn, m.role AS role, left(m.content, 180) AS content FROM t""",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shardloom.operators.ordering import order_hash

    ordered = qa_rows(spark, sf_dir).withColumn("place", order_hash(SEED, *[F.col(k) for k in KEY]))
    return ops.preview(ordered, "place").select(F.col("turn").cast("bigint").alias("turn"), "role", "content")


@query(
    "B10",
    f"WITH {GROUNDED_SQL} SELECT doc_id, answerable, md5(answer) AS answer FROM gr_rows",
)
def answerable_or_abstain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.answerable_or_abstain(ops.require_grounded_fields(grounded_source(spark, sf_dir)))
    return rows.select("doc_id", "answerable", F.md5("answer").alias("answer"))


@query(
    "C13",
    f"""WITH {GROUNDED_SQL} SELECT doc_id, length(prompt) AS n_chars, md5(prompt) AS prompt,
        md5({sql_text(GROUNDED_SYSTEM)}) AS system FROM gr_rows""",
)
def grounded_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = lambda i: F.col("messages")[i]["content"]
    return grounded(spark, sf_dir).select(
        "doc_id",
        F.length(content(1)).cast("bigint").alias("n_chars"),
        F.md5(content(1)).alias("prompt"),
        F.md5(content(0)).alias("system"),
    )


@query("G3", f"WITH {GROUNDED_SQL} SELECT doc_id, answerable, md5(prompt) AS prompt FROM capped")
def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = ops.stratified_cap(grounded(spark, sf_dir), WANTED, ["doc_id"])
    return capped.select("doc_id", "answerable", F.md5(F.col("messages")[1]["content"]).alias("prompt"))


@query(
    "H2",
    f"""WITH {GROUNDED_SQL} SELECT doc_id, answerable, md5(answer) AS answer,
        row_number() OVER (ORDER BY {sql_hash(SEED + 1, "doc_id")}, doc_id) - 1 AS pos FROM capped""",
)
def union_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.union_grounded(grounded(spark, sf_dir), WANTED, ["doc_id"])
    return rows.select("doc_id", "answerable", F.md5(F.col("messages")[2]["content"]).alias("answer"), "pos")


@query(
    "E2",
    f"""WITH {GROUNDED_SQL} SELECT answerable, count(*) AS n_rows,
        printf('%.1f', count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE * 100.0) AS percent FROM gr_rows GROUP BY answerable""",
)
def class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the whole grounded set: an audit that sees a sample can miss what it is for."""
    return ops.class_share(grounded(spark, sf_dir))


@query(
    "E3",
    f"""WITH {GROUNDED_SQL}, per AS (SELECT answerable, count(*) AS n_examples,
          sum(length(answer) + 2)::BIGINT AS n_trained FROM gr_rows GROUP BY answerable)
        SELECT answerable, n_examples, n_trained, round(n_trained / (sum(n_trained) OVER ())::DOUBLE, 6) AS share FROM per""",
)
def trained_token_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = chat_ops.encode_chats(grounded(spark, sf_dir), ["answerable"], "char")
    audit = chat_ops.trained_token_share(encoded, "answerable")
    return audit.select("answerable", "n_examples", "n_trained", F.round("share", 6).alias("share"))


@query("E3 (byte-level BPE)")
def trained_token_share_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_ops.trained_token_share(chat_ops.encode_chats(grounded(spark, sf_dir), ["answerable"]), "answerable")


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected: the context's first word, or the abstain label; got: the answer, or a refusal on toxic rows."""
    content = lambda i: F.col("messages")[i]["content"]
    word = F.substring_index(F.substring_index(content(1), "\n", -1), " ", 2)
    expected = F.when(F.col("answerable"), F.substring_index(word, " ", -1)).otherwise("ABSTAIN")
    got = F.when(F.col("toxic") == 1, "I DON'T KNOW").otherwise(content(2))
    return grounded(spark, sf_dir).select(
        "doc_id", expected.alias("expected"), F.concat(F.lit(" "), got, F.lit("<|im_end|>")).alias("got")
    )


CASES_SQL = (
    GROUNDED_SQL
    + """,
cases AS (SELECT doc_id, CASE WHEN answerable THEN split_part(question, ' ', 1) ELSE 'ABSTAIN' END AS expected,
                 lower(CASE WHEN toxic = 1 THEN 'I DON''T KNOW' ELSE answer END) AS got FROM gr_rows),
hits AS (SELECT doc_id, expected, CASE WHEN expected = 'ABSTAIN' THEN contains(got, 'don''t know')
                 ELSE contains(got, lower(expected)) END AS hit FROM cases)"""
)


@query("C22", f"WITH {CASES_SQL} SELECT doc_id, expected, hit FROM hits")
def answer_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.with_hits(eval_cases(spark, sf_dir)).select("doc_id", "expected", "hit")


@query(
    "E7",
    f"""WITH {CASES_SQL} SELECT CASE WHEN grouping(expected = 'ABSTAIN') = 1 THEN 'total'
          WHEN expected = 'ABSTAIN' THEN 'abstain' ELSE 'answerable' END AS class,
          sum(hit::INTEGER)::BIGINT AS n_hits, count(*) AS n_cases
        FROM hits GROUP BY ROLLUP (expected = 'ABSTAIN')""",
)
def score_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.score_by_class(eval_cases(spark, sf_dir))


@query("I5")
def mask_audit_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of byte-level BPE examples: aligned, binary, per class."""
    from shardloom.constants import END_TOOL_RESULT, TOOL_RESULT
    from shardloom.operators.quality import mask_audit

    encoded = chat_ops.encode_chats(grounded(spark, sf_dir), ["doc_id", "answerable"])
    audited = mask_audit(encoded, TOOL_RESULT, END_TOOL_RESULT)
    return audited.groupBy("answerable").agg(
        F.count("*").alias("n_rows"), F.count_if("violation").alias("n_violations"), F.sum(total(F.col("mask"))).alias("n_learn")
    )
