"""Calculator-call queries: calls are rendered from ``lineitem``, slots from ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.constants import END_TOOL_RESULT, SEED, TOOL_RESULT, TOOL_SYSTEM
from shardloom.functions.arrays import digest, total
from shardloom.functions.pieces import encode_examples
from shardloom.functions.text import python_number
from shardloom.operators import tools as ops
from shardloom.operators.ordering import dense_index
from shardloom.operators.quality import mask_audit
from shardloom.plans import fixtures as fx
from shardloom.plans.chat import EXAMPLES_SQL, char_examples, chars, repeated
from shardloom.plans.instruct import sql_hash
from shardloom.plans.registry import query

FRACTION = 0.15

# One call per line: the operator follows from the line number.
CALLS_SQL = """
q AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber AS n, l_quantity::BIGINT AS q FROM lineitem),
calls AS (SELECT *, q || CASE n WHEN 1 THEN '*' WHEN 2 THEN ' + ' WHEN 3 THEN '-' WHEN 4 THEN '//' WHEN 5 THEN '%'
                          ELSE ' * -' END || n AS expr,
                 CASE n WHEN 1 THEN q * n WHEN 2 THEN q + n WHEN 3 THEN q - n WHEN 4 THEN floor(q::DOUBLE / n)::BIGINT
                        WHEN 5 THEN q % n ELSE q * -n END::VARCHAR AS result
          FROM q),
texts AS (SELECT *, 'First ' || n || '.' || chr(10) || '<tool_call>' || expr || '</tool_call>' AS head,
                 CASE WHEN n % 2 = 0 THEN 'Then <tool_call>' || q || '-' || q || '</tool_call> done.' ELSE ' done.' END AS tail
          FROM calls)"""

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "n"]


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.spread(fx.table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.col("l_linenumber").alias("n"),
        F.col("l_quantity").cast("bigint").alias("q"),
    )
    n = F.col("n")
    sign = (
        F.when(n == 1, "*").when(n == 2, " + ").when(n == 3, "-").when(n == 4, "//").when(n == 5, "%").otherwise(" * -")
    )
    return lines.withColumn("expr", F.concat(F.col("q").cast("string"), sign, n.cast("string")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("q").cast("string"), F.col("n").cast("string")
    second = F.concat(F.lit("Then <tool_call>"), q, F.lit("-"), q, F.lit("</tool_call> done."))
    tail = F.when(F.col("n") % 2 == 0, second).otherwise(" done.")
    head = F.concat(F.lit("First "), n, F.lit(".\n<tool_call>"), F.col("expr"), F.lit("</tool_call>"))
    return calls(spark, sf_dir).withColumn("text", F.concat(head, tail))


@query(
    "C7",
    f"""WITH {CALLS_SQL} SELECT l_orderkey, l_partkey, l_suppkey, n,
        CASE WHEN n % 2 = 0 THEN q || '-' || q ELSE expr END AS last_call,
        (CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS n_calls FROM texts""",
)
def extract_tool_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(
        *LINE,
        ops.extract_tool_call(F.col("text")).alias("last_call"),
        F.size(ops.call_expressions(F.col("text"))).cast("bigint").alias("n_calls"),
    )


@query("C8", f"WITH {CALLS_SQL} SELECT l_orderkey, l_partkey, l_suppkey, n, expr, result, NULL::VARCHAR AS error FROM calls")
def evaluate_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.evaluate_tool_calls(calls(spark, sf_dir)).select(*LINE, "expr", "result", "error")


@query(
    "C8 (nested expressions)",
    f"""WITH {CALLS_SQL} SELECT l_orderkey, l_partkey, l_suppkey, n, ((q - n) * 7 + q * q)::VARCHAR AS result,
        CASE WHEN n = 7 THEN 'not a plain arithmetic expression' END AS error
        FROM calls WHERE n <> 7
        UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, n, NULL, 'not a plain arithmetic expression' FROM calls WHERE n = 7""",
)
def evaluate_nested_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("q").cast("string"), F.col("n").cast("string")
    nested = F.concat(F.lit("("), q, F.lit("-"), n, F.lit(")*7 + "), q, F.lit("**2"))
    bad = F.concat(F.lit("open("), n, F.lit(")"))
    rows = calls(spark, sf_dir).withColumn("expr", F.when(F.col("n") == 7, bad).otherwise(nested))
    return ops.evaluate_tool_calls(rows).select(*LINE, "result", "error")


@query(
    "C9",
    """WITH v AS (SELECT l_orderkey, l_linenumber AS n, l_partkey, l_suppkey, l_extendedprice * l_quantity * 10 AS x FROM lineitem)
       SELECT l_orderkey, l_partkey, l_suppkey, n,
              CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END AS shown FROM v""",
)
def format_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("l_extendedprice") * F.col("l_quantity") * 10
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("n"), python_number(value).alias("shown")
    )


@query(
    "C10",
    f"""WITH {CALLS_SQL} SELECT l_orderkey, l_partkey, l_suppkey, n,
        head || chr(10) || '<tool_result>' || result || '</tool_result>' || chr(10) ||
        CASE WHEN n % 2 = 0 THEN 'Then <tool_call>' || q || '-' || q || '</tool_call>' || chr(10)
             || '<tool_result>0</tool_result>' || chr(10) || ' done.' ELSE tail END AS injected FROM texts""",
)
def inject_tool_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.inject_tool_result(texts(spark, sf_dir)).select(*LINE, "injected")


SYNTH_SQL = f"""
keys AS (SELECT DISTINCT o_orderkey FROM orders),
draws AS (SELECT o_orderkey, 2 + {sql_hash(SEED, "'a'", "o_orderkey")} % 998 AS a,
                 2 + {sql_hash(SEED, "'b'", "o_orderkey")} % 98 AS b,
                 ['+', '-', '*'][({sql_hash(SEED, "'op'", "o_orderkey")} % 3 + 1)::INTEGER] AS op FROM keys),
synth AS (SELECT o_orderkey, 'What is ' || a || ' ' || op || ' ' || b || '?' AS question,
                 'I''ll compute ' || a || ' ' || op || ' ' || b || '.' AS reasoning, a || op || b AS expr,
                 CASE op WHEN '+' THEN a + b WHEN '-' THEN a - b ELSE a * b END::VARCHAR AS result FROM draws)"""


def synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fx.table(spark, sf_dir, "orders").select("o_orderkey")
    return ops.synth_tool_examples(keys, F.col("o_orderkey"))


@query("H4", f"WITH {SYNTH_SQL} SELECT *, 'The answer is ' || result || '.' AS answer FROM synth")
def synth_tool_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth(spark, sf_dir)


_PROMPT = "'<|im_start|>'"
TOOL_EXAMPLE_SQL = (
    SYNTH_SQL
    + f""",
parts AS (SELECT o_orderkey,
    [50257] || {chars("'system' || chr(10)")} || {chars(f"'{TOOL_SYSTEM}'")} || [50258, 10]
    || [50257] || {chars("'user' || chr(10)")} || {chars("question")} || [50258, 10]
    || [50257] || {chars("'assistant' || chr(10)")} AS prompt,
    {chars("reasoning || chr(10)")} || [50262] || {chars("expr")} || [50263, 10] AS call,
    [50264] || {chars("result")} || [50265, 10] AS res,
    {chars("'The answer is ' || result || '.'")} || [50258, 10] AS ans FROM synth),
tool_ex AS (SELECT o_orderkey, prompt || call || res || ans AS ids,
    {repeated("0", "len(prompt)")} || {repeated("1", "len(call)")} || {repeated("0", "len(res)")}
    || {repeated("1", "len(ans)")} AS mask FROM parts)"""
)


@query(
    "C6 (char vocabulary)",
    f"""WITH {TOOL_EXAMPLE_SQL} SELECT o_orderkey, len(ids)::BIGINT AS n_ids, list_sum(mask)::BIGINT AS n_learn,
        {fx.list_digest("ids")} AS ids_digest, {fx.list_digest("mask")} AS mask_digest FROM tool_ex""",
)
def render_tool_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_examples(synth(spark, sf_dir), ["o_orderkey"], ops.example_pieces(TOOL_SYSTEM), "char")
    return encoded.select(
        "o_orderkey",
        F.size("ids").cast("bigint").alias("n_ids"),
        total(F.col("mask")).alias("n_learn"),
        digest(F.col("ids")).alias("ids_digest"),
        digest(F.col("mask")).alias("mask_digest"),
    )


@query("I5 (tool examples)", f"""WITH {TOOL_EXAMPLE_SQL} SELECT count(*) AS n_rows, 0::BIGINT AS n_violations,
       count(*) AS n_result_masked FROM tool_ex""")
def mask_audit_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_examples(synth(spark, sf_dir), ["o_orderkey"], ops.example_pieces(TOOL_SYSTEM))
    audited = mask_audit(encoded, TOOL_RESULT, END_TOOL_RESULT)
    return audited.agg(
        F.count("*").alias("n_rows"),
        F.count_if("violation").alias("n_violations"),
        F.count_if(F.col("result_masked") & F.array_contains("ids", TOOL_RESULT)).alias("n_result_masked"),
    )


@query(
    "H3",
    f"""WITH {EXAMPLES_SQL}, n AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS idx,
          count(*) OVER () AS n_all FROM ex),
        slots AS (SELECT turn_no AS slot FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS turn_no FROM conversations)),
        flagged AS (SELECT slot, {sql_hash(SEED, "'slot'", "slot")} / 1152921504606846976::DOUBLE < {FRACTION}::DOUBLE AS synthetic FROM slots),
        ord AS (SELECT *, row_number() OVER (PARTITION BY synthetic ORDER BY slot) - 1 AS ordinal FROM flagged)
        SELECT slot, synthetic, ordinal, conv_id FROM ord
        LEFT JOIN n ON NOT synthetic AND idx = ordinal % (SELECT max(n_all) FROM n)""",
)
def mix_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many slots as there are turns; chat rows repeat once they run out."""
    chats = dense_index(char_examples(spark, sf_dir).select("conv_id"), [], "conv_id")
    slots = spark.range(fx.table(spark, sf_dir, "conversations").count()).withColumnRenamed("id", "slot")
    return ops.mix_bernoulli(slots, chats, FRACTION).select("slot", "synthetic", "ordinal", "conv_id")
