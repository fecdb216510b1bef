"""One query per operator over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import (
    centroids,
    decontaminate,
    grammar,
    infill,
    licenses,
    lines,
    mixing,
    quality,
    quotes,
    sharding,
    simhash,
    toxicity,
    urls,
)
from shardloom.llm.common import documents, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, class and number of offending spans per document; the field never sees held-out labels."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"), usable=~held_out())
    return toxicity.score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans")
    )


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty contiguous shards of nearly equal bytes."""
    return sharding.byte_shards(documents(spark, sf_dir), 40, 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document when the sources weigh 5, 2, 1, repeating, in 150 % of all words."""
    return mixing.mix(documents(spark, sf_dir), (5, 2, 1), 150).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a benchmark window of 13, and the items they come from;
    ``n_near_items`` counts the items whose three rarest terms stand within 20 words."""
    found = decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), 13, near=(3, 20))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated(5).alias("contaminated"),
        "n_near_items",
    )


SQL["op7_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws, row_number() OVER () AS k FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[p:p + least(13, len(ws)) - 1], ' ') AS g
       FROM (SELECT *, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS p FROM b WHERE len(ws) > 0)),
dw AS (SELECT k, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g
       FROM (SELECT k, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS p
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hit AS (SELECT k, item_id, dw.n, p FROM dw JOIN bw USING (n, g)),
words AS (SELECT k, count(DISTINCT spot) AS n_hit FROM (SELECT k, unnest(generate_series(p, p + n - 1)) AS spot FROM hit)
          GROUP BY k),
items AS (SELECT k, list_sort(list(DISTINCT coalesce(item_id::VARCHAR, ''))) AS ids FROM hit GROUP BY k),
dp AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
freq AS (SELECT w, count(*) AS n FROM dp GROUP BY w),
bi AS (SELECT *, row_number() OVER () AS item FROM (SELECT DISTINCT item_id, ws FROM b WHERE len(ws) > 0)),
bt AS (SELECT item, item_id, w, least(3, count(*) OVER (PARTITION BY item)) AS need
       FROM (SELECT DISTINCT item, item_id, unnest(ws) AS w FROM bi)),
rare AS (SELECT *, count(*) OVER (PARTITION BY item) AS have FROM (
         SELECT item, item_id, w, need, row_number() OVER (PARTITION BY item ORDER BY n, w) AS r FROM bt JOIN freq USING (w))
         WHERE r <= 3),
-- A stretch ends at a term and holds every other one in the 19 words before it.
ends AS (SELECT DISTINCT k, item, item_id, need, p FROM dp JOIN (SELECT * FROM rare WHERE have = need) USING (w)),
near AS (SELECT k, count(DISTINCT coalesce(item_id::VARCHAR, '')) AS n_near FROM (
         SELECT e.k, e.item, e.item_id, e.p, e.need FROM ends e
         JOIN (SELECT k, item, w, p AS q FROM dp JOIN rare USING (w)) o ON o.k = e.k AND o.item = e.item AND q BETWEEN e.p - 19 AND e.p
         GROUP BY ALL HAVING count(DISTINCT o.w) = e.need) GROUP BY k)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k) LEFT JOIN near USING (k)
"""


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; four differing bits link."""
    found = simhash.near_duplicates(documents(spark, sf_dir), 4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the compressed files."""
    return grammar.encoded_documents(documents(spark, sf_dir), TOKENIZER)


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    found = urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base numbers and verdict of every document."""
    return quality.judge(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First place, copies, links and class of every distinct line; two edits link."""
    return lines.classes(documents(spark, sf_dir), 2).select(
        "doc_id", "line_no", F.crc32(F.col("line").cast("binary")).alias("line_crc32"), "copies", "n_links",
        "class_doc_id", "class_line_no",
    )


@query
def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply, thread, place and quote-free text of every message."""
    found = quotes.linked(table(spark, sf_dir, "conversations"))
    return found.select(
        "conv_id", "turn", "role", "reply_turn", "thread_turn", "n_ancestors", "position",
        F.crc32(F.col("body").cast("binary")).alias("body_crc32"), F.length("body").alias("body_chars"),
    )


@query
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cut places and checksums of every document rearranged for infilling and put back."""
    found = infill.infill(documents(spark, sf_dir), seed=1)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL["op13_infill"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
             ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every usable vector, after three rounds of sixteen centroids."""
    found, final = centroids.clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, seed=1)
    return centroids.with_inertia(found, final).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _centroid_sql(k: int, rounds: int, dims: int) -> str:
    """Every round compares every vector with every centroid."""
    usable = f"len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}"
    step = """
d{r} AS MATERIALIZED (SELECT n, min(c) AS c, any_value(d) AS d FROM (SELECT *, min(d) OVER (PARTITION BY n) AS least FROM (
         SELECT n, c, list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
         FROM v CROSS JOIN c{r})) WHERE d = least GROUP BY n)"""
    move = """,
c{s} AS MATERIALIZED (SELECT c{r}.c, coalesce(u.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
         SELECT c, list(m ORDER BY i) AS m FROM (SELECT c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (
           SELECT c, unnest(q) AS x, unnest(range(1, {dims} + 1)) AS i FROM v JOIN d{r} USING (n)) GROUP BY c, i) GROUP BY c) u USING (c))"""
    tables = [step.format(r=r) + (move.format(r=r, s=r + 1, dims=dims) if r < rounds else "") for r in range(rounds + 1)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id,
                          list_transform(embedding, lambda x: floor(x::DOUBLE * {centroids.SCALE})::BIGINT) AS q
                        FROM embeddings WHERE {usable}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q AS m FROM (
        SELECT q, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, q LIMIT {k})),{",".join(tables)}
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM d{rounds} JOIN v USING (n) JOIN c{rounds} USING (c)
"""


SQL["op11_centroids"] = _centroid_sql(16, 3, 64)


@query
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license templates in every document."""
    joined = lambda name: F.array_join(name, ",").alias(name)
    return licenses.licenses(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score"
    )


def _license_sql() -> str:
    """Every block against every template, without filters."""
    sets = [sorted(set(licenses.template_words(text))) for _, text in licenses.TEMPLATES]
    wider = [[o for o, other in enumerate(sets) if set(own) < set(other)] for own in sets]
    rows = ", ".join(
        f"({t}, '{label}', {own}, {licenses.needed(len(own), licenses.THRESHOLD)}, {wider[t]}::BIGINT[])"
        for t, ((label, _), own) in enumerate(zip(licenses.TEMPLATES, sets))
    )
    spots = ", ".join(
        "list_filter(range(len(ws)), lambda i: " + " AND ".join(f"ws[i + {n}] = '{w}'" for n, w in enumerate(phrase.split(), 1)) + f") AS p{j}"
        for j, phrase in enumerate(licenses.PHRASES)
    )
    every = " || ".join(f"p{j}" for j in range(len(licenses.PHRASES)))
    named = " || ".join(f"CASE WHEN len(p{j}) > 0 THEN ['{label}'] ELSE [] END" for j, label in enumerate(licenses.PHRASES.values()))
    block, stride = licenses.BLOCK, licenses.STRIDE
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '{licenses.GAPS}'), lambda w: w <> '') AS ws FROM documents),
p AS (SELECT k, doc_id, len(ws) AS n_words, {spots} FROM d),
base AS (SELECT k, doc_id, n_words, {every} AS a, {named} AS names FROM p),
t(t, label, ws, needed, wider) AS (VALUES {rows}),
b AS (SELECT k, b, ws[b * {stride} + 1:b * {stride} + {block}] AS ws
      FROM (SELECT k, ws, unnest(range(greatest(len(ws) - {block - stride}, 0) // {stride} + 1)) AS b FROM d)),
h AS (SELECT k, b, t, label, needed, wider, len(t.ws) AS size, len(list_intersect(t.ws, b.ws)) AS common FROM b CROSS JOIN t),
f AS (SELECT *, list(t) OVER (PARTITION BY k, b) AS ts FROM h WHERE common >= needed),
g AS (SELECT k, list(DISTINCT label) AS labels, max(common / size) AS score FROM f WHERE NOT list_has_any(wider, ts) GROUP BY k)
SELECT doc_id, n_words::BIGINT AS n_words, len(a)::BIGINT AS n_base, list_min(a)::BIGINT AS first_word, list_max(a)::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(names)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(names || coalesce(labels, []))), ',') AS labels,
       CASE WHEN len(a) > 0 THEN 1.0 ELSE coalesce(score, 0) END::DOUBLE AS score
FROM base LEFT JOIN g USING (k)
"""


SQL["op12_licenses"] = _license_sql()


URL_LEVELS = 6


def _url_sql() -> str:
    """The tree level by level, with the operator's constants. The operator goes to any depth; this goes
    to ``URL_LEVELS``, beyond those of the given pages, and fails on deeper paths."""
    levels = [
        """
x{d} AS (SELECT *, segs[{d}] AS s, CASE WHEN regexp_matches(segs[{d}], '^[0-9]+$') THEN '<num>'
           WHEN regexp_matches(segs[{d}], '^[0-9]+[.][a-z]+$') THEN regexp_replace(segs[{d}], '^[0-9]+', '<num>')
           WHEN regexp_matches(segs[{d}], '^[0-9a-fA-F-]{{8,}}$') THEN '<id>'
           WHEN regexp_matches(segs[{d}], '[0-9]') THEN '<mixed>' ELSE '<word>' END AS shape FROM p{e}),
c{d} AS (SELECT host, template, s, shape, sum(pages) AS pages, sum(labelled) AS labelled, sum(good) AS good
         FROM x{d} WHERE s IS NOT NULL GROUP BY ALL),
h{d} AS (SELECT host, template, shape, count(*) AS vals, sum(labelled) AS lab, sum(good) AS gd,
                count(*) >= {many} AND sum(pages) <= {rare} * count(*) AS variable FROM c{d} GROUP BY ALL),
l{d} AS (SELECT host, template, sum(lab)::DOUBLE AS al, sum(gd)::DOUBLE AS ag, sum(vals) AS br
         FROM h{d} WHERE NOT variable GROUP BY ALL),
t{d} AS (SELECT host, template, s, CASE WHEN variable THEN shape
           WHEN br = 1 OR coalesce(labelled > 0 AND al - labelled > 0 AND
             abs(good / labelled::DOUBLE - (ag - good) / (al - labelled))
               > {z} * sqrt(ag / al * (1 - ag / al) * (1 / labelled::DOUBLE + 1 / (al - labelled))), false) THEN s
           ELSE '*' END AS tok
         FROM c{d} JOIN h{d} USING (host, template, shape) LEFT JOIN l{d} USING (host, template)),
p{d} AS (SELECT x{d}.host, path, pages, labelled, good, segs,
                CASE WHEN x{d}.s IS NULL THEN x{d}.template ELSE x{d}.template || '/' || tok END AS template
         FROM x{d} LEFT JOIN t{d} ON x{d}.host = t{d}.host AND x{d}.template = t{d}.template AND x{d}.s = t{d}.s)""".format(
            d=d, e=d - 1, many=urls.MANY, rare=urls.RARE, z=urls.Z
        )
        for d in range(1, URL_LEVELS + 1)
    ]
    rules = sorted(urls.RULES, key=lambda r: -len(r[1]))
    fits = lambda r: (
        f"(host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}')"
    )
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in rules)
    return f"""
WITH labelled AS (SELECT doc_id AS page_id, (min(quality) > 0)::INTEGER AS good FROM labels
                  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
r AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p0 AS (SELECT host, path, count(*) AS pages, count(good) AS labelled, coalesce(sum(good), 0) AS good,
              CASE WHEN path = '' THEN [] ELSE string_split(regexp_replace(path, '^/', ''), '/') END AS segs, '' AS template
       FROM r LEFT JOIN labelled USING (page_id) GROUP BY host, path),{",".join(levels)},
tree AS (SELECT host, path, labelled, good, CASE WHEN len(segs) > {URL_LEVELS} THEN error('path too deep') ELSE template END AS template
         FROM p{URL_LEVELS}),
bt AS (SELECT host, template, sum(labelled)::DOUBLE AS labelled, sum(good)::DOUBLE AS good FROM tree GROUP BY ALL),
bh AS (SELECT host, sum(labelled) AS hl, sum(good) AS hg FROM bt GROUP BY host),
hp AS (SELECT host, (hg + {urls.PRIOR} * (SELECT (sum(hg) + 1) / (sum(hl) + 2) FROM bh)) / (hl + {urls.PRIOR}) AS prior FROM bh),
pur AS (SELECT host, template, (good + {urls.PRIOR} * prior) / (labelled + {urls.PRIOR}) AS purity FROM bt JOIN hp USING (host))
SELECT page_id, host, path, template, {rule} AS rule,
       {verdict} WHEN purity < {urls.PURITY} THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN (SELECT host, path, template FROM tree) USING (host, path) JOIN pur USING (host, template)
"""


SQL["op3_url_filters"] = _url_sql()


def _crc32_sql(digits: str) -> str:
    """CRC-32 of bytes given as hexadecimal digits, half a byte at a time, with the usual reflected
    polynomial."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    digit = f"strpos('0123456789ABCDEF', substr({digits}, j + 2 - j % 2 * 2, 1)) - 1"  # the low half first
    halves = f"list_transform(range(strlen({digits})), lambda j: ({digit})::BIGINT)"
    step = f"xor(crc >> 4, ({table}::BIGINT[])[xor(crc & 15, half) + 1])"
    return f"xor(list_reduce([4294967295::BIGINT] || {halves}, lambda crc, half: {step}), 4294967295::BIGINT)"


SQL["op2_sharding"] = f"""
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
s AS (SELECT doc_id, strlen(digits) // 2 + 16 AS size, {_crc32_sql("digits")} AS text_crc32 FROM t),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS start,
             sum(size) OVER () AS total FROM s),
c AS (SELECT *, ((2 * start + size) * 40 // (2 * total))::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       NULL::INTEGER AS grown_shard
FROM c
"""
