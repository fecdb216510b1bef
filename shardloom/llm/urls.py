"""URL filters from fixed rules and a tree of path templates per host.

Paths grow into templates level by level, from the host down, to any depth; what all paths below a
node begin with is appended in one step, as each of its levels has a single branch. Under each node, segments of a shape
with many rare values (numbers, numbered files, identifiers) become that shape's wildcard. Of the
other segments, those whose labelled purity doesn't differ from the rest of their siblings (two
proportions, pooled) become one merged branch ``*``; the rest stay literal branches. Templates are then
rejected by their purity among labelled pages, smoothed towards their host's, which is smoothed
towards that of all pages.

Only counts per distinct path are moved. A label belongs to the page whose page_id is its doc_id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import UPPER, bounded
from shardloom.session import materialize

# Verdict and rule (host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MANY = 8  # distinct values a variable segment has at least
RARE = 8  # pages per value it has on average at most
Z = 1.96
PRIOR = 5.0  # labelled pages the prior counts for
PURITY = 0.5  # templates below it are rejected


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (length, rule, verdict) of the longest fitting rule, else null. ``rules`` is a literal
    policy list; a rule fits its host and all subdomains of it."""
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        on_host = (host == name) | host.endswith("." + name)
        value = F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(on_host & path.startswith(slash + rest), value))
    return F.array_max(F.array_compact(F.array(*fits)))


def shape(segment: Column) -> Column:
    """Wildcard a segment would become: all values of one shape share it."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "<num>")
        .when(segment.rlike(r"^[0-9]+\.[a-z]+$"), F.regexp_replace(segment, r"^[0-9]+", "<num>"))
        .when(segment.rlike(r"^[0-9a-fA-F-]{8,}$"), "<id>")
        .when(segment.rlike(r"[0-9]"), "<mixed>")
        .otherwise("<word>")
    )


def skip(paths: DataFrame) -> DataFrame:
    """Appends to each node's template the segments that all its paths go on with, of rows that go on."""
    node = ["host", "template"]
    rest = F.slice("segments", F.col("at") + 1, F.size("segments"))
    ends = paths.groupBy(*node).agg(F.min(rest).alias("_low"), F.max(rest).alias("_high"))
    # Arrays are ordered by their first difference, so the least and the greatest differ first.
    apart = F.array_position(F.zip_with("_low", "_high", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
    common = F.when(apart == 0, F.size("_low")).otherwise(apart - 1)
    # A count per node: a node of very many paths is not dealt out by its key again.
    ends = bounded(ends.select(*node, common.alias("_n")).where("_n > 0"), "url-ends", 32 << 20, 200)
    more = F.array_join(F.slice("segments", F.col("at") + 1, F.col("_n")), "/")
    longer = F.when(F.col("_n") > 0, F.concat("template", F.lit("/"), more)).otherwise(F.col("template"))
    joined = paths.join(ends, node, "left").withColumn("template", longer)
    return joined.withColumn("at", F.col("at") + F.coalesce("_n", F.lit(0))).select(*paths.columns)


def grow(paths: DataFrame) -> DataFrame:
    """One more level: rows (host, path, segments, template, at, pages, labelled, good) that go on."""
    here = F.element_at("segments", F.col("at") + 1)
    rows = paths.withColumn("_s", here).withColumn("_shape", shape(here))
    node = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "good")]
    children = materialize(rows.groupBy(*node, "_s", "_shape").agg(*sums), "url-children")
    shapes = children.groupBy(*node, "_shape").agg(
        F.count("*").alias("_values"), F.sum("pages").alias("_pages"), *[F.sum(c).alias(f"_{c}") for c in ("labelled", "good")]
    )
    shapes = shapes.withColumn("_variable", (F.col("_values") >= MANY) & (F.col("_pages") <= RARE * F.col("_values")))
    # A row per node and shape: a host with very many segments is not dealt out by them again.
    shapes = bounded(shapes, "url-shapes", 32 << 20, 200)
    literal = shapes.where("NOT _variable").groupBy(*node).agg(
        F.sum("_labelled").alias("_all_labelled"), F.sum("_good").alias("_all_good"), F.sum("_values").alias("_branches")
    )
    rest, rest_good = F.col("_all_labelled") - F.col("labelled"), F.col("_all_good") - F.col("good")
    one = F.lit(1)
    pooled = F.try_divide("_all_good", "_all_labelled")
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(one, F.col("labelled")) + F.try_divide(one, rest)))
    difference = F.abs(F.try_divide("good", "labelled") - F.try_divide(rest_good, rest))
    apart = (F.col("labelled") > 0) & (rest > 0) & (difference > Z * error)
    token = (
        F.when(F.col("_variable"), F.col("_shape"))
        .when((F.col("_branches") == 1) | F.coalesce(apart, F.lit(False)), F.col("_s"))
        .otherwise("*")
    )
    decided = (
        children.join(shapes.select(*node, "_shape", "_variable"), [*node, "_shape"])
        .join(literal, node, "left")
        .select(*node, "_s", token.alias("_token"))
    )
    grown = rows.drop("_shape").join(decided, [*node, "_s"])
    grown = grown.withColumn("template", F.concat("template", F.lit("/"), "_token")).withColumn("at", F.col("at") + 1)
    return grown.select(*paths.columns)


def templates(paths: DataFrame) -> DataFrame:
    """Adds template to rows (host, path, pages, labelled, good), one row per distinct path.

    A round goes down to the next place where paths part; paths that have ended leave the rounds. So
    there are as many rounds as there are such places on one path, however long the paths are.
    """
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace("path", "^/", ""), "/")
    )
    rows = paths.select("*", segments.alias("segments"), F.lit("").alias("template"), F.lit(0).alias("at"))
    goes_on = F.col("at") < F.size("segments")
    ended = [rows.where(~goes_on)]
    step = skip
    while not rows.where(goes_on).isEmpty():
        rows = materialize(step(rows.where(goes_on)), "url-templates")
        ended.append(rows.where(~goes_on))
        step = grow if step is skip else skip
    return reduce(DataFrame.union, ended).drop("segments", "at")


def purity(rows: DataFrame) -> DataFrame:
    """host, template and smoothed purity, from rows with labelled and good counts."""
    sums = [F.sum(c).alias(c) for c in ("labelled", "good")]
    by_template = rows.groupBy("host", "template").agg(*sums)
    by_host = by_template.groupBy("host").agg(F.sum("labelled").alias("_hl"), F.sum("good").alias("_hg"))
    good, labelled = by_host.agg(F.sum("_hg"), F.sum("_hl")).first()  # two numbers
    whole = F.lit(((good or 0) + 1) / ((labelled or 0) + 2))
    by_host = by_host.select("host", ((F.col("_hg") + PRIOR * whole) / (F.col("_hl") + PRIOR)).alias("_hp"))
    smooth = (F.col("good") + PRIOR * F.col("_hp")) / (F.col("labelled") + PRIOR)
    return by_template.join(by_host, "host").select("host", "template", smooth.alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, template, purity, rule and verdict of every page.

    Null urls and urls without ``://`` have empty host and path, which are a host and a path like
    any other. A page labelled twice is good only if both labels say so. Without labels all
    purities are one half, and nothing is rejected.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("page_id"))
    good = good.agg((F.min("quality") > 0).cast("bigint").alias("_good"))
    counted = rows.join(good, "page_id", "left").groupBy("host", "path").agg(
        F.count("*").alias("pages"),
        F.count("_good").alias("labelled"),
        F.coalesce(F.sum("_good"), F.lit(0)).alias("good"),
    )
    paths = materialize(templates(materialize(counted, "url-paths")).select("host", "path", "template", "labelled", "good"), "url-tree")
    pure = bounded(purity(paths), "url-purity", 32 << 20, 200)
    found = paths.select("host", "path", "template").join(pure, ["host", "template"])
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    judged = rows.join(found, ["host", "path"]).withColumn("_rule", rule)
    by_method = F.when(F.col("purity") < PURITY, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "template", "purity", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", by_method).alias("verdict"),
    )
