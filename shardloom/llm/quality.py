"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects documents whose ratio exceeds a cutoff. The rules are tightened along one path of
joint settings, each stricter than the one before: the order comes from documents labelled bad (what
rejects most of them comes first), never from those labelled good. Per stratum (language) the path's
settings are tested in turn on documents labelled good: the exact binomial tail tells whether the
share of good documents that all rules together reject is below ``alpha``. Testing stops at the first
setting that fails, so neither the path's length nor the number of rules needs a correction; strata
share ``delta`` equally (Bonferroni).

A stratum with too few good labels for even a setting that rejects none of them is not tested by
itself. It takes the setting found for the good documents of all strata together, which has a part of
``delta`` of its own, no further than its own good labels show at most ``alpha`` rejected. With
probability 1 - delta, at most ``alpha`` of the good documents are falsely rejected in every tested
stratum, and of all strata together where the pooled setting is used; for a small stratum alone
nothing is promised. A stratum without any good label is no part of that pool and keeps whatever the
base part keeps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import bounded
from shardloom.session import materialize, ship_package

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
NGRAM = 5
ALPHA = 0.01
DELTA = 0.05
POOLED = 0.2  # the pooled test's part of delta
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_lines bigint, n_repeat_words bigint"


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


# Cutoffs of each rule's ratio, from the loosest to the strictest.
RULES: dict[str, tuple[float, ...]] = {
    "symbols": (0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01),
    "dup_lines": (0.9, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05),
    "repeat_words": (0.19, 0.17, 0.15, 0.12, 0.1, 0.07, 0.05),
    "long_words": (60.0, 40.0, 25.0, 18.0, 14.0, 12.0, 10.0),
    "short_words": (0.9, 0.7, 0.5, 0.4, 0.33, 0.3, 0.27),
}


def rule_values() -> dict[str, Column]:
    words = F.col("n_words")
    return {
        "symbols": ratio(F.col("n_symbols"), F.col("word_chars")),
        "dup_lines": ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_words": ratio(F.col("n_repeat_words"), words),
        "long_words": ratio(F.col("word_chars"), words),
        "short_words": ratio(words, F.col("word_chars")),
    }


def repeated_words(words: list[bytes], n: int = NGRAM) -> int:
    """Words inside windows of ``n`` words that occur at least twice."""
    if len(words) <= n:
        return 0
    windows = list(zip(*[words[i:] for i in range(n)]))
    first: dict[tuple, int] = {}
    repeats = [(first.setdefault(w, i), i) for i, w in enumerate(windows)] if len(set(windows)) < len(windows) else []
    starts = sorted({i for pair in repeats if pair[0] != pair[1] for i in pair})
    total, reached = 0, 0
    for s in starts:
        total += s + n - max(s, reached)
        reached = s + n
    return total


def base_numbers(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    n_lines = n_dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n_lines += 1
            if line in seen:
                n_dup += 1
            seen.add(line)
    spaces = sum(map(text.count, SPACES))
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), n_dup, n_lines, repeated_words(words)


def base_statistics(text: Column) -> Column:
    """Base numbers of whole texts; null and empty texts have zeros throughout."""

    @F.pandas_udf(BASE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in BASE.split(", ")]
        for batch in batches:
            yield pd.DataFrame([base_numbers(t) for t in batch], columns=names, dtype="int64")

    return run(text)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of probability p, through the incomplete beta function's continued
    fraction, so that its cost doesn't grow with n."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), float(k + 1), 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1.0 - front * fraction(b, a, 1.0 - x) / b


def fraction(a: float, b: float, x: float) -> float:
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d or tiny)
    value = d
    for m in range(1, 100_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / ((1.0 + step * d) or tiny)
            c = (1.0 + step / c) or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return value


def strictest(n_good: int, rejected: list[int], grid: tuple[float, ...], alpha: float, delta: float) -> float | None:
    """The last cutoff reached before a test fails; None if the loosest already does."""
    best = None
    for cutoff, k in zip(grid, rejected):
        if n_good == 0 or binomial_tail(k, n_good, alpha) > delta:
            break
        best = cutoff
    return best


def least_good(alpha: float, delta: float) -> int:
    """Good documents it takes for a setting that rejects none of them to pass."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def first_exceeded() -> dict[str, Column]:
    """Per rule, the place in its grid of the loosest cutoff that rejects a row; the grid's length if none."""
    values = rule_values()
    return {
        name: F.lit(len(grid)) - sum((F.when(values[name] > c, 1).otherwise(0) for c in grid), F.lit(0))
        for name, grid in RULES.items()
    }


def tightening(bad: list[tuple[tuple[int, ...], int]]) -> list[tuple[str, int]]:
    """The path: (rule, place in its grid) of each step, from (first exceeded places, rows) of bad
    documents. Next comes what rejects most bad documents not rejected yet, in the fewest steps;
    cutoffs that reject no more of them come last, loosest first."""
    names = list(RULES)
    first = np.array([f for f, _ in bad], dtype=np.int64).reshape(-1, len(names))
    rows = np.array([n for _, n in bad], dtype=np.int64)
    done = dict.fromkeys(names, 0)
    path: list[tuple[str, int]] = []
    while True:
        offers = [
            (int(rows[first[:, r] < stop].sum()), done[name] - stop, -r, name, stop)
            for r, name in enumerate(names)
            for stop in range(done[name] + 1, len(RULES[name]) + 1)
        ]
        gain, _, r, name, stop = max(offers, default=(0, 0, 0, "", 0))
        if not gain:
            break
        path += [(name, i) for i in range(done[name], stop)]
        done[name] = stop
        left = first[:, -r] >= stop
        first, rows = first[left], rows[left]
    rest = [(i, names.index(name), name) for name in names for i in range(done[name], len(RULES[name]))]
    return path + [(name, i) for i, _, name in sorted(rest)]


def cutoffs(good: DataFrame, bad: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and one cutoff column per rule (null: rule unused), from rows (stratum, numbers) of
    documents labelled good and bad. Bad rows are gathered as counts of their places in the grids (8
    to the 5th at most). Rejections per step are counted before anything is gathered: a row per
    stratum leaves the cluster's aggregation, with one count per step."""
    places = first_exceeded()
    seen = bad.groupBy(*[c.alias(name) for name, c in places.items()]).agg(F.count("*").alias("_n")).collect()
    path = tightening(sorted((tuple(r[name] for name in RULES), r["_n"]) for r in seen))
    steps = range(len(path))
    # The step that rejects a row first.
    step = F.least(
        *[
            F.element_at(F.array(*[F.lit(path.index((name, i))) for i in range(len(grid))], F.lit(len(path))), places[name] + 1)
            for name, grid in RULES.items()
        ]
    )
    counts = [F.count(F.when(F.col("_step") <= s, 1)).alias(f"step_{s}") for s in steps]
    table = good.select("stratum", step.alias("_step")).groupBy("stratum").agg(F.count("*").alias("n_good"), *counts)
    table = materialize(table, "quality-counts")
    pool = table.agg(F.sum("n_good").alias("n_good"), *[F.sum(f"step_{s}").alias(f"step_{s}") for s in steps]).first()
    pooled = strictest(pool["n_good"] or 0, [pool[f"step_{s}"] or 0 for s in steps], tuple(steps), alpha, POOLED * delta)
    # The strata tested are chosen by their size alone, before any rejection is looked at.
    enough = least_good(alpha, (1 - POOLED) * delta / max(1, table.count()))
    share = (1 - POOLED) * delta / max(1, table.where(F.col("n_good") >= enough).count())

    def reached(n: int, rejected: list[int]) -> int | None:
        if n >= enough:
            return strictest(n, rejected, tuple(steps), alpha, share)
        fine = [s for s in steps if pooled is not None and s <= pooled and rejected[s] <= alpha * n]
        return max(fine, default=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = [batch[f"step_{s}"].tolist() for s in steps]
            last = [reached(n, list(k)) for n, k in zip(batch["n_good"].tolist(), zip(*columns))]
            settings = [{name: RULES[name][i] for name, i in path[: s + 1]} if s is not None else {} for s in last]
            out = {"stratum": batch["stratum"]}
            for name in RULES:
                out[name] = pd.Series([found.get(name) for found in settings], index=batch.index, dtype="float64")
            yield pd.DataFrame(out)

    return table.mapInPandas(run, "stratum string, " + ", ".join(f"{name} double" for name in RULES))


def base_failed() -> Column:
    """The fixed part: too few words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, base numbers, base_failed and kept of every document.

    A null language is a stratum of its own. Strata without a good label keep whatever the base part
    keeps, others with few take the pooled setting. An id labelled twice is good only if both labels
    say so; null labels and ids don't count. Rows that share an id are judged each by its own text.
    """
    ship_package(docs.sparkSession)
    stratum = F.when(F.col("lang").isNull(), "null").otherwise(F.concat(F.lit("lang "), "lang"))
    rows = docs.select("doc_id", stratum.alias("stratum"), base_statistics(F.col("text")).alias("_b"))
    rows = materialize(rows.select("doc_id", "stratum", "_b.*"), "quality-rows")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg((F.min("quality") > 0).alias("_good"))
    known = materialize(rows.where(~base_failed()).join(known, "doc_id"), "quality-labelled")
    found = cutoffs(known.where("_good"), known.where("NOT _good"), alpha, delta)
    found = bounded(found, "quality-cutoffs", 8 << 20, 100)
    values = rule_values()
    passed = [F.col(f"_c.{name}").isNull() | (values[name] <= F.col(f"_c.{name}")) for name in RULES]
    every = passed[0]
    for p in passed[1:]:
        every = every & p
    found = found.select("stratum", F.struct(*RULES).alias("_c"))
    judged = rows.join(found, "stratum", "left").withColumn("base_failed", base_failed())
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(every, F.lit(True))).alias("kept"),
    )
