"""Benchmark decontamination over a distributed positional inverted index.

The index stores (term, document, position) for every corpus occurrence of a term that some
benchmark item uses, plus one header posting per document with its word count. It is written once;
term frequencies, candidates and matches are all read from it, and the texts are scanned only to
build it. Each benchmark window is looked up by its rarest term: a posting of that term puts the
window at one offset (document position minus item position). Around it, the offset-adjusted
postings of all the item's terms are intersected, and runs of consecutive item positions as long as
a window are exact phrase matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import ascii_lower, bounded, row_key, text_or_empty
from shardloom.session import materialize

WINDOW = 13
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 64 << 20  # a benchmark side larger than this is joined by a shuffle
KEY = ("_k1", "_k2")


def words(text: Column) -> Column:
    """Runs of 0-9, a-z and all characters beyond ASCII, after lowering A-Z. Null has none."""
    return F.filter(F.split(ascii_lower(text_or_empty(text)), GAPS), lambda w: w != "")


def item_terms(benchmark: DataFrame) -> DataFrame:
    """item, item_id, n_item, item_pos, word. ``item`` is a non-null key that keeps repeated ids apart."""
    items = benchmark.select("item_id", words(F.col("text")).alias("_words"))
    items = items.where(F.size("_words") > 0).distinct()
    items = items.select(
        F.xxhash64(F.col("item_id").isNull(), "item_id", "_words").alias("item"),
        "item_id",
        F.size("_words").alias("n_item"),
        F.posexplode("_words").alias("item_pos", "word"),
    )
    return materialize(items, "bench-terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """_k1, _k2, pos, word_id, n_words per posting; a document's header has pos -1 and word_id 0.

    ``terms`` has one row per distinct benchmark word: word, word_id (above 0).
    """
    listed = F.concat(F.array(F.lit("")), words(F.col("text")))  # no word is empty: that's the header
    known = terms.select("word", "word_id").unionByName(
        docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).cast("bigint").alias("word_id"))
    )
    exploded = docs.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", listed.alias("_words")).select(
        *KEY, "doc_id", (F.size("_words") - 1).alias("n_words"), F.posexplode("_words").alias("_at", "word")
    )
    known = bounded(known, "bench-words", BROADCAST_BYTES, 100)
    postings = exploded.join(known, "word").select(
        *KEY, "doc_id", (F.col("_at") - 1).alias("pos"), "word_id", "n_words"
    )
    return materialize(postings, "postings")


def number_terms(items: DataFrame) -> DataFrame:
    return materialize(
        items.select("word").distinct().withColumn("word_id", F.monotonically_increasing_id() + 1), "bench-vocabulary"
    )


def rarest_places(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """item, n_item, item_pos, word_id of the rarest term of each of the items' windows, once each.

    Windows are found by a sliding minimum over (corpus count, position) per item.
    """
    rated = items.join(counts, "word_id", "left").withColumn(
        "_rarity", F.struct(F.coalesce("n_postings", F.lit(0)).alias("n"), "item_pos", "word_id")
    )
    slide = Window.partitionBy("item").orderBy("item_pos").rowsBetween(0, window - 1)
    starts = rated.withColumn("_best", F.min("_rarity").over(slide)).where(
        F.col("item_pos") <= F.greatest(F.col("n_item") - window, F.lit(0))
    )
    # A window whose rarest term never occurs has no match.
    return (
        starts.where("_best.n > 0")
        .select("item", "n_item", F.col("_best.item_pos").alias("item_pos"), F.col("_best.word_id").alias("word_id"))
        .distinct()
    )


def matched_positions(index: DataFrame, items: DataFrame, seeds: DataFrame) -> DataFrame:
    """_k1, _k2, item, n_item, offset, item_pos: where item and document agree around a candidate."""
    seeds = bounded(seeds, "bench-seeds", BROADCAST_BYTES, 100)
    candidates = (
        index.where("pos >= 0")
        .join(seeds, "word_id")
        .select(*KEY, "item", "n_item", (F.col("pos") - F.col("item_pos")).alias("offset"))
        .distinct()
    )
    # The index is wide and the candidates few: it stays in place while they fit.
    candidates = bounded(candidates, "bench-candidates", BROADCAST_BYTES, 120)
    places = bounded(items.select("item", "item_pos", "word_id"), "bench-places", BROADCAST_BYTES, 100)
    return (
        index.where("pos >= 0")
        .select(*KEY, "pos", "word_id")
        .join(candidates, list(KEY))
        .withColumn("item_pos", F.col("pos") - F.col("offset"))
        .where("item_pos >= 0 AND item_pos < n_item")
        .join(places, ["item", "item_pos", "word_id"])
        .select(*KEY, "item", "n_item", "offset", "item_pos")
        .distinct()  # repeated rows of a document repeat their postings
    )


def phrase_runs(matches: DataFrame, window: int) -> DataFrame:
    """_k1, _k2, item, start, stop: maximal runs of matched positions at least one window long.

    A shorter item is one window by itself. A group is one item at one offset of one document, so
    it has at most as many rows as the item has words.
    """
    place = Window.partitionBy(*KEY, "item", "offset").orderBy("item_pos")
    runs = matches.withColumn("_run", F.col("item_pos") - F.row_number().over(place))
    runs = runs.groupBy(*KEY, "item", "offset", "n_item", "_run").agg(
        F.min("item_pos").alias("_from"), F.count("*").alias("_long")
    )
    return runs.where(F.col("_long") >= F.least(F.lit(window), F.col("n_item"))).select(
        *KEY,
        "item",
        (F.col("offset") + F.col("_from")).alias("start"),
        (F.col("offset") + F.col("_from") + F.col("_long")).alias("stop"),
    )


def covered_words(runs: DataFrame) -> DataFrame:
    """_k1, _k2, n_hit: positions inside any run, counted once."""
    spans = runs.select(*KEY, "start", "stop").distinct()
    earlier = Window.partitionBy(*KEY).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("start"), F.coalesce(F.max("stop").over(earlier), F.col("start")))
    new = spans.select(*KEY, F.greatest(F.col("stop") - fresh, F.lit(0)).alias("_new"))
    return new.groupBy(*KEY).agg(F.sum("_new").cast("bigint").alias("n_hit"))


def prepare(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index of ``docs`` and the benchmark's terms with their ids."""
    items = item_terms(benchmark)
    terms = number_terms(items)
    return build_index(docs, terms), materialize(items.join(terms, "word"), "bench-items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: tuple[int, int] | None = None) -> DataFrame:
    """_k1, _k2, doc_id, n_words, n_hit, items (ids of occurring items) of every document.

    With ``near`` = (terms, slop) there is n_near_items too: how many items ``near_places`` finds in
    the document, from the same index.

    Null and empty texts have no words and no hits; so do all documents where the benchmark is
    empty. Benchmark items without words are left out. Rows equal in id and text get equal results;
    rows that share only the id are told apart. A null item id counts as an item and is listed as
    an empty string.
    """
    index, items = prepare(docs, benchmark)
    counts = index.where("pos >= 0").groupBy("word_id").agg(F.count("*").alias("n_postings"))
    seeds = rarest_places(items, counts, window)
    runs = materialize(phrase_runs(matched_positions(index, items, seeds), window), "bench-runs")
    ids = bounded(items.select("item", "item_id").distinct(), "bench-ids", BROADCAST_BYTES, 40)
    listed = (
        runs.select(*KEY, "item")
        .distinct()
        .join(ids, "item")
        .groupBy(*KEY)  # at most the benchmark's items per document
        .agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"))
    )
    found = materialize(covered_words(runs).join(listed, list(KEY)), "bench-found")
    out = (
        index.where("word_id = 0")
        .select(*KEY, "doc_id", "n_words")
        .join(found, list(KEY), "left")
        .select(
            *KEY,
            "doc_id",
            F.col("n_words").cast("bigint").alias("n_words"),
            F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
    if near is None:
        return out
    close = near_places(index, items, *near).groupBy(*KEY).agg(
        F.count_distinct(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("_near")
    )
    close = materialize(close, "bench-near-found")
    return out.join(close, list(KEY), "left").withColumn("n_near_items", F.coalesce("_near", F.lit(0).cast("bigint"))).drop("_near")


def is_contaminated(percent: int = 5) -> Column:
    """True where at least ``percent`` of a document's words are hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """``docs`` without the contaminated rows; of the others, every row as it is."""
    found = contamination(docs, benchmark, window).where(is_contaminated(percent))
    # Written, so that the planner broadcasts it while it is small instead of moving the texts.
    found = materialize(found.select(*KEY).distinct(), "contaminated")
    # The document in one column, so that no name of its own can clash.
    keyed = docs.select(F.struct(*docs.columns).alias("_doc"), *row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(found, list(KEY), "left_anti").select("_doc.*")


def near_matches(docs: DataFrame, benchmark: DataFrame, terms: int = 3, slop: int = 20) -> DataFrame:
    """doc_id, item_id, start, stop: stretches of at most ``slop`` words that hold the ``terms``
    rarest terms of an item in any order (all of a shorter item's terms)."""
    found = near_places(*prepare(docs, benchmark), terms, slop)
    return found.select("doc_id", "item_id", "start", "stop").distinct()


def near_places(index: DataFrame, items: DataFrame, terms: int = 3, slop: int = 20) -> DataFrame:
    """_k1, _k2, doc_id, item, item_id, start, stop of the proximity matches in a written index.

    Only terms that occur in the corpus are ranked (of equally rare ones the lesser word first), so a reworded item is found by its other words;
    an item of which fewer than ``terms`` (or than it has) occur has no match. Postings of those
    terms are ordered by position per document and item; each is followed by the last place of every
    other term, so no pairs are formed. The shortest stretch that ends at each posting counts.
    """
    counts = index.where("pos >= 0").groupBy("word_id").agg(F.count("*").alias("n_postings"))
    own = Window.partitionBy("item")
    wanted = items.select("item", "item_id", "word", "word_id").distinct().withColumn("_of", F.least(F.count("*").over(own), F.lit(terms)))
    wanted = wanted.join(counts, "word_id")
    wanted = wanted.withColumn("_rank", F.row_number().over(own.orderBy("n_postings", "word"))).where(F.col("_rank") <= terms)
    wanted = wanted.withColumn("_found", F.count("*").over(own)).where("_found = _of")
    wanted = bounded(wanted.select("item", "item_id", "word_id", "_rank", "_of"), "bench-near", BROADCAST_BYTES, 60)
    postings = index.where("pos >= 0").select(*KEY, "doc_id", "pos", "word_id").distinct().join(wanted, "word_id")
    here = Window.partitionBy(*KEY, "item").orderBy("pos")
    last = {r: F.last(F.when(F.col("_rank") == r, F.col("pos")), True).over(here) for r in range(1, terms + 1)}
    seen = postings.select("*", *[c.alias(f"_last{r}") for r, c in last.items()])
    start = F.least(*[F.when(F.col("_of") >= r, F.coalesce(F.col(f"_last{r}"), F.lit(-(1 << 30)))) for r in last], F.col("pos"))
    seen = seen.withColumn("start", start).withColumn("stop", F.col("pos") + 1)
    return seen.where(F.col("stop") - F.col("start") <= slop).select(*KEY, "doc_id", "item", "item_id", "start", "stop")
