"""Conversations in reply order, without quotes, by linking quoted passages to their originals.

A message's leading ``>`` marks give each line a quote level. The lines of level 0 are what the
message itself says. Lines are normalised (case, white space and marks don't count). Passages are
single lines, paragraphs (lines without a blank one between them) and blocks (lines of one level
without a line of another level between them), each joined without its line breaks and hashed, so
that a passage wrapped anew has the same hash. A quoted passage links to the latest earlier message of
the conversation that states it at level 0; where a block has a link, its paragraphs and lines are not
looked at, and where a paragraph has one, its lines aren't. Each linked line of level 1 is a vote, and
the message with most votes (the latest on a tie) is the one replied to. Deeper levels link to what is
quoted there, and count as a message's ancestors. A quote of a part of a line finds no original.

The latest earlier statement comes from one ordered scan over statements and quotes of a hash, in
blocks of turns; no pairs are formed within a conversation, however often a line occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import text_or_empty
from shardloom.operators.ordering import dense_index, prefix_scan
from shardloom.session import materialize

MARKS = r"^([ \t>]*>)[ \t]?"
# A line that only announces a quote belongs to the quote.
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió)\s*:\s*$"
KEY = ("conv_id", "_m")


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(F.regexp_replace(marks, "[^>]", ""))


def normalised(line: Column) -> Column:
    bare = F.regexp_replace(line, MARKS, "")
    return F.trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


def message_lines(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, _m, turn, at, level, plain); plain is null for lines without a word."""
    lines = messages.select(*KEY, "turn", F.posexplode(F.split(text_or_empty(F.col("text")), "\n", -1)).alias("at", "_raw"))
    plain = normalised(F.col("_raw"))
    return lines.select(*KEY, "turn", "at", level(F.col("_raw")).alias("level"), F.when(plain != "", plain).alias("plain"))


def passages(lines: DataFrame) -> DataFrame:
    """(conv_id, _m, turn, level, _block, _par, kind, n, hash): lines (kind 0), paragraphs of several
    lines (1) and blocks of several paragraphs (2), with their lines that have words."""
    order = Window.partitionBy(*KEY).orderBy("at")
    changed = F.coalesce(F.col("level") != F.lag("level").over(order), F.lit(False))
    numbered = lines.withColumn("_changed", changed)
    numbered = numbered.withColumn("_block", F.sum(F.col("_changed").cast("int")).over(order))
    numbered = numbered.withColumn("_par", F.sum((F.col("_changed") | F.col("plain").isNull()).cast("int")).over(order))
    numbered = numbered.where("plain IS NOT NULL")
    said = F.array_sort(F.collect_list(F.struct("at", "plain")))
    pars = numbered.groupBy(*KEY, "turn", "level", "_block", "_par").agg(said.alias("_lines"))
    joined = lambda c: F.sha2(F.array_join(c, " ").cast("binary"), 256)
    pars = pars.select("*", F.col("_lines.plain").alias("_plain"), F.col("_lines.at").getItem(0).alias("_at"))
    same = [*KEY, "turn", "level", "_block"]
    single = pars.select(*same, "_par", F.explode("_plain").alias("_line")).select(
        *same, "_par", F.lit(0).alias("kind"), F.lit(1).alias("n"), F.sha2(F.col("_line").cast("binary"), 256).alias("hash")
    )
    several = pars.where(F.size("_plain") > 1).select(
        *same, "_par", F.lit(1).alias("kind"), F.size("_plain").alias("n"), joined(F.col("_plain")).alias("hash")
    )
    blocks = pars.groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("_at", "_plain"))).alias("_pars"))
    blocks = blocks.where(F.size("_pars") > 1).withColumn("_plain", F.flatten(F.col("_pars._plain"))).select(
        *same, F.lit(-1).cast("bigint").alias("_par"), F.lit(2).alias("kind"), F.size("_plain").alias("n"), joined(F.col("_plain")).alias("hash")
    )
    return single.unionByName(several).unionByName(blocks)


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv_id, _m, level, source, source_turn, votes): per message and quote level, each earlier
    message that stated some of the quoted lines."""
    messages = messages.where("turn IS NOT NULL")
    quoting = messages.where(F.col("text").rlike(r"(?:^|\n)[ \t]*>"))
    quoted = materialize(passages(message_lines(quoting)).where("level > 0"), "quoted-passages")
    # Only conversations with quotes are cut into statements, and only quoted hashes are kept.
    asked = messages.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    stated = passages(message_lines(asked)).where("level = 0").select("conv_id", "hash", "turn", "_m").distinct()
    stated = stated.join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    events = quoted.withColumn("_states", F.lit(0)).unionByName(stated.withColumn("_states", F.lit(1)), allowMissingColumns=True)
    events = materialize(events, "quote-events")
    place = F.when(F.col("_states") == 1, F.struct(F.col("turn").cast("bigint").alias("turn"), F.col("_m").alias("m")))
    # In a turn, quotes come before statements: only earlier turns count.
    found = prefix_scan(events, ["conv_id", "hash"], "turn", {"stated": ("max", place)}, tie=["_states"], levels=(10, 30))
    found = found.where("_states = 0 AND stated IS NOT NULL")
    longest = Window.partitionBy(*KEY, "_block")
    found = found.withColumn("_in_block", F.max("kind").over(longest) == 2)
    found = found.withColumn("_in_par", F.max("kind").over(Window.partitionBy(*KEY, "_block", "_par")) == 1)
    found = found.where((F.col("kind") == 2) | (~F.col("_in_block") & ((F.col("kind") == 1) | ~F.col("_in_par"))))
    return found.groupBy(*KEY, "level", F.col("stated.m").alias("source"), F.col("stated.turn").alias("source_turn")).agg(
        F.sum("n").alias("votes")
    )


def without_quotes(text: Column) -> Column:
    """The level-0 lines of a text, without attribution lines right before a quote and without the
    empty lines this leaves at either end."""
    lines = F.split(text_or_empty(text), "\n", -1)
    kept = F.filter(
        lines,
        lambda line, i: (level(line) == 0)
        & ~(line.rlike(ATTRIBUTION) & (level(F.coalesce(F.try_element_at(lines, i + 2), F.lit(""))) > 0)),
    )
    return F.when(F.exists(lines, lambda line: level(line) > 0), F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")).otherwise(
        text_or_empty(text)
    )


def thread_roots(links: DataFrame) -> DataFrame:
    """(conv_id, _m, root, root_turn) of messages that reply to another, by pointer doubling: each
    round replaces a message's ancestor by the ancestor's own, so the rounds are the logarithm of
    the longest chain of replies."""
    up = materialize(links.select(*KEY, F.col("reply_to").alias("root"), F.col("reply_turn").alias("root_turn")), "thread-roots")
    while True:
        above = up.select("conv_id", F.col("_m").alias("root"), F.col("root").alias("_r"), F.col("root_turn").alias("_t"))
        stepped = up.join(above, ["conv_id", "root"], "left").withColumn("_moved", F.col("_r").isNotNull())
        stepped = stepped.select(
            *KEY, F.coalesce("_r", "root").alias("root"), F.coalesce("_t", "root_turn").alias("root_turn"), "_moved"
        )
        stepped = materialize(stepped, "thread-roots")
        up = stepped.drop("_moved")
        if stepped.where("_moved").isEmpty():
            return up


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, body, reply_turn, thread_turn, n_ancestors and position of every
    message.

    ``body`` is the text without quotes. ``reply_turn`` is the turn replied to (null: none found).
    Messages are ordered by the turn that began their thread (a message that replies to none begins
    one), then by turn; ``position`` counts that order per conversation from 0, so every reply comes
    after what it answers. Rows without conv_id or turn take no part in links and have no position;
    null texts have an empty body. Repeated rows are each a message; of several that state a
    passage in one turn, one is linked.
    """
    rows = materialize(
        messages.select("conv_id", "turn", "role", "text").withColumn("_m", F.monotonically_increasing_id()), "messages"
    )
    usable = rows.where("conv_id IS NOT NULL")
    found = materialize(quote_links(usable), "quote-links")
    best = F.max(F.struct("votes", "source_turn", "source")).alias("_best")
    reply = found.where("level = 1").groupBy(*KEY).agg(best)
    reply = reply.select(*KEY, F.col("_best.source").alias("reply_to"), F.col("_best.source_turn").alias("reply_turn"))
    reply = materialize(reply, "replies")
    ancestors = found.groupBy(*KEY).agg(F.count_distinct("source").alias("n_ancestors"))
    tree = reply.join(thread_roots(reply), list(KEY)).join(ancestors, list(KEY))
    joined = rows.join(tree.select(*KEY, "reply_turn", "root", "root_turn", "n_ancestors"), list(KEY), "left")
    joined = joined.withColumn("thread_turn", F.coalesce("root_turn", "turn")).withColumn("_root", F.coalesce("root", "_m"))
    joined = joined.withColumn("n_ancestors", F.coalesce("n_ancestors", F.lit(0).cast("bigint")))
    body = without_quotes(F.col("text"))
    columns = ["conv_id", "turn", "role", "text", "_m", "reply_turn", "thread_turn", "n_ancestors"]
    placed = joined.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(*columns, "_root")
    placed = materialize(placed, "threads")
    # Threads by the turn that began them, then by number; within a thread by turn.
    sized = placed.groupBy("conv_id", "thread_turn", "_root").agg(F.count("*").alias("_size"))
    sized = materialize(sized, "thread-sizes")
    begin = running_sizes(sized)
    within = dense_index(
        placed.withColumn("_thread", F.col("_root")), ["conv_id", "_root"], "turn", "_within", tie=["_m"], levels=(10, 30)
    )
    ordered = within.join(begin, ["conv_id", "_root"]).withColumn("position", F.col("_begin") + F.col("_within"))
    rest = joined.where("conv_id IS NULL OR turn IS NULL").select(*columns).withColumn("position", F.lit(None).cast("bigint"))
    out = ordered.select(*columns, "position").unionByName(rest)
    return out.withColumn("body", body).drop("_m")


def running_sizes(sized: DataFrame) -> DataFrame:
    """(conv_id, _root, _begin): messages in the threads before each thread of a conversation."""
    # Threads of one conversation may begin in one turn; equal turns are told apart by the root.
    scanned = prefix_scan(
        sized, ["conv_id"], "thread_turn", {"_until": ("sum", F.col("_size"))}, tie=["_root"], levels=(10, 30)
    )
    return scanned.select("conv_id", "_root", (F.col("_until") - F.col("_size")).cast("bigint").alias("_begin"))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, position, role and body in reply order: the chat without quotes."""
    rows = linked(messages).where("position IS NOT NULL").select("conv_id", "position", "role", "body", "turn", "reply_turn")
    return rows.repartition("conv_id", F.floor(F.col("position") / 1024)).sortWithinPartitions("conv_id", "position")
