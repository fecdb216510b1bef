"""Conversations to training batches: render, mask, truncate, batch, pad, loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.constants import PAD
from shardloom.functions.arrays import inputs_of, labels_of, pad_to, total, whole_div
from shardloom.functions.pieces import (
    char_example,
    encode_examples,
    encode_pieces,
    generation_prompt,
    piece_structs,
    render,
    turn_pieces,
)
from shardloom.functions.vocab import DEFAULT_VOCAB
from shardloom.operators.layout import repeat_epochs
from shardloom.operators.ordering import dense_index, prefix_scan
from shardloom.session import materialize

def render_turns(turns: DataFrame, add_generation_prompt: bool = False) -> DataFrame:
    """(conv_id, turn, text): one rendered row per turn, no shuffle; texts concatenate in turn order."""
    rendered = turns.select("conv_id", "turn", render(turn_pieces(F.col("role"), F.col("content"))).alias("text"))
    if not add_generation_prompt:
        return rendered
    ends = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    return rendered.unionByName(ends.withColumn("text", render([generation_prompt()])))


def render_chat(messages: Column, add_generation_prompt: bool = False) -> Column:
    """The text of a conversation held in one row."""
    turns = F.transform(messages, lambda m: render(turn_pieces(m["role"], m["content"])))
    tail = render([generation_prompt()]) if add_generation_prompt else F.lit("")
    return F.concat(F.array_join(turns, ""), tail)


def encode_turns(
    turns: DataFrame, vocab: str = DEFAULT_VOCAB, escape: bool = False, add_generation_prompt: bool = False
) -> DataFrame:
    """(conv_id, turn, role, ids, mask) per turn, no shuffle.

    With ``add_generation_prompt`` every conversation ends with one more row that opens the
    assistant's turn and trains nothing.

    As in the source data special strings inside content become special ids; ``escape`` keeps
    them ordinary text.
    """
    pieces = turn_pieces(F.col("role"), F.col("content"))
    keys = ["conv_id", "turn", "role"]
    encoded = encode_examples(turns, keys, pieces, vocab, escape)
    if not add_generation_prompt:
        return encoded
    ends = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("role", F.lit("assistant"))
    return encoded.unionByName(encode_examples(ends, keys, [generation_prompt()], vocab, escape))


def _char_turn_ids(m: Column) -> Column:
    return char_example(turn_pieces(m["role"], m["content"]))[0]


def _char_turn_mask(m: Column) -> Column:
    return char_example(turn_pieces(m["role"], m["content"]))[1]


def encode_chats(chats: DataFrame, keep: list[str], vocab: str = DEFAULT_VOCAB, escape: bool = False) -> DataFrame:
    """``keep`` + (ids, mask) of conversations held in one row."""
    if vocab == "char":
        both = [F.transform("messages", part) for part in (_char_turn_ids, _char_turn_mask)]
        return chats.select(*keep, F.flatten(both[0]).alias("ids"), F.flatten(both[1]).alias("mask"))
    pieces = F.flatten(
        F.transform("messages", lambda m: piece_structs(turn_pieces(m["role"], m["content"]), escape))
    )
    return encode_pieces(chats.select(*keep, pieces.alias("pieces")), vocab=vocab)


def has_learnable(examples: DataFrame) -> DataFrame:
    return examples.where(F.array_contains("mask", 1))


def truncate(examples: DataFrame, T: int) -> DataFrame:
    return examples.withColumn("ids", F.slice("ids", 1, T)).withColumn("mask", F.slice("mask", 1, T))


def min_len(examples: DataFrame, n: int = 2) -> DataFrame:
    return examples.where(F.size("ids") >= n)


def assemble_examples(encoded: DataFrame, T: int) -> DataFrame:
    """Turn rows to (conv_id, ids, mask), cut to T tokens, conversations without anything to learn dropped.

    Whether a conversation has learnable tokens is decided on all its turns, before the cut. Where
    each turn starts is an exact prefix sum in blocks of turns, so a conversation of any length is
    no single task; turns that start behind the cut leave before the rest is gathered. The encoded
    turns have four readers (what is learnable, two scans, the rows), so they are written once.
    """
    encoded = materialize(encoded, "encoded-turns")
    learnable = encoded.where(F.array_contains("mask", 1)).select("conv_id").distinct()
    cut = encoded.select("conv_id", "turn", F.slice("ids", 1, T).alias("ids"), F.slice("mask", 1, T).alias("mask"))
    placed = prefix_scan(cut, ["conv_id"], "turn", {"__at": ("sum", F.size("ids"))}, inclusive=False)
    early = placed.where(F.col("__at") < T)
    room = (F.lit(T) - F.col("__at")).cast("int")
    parts = F.struct("turn", F.slice("ids", F.lit(1), room).alias("ids"), F.slice("mask", F.lit(1), room).alias("mask"))
    return (
        early.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(parts)).alias("parts"))
        .join(learnable, "conv_id", "left_semi")
        .select(
            "conv_id",
            F.flatten(F.col("parts.ids")).alias("ids"),
            F.flatten(F.col("parts.mask")).alias("mask"),
        )
    )


def tuning_batches(examples: DataFrame, B: int, order: str = "conv_id") -> DataFrame:
    """Every B consecutive examples make a batch; an incomplete last batch is never emitted.

    Adds ``batch``, ``row`` and ``L`` (longest example of the batch). ``examples`` is read twice:
    pass a materialised table.
    """
    indexed = dense_index(examples, [], order, "__idx")
    placed = indexed.select(
        whole_div(F.col("__idx"), B).alias("batch"), (F.col("__idx") % B).cast("int").alias("row"), *examples.columns
    )
    in_batch = Window.partitionBy("batch")
    return (
        placed.select("*", F.count("*").over(in_batch).alias("__n"), F.max(F.size("ids")).over(in_batch).alias("L"))
        .where(F.col("__n") == B)
        .drop("__n")
    )


def tuning_stream(examples: DataFrame, B: int, steps: int, order: str = "conv_id") -> DataFrame:
    """Exactly ``steps`` batches of B examples from an endlessly repeated source.

    The source starts again where it ends, inside a batch if need be, so no example is left out at
    the end of an epoch. Adds ``batch``, ``row``, ``epoch`` and ``L``. ``examples`` is read more than
    once: pass a materialised table. Without examples there are no batches to make.
    """
    n = examples.count()  # from file footers
    if not n and steps:
        raise ValueError("no examples to make batches of")
    indexed = dense_index(examples, [], order, "__idx").withColumn("__n", F.lit(n).cast("bigint"))
    stream = repeat_epochs(indexed, -(-steps * B // max(n, 1)), "__idx", "__n").where(F.col("stream_pos") < steps * B)
    placed = stream.select(
        whole_div(F.col("stream_pos"), B).alias("batch"),
        (F.col("stream_pos") % B).cast("int").alias("row"),
        "epoch",
        *examples.columns,
    )
    return placed.withColumn("L", F.max(F.size("ids")).over(Window.partitionBy("batch")))


def pad_batch(batches: DataFrame) -> DataFrame:
    return batches.withColumn("ids", pad_to(F.col("ids"), F.col("L"), PAD)).withColumn(
        "mask", pad_to(F.col("mask"), F.col("L"), 0)
    )


def shift_masked(batches: DataFrame) -> DataFrame:
    """x, y and the mask of y."""
    return (
        batches.withColumn("x", inputs_of(F.col("ids")))
        .withColumn("y", labels_of(F.col("ids")))
        .withColumn("m", labels_of(F.col("mask")))
        .drop("ids", "mask")
    )


def masked_mean_loss(batches: DataFrame, loss: str = "loss", mask: str = "m") -> DataFrame:
    """Σ(loss·mask) / max(Σmask, 1) per batch, summed inside the row first."""
    weighted = F.aggregate(
        F.zip_with(loss, mask, lambda v, m: v * m), F.lit(0.0), lambda acc, v: acc + v
    )
    sums = batches.select("batch", weighted.alias("w"), total(F.col(mask)).alias("n"))
    per_batch = sums.groupBy("batch").agg(F.sum("w").alias("w"), F.sum("n").alias("n_learn"))
    return per_batch.select("batch", "n_learn", (F.col("w") / F.greatest("n_learn", F.lit(1))).alias("loss"))


def trained_token_share(examples: DataFrame, by: str) -> DataFrame:
    """Share of trained tokens per class: the audit that shows a class hijacking the objective."""
    per_class = examples.groupBy(by).agg(
        F.count("*").alias("n_examples"), F.sum(total(F.col("mask"))).alias("n_trained")
    )
    # One row per class.
    everything = F.sum("n_trained").over(Window.partitionBy(F.lit(0)))
    return per_class.withColumn("share", F.col("n_trained") / everything)

