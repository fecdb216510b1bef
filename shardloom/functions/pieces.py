"""Chat text as pieces: each piece is tokenised on its own and carries one learn flag.

A piece is a list of parts, special ids (int) and text (Column). Merges never cross a piece, so
ids and mask stay aligned by construction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.constants import (
    END_TOOL_CALL,
    END_TOOL_RESULT,
    IM_END,
    IM_START,
    SPECIAL_TOKENS,
    TOOL_CALL,
    TOOL_RESULT,
)
from shardloom.functions.arrays import char_ids
from shardloom.functions.vocab import DEFAULT_VOCAB, IDS, encoder, list_sizes, small_batches, text_sizes
from shardloom.session import ship_package

NAMES = {v: k for k, v in SPECIAL_TOKENS.items()}


@dataclass(frozen=True)
class Piece:
    parts: tuple[int | Column, ...]
    learn: Column
    user_text: bool = False  # content written by users, where special strings may be escaped


def _text(piece: Piece) -> Column:
    return F.concat(*[F.lit(NAMES[p]) if isinstance(p, int) else p for p in piece.parts])


def _chars(piece: Piece) -> Column:
    return F.concat(*[F.array(F.lit(p)) if isinstance(p, int) else char_ids(p) for p in piece.parts])


def _char_count(piece: Piece) -> Column:
    return sum((F.lit(1) if isinstance(p, int) else F.length(p) for p in piece.parts), F.lit(0))


def learns(role: Column) -> Column:
    """Assistant turns are trained on, every other role is not."""
    return F.when(role == "assistant", 1).otherwise(0)


def turn_pieces(role: Column, content: Column) -> list[Piece]:
    never, learn = F.lit(0), learns(role)
    return [
        Piece((IM_START, F.concat(role, F.lit("\n"))), never),
        Piece((content,), learn, user_text=True),
        Piece((IM_END, F.lit("\n")), learn),
    ]


def generation_prompt() -> Piece:
    return Piece((IM_START, F.lit("assistant\n")), F.lit(0))


def tool_pieces(
    question: Column, reasoning: Column, expr: Column, result: Column, answer: Column, system: Column | None = None
) -> list[Piece]:
    """A worked calculator turn; the injected result line is read but never learned."""
    never, learn, newline = F.lit(0), F.lit(1), F.lit("\n")
    prompt = [] if system is None else turn_pieces(F.lit("system"), system)
    prompt += [*turn_pieces(F.lit("user"), question), generation_prompt()]
    return [
        *prompt,
        Piece((F.concat(reasoning, newline),), learn),
        Piece((TOOL_CALL, expr, END_TOOL_CALL, newline), learn),
        Piece((TOOL_RESULT, result, END_TOOL_RESULT, newline), never),
        Piece((answer, IM_END, newline), learn),
    ]


def render(pieces: Sequence[Piece]) -> Column:
    return F.concat(*[_text(p) for p in pieces])


def char_example(pieces: Sequence[Piece]) -> tuple[Column, Column]:
    """(ids, mask) in the native vocabulary."""
    ids = F.concat(*[_chars(p) for p in pieces])
    mask = F.concat(*[F.array_repeat(p.learn, _char_count(p).cast("int")) for p in pieces])
    return ids, mask


def piece_structs(pieces: Sequence[Piece], escape: bool) -> Column:
    return F.array(
        *[
            F.struct(
                _text(p).alias("text"),
                p.learn.alias("learn"),
                F.lit(not (escape and p.user_text)).alias("special"),
            )
            for p in pieces
        ]
    )


def encode_pieces(df: DataFrame, pieces: str = "pieces", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """Replace an array of (text, learn, special) by aligned ``ids`` and ``mask``."""
    ship_package(df.sparkSession)
    column = df.columns.index(pieces)
    kept = [f for f in df.schema.fields if f.name != pieces]

    def text_bytes(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column(column)
        ends = np.concatenate(([0], np.cumsum(text_sizes(lists.flatten().field("text")))))
        return np.diff(ends[np.concatenate(([0], np.cumsum(list_sizes(lists))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in small_batches(batches, text_bytes):
            lists = batch.column(column)
            flat = lists.flatten()
            texts = flat.field("text").to_pylist()
            special = flat.field("special").to_pylist()
            learn = flat.field("learn").to_numpy(zero_copy_only=False).astype(np.int32)
            ids = [
                enc.encode_to_numpy(t, allowed_special="all" if s else set(), disallowed_special=())
                for t, s in zip(texts, special)
            ]
            sizes = np.array([len(i) for i in ids], dtype=np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            piece_offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            offsets = pa.array(ends[piece_offsets.astype(np.int64)].astype(np.int32))
            all_ids = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, dtype=np.int32)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != column]
            columns += [
                pa.ListArray.from_arrays(offsets, pa.array(all_ids)),
                pa.ListArray.from_arrays(offsets, pa.array(np.repeat(learn, sizes))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["ids", "mask"])

    schema = T.StructType([*kept, T.StructField("ids", IDS), T.StructField("mask", IDS)])
    return df.mapInArrow(run, schema)


def encode_examples(
    df: DataFrame, keep: Sequence[str], pieces: Sequence[Piece], vocab: str = DEFAULT_VOCAB, escape: bool = False
) -> DataFrame:
    """One row in, one row out: ``keep`` plus aligned ``ids`` and ``mask``."""
    if vocab == "char":
        ids, mask = char_example(pieces)
        return df.select(*keep, ids.alias("ids"), mask.alias("mask"))
    return encode_pieces(df.select(*keep, piece_structs(pieces, escape).alias("pieces")), vocab=vocab)
