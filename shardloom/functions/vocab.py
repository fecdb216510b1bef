"""Byte-level BPE as Arrow stages: one encoder per Python worker, one flat array per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shardloom.constants import EOT, SPECIAL_TOKENS
from shardloom.session import ship_package

IDS = T.ArrayType(T.IntegerType(), False)
DEFAULT_VOCAB = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(vocab: str = DEFAULT_VOCAB):
    """Encoder of a rank file: a name inside the vocabulary package, or a path all workers see."""
    import os

    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path = vocab if os.path.sep in vocab else public_tokenizers.path(vocab)
    return tiktoken.Encoding(
        name=os.path.basename(path),
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=load_tiktoken_bpe(path),
        special_tokens={"<|endoftext|>": EOT, **SPECIAL_TOKENS},
    )


# Bytes of text, or of ids, that a worker has in hand as Python values at a time, one row excepted.
IN_HAND = 1 << 20


def small_batches(
    batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], np.ndarray], most: int = IN_HAND
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` bytes, by ``sizes`` of a batch's rows, or of one row more.

    Spark counts rows, so a batch of long texts would take several times its size in Python values.
    """
    for batch in batches:
        size = sizes(batch)
        block = (np.cumsum(size) - size) // most
        starts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(size)]
        for low, high in zip(starts, starts[1:]):
            yield batch.slice(low, high - low)


def text_sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text, nulls 0."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def list_sizes(lists: pa.Array) -> np.ndarray:
    """Items of each list, nulls 0."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _ids_array(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _replace(schema: T.StructType, old: str, new: T.StructField) -> T.StructType:
    return T.StructType([new if f.name == old else f for f in schema.fields])


def encode_column(
    df: DataFrame,
    text: str = "text",
    out: str = "tokens",
    *,
    vocab: str = DEFAULT_VOCAB,
    specials: bool = False,
    prefix: Sequence[int] = (),
    limit: int | None = None,
) -> DataFrame:
    """Replace a text column by its token ids.

    Select only the needed columns first: everything in ``df`` crosses to Python. With
    ``specials`` the reserved strings map to their single ids, else they are ordinary text. An id
    above ``limit`` fails the job.
    """
    ship_package(df.sparkSession)
    column = df.columns.index(text)
    head = np.array(list(prefix), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        allowed = "all" if specials else set()
        empty = np.zeros(0, dtype=np.uint32)
        for batch in small_batches(batches, lambda b: text_sizes(b.column(column))):
            parts = []
            for value in batch.column(column).to_pylist():
                ids = enc.encode_to_numpy(value, allowed_special=allowed, disallowed_special=()) if value else empty
                if limit is not None and len(ids) and ids.max() > limit:
                    raise ValueError(f"token id outside 0..{limit}")
                parts.append(np.concatenate((head, ids)) if len(head) else ids)
            columns = list(batch.columns)
            columns[column] = _ids_array(parts)
            names = list(batch.schema.names)
            names[column] = out
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, _replace(df.schema, text, T.StructField(out, IDS)))


def decode_column(df: DataFrame, ids: str = "tokens", out: str = "text", *, vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """Replace an id column by its text."""
    ship_package(df.sparkSession)
    column = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in small_batches(batches, lambda b: 4 * list_sizes(b.column(column))):
            texts = [None if v is None else enc.decode(v) for v in batch.column(column).to_pylist()]
            columns = list(batch.columns)
            columns[column] = pa.array(texts, type=pa.string())
            names = list(batch.schema.names)
            names[column] = out
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, _replace(df.schema, ids, T.StructField(out, T.StringType())))
