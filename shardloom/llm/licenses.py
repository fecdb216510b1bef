"""License notices found by an exact set-similarity join of text blocks with templates.

A block is ``BLOCK`` words of a document, one every ``STRIDE``, so that any stretch of
``BLOCK - STRIDE`` words lies whole in a block. A template of m distinct words is found in a block
that holds at least ``ceil(threshold * m)`` of them. All sets are ordered by how many documents of the
corpus hold a word, rarest first, and cut to the templates' vocabulary, which loses no overlap:

* prefix filter: of the m words, the first ``m - needed + 1`` must meet the block's first
  ``b - needed + 1``;
* length filter: a block needs ``needed`` words of the vocabulary;
* positional filter: what follows the first common word on both sides must suffice.

Blocks that pass are verified by the whole intersection. Everything is native; only words of the
templates' prefixes are exploded, and only blocks that hold one are cut out of a text at all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import UPPER, ascii_lower, bounded, text_or_empty
from shardloom.session import materialize

BLOCK, STRIDE = 96, 32
THRESHOLD = 0.9
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 16 << 20

# Phrases that name a license by themselves.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices and characteristic sentences of public licenses, lower-cased.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
        "apache org licenses license 2 0",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
    ),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "made available under the terms of the eclipse public license 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
]


def words(text: Column) -> Column:
    """Runs of 0-9, a-z and all characters beyond ASCII, after lowering A-Z. Null has none."""
    return F.filter(F.split(ascii_lower(text_or_empty(text)), GAPS), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(GAPS, text.translate(str.maketrans(UPPER, UPPER.lower()))) if w]


def needed(size: int, threshold: float) -> int:
    """Common words a set of ``size`` words must have; one at least."""
    return max(1, math.ceil(round(threshold * size, 9)))


def places(found: Column, phrase: Sequence[str]) -> Column:
    """Positions from 0 at which the words of ``phrase`` stand one after the other."""
    starts = F.filter(F.transform(found, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull())

    def follows(i: Column) -> Column:
        same = F.lit(True)
        for n, word in enumerate(phrase[1:], 1):
            same = same & F.coalesce(F.get(found, i + n) == word, F.lit(False))
        return same

    return F.when(F.array_contains(found, phrase[-1]), F.filter(starts, follows)).otherwise(F.array().cast("array<int>"))


def frequency_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """``vocabulary`` by the number of documents that hold a word, rarest first. As many rows as the
    templates have words reach the driver."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    held = docs.select(F.explode(F.array_intersect(words(F.col("text")), known)).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def prefix_index(sets: list[set[str]], order: list[str], threshold: float) -> list[tuple]:
    """(word, template, place, size, needed, members) for the words of every template's prefix."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for t, members in enumerate(sets):
        ordered = sorted(members, key=rank.__getitem__)
        least = needed(len(ordered), threshold)
        rows += [(w, t, i, len(ordered), least, ordered) for i, w in enumerate(ordered[: len(ordered) - least + 1])]
    return rows


def document_blocks(docs: DataFrame, order: list[str], prefixes: list[str], least: int, phrases: Mapping[str, str]) -> DataFrame:
    """_row, doc_id, n_words, n_base, first_word, last_word, base_labels, blocks; written.

    ``blocks`` are (block, set) of the blocks that hold a word of a prefix and ``least`` words of the
    vocabulary, their sets in the order of ``order``. ``_row`` tells all rows apart.
    """
    listed = lambda names: F.array(*[F.lit(n) for n in names])
    spots = {f"_places{i}": phrase.split() for i, phrase in enumerate(phrases)}
    rows = docs.select("doc_id", words(F.col("text")).alias("_words"))
    rows = rows.select("doc_id", "_words", *[places(F.col("_words"), p).alias(n) for n, p in spots.items()])

    def cut(b: Column) -> Column:
        own = F.slice("_words", (b * STRIDE + 1).cast("int"), F.lit(BLOCK))
        return F.struct(b.cast("int").alias("block"), F.array_intersect(listed(order), own).alias("set"))

    last = F.expr(f"greatest(size(_words) - {BLOCK - STRIDE}, 0) div {STRIDE}")
    useful = lambda b: (F.size(b["set"]) >= least) & F.arrays_overlap(b["set"], listed(prefixes))
    none = F.array().cast("array<struct<block:int,set:array<string>>>")
    blocks = F.when(
        F.arrays_overlap("_words", listed(prefixes)), F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), last), cut), useful)
    ).otherwise(none)
    every = F.concat(*[F.col(n) for n in spots]) if spots else F.array().cast("array<int>")
    named = [F.when(F.size(n) > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for n, label in zip(spots, phrases.values())]
    return materialize(
        rows.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            F.size("_words").cast("bigint").alias("n_words"),
            F.size(every).cast("bigint").alias("n_base"),
            F.array_min(every).cast("bigint").alias("first_word"),
            F.array_max(every).cast("bigint").alias("last_word"),
            (F.concat(*named) if named else F.array().cast("array<string>")).alias("base_labels"),
            blocks.alias("blocks"),
        ),
        "license-blocks",
    )


def matched_blocks(rows: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """_row, block, template, containment of every block and template that meet the threshold."""
    blocks = rows.where(F.size("blocks") > 0).select("_row", F.inline("blocks"))
    probes = blocks.select(
        "_row", "block", "set", F.posexplode(F.slice("set", F.lit(1), F.size("set") - least + 1)).alias("_at", "word")
    )
    size = F.size("set")
    passes = (
        (size >= F.col("needed"))
        & (F.col("_at") <= size - F.col("needed"))
        & (F.least(F.col("size") - F.col("place"), size - F.col("_at")) >= F.col("needed"))  # this word and all behind it
    )
    common = F.size(F.array_intersect("set", "members"))
    return (
        probes.join(index, "word")
        .where(passes)
        .select("_row", "block", "template", "needed", "size", common.alias("_common"))
        .where("_common >= needed")
        .select("_row", "block", "template", (F.col("_common") / F.col("size")).alias("containment"))
        .distinct()
    )


def specific(hits: DataFrame, sets: list[set[str]]) -> DataFrame:
    """``hits`` without the templates whose words are all in another template found in the same block:
    a notice with a further term is that license, not the one without the term."""
    wider = [[o for o, other in enumerate(sets) if members < other] for members in sets]
    table = F.array(*[F.array(*[F.lit(o) for o in row]).cast("array<int>") for row in wider])
    grouped = hits.groupBy("_row", "block").agg(F.collect_list(F.struct("template", "containment")).alias("_found"))  # templates at most
    alone = F.filter("_found", lambda h: ~F.arrays_overlap(F.get(table, h["template"]), F.col("_found.template")))
    return grouped.select("_row", "block", F.inline(alone))


def prepared(docs: DataFrame, templates: Sequence[tuple[str, str]], threshold: float, phrases: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    sets = [set(template_words(text)) for _, text in templates]
    if not all(sets):
        raise ValueError("a template has no words")
    if any(len(template_words(text)) > BLOCK - STRIDE for _, text in templates):
        raise ValueError(f"a template has more than {BLOCK - STRIDE} words and may not lie in one block")
    order = frequency_order(docs, sorted(set().union(*sets)))
    index = prefix_index(sets, order, threshold)
    least = min(row[4] for row in index)
    rows = document_blocks(docs, order, sorted({row[0] for row in index}), least, phrases)
    schema = "word string, template int, place int, size int, needed int, members array<string>"
    index = bounded(docs.sparkSession.createDataFrame(index, schema), "license-index", BROADCAST_BYTES, 2000)
    return rows, specific(matched_blocks(rows, index, least), sets)


def license_blocks(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, first_word, n_block_words, label, template (its number) and containment of every block
    of every document that holds a template."""
    rows, hits = prepared(docs, templates, threshold, {})
    label = F.get(F.array(*[F.lit(name) for name, _ in templates]), F.col("template"))
    first = F.col("block") * STRIDE
    found = hits.join(rows.select("_row", "doc_id", "n_words"), "_row")
    return found.select(
        "doc_id",
        first.cast("bigint").alias("first_word"),
        F.least(F.lit(BLOCK), F.col("n_words") - first).alias("n_block_words"),
        label.alias("label"),
        "template",
        "containment",
    )


def licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    phrases: Mapping[str, str] = PHRASES,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are their smallest and
    largest start (null without one). ``labels`` adds those of the templates held by a block; both are
    sorted arrays. ``score`` is 1 where a phrase stands, else the greatest containment found, else 0.
    Null and empty texts have no words, no labels and score 0. Rows are told apart whatever their ids:
    repeated rows come back as often as they are. Other columns are left out; no rows give no rows.
    """
    rows, hits = prepared(docs, templates, threshold, phrases)
    label = F.get(F.array(*[F.lit(name) for name, _ in templates]), F.col("template"))
    found = hits.groupBy("_row").agg(F.collect_set(label).alias("_labels"), F.max("containment").alias("_score"))
    found = bounded(found, "license-found", BROADCAST_BYTES, 200)
    own = F.array_sort(F.array_distinct("base_labels"))
    none = F.array().cast("array<string>")
    return rows.drop("blocks").join(found, "_row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        own.alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("_labels", none)))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
