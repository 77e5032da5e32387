"""License scans: license phrases, and an exact set-similarity join of text blocks with license templates.

The words of a document are cut into overlapping blocks, so that every run of as
many words as a template has lies whole in one block of the template's width.  A
block meets a template if it holds at least CONTAINMENT of the template's
distinct words.  Words are ordered by the number of blocks that hold them,
rarest first: a block and a template that meet share a word among the first few
of both (prefix filter), the block has enough words (length filter), and enough
words follow the shared one in both (positional filter).  What passes is
verified on the whole sets.  No pair is missed, whatever the frequencies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import Workspace

CONTAINMENT = 0.9

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: What public licenses ask to be put into files, with labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
]

#: Bytes of a word: a-z, 0-9 and all of other scripts.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass(frozen=True)
class Template:
    """One template: its distinct words as numbers of the vocabulary, the least overlap, the width of blocks it is compared with."""

    label: str
    words: tuple[int, ...]
    least: int
    width: int


def least_overlap(n: int, containment: float) -> int:
    """The smallest whole number of words that is at least the share of n."""
    return max(1, -int(-round(containment * n, 9) // 1))


def prepare(templates: list[tuple[str, str]], containment: float = CONTAINMENT) -> tuple[list[str], list[Template]]:
    """(vocabulary, templates).  A block is as wide as the power of two at or above twice the template's words, 16 at least."""
    split = [(label, text.split()) for label, text in templates]
    vocabulary = sorted({w for _, words in split for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    return vocabulary, [Template(label, tuple(sorted({number[w] for w in words})), least_overlap(len(set(words)), containment), max(16, 1 << (2 * len(words) - 1).bit_length())) for label, words in split]


def _numbers(words: textscan.Words, known: textscan.Words) -> tuple[np.ndarray, np.ndarray]:
    """(places of the words that are known, their numbers), compared byte by byte; known has each word once."""
    if not len(words.start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # the first eight bytes leave few words
    (_, _, begin), *_ = known._chunks()
    first = np.zeros(len(words.start), np.uint64)
    for who, _, eight in words._chunks():
        first[who] = eight
        break
    begin = np.unique(begin)
    at = np.flatnonzero(begin[np.minimum(np.searchsorted(begin, first), len(begin) - 1)] == first)
    some = textscan.Words(words.data, words.start[at], words.end[at], np.array([0, len(at)]), words.text_start)
    h = known.hashes()
    order = np.argsort(h)
    number = order[np.minimum(np.searchsorted(h[order], some.hashes()), len(h) - 1)]
    same = (some.end - some.start) == (known.end - known.start)[number]
    chunks = []
    for who, _, eight in known._chunks():
        chunks.append(np.zeros(len(h), np.uint64))
        chunks[-1][who] = eight
    for k, (who, _, eight) in enumerate(some._chunks()):
        same[who] &= chunks[k][number[who]] == eight if k < len(chunks) else False
    return at[same], number[same]


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())


def _scan(vocabulary: list[str], templates: list[Template], phrases: dict[str, str]):
    """Rows of texts (doc_id, text) to (doc_id, n_words, n_base, first_word, last_word, base_labels, blocks)."""
    listed = [*vocabulary, *sorted({w for p in phrases for w in p.split()} - set(vocabulary))]
    number = {w: i for i, w in enumerate(listed)}
    known = textscan.scan([w.encode() for w in listed], table=_WORD)
    sought = [([number[w] for w in p.split()], label) for p, label in phrases.items()]
    labels = sorted(set(phrases.values()))
    widths = sorted({t.width for t in templates})
    least = {w: min(t.least for t in templates if t.width == w) for w in widths}
    used = {w: np.isin(np.arange(len(listed)), [x for t in templates if t.width == w for x in t.words]) for w in widths}

    def one(ids, raw):
        words = textscan.scan(raw, lower=True, table=_WORD)
        at, code = _numbers(words, known)
        owner = np.searchsorted(words.first, at, side="right") - 1
        place = at - words.first[owner]
        # phrases
        n, base = len(raw), np.zeros(len(raw), np.int64)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        has = np.zeros((n, len(labels)), bool)
        for sequence, label in sought:
            m = len(sequence)
            if len(at) < m:
                continue
            here = np.ones(len(at) - m + 1, bool)
            for k, x in enumerate(sequence):
                end = len(at) - m + 1 + k
                here &= (code[k:end] == x) & (at[k:end] == at[: len(here)] + k) & (owner[k:end] == owner[: len(here)])
            o, p = owner[: len(here)][here], place[: len(here)][here]
            base += np.bincount(o, minlength=n)
            np.minimum.at(low, o, p)
            np.maximum.at(high, o, p)
            has[o, labels.index(label)] = True
        found = high >= 0
        # blocks: every word is in two, which start half a width apart
        parts = []
        for width in widths:
            mine = used[width][code]
            o, q, c = owner[mine], place[mine] // (width // 2), code[mine]
            o, q, c = np.concatenate([o, o]), np.concatenate([q, q - 1]), np.concatenate([c, c])
            keep = q >= 0
            o, q, c = o[keep], q[keep], c[keep]
            order = np.lexsort((c, q, o))
            o, q, c = o[order], q[order], c[order]
            new = np.ones(len(o), bool)
            new[1:] = (o[1:] != o[:-1]) | (q[1:] != q[:-1]) | (c[1:] != c[:-1])
            o, q, c = o[new], q[new], c[new]
            head = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (q[1:] != q[:-1])))) if len(o) else np.empty(0, np.int64)
            size = np.diff(np.concatenate((head, [len(o)])))
            enough = size >= least[width]
            parts.append((o[head][enough], np.full(enough.sum(), width), q[head][enough], size[enough], c[np.repeat(enough, size)]))
        o, width, q, size, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(o, kind="stable")
        begin = np.concatenate(([0], np.cumsum(size)))
        c = c[np.repeat(begin[:-1][order] - np.concatenate(([0], np.cumsum(size[order])))[:-1], size[order]) + np.arange(len(c))]
        tokens = pa.ListArray.from_arrays(_offsets(size[order]), pa.array(c.astype(np.int32)))
        rows = pa.StructArray.from_arrays([pa.array(width[order].astype(np.int32)), pa.array(q[order].astype(np.int64)), tokens], ["width", "block", "words"])
        blocks = pa.ListArray.from_arrays(_offsets(np.bincount(o, minlength=n)), rows)
        base_labels = pa.ListArray.from_arrays(_offsets(has.sum(1)), pa.array(np.array(labels)[np.nonzero(has)[1]], pa.string()))
        none = ~found
        return [ids, pa.array(words.counts), pa.array(base), pa.array(low, mask=none), pa.array(high, mask=none), base_labels, blocks]

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"]

    def run(batches):
        for batch in batches:
            for first, raw in textscan.blocks(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(one(batch.column(0).slice(first, len(raw)), raw), names)

    return run


def find(blocks: DataFrame, vocabulary: list[str], templates: list[Template]) -> DataFrame:
    """(row, width, block, template, label, overlap, containment) of every block of `blocks` (row, width, block, words) that meets a template.

    The vocabulary and the templates are parameters; the order of the vocabulary
    and the templates' words are small tables whose size they bound.
    """
    spark = blocks.sparkSession
    counted = blocks.select(F.explode("words").alias("word")).groupBy("word").count()
    seen = {r.word: r["count"] for r in counted.collect()}  # at most one row for each word of the vocabulary
    order = sorted(range(len(vocabulary)), key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    ranks = F.array(*[F.lit(rank[w]) for w in range(len(vocabulary))])
    sets = [sorted(rank[w] for w in t.words) for t in templates]
    prefix = [(t.width, r, k, i, len(s), t.least, t.label, s) for k, (t, s) in enumerate(zip(templates, sets, strict=True)) for i, r in enumerate(s) if i <= len(s) - t.least]
    rare = spark.createDataFrame(prefix, "width int, rank int, template int, i int, size int, least int, label string, whole array<int>")
    fewest = F.create_map(*[F.lit(x) for w in sorted({t.width for t in templates}) for x in (w, min(t.least for t in templates if t.width == w))])
    ordered = blocks.withColumn("ranks", F.array_sort(F.transform("words", lambda w: F.element_at(ranks, w + 1)))).drop("words")
    # a block's own prefix: as many words as may be missing from the smallest overlap asked for, and one more
    heads = ordered.withColumn("n", F.size("ranks")).select("*", F.posexplode(F.slice("ranks", F.lit(1), F.greatest(F.lit(0), F.col("n") - fewest[F.col("width")] + 1))).alias("j", "rank"))
    left = F.least(F.col("size") - F.col("i"), F.col("n") - F.col("j"))
    pairs = heads.join(F.broadcast(rare), ["width", "rank"]).where((F.col("n") >= F.col("least")) & (F.col("j") <= F.col("n") - F.col("least")) & (left >= F.col("least")))
    both = pairs.withColumn("shared", F.array_intersect("ranks", "whole")).where(F.size("shared") >= F.col("least"))
    # a pair that shares several words of its prefixes is kept at the first
    both = both.where(F.col("shared")[0] == F.col("rank"))
    overlap = F.size("shared")
    return both.select("row", "width", "block", "template", "label", overlap.alias("overlap"), (overlap / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    Words are runs of a-z, 0-9 and other scripts' bytes after lower-casing A-Z.
    A phrase counts at every place where its words stand next to one another;
    places are word numbers from 0, null without any.  labels has the phrases'
    labels and those of all templates that a block meets.  score is 1 with a
    phrase, else the largest share of a template's words that a block which
    meets it holds, else 0.  Null and empty texts have no words, no labels and
    score 0.  Rows of one id are separate rows, null ids stay null, other
    columns are ignored, and an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases
    vocabulary, prepared = prepare(TEMPLATES if templates is None else templates, containment)
    kind = dict(docs.dtypes)[id_col]
    scanned = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _scan(vocabulary, prepared, phrases), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<width: int, block: long, words: array<int>>>"
    )
    rows = ws.save(scanned.withColumn("row", F.monotonically_increasing_id()), "rows")
    blocks = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    met = find(blocks, vocabulary, prepared).groupBy("row").agg(F.collect_set("label").alias("met"), F.max("containment").alias("best"))
    out = rows.drop("blocks").join(met, "row", "left")
    join = lambda c: F.array_join(F.array_sort(c), ",")
    every = F.array_union("base", F.coalesce("met", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", join("base").alias("base_labels"), join(every).alias("labels"), score.alias("score"))
