"""License scans by an exact set-similarity join of text blocks with templates.

A template and a block are sets of words. A block meets a template if it holds
at least a given share of the template's words (containment). Words are ordered
by how often they occur in all documents, rarest first, which is counted in a
first pass; only words of templates matter. A block that meets a template of m
words shares at least a = ceil(share * m) of them, so it must hold one of the
template's m - a + 1 rarest words (prefix filter), have a template words at all
(length filter), and after the first shared word enough words must be left on
both sides (positional filter). What passes is counted in full, so every block
that meets a template is found.

Blocks are windows of words. A template of n words is held against windows of 2s
words that begin at every multiple of s, the least power of two that is no less
than n: a passage of up to s + 1 words lies in one of them.

Templates are an argument of bounded size, so the texts stay where they are:
both passes are maps, and all that is shuffled is the counts of template words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .textarrow import ALNUM_LOWER, BLOCK_BYTES, Block, text_blocks, words

#: Share of a template's distinct words that a block must hold.
LEAST = 0.8
#: Words of all templates together, at most; they travel with every task.
MOST_WORDS = 2_000_000

#: Fixed values: (phrase, label) of the base search.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
#: Fixed values: (label, notice), the usual public wordings.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "Copyright. All rights reserved. No part of this publication may be reproduced"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

_EMPTY = np.zeros(0, np.int64)


def _hashes(text: str | None) -> np.ndarray:
    found = [words(b, ALNUM_LOWER).hashes for b in text_blocks(pa.array([text or ""]))]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


class Template(NamedTuple):
    label: str
    step: int  # s: windows are twice as long
    words: list  # distinct words, as numbers in the global order
    need: int


class Index(NamedTuple):
    """What a task needs: the word table in order of hashes, and templates by window size."""

    hashes: np.ndarray  # sorted
    number: np.ndarray  # place of each in the global order, rarest first
    phrases: list  # (label, numbers)
    classes: dict  # step -> (is a number in a prefix, number -> [(template, its place there)])
    templates: list


def _step(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def _need(m: int, least: float) -> int:
    """Words of m that make at least the share; the sum is guarded against the last bit of a float."""
    return max(1, math.ceil(least * m - 1e-9))


def _index(vocabulary: np.ndarray, counts: np.ndarray, templates: Sequence, phrases: Sequence, least: float) -> Index:
    """Number all words by (count, hash) and list the prefixes of each template."""
    number = np.empty(len(vocabulary), np.int64)
    number[np.lexsort((vocabulary, counts))] = np.arange(len(vocabulary))
    place = lambda h: number[np.searchsorted(vocabulary, h)]
    out, classes = [], {}
    for label, text in templates:
        h = _hashes(text)
        if not len(h):
            continue
        own = sorted(set(place(h).tolist()))
        t = Template(label, _step(len(h)), own, _need(len(own), least))
        prefix, lists = classes.setdefault(t.step, (np.zeros(len(vocabulary), bool), {}))
        for j, w in enumerate(own[: len(own) - t.need + 1]):
            prefix[w] = True
            lists.setdefault(w, []).append((len(out), j))
        out.append(t)
    return Index(vocabulary, number, [(label, place(_hashes(p))) for p, label in phrases if len(_hashes(p))], classes, out)


class Found(NamedTuple):
    """Template words of one text: which words they are, and their numbers."""

    at: np.ndarray
    number: np.ndarray
    n_words: int


def _cut(block: Block) -> Iterator[Block]:
    """A long single text in pieces that end between words; others as they are."""
    n = len(block.data)
    if len(block.bounds) != 2 or n <= 2 * BLOCK_BYTES:
        yield block
        return
    a = 0
    while a < n:
        b = min(n, a + BLOCK_BYTES)
        while b < n:  # on to the next separator: a word is never cut
            gap = np.flatnonzero(ALNUM_LOWER[block.data[b : b + 4096]] == 0)
            if len(gap):
                b += int(gap[0])
                break
            b = min(n, b + 4096)
        yield Block(block.first, block.data[a:b], np.array([0, b - a]))
        a = b


def _texts(column, hashes: np.ndarray, number: np.ndarray) -> Iterator[Found]:
    """The template words of each text of a column, in its order."""
    for block in text_blocks(column):
        parts, base = [], 0
        for piece in _cut(block):
            w = words(piece, ALNUM_LOWER)
            k = np.minimum(np.searchsorted(hashes, w.hashes), len(hashes) - 1)
            at = np.flatnonzero(hashes[k] == w.hashes) if len(hashes) else _EMPTY
            if len(block.bounds) != 2:
                cuts, num = np.searchsorted(at, w.bounds), number[k[at]]
                for i in range(len(w.bounds) - 1):
                    s = slice(cuts[i], cuts[i + 1])
                    yield Found(at[s] - w.bounds[i], num[s], int(w.bounds[i + 1] - w.bounds[i]))
            else:
                parts.append((at + base, number[k[at]] if len(at) else _EMPTY))
                base += len(w.hashes)
        if len(block.bounds) == 2:
            yield Found(np.concatenate([p[0] for p in parts] or [_EMPTY]), np.concatenate([p[1] for p in parts] or [_EMPTY]), base)


def _phrase_places(f: Found, ix: Index) -> list:
    """(first word, label) of every place where a phrase's words stand one after the other."""
    out = []
    for label, p in ix.phrases:
        k = np.flatnonzero(f.number[: len(f.number) - len(p) + 1] == p[0]) if len(f.number) >= len(p) else _EMPTY
        for j in range(1, len(p)):
            k = k[(f.number[k + j] == p[j]) & (f.at[k + j] == f.at[k] + j)]
        out += [(int(x), label) for x in f.at[k]]
    return sorted(out)


def _met(f: Found, ix: Index) -> list:
    """(first word of the block, its words, template, share) of every block that meets a template."""
    out = []
    for step, (prefix, lists) in ix.classes.items():
        rare = f.at[prefix[f.number]] // step if len(f.at) else _EMPTY
        for k in np.unique(np.concatenate([rare, rare[rare > 0] - 1])).tolist():
            a, b = np.searchsorted(f.at, (k * step, (k + 2) * step))
            own = sorted(set(f.number[a:b].tolist()))
            seen: set = set()
            for i, w in enumerate(own):
                for t, j in lists.get(w, ()):
                    if t in seen:
                        continue
                    seen.add(t)  # the first shared word decides: nothing before it is shared
                    template = ix.templates[t]
                    if len(own) < template.need or 1 + min(len(own) - 1 - i, len(template.words) - 1 - j) < template.need:
                        continue
                    shared = len(set(own).intersection(template.words))
                    if shared >= template.need:
                        out.append((k * step, min(2 * step, f.n_words - k * step), template.label, shared / len(template.words)))
    return sorted(out)


def _vocabulary(templates: Sequence, phrases: Sequence) -> np.ndarray:
    every = [_hashes(t) for _, t in templates] + [_hashes(p) for p, _ in phrases]
    if sum(map(len, every)) > MOST_WORDS:
        raise ValueError(f"license templates have more than {MOST_WORDS} words; pass them in parts")
    return np.unique(np.concatenate([*every, np.zeros(0, np.uint64)]))


def word_counts(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> np.ndarray:
    """How often each word of a vocabulary (sorted hashes) occurs in all texts; summed in each task before the shuffle."""

    def count(batches):
        n = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for f in _texts(batch.column(0), vocabulary, np.arange(len(vocabulary))):
                n += np.bincount(f.number, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["k", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    # One row for each word of the templates, which are bounded.
    for r in docs.select(text_col).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return out


_OUT = "n_words long, base array<struct<word:long,label:string>>, blocks array<struct<first_word:long,n_words:long,label:string,share:double>>"


def scan_licenses(docs: DataFrame, templates: Sequence = TEMPLATES, phrases: Sequence = PHRASES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Phrases and license templates in each text.

    Returns one row per input row: `id_col`, n_words, base (every place of a
    phrase: number of its first word and label, in order) and blocks (every block
    that meets a template: number of its first word, its words, label and share
    of the template's words, in order). Words are runs of letters, digits and
    characters beyond ASCII, with A-Z lower-cased, and are told by 64-bit hashes.

    Null and empty texts have no words and empty lists; rows that repeat or share
    an identifier are each judged; an empty table gives an empty result; other
    columns are not looked at. A template met in several blocks, or by several
    templates of a label, is listed for each. Templates without words are passed
    over; more than MOST_WORDS words of templates are refused. Long texts are
    read in pieces of a megabyte; what is kept of them is 16 bytes for each word
    that also occurs in a template.
    """
    vocabulary = _vocabulary(templates, phrases)
    ix = _index(vocabulary, word_counts(docs, vocabulary, text_col), templates, phrases, least)

    def scan(batches):
        for batch in batches:
            n, base, blocks = [], [], []
            for f in _texts(batch.column(1), ix.hashes, ix.number):
                n.append(f.n_words)
                base.append([{"word": w, "label": x} for w, x in _phrase_places(f, ix)])
                blocks.append([{"first_word": a, "n_words": m, "label": x, "share": s} for a, m, x, s in _met(f, ix)])
            kinds = (pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, kinds[0]), pa.array(blocks, kinds[1])], names=["_id", "n_words", "base", "blocks"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = rows.mapInArrow(scan, f"_id {rows.schema['_id'].dataType.simpleString()}, {_OUT}")
    return found.withColumnRenamed("_id", id_col)


def op12_license_scans(spark, sf_dir: str) -> DataFrame:
    """License phrases and notices in all of `documents`; the score is 1 where a phrase stands, else the best share of a template that is met, else 0."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.array_max("blocks.share")
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"), joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "blocks.label")).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def _values(rows: Sequence) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
p AS (SELECT label, string_split(phrase, ' ') AS ps FROM (VALUES {_values(PHRASES)}) v(phrase, label)),
base AS (SELECT doc_id, i AS pos, label FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS i FROM d) JOIN p ON ws[i + 1 : i + len(ps)] = ps),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY 1),
t AS (SELECT row_number() OVER () AS t, label, {_WORDS.format("notice")} AS ts FROM (VALUES {_values(TEMPLATES)}) v(label, notice)),
tw AS (SELECT t, label, unnest(list_distinct(ts)) AS word, len(list_distinct(ts)) AS m, CAST(pow(2, ceil(log2(len(ts)))) AS BIGINT) AS s FROM t),
hit AS (SELECT doc_id, t, label, m, w.word, pos // s AS k FROM w JOIN tw USING (word) UNION ALL SELECT doc_id, t, label, m, w.word, pos // s - 1 FROM w JOIN tw USING (word) WHERE pos >= s),
met AS (SELECT doc_id, k, t, label, count(DISTINCT word) / m AS share FROM hit GROUP BY doc_id, k, t, label, m HAVING count(DISTINCT word) >= ceil({LEAST} * m - 1e-9)),
best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY 1),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM met) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN l USING (doc_id)
"""
