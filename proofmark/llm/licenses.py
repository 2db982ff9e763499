"""License notices in texts: an exact set-similarity join of text blocks with templates, in DataFrame functions alone.

A template is a set of words, and a block a stretch of a text's words.  A block
meets a template if it holds at least ``threshold`` of the template's words.
Blocks are twice as wide as the template (rounded up to a power of two) and begin
a width apart, so any stretch as long as the template lies whole in one of them.

The words of all templates are put in order of the number of documents that
hold them, rarest first.  Three filters lose no pair that meets the threshold
(``need`` words in common):

* prefix: a template and a block share one of the template's first
  ``size - need + 1`` words and one of the block's first ``size - need + 1``;
* length: the block holds at least ``need`` words of the templates;
* position: behind a first common word, both have words enough to reach ``need``.

The join is by prefix word.  What passes is verified by counting common words.

Besides, phrases are looked for word by word (the base).  Labels name families of
licenses: templates of one family have one label.

Words are runs of digits, letters and non-ASCII characters, A-Z in lower case.
Defined results: a null text counts as empty and has no words; a text without
license has empty labels, score 0 and null places; null and repeated ids change
nothing, each row has its result; columns other than ``doc_id`` and ``text`` are left
out; no rows give no rows.  To the driver comes one count for each word of the
templates (at most ``MOST_WORDS``, checked).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Share of a template's words that a block holds at least.
THRESHOLD = 0.8
#: Words of all templates together, at most: they and the index of prefixes are sent to all tasks.
MOST_WORDS = 65_536

# Phrases with their labels, and public notices by which licenses are known.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BREAKS), "")


def words_of(text: str) -> list[str]:
    """``words`` of one text, here."""
    return [w for w in re.split(BREAKS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def width_of(template: str) -> int:
    """Words that a template stretches over, rounded up to a power of two; its blocks are twice as wide."""
    return 1 << max(3, (len(words_of(template)) - 1).bit_length())


def need_of(size: int, threshold: float) -> int:
    """Words in common that a template of so many different words needs, at least one."""
    return max(1, math.ceil(threshold * size - 1e-9))


def n_blocks(n: Column, width: int) -> Column:
    """Blocks of a text of n words; the last one holds its end."""
    return F.greatest(F.lit(1), F.ceil(n / width) - 1).cast("int")


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def order_of(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The words by the number of documents that hold them, rarest first, then as strings."""
    held = docs.select(F.explode(F.array_intersect(words(F.col("text")), _array(vocabulary))).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def blocks(docs: DataFrame, order: list[str], needs: dict[int, int]) -> DataFrame:
    """Blocks of texts that hold a word of ``order``: ``width``, ``block`` (their number), and ``held``, the words of ``order`` in them, in its order.

    ``needs`` gives the widths, and the words in common that a template of that width needs at least.
    """
    kinds = F.array(*(F.struct(F.lit(w).alias("width"), F.lit(n).alias("need"), n_blocks(F.size("words"), w).alias("n")) for w, n in sorted(needs.items())))
    every = docs.withColumn("kind", F.explode(kinds)).select("*", "kind.width", "kind.need", F.explode(F.sequence(F.lit(0), F.col("kind.n") - 1)).alias("block"))
    held = F.array_intersect(_array(order), F.slice("words", F.col("block") * F.col("width") + 1, 2 * F.col("width")))
    return every.withColumn("held", held).where(F.size("held") >= F.col("need")).drop("words", "kind")


def matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` but ``text``, with ``template`` (its number), ``label``, ``width``, ``block`` and ``score`` (the share of the template's words held) of every block that meets a template.

    A pair of block and template may occur several times, once for each prefix word in common.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    sets = [set(words_of(t)) for _, t in templates]
    if not sets or not all(sets):
        raise ValueError("every template has words")
    vocabulary = sorted(set().union(*sets))
    if sum(map(len, sets)) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words; split them")
    order = order_of(docs, vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    rows, prefixes, needs = [], set(), {}
    for k, ((label, text), held) in enumerate(zip(templates, sets, strict=True)):
        held, need, width = sorted(held, key=rank.__getitem__), need_of(len(held), threshold), width_of(text)
        needs[width] = min(need, needs.get(width, need))
        prefixes.update(held[: len(held) - need + 1])
        rows.append(F.struct(F.lit(width).alias("width"), F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(need).alias("least"), _array(held).alias("all")))
    known = docs.sparkSession.range(1).select(F.inline(F.array(*rows))).withColumn("size", F.size("all"))
    index = known.select("*", F.posexplode(F.slice("all", F.lit(1), F.col("size") - F.col("least") + 1)).alias("i", "word")).withColumn("i", F.col("i") + 1)
    # Texts without any prefix word have no blocks to look at.
    texts = docs.withColumn("words", words(F.col("text"))).drop("text").where(F.arrays_overlap("words", _array(sorted(prefixes))))
    every = blocks(texts, order, needs)
    n = F.size("held")
    first = every.select("*", F.posexplode(F.slice("held", F.lit(1), n - F.col("need") + 1)).alias("j", "word")).withColumn("j", F.col("j") + 1)
    # Sent to all tasks: its size is that of the templates, checked above.
    pairs = first.join(F.broadcast(index), ["word", "width"])
    pairs = pairs.where((n >= F.col("least")) & (F.col("j") <= n - F.col("least") + 1))
    pairs = pairs.where(1 + F.least(F.col("size") - F.col("i"), n - F.col("j")) >= F.col("least"))
    common_words = F.size(F.array_intersect("held", "all"))
    return pairs.where(common_words >= F.col("least")).select(*[c for c in docs.columns if c != "text"], "template", "label", "width", "block", (common_words / F.col("size")).alias("score"))


def _places(at: Column, phrase: list[str]) -> Column:
    """The places, from 0, at which the words of a phrase stand one after another; looked for where its first two words occur."""
    found = F.filter(F.sequence(F.lit(0), F.size(at) - len(phrase)), lambda i: _all([F.get(at, i + k) == w for k, w in enumerate(phrase)]))
    there = (F.size(at) >= len(phrase)) & _all([F.array_contains(at, w) for w in phrase])
    return F.when(there, found).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def phrases(docs: DataFrame, wanted: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """All columns but ``text``, with ``n_words``, ``places`` (the first word of every place) and ``base_labels`` (sorted) by phrases."""
    found = docs.withColumn("words", words(F.col("text"))).drop("text")
    each = found.select(*found.columns, F.array(*(F.struct(F.lit(label).alias("label"), _places(F.col("words"), words_of(p)).alias("places")) for p, label in wanted)).alias("each"))
    labels = F.array_sort(F.array_distinct(F.transform(F.filter("each", lambda e: F.size(e["places"]) > 0), lambda e: e["label"])))
    return each.select(*[c for c in found.columns if c != "words"], F.size("words").cast("long").alias("n_words"), F.array_sort(F.flatten(F.transform("each", lambda e: e["places"]))).alias("places"), labels.alias("base_labels"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, wanted: tuple[tuple[str, str], ...] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``places``, ``base_labels``, ``labels`` (those of templates too) and ``score``.

    The score is 1 where a phrase stands, else the greatest share of a template's words in a block that meets it, else 0.
    """
    # Rows of one id and one text have one result, so these two name a row.
    texts = common.texts_of(docs).withColumn("digest", F.sha2("text", 256))
    met = matches(texts, templates, threshold).groupBy("doc_id", "digest").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    met = met.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), "more", "best")
    both = phrases(texts, wanted).join(met, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select("doc_id", "n_words", "places", "base_labels", labels.alias("labels"), score.alias("score"))
