"""Scanning texts for licenses by an exact set-similarity join (operator 13).

Every text is cut into overlapping blocks of words; a block meets a template if
it holds at least ``THRESHOLD`` per cent of the template's distinct words. The
words of all templates are put in one order, rarest in the blocks first. A pair
that meets the threshold shares a word among the first ones of the template
(prefix), the block has enough words (length), and enough words follow on both
sides (position); pairs that pass are counted out in full. The filters lose no
pair, so the result equals that of comparing every block with every template.

Built of DataFrame operations only. Words outside all templates can't add to an
overlap and are left out of blocks at the scan, so what is joined is small, and
the join itself is with the templates, whose size doesn't grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.llm.common import Scratch, table, text_or_empty

THRESHOLD = 80  #: per cent of a template's distinct words
STEP = 128  #: words between blocks, and the most that a template may have; a block has twice as many
BROADCAST_WORDS = 1 << 16  #: words of all templates, up to which they are broadcast

# The phrases of the contract with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of public licenses as their authors word them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
)


def template_words(text: str) -> list[str]:
    """The words of a template, which has to be of ASCII."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    if not text.isascii() or not 0 < len(words) <= STEP:
        raise ValueError(f"a template has 1 to {STEP} words of ASCII letters and digits")
    return words


def needed(size: int, threshold: int) -> int:
    """The least number of a template's ``size`` distinct words that makes ``threshold`` per cent."""
    return -(-threshold * size // 100)


def spaced(text: Column) -> Column:
    """The words of ``text`` with one space between them; runs of signs beyond ASCII are one such sign each."""
    ascii_only = F.lower(F.regexp_replace(text, r"[^\x00-\x7F]+", "中"))
    return F.btrim(F.regexp_replace(ascii_only, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _base(line: Column, phrases: dict[str, str]) -> dict[str, Column]:
    """Places of the phrases in ``line``, words with a space before and behind each."""
    count, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in phrases.items():
        sought = f" {phrase} "
        there = F.contains(line, F.lit(sought))
        count = count + F.when(there, F.regexp_count(line, F.lit(f"(?={sought})"))).otherwise(0)
        firsts.append(F.when(there, F.instr(line, sought)))
        lasts.append(F.when(there, F.length(line) - F.instr(F.reverse(line), sought[::-1]) - len(sought) + 2))
        labels.append(F.when(there, F.lit(label)))
    nowhere = F.lit(None).cast("int")
    return {
        "n_base": count,
        "first_word": _spaces(F.substring(line, F.lit(1), F.least(nowhere, nowhere, *firsts) - 1)),
        "last_word": _spaces(F.substring(line, F.lit(1), F.greatest(nowhere, nowhere, *lasts) - 1)),
        "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels) if labels else F.array().cast("array<string>")))),
    }


def scanned(docs: DataFrame, templates, phrases, threshold: int) -> DataFrame:
    """row, doc_id, n_words, n_base, first_word, last_word, base and blocks (first word, and the template words in it) of each text."""
    sets = [set(template_words(t)) for _, t in templates]
    every = F.array(*map(F.lit, sorted(set().union(*sets)))) if sets else F.array().cast("array<string>")
    least = min((needed(len(s), threshold) for s in sets), default=1)
    words = docs.select(F.col("doc_id"), spaced(text_or_empty()).alias("line"))
    n_words = F.when(F.col("line") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("line")) + 1)
    framed = words.select("doc_id", n_words.alias("n_words"), F.concat(F.lit(" "), "line", F.lit(" ")).alias("framed"), F.split("line", " ").alias("words"))
    base = _base(F.col("framed"), phrases)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("n_words") - STEP - 1), F.lit(STEP).cast("long"))
    blocks = F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_intersect(every, F.slice("words", (s + 1).cast("int"), 2 * STEP)).alias("tokens")))
    return framed.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", *(c.alias(n) for n, c in base.items()), F.filter(blocks, lambda b: F.size(b["tokens"]) >= least).alias("blocks"))


def met(scan: DataFrame, templates, threshold: int) -> DataFrame:
    """row, start, template, label, containment: the blocks of ``scan`` that meet a template, by the filtered join."""
    spark = scan.sparkSession
    sets = [set(template_words(t)) for _, t in templates]
    blocks = scan.select("row", F.explode("blocks").alias("block")).select("row", "block.start", "block.tokens")
    counted = dict(blocks.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*")).collect()) if sets else {}
    order = sorted(set().union(*sets), key=lambda w: (counted.get(w, 0), w))
    place = {w: k for k, w in enumerate(order)}
    index, known = [], []
    for no, ((label, _), own) in enumerate(zip(templates, sets, strict=True)):
        tokens, need = sorted(own, key=place.__getitem__), needed(len(own), threshold)
        known.append((no, label, tokens, need))
        index += [(w, no, i, len(tokens), need) for i, w in enumerate(tokens[: len(tokens) - need + 1])]
    small = F.broadcast if len(order) <= BROADCAST_WORDS else (lambda df: df)
    heads = small(spark.createDataFrame(index, "word string, template int, i int, size int, need int"))
    whole = small(spark.createDataFrame(known, "template int, label string, own array<string>, need int"))
    least = min((k[3] for k in known), default=1)
    ordered = blocks.withColumn("tokens", F.array_intersect(F.array(*map(F.lit, order)) if order else F.array().cast("array<string>"), "tokens")).withColumn("n", F.size("tokens"))
    firsts = ordered.select("row", "start", "tokens", "n", F.posexplode(F.slice("tokens", F.lit(1), F.col("n") - least + 1)).alias("j", "word"))
    near = firsts.join(heads, "word").filter((F.col("n") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.col("n") - F.col("j")) >= F.col("need")))
    pairs = near.groupBy("row", "start", "template").agg(F.first("tokens").alias("tokens"))
    overlap = pairs.join(whole, "template").withColumn("overlap", F.size(F.array_intersect("tokens", "own")))
    return overlap.filter(F.col("overlap") >= F.col("need")).select("row", "start", "template", "label", (F.col("overlap") / F.size("own")).alias("containment"))


def _kept_scan(docs: DataFrame, templates, phrases, threshold: int) -> DataFrame:
    return Scratch(docs.sparkSession, "licenses").keep(scanned(docs, templates, phrases, threshold), "scan")


def license_blocks(docs: DataFrame, templates=TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """Each block of a text that meets a template: doc_id, first_word, last_word, template (its number), label, containment.

    Blocks have 256 words and start every 128, so any 128 words in a row lie in
    one. Odd texts as in ``license_labels``.
    """
    scan = _kept_scan(docs, templates, {}, threshold)
    last = F.least(F.col("start") + 2 * STEP, F.col("n_words")) - 1
    return met(scan, templates, threshold).join(scan.select("row", "doc_id", "n_words"), "row").select("doc_id", F.col("start").alias("first_word"), last.alias("last_word"), "template", "label", "containment")


def license_labels(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: int = THRESHOLD) -> DataFrame:
    """The licenses of each text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are lower-cased (A-Z only) runs of letters, digits and signs beyond
    ASCII. ``n_base`` counts all places where a phrase's words stand in a row,
    overlapping ones too; ``labels`` adds those of templates that a block
    meets. ``score`` is 1 with a phrase, else the largest share of a template
    found, else 0. Null and empty texts have no words, empty labels and null
    places; equal rows and ids are rows of their own; an empty table has no
    rows. Other columns aren't read.
    """
    scan = _kept_scan(docs, templates, phrases, threshold)
    found = met(scan, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("share"))
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return scan.drop("blocks").join(found, "row", "left").select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def oracle(templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: int = THRESHOLD) -> str:
    """SQL that compares every block with every template."""
    sought = ", ".join(f"({_listed(p.split())}, '{label}')" for p, label in phrases.items())
    known = ", ".join(f"('{label}', {_listed(sorted(set(template_words(t))))})" for label, t in templates)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), p AS (SELECT * FROM (VALUES {sought}) AS v(phrase, label)
), t AS (SELECT * FROM (VALUES {known}) AS v(label, own)
), b AS (
  SELECT no, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1:i + len(phrase)] = phrase)) AS place FROM d, p
), n AS (
  SELECT no, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY no
), w AS (
  SELECT no, unnest(list_transform(range(0, greatest(1, len(words) - {STEP}), {STEP}), lambda s: list_distinct(words[s + 1:s + {2 * STEP}]))) AS block FROM d
), m AS (
  SELECT no, label, len(list_intersect(block, own)) / len(own)::DOUBLE AS share
  FROM w, t WHERE len(list_intersect(block, own)) * 100 >= {threshold} * len(own)
), f AS (SELECT no, list(DISTINCT label) AS found, max(share) AS share FROM m GROUP BY no)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(list_aggregate(list_sort(base), 'string_agg', ','), '') AS base_labels,
       coalesce(list_aggregate(list_sort(list_distinct(coalesce(base, []) || coalesce(found, []))), 'string_agg', ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN n USING (no) LEFT JOIN f USING (no)
"""


ORACLE = oracle()
