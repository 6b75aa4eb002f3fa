"""License scans: phrase places, and an exact set-similarity join of text blocks with license templates.

A block is a run of words, wherever lines and paragraphs end, of at most STRETCH times a template's length; it meets
the template if it holds CONTAINMENT of the template's distinct words. The words of all templates are ordered by how
many documents hold them, rarest first. A block that meets a template must hold one of the template's first
size - needed + 1 words (prefix filter). Around each such word, the words in reach must be `needed` at least (length
filter), and so must both what is left of the template from that word on and what the reach holds of the ordered
words from that word on (positional filter). What passes is counted exactly, block by block. The template side is a
list of a few hundred words, so it stands in the expression, and text is neither exploded nor shuffled. Only
DataFrame functions are used.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINMENT, STRETCH = 0.9, 1.5
#: Fixed phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label and wording of public license notices.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("gpl", "Licensed under the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl", "Distributed under the Boost Software License, Version 1.0"),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("cc0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words(low: Column) -> Column:
    return F.array_remove(F.split(low, _BREAK), "")


def places(words: Column, phrase: list[str]) -> Column:
    """The numbers, from 0, of the words at which the phrase's words begin to stand consecutively."""
    at = lambda i: F.get(words, i) == phrase[0]
    whole = lambda i: at(i) if len(phrase) == 1 else at(i) & F.reduce(F.array(*[F.get(words, i + k) == w for k, w in enumerate(phrase[1:], 1)]), F.lit(True), lambda a, b: a & F.coalesce(b, F.lit(False)))
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - len(phrase), F.lit(0))), whole)


@dataclass(frozen=True)
class Template:
    """A template in the order of document frequency: its distinct words, how many a block needs, a block's length."""

    label: str
    ordered: tuple[str, ...]
    needed: int
    reach: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.ordered[: len(self.ordered) - self.needed + 1]


def _template_words(text: str) -> list[str]:
    fold = str.maketrans({c: " " for c in map(chr, range(128)) if not (c.isdigit() or c.islower())})
    return text.lower().translate(fold).split()


def ordered_templates(rows: DataFrame, words_column: str, templates: list[tuple[str, str]]) -> tuple[list[str], list[Template]]:
    """All templates' words by document frequency, rarest first (then by name), and the templates in that order.

    Documents are counted by Spark; a row for each word of the templates comes to the driver."""
    split = [(label, _template_words(text)) for label, text in templates]
    vocabulary = sorted({w for _, own in split for w in own})
    if not vocabulary:
        return [], []
    held = rows.select(F.explode(F.array_intersect(words_column, F.array(*map(F.lit, vocabulary)))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    vocabulary.sort(key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(vocabulary)}
    made = [(label, tuple(sorted(set(own), key=rank.__getitem__)), math.ceil(STRETCH * len(own))) for label, own in split]
    return vocabulary, [Template(label, own, math.ceil(CONTAINMENT * len(own) - 1e-9), reach) for label, own, reach in made]


def _texts(values: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def prefix_words(words: Column, templates: list[Template]) -> Column:
    """The words of any template's prefix that a document holds."""
    return F.array_intersect(words, _texts(sorted({w for t in templates for w in t.prefix})))


def matches(words: Column, held: Column, vocabulary: list[str], templates: list[Template]) -> Column:
    """The blocks of a document's words that meet a template: an array of (template, label, anchor, first, last, share).

    For each place of a prefix word (the anchor) the block around it, of those in which no rarer word of the template
    counts, that holds most of the template's words from the anchor's on; of equals the shortest, then the last to begin.
    first and last are the block's first and last word of the template. A block that meets a template holds an anchor, its rarest shared
    word, so none is missed. held: a column with prefix_words(); as a column it is worked out once for a document.
    """
    none = F.array().cast("array<struct<template:int,label:string,anchor:int,first:int,last:int,share:double>>")
    if not templates:
        return none
    rank = {w: k for k, w in enumerate(vocabulary)}
    pairs = [(word, place, k, t) for k, t in enumerate(templates) for place, word in enumerate(t.prefix)]
    side = F.array(*[  # a row for each prefix word of each template
        F.struct(F.lit(w).alias("word"), F.lit(place).alias("place"), F.lit(rank[w]).alias("rank"), F.lit(k).alias("template"), F.lit(t.label).alias("label"), F.lit(len(t.ordered)).alias("size"), F.lit(t.needed).alias("needed"), F.lit(t.reach).alias("reach"), _texts(t.ordered[place:]).alias("rest"))
        for w, place, k, t in pairs
    ])
    order = _texts(vocabulary)
    places = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains(held, x["word"]))
    joined = F.flatten(F.transform(places, lambda x: F.transform(F.filter(side, lambda t: t["word"] == x["word"]), lambda t: F.struct(x["at"].alias("at"), t.alias("t")))))

    def around(c: Column) -> Column:
        low = F.greatest(c["at"] - c["t"]["reach"] + 1, F.lit(0))
        return F.struct(c["at"].alias("at"), c["t"].alias("t"), low.alias("low"), F.slice(words, low + 1, c["at"] - low + c["t"]["reach"]).alias("near"))

    def may_meet(c: Column) -> Column:
        t = c["t"]
        long_enough = F.size(c["near"]) >= t["needed"]
        from_here = F.size(F.array_intersect(c["near"], F.slice(order, t["rank"] + 1, len(vocabulary))))
        return long_enough & (F.least(t["size"] - t["place"], from_here) >= t["needed"])

    def with_hits(c: Column) -> Column:
        hits = F.filter(F.transform(c["near"], lambda w, i: F.struct((c["low"] + i).alias("at"), w.alias("word"))), lambda h: F.array_contains(c["t"]["rest"], h["word"]))
        return F.struct(c["at"].alias("at"), c["t"].alias("t"), hits.alias("hits"))

    def best(c: Column) -> Column:
        def block(start: Column) -> Column:
            inside = F.filter(c["hits"], lambda h: (h["at"] >= start["at"]) & (h["at"] < start["at"] + c["t"]["reach"]))
            new = F.array_distinct(inside["word"])
            end = F.get(inside["at"], F.array_max(F.transform(new, lambda w: F.array_position(inside["word"], w))).cast("int") - 1)  # where the last of them comes first
            return F.struct(F.size(new).alias("n"), (start["at"] - end).alias("tight"), start["at"].alias("first"), end.alias("last"))

        top = F.array_max(F.transform(F.filter(c["hits"], lambda h: h["at"] <= c["at"]), block))
        return F.struct(c["t"]["template"].alias("template"), c["t"]["label"].alias("label"), c["at"].alias("anchor"), top["first"].alias("first"), top["last"].alias("last"), (top["n"] / c["t"]["size"]).alias("share"), (top["n"] >= c["t"]["needed"]).alias("met"))

    found = F.transform(F.transform(F.filter(F.transform(joined, around), may_meet), with_hits), best)
    met = F.transform(F.filter(found, lambda m: m["met"]), lambda m: F.struct(*[m[c].alias(c) for c in ("template", "label", "anchor", "first", "last", "share")]))
    return F.when(F.size(held) > 0, met).otherwise(none)


def _with_matches(rows: DataFrame, vocabulary: list[str], templates: list[Template]) -> DataFrame:
    """rows with the matches of each document in column _met."""
    rows = rows.withColumn("_held", prefix_words(F.col("_words"), templates))
    return rows.withColumn("_met", matches(F.col("_words"), F.col("_held"), vocabulary, templates)).drop("_held")


def _that_name(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """rows with those matches that name a license: without those that overlap a shorter and no poorer match of the same
    template, and then without those whose anchor lies in a block that meets a template with all their words and more."""
    if not templates:
        return rows
    larger = F.array(*[F.array(*[F.lit(j) for j, b in enumerate(templates) if set(a.ordered) < set(b.ordered)]).cast("array<int>") for a in templates])

    def betters(b: Column, a: Column) -> Column:
        return (a["template"] == b["template"]) & (b["first"] <= a["last"]) & (a["first"] <= b["last"]) & (b["last"] - b["first"] < a["last"] - a["first"]) & (b["share"] >= a["share"])

    rows = rows.withColumn("_met", F.filter("_met", lambda a: ~F.exists("_met", lambda b: betters(b, a))))
    return rows.withColumn("_met", F.filter("_met", lambda a: ~F.exists("_met", lambda b: F.array_contains(F.get(larger, a["template"]), b["template"]) & (b["first"] <= a["anchor"]) & (a["anchor"] <= b["last"]))))


def _with_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("_key"), lowered(F.col(text)).alias("_low"))
    return rows.withColumn("_words", words(F.col("_low")))


def template_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Every block that meets a template: (key, label, anchor, first_word, last_word, containment), words counted from 0.

    The blocks are those of matches(), the best around each anchor. Null texts have none; other columns are not read.
    """
    rows = _with_words(docs, key, text)
    vocabulary, ordered = ordered_templates(rows, "_words", templates)
    found = _with_matches(rows, vocabulary, ordered).select("_key", F.explode("_met").alias("m"))
    return found.select(F.col("_key").alias(key), "m.label", "m.anchor", F.col("m.first").alias("first_word"), F.col("m.last").alias("last_word"), F.col("m.share").alias("containment"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """A row for each document: n_words, n_base (all places of phrases), first_word, last_word, base_labels,
    labels (with those of the templates met) and score (1 with a phrase, else the largest containment, else 0).

    Labels are distinct, sorted and joined by commas; without any the string is empty. A null text is empty; null
    keys and repeated rows stay; other columns are not read. Texts are read twice: for the words' frequencies, and for
    the scan itself, which shuffles nothing.
    """
    rows = _with_words(docs, key, text)
    vocabulary, ordered = ordered_templates(rows, "_words", templates)
    maybe = F.lit(False)
    for phrase in phrases:
        maybe = maybe | F.contains("_low", F.lit(max(phrase.split(), key=len)))
    labelled = lambda label: lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))
    found = [F.transform(places(F.col("_words"), p.split()), labelled(label)) for p, label in phrases.items()]
    none = F.array().cast("array<struct<at:int,label:string>>")
    based = _that_name(_with_matches(rows, vocabulary, ordered), ordered).select("_key", F.size("_words").cast("long").alias("n_words"), F.when(maybe, F.concat(*found)).otherwise(none).alias("_base"), "_met")
    own = F.array_distinct(F.col("_base.label"))
    return based.select(
        F.col("_key").alias(key),
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base.at").cast("long").alias("first_word"),
        F.array_max("_base.at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.array_distinct("_met.label"))), ",").alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("_met.share"), F.lit(0.0))).alias("score"),
    )
