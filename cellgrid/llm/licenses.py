"""License scans: phrases, and an exact set-similarity join of text blocks with license templates (native).

A block is a line of the text.  A template may also run over line breaks: it
is found as well where that share of its tokens stands within WINDOW times as
many words of the text as it has, lines aside.  Such places give labels and
scores; `blocks` has the lines that hold a template alone.  Tokens are ordered by their frequency over all
blocks, rarest first.  A block can reach the containment threshold t in a
template of n tokens only if it has at least ceil(t n) distinct tokens (length
filter) and one of the template's first n - ceil(t n) + 1 tokens (prefix
filter), and, from that token's place on, enough tokens are left (positional
filter); what passes is verified by the exact overlap.

Defined cases: null or wordless texts have no words, no labels and score 0;
repeated rows give one row each; ties are ordered by the token; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, save, spaced_words, words_of

THRESHOLD = 0.9
#: Words of a place over line breaks, to those of the template.
WINDOW = 1.25

#: Phrases that name a license by themselves.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: License sentences as published with the licenses; (label, words).
TEMPLATES = [
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


#: As WORD_GAP, without the line feed.
LINE_GAP = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def lined_words(text: Column) -> Column:
    """The words in lower case with one blank or more between them, lines kept apart."""
    return F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), LINE_GAP, " ")


def phrase_counts(spaced: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Adds n_base, first_word, last_word, base_labels (array) to rows with a column `spaced`."""
    padded = F.concat(F.lit(" "), F.col("spaced"), F.lit(" "))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        needle = f" {phrase} "
        has = F.instr(padded, needle) > 0
        counts.append(F.when(has, F.regexp_count(padded, F.lit(f" {phrase}(?= )"))).otherwise(0))
        head = F.substring_index(padded, needle, 1)
        tail = F.substring_index(padded, needle, -1)
        blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
        firsts.append(F.when(has, blanks(head)))
        lasts.append(F.when(has, blanks(padded) - blanks(tail) - len(needle.split()) - 1))
        labels.append(F.when(has, F.lit(label)))
    n = sum(counts[1:], counts[0])
    return spaced.withColumns({
        "n_base": n.cast("long"), "first_word": F.least(*firsts).cast("long"), "last_word": F.greatest(*lasts).cast("long"),
        "base_labels": F.array_compact(F.array(*labels)),
    })


class Templates:
    """Templates with their tokens ordered by frequency over all blocks, rarest first, and their prefixes."""

    def __init__(self, docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.spark = docs.sparkSession
        words = [sorted(set(text.split())) for _, text in templates]
        self.widths = [int(WINDOW * len(text.split())) for _, text in templates]
        vocabulary = F.broadcast(self.spark.createDataFrame([(t,) for t in sorted({t for w in words for t in w})], "token string"))
        tokens = docs.select(F.explode(F.split(spaced_words(F.col(text_col)), " ", -1)).alias("token"))
        counted = {r["token"]: r["count"] for r in tokens.join(vocabulary, "token").groupBy("token").count().collect()}  # at most the templates' vocabulary
        rank = {t: i for i, t in enumerate(sorted({t for w in words for t in w}, key=lambda t: (counted.get(t, 0), t)))}
        self.ranks = list(rank.items())
        self.index = []
        for k, (label, _) in enumerate(templates):
            ordered = sorted(words[k], key=rank.__getitem__)
            need = math.ceil(threshold * len(ordered) - 1e-9)
            self.index += [(ordered[i], k, label, len(ordered), need, i, ordered, [rank[t] for t in ordered]) for i in range(len(ordered) - need + 1)]

    def pattern(self) -> str:
        """Finds a prefix token among words parted by blanks."""
        return "(?:^|[ \n])(?:" + "|".join(sorted({r[0] for r in self.index})) + ")(?:$|[ \n])"

    def matches(self, blocks: DataFrame) -> DataFrame:
        """(rid, block, template, label, containment) of every block (rid, block, words array) that meets the threshold.

        The index is made from the fixed list of templates, so its broadcast is bounded.
        """
        ranks = F.broadcast(self.spark.createDataFrame(self.ranks, "token string, rank int"))
        index = [(all_ranks[i], k, label, n, need, i, all_ranks) for _, k, label, n, need, i, _, all_ranks in self.index]
        index = F.broadcast(self.spark.createDataFrame(index, "rank int, template int, label string, n int, need int, i int, ordered array<int>"))
        known = blocks.select("rid", "block", F.explode("words").alias("token")).join(ranks, "token").groupBy("rid", "block").agg(F.array_sort(F.collect_set("rank")).alias("own"))
        b, i, j, n, need = F.size("own"), F.col("i"), F.col("j"), F.col("n"), F.col("need")
        probes = known.select("rid", "block", "own", F.posexplode("own").alias("j", "rank")).join(index, "rank")
        probes = probes.where((b >= need) & (j <= b - need) & (F.least(i, j) + 1 + F.least(n - i, b - j) - 1 >= need))
        overlap = F.size(F.array_intersect("ordered", "own"))
        verified = probes.select("rid", "block", "template", "label", "n", "need", overlap.alias("overlap")).where(F.col("overlap") >= F.col("need"))
        return verified.select("rid", "block", "template", "label", (F.col("overlap") / F.col("n")).alias("containment")).distinct()

    def places(self, texts: DataFrame) -> DataFrame:
        """(rid, label, containment) of every template that meets the threshold somewhere in texts (rid, words array with repeats).

        Such a place has a prefix token; the windows around each of these are looked at.
        """
        rows = [(t, k, label, n, need, ordered, self.widths[k]) for t, k, label, n, need, _, ordered, _ in self.index]
        index = F.broadcast(self.spark.createDataFrame(rows, "token string, template int, label string, n int, need int, ordered array<string>, width int"))
        tokens = sorted({r[0] for r in self.index})
        found = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.col("words")[i].isin(tokens))
        near = texts.where(F.size("words") > 0).select("rid", "words", F.explode(found).alias("at")).withColumn("token", F.col("words")[F.col("at")]).join(index, "token")
        start = F.greatest(F.col("at") - F.col("width") + 1, F.lit(0))
        around = near.select("rid", "label", "n", "need", "ordered", "width", F.slice("words", start + 1, F.col("at") + F.col("width") - start).alias("around"))
        around = around.where(F.size(F.array_intersect("ordered", "around")) >= F.col("need"))
        starts = F.sequence(F.lit(1), F.size("around"))
        overlap = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect("ordered", F.slice("around", i, F.col("width"))))))
        met = around.select("rid", "label", "n", "need", overlap.alias("overlap")).where(F.col("overlap") >= F.col("need"))
        return met.select("rid", "label", (F.col("overlap") / F.col("n")).alias("containment")).distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score, blocks."""
    known = Templates(docs, text_col, templates, threshold)
    lined = F.col("lined")
    hold = F.transform(F.split(lined, "\n", -1), lambda line, k: F.struct(k.alias("block"), line.alias("line")))
    held = F.filter(hold, lambda b: b["line"].rlike(known.pattern()))
    base = phrase_counts(docs.select(F.col(id_col).alias("id"), lined_words(F.col(text_col)).alias("lined")).withColumn("spaced", F.trim(F.regexp_replace("lined", "[ \n]+", " "))))
    n_words = F.when(F.col("spaced") == "", 0).otherwise(F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1)
    stored = save(
        base.select(
            F.monotonically_increasing_id().alias("rid"), "id", n_words.cast("long").alias("n_words"), "n_base", "first_word", "last_word",
            F.array_sort(F.array_distinct("base_labels")).alias("base_labels"), F.when(lined.rlike(known.pattern()), F.struct(held.alias("lines"), F.col("spaced"))).alias("held"),
        ),
        "blocks",
    )
    lines = save(
        stored.where(F.col("held").isNotNull())
        .select("rid", F.explode("held.lines").alias("held"))
        .select("rid", "held.block", F.array_distinct(words_of(F.col("held.line"))).alias("words")),
        "lines",
    )
    wide = stored.where(F.col("held").isNotNull()).select("rid", words_of(F.col("held.spaced")).alias("words"))
    found = (
        known.matches(lines)
        .select("rid", "label", "containment", "block")
        .union(known.places(wide).withColumn("block", F.lit(None).cast("int")))
        .groupBy("rid")
        .agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"), F.array_sort(F.collect_set("block")).alias("blocks"))
    )
    out = stored.drop("held").join(found, "rid", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"),
        F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("blocks", F.array().cast("array<int>")).alias("blocks"),
    )
