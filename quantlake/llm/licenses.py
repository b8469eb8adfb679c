"""License scans by diagonal voting, in DataFrame functions only.

Every rolling gram of a text's words is joined, by hash, to the places where templates have it, and the words of the gram are
compared as they are.  Each match votes for a diagonal, the place in the text less the place in the template.  Votes are
counted by document, template and diagonal; neighbouring diagonals of one template are merged, since a word put in or left
out moves the rest by one.  A merged span is verified by the distinct places of the template that it has, and by its length.
Short phrases vote with grams of two words and count where one diagonal has all their places; whole license notices vote with
grams of four words and give a label where enough of the notice is found.

Templates are the tables below: about two thousand grams, whatever the corpus.  Their hashes are literals that a text's grams
are held against before anything is exploded, and their places are broadcast.  Rows beyond the matches are one for each
document, which carries its number of words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantlake.llm import runtime
from quantlake.llm.secrets import let

PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Diagonals of one template this close are one occurrence.
NEAR = 3
#: Share of a notice's places that gives its label, in a span of at most so many times its words.
COVERED, STRETCH = 0.75, 2

#: The phrases of the contract.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Notices as the licenses themselves give them.
NOTICES = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "mit",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "gpl",
    ),
    (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "lgpl",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "agpl",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
        "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "isc",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mpl",
    ),
    (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at http://www.eclipse.org/legal/epl-2.0",
        "epl",
    ),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software.",
        "zlib",
    ),
    (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered "
        "by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
        "Software, and to permit third-parties to whom the Software is furnished to do so",
        "boost",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain "
        "worldwide. This software is distributed without any warranty.",
        "cc0",
    ),
)

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (words, label, k) of every template.
TEMPLATES = [(" ".join(filter(None, re.split(SPLIT, text.lower()))), label, k) for table, k in ((PHRASES, PHRASE_GRAM), (NOTICES, NOTICE_GRAM)) for text, label in table]


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case.

    ``lower`` changes other letters too; of those only the Kelvin sign becomes a letter of A-Z, so it is kept out first.
    """
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e5"))), SPLIT, -1), "")


def _templates(spark: SparkSession) -> DataFrame:
    """(template, label, is_phrase, words, k): literals, so that no Python runs on an executor."""
    rows = [
        F.struct(F.lit(t).alias("template"), F.lit(label).alias("label"), F.lit(k == PHRASE_GRAM).alias("is_phrase"), F.split(F.lit(text), " ").alias("words"), F.lit(k).alias("k"))
        for t, (text, label, k) in enumerate(TEMPLATES)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def template_grams(spark: SparkSession, k: int) -> DataFrame:
    """(h, places): for each gram's hash the list of (template, place, words); as many rows as templates have grams."""
    places = _templates(spark).filter(F.col("k") == k).select("template", "words", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("place"))
    hashed = F.xxhash64(*(F.get("words", F.col("place") + i) for i in range(k)))
    own = F.struct("template", "place", F.slice("words", F.col("place") + 1, k).alias("words"))
    return places.groupBy(hashed.alias("h")).agg(F.collect_list(own).alias("places"))


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template, diagonal, covered, first, last) and, with template -1, the words and the rows of each document."""
    spark = docs.sparkSession
    phrases, notices = (template_grams(spark, k) for k in (PHRASE_GRAM, NOTICE_GRAM))
    known2, known4 = ([r["h"] for r in table.select("h").collect()] for table in (phrases, notices))

    def grams(own: Column) -> Column:
        def row(word: Column, i: Column) -> Column:
            after = [F.get(own, i + k) for k in range(1, NOTICE_GRAM)]
            return F.struct(i.alias("place"), F.xxhash64(word, after[0]).alias("h2"), F.xxhash64(word, *after).alias("h4"))

        met = F.filter(F.transform(own, row), lambda g: g["h2"].isin(known2) | g["h4"].isin(known4))
        spelled = F.transform(met, lambda g: F.struct(g["place"].alias("place"), g["h2"].alias("h2"), g["h4"].alias("h4"), F.slice(own, g["place"] + 1, NOTICE_GRAM).alias("words")))
        end = F.struct(F.size(own).alias("place"), F.lit(None).cast("bigint").alias("h2"), F.lit(None).cast("bigint").alias("h4"), F.lit(None).cast("array<string>").alias("words"))
        return F.concat(spelled, F.array(end))

    # The text ends here: what is exploded next carries its hash.
    source = runtime.id_and_text(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), let(words(F.col("text")), grams).alias("grams"))
    # Outer: else a filter on the size of grams is inferred, which would work them out twice.
    placed = source.select("doc_id", "text_hash", F.inline_outer("grams"))
    placed = placed.join(F.broadcast(phrases.select(F.col("h").alias("h2"), F.col("places").alias("phrase"))), "h2", "left")
    placed = placed.join(F.broadcast(notices.select(F.col("h").alias("h4"), F.col("places").alias("notice"))), "h4", "left")
    no_votes = F.array().cast("array<struct<template:int,place:int,words:array<string>>>")
    whole = F.array(F.struct(F.lit(-1).alias("template"), F.lit(0).alias("place"), F.array().cast("array<string>").alias("words")))
    cast = F.when(F.col("words").isNull(), whole).otherwise(F.concat(F.coalesce("phrase", no_votes), F.coalesce("notice", no_votes)))
    each = placed.select("doc_id", "text_hash", "place", "words", F.explode(cast).alias("vote"))
    verified = each.filter(F.col("words").isNull() | (F.slice("words", 1, F.size("vote.words")) == F.col("vote.words")))
    return verified.groupBy("doc_id", "text_hash", F.col("vote.template").alias("template"), (F.col("place") - F.col("vote.place")).alias("diagonal")).agg(
        F.collect_set("vote.place").alias("covered"), F.count("*").alias("rows"), F.min("place").alias("first"), F.max("place").alias("last")
    )


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template, label, is_phrase, grams, size, covered, first, last) of merged diagonals.

    ``covered`` counts the template's places that the span has, of ``grams``; ``size`` is the template's words.  The rows of
    template -1 have a document's words in ``first`` and its rows in ``rows``.
    """
    own = ["doc_id", "text_hash", "template"]
    by = Window.partitionBy(*own).orderBy("diagonal")
    table = F.broadcast(_templates(docs.sparkSession).select("template", "label", "is_phrase", F.size("words").alias("size"), (F.size("words") - F.col("k") + 1).alias("grams")))
    kinds = votes(docs).join(table, "template", "left")
    # A phrase stands or falls with its own diagonal.
    far = F.coalesce(F.col("is_phrase") | (F.col("diagonal") - F.lag("diagonal").over(by) > NEAR), F.lit(True))
    islands = kinds.withColumn("island", F.sum(far.cast("int")).over(by))
    return islands.groupBy(*own, "island").agg(
        *(F.first(c).alias(c) for c in ("label", "is_phrase", "grams", "size", "rows")),
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("covered"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    first_word and last_word are the smallest and largest start of a base phrase, in words from 0.  labels adds those of
    notices of whose places a span has ``COVERED`` (of overlapping spans those with the greatest share); score is the greatest share found of any template.  A null text is empty:
    no words, no labels, score 0.  Texts are read whole, however long.  Rows with equal doc_id and text have equal results,
    each its own row, rows that share only a doc_id, or have none, their own; only doc_id and text are read, whatever other
    columns there are; an empty table gives none.
    """
    share, base, added = F.col("share"), F.col("base"), F.col("added")
    likely = F.coalesce(~F.col("is_phrase") & (F.col("share") >= COVERED) & (F.col("last") - F.col("first") < STRETCH * F.col("size")), F.lit(False))
    found = occurrences(docs).withColumn("share", F.col("covered") / F.col("grams")).withColumn("likely", likely)
    found = found.withColumn("base", F.coalesce(F.col("is_phrase") & (F.col("covered") == F.col("grams")), F.lit(False)))
    # Notices of one family have most of their words in common: of spans that overlap, those with the greatest share count.
    own = Window.partitionBy("doc_id", "text_hash", "likely")
    before = own.orderBy("first", "last", "template", "island").rowsBetween(Window.unboundedPreceding, -1)
    by = own.orderBy("first", "last", "template", "island").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("apart", F.coalesce(F.col("first") > F.max("last").over(before), F.lit(True)))
    found = found.withColumn("place", F.sum(F.col("apart").cast("int")).over(by))
    best = F.max("share").over(Window.partitionBy("doc_id", "text_hash", "likely", "place"))
    found = found.withColumn("added", F.col("likely") & (F.col("share") == best))
    labels = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("label")))), ",")
    whole = F.col("template") == -1
    per_doc = found.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(whole, F.col("first"))).cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base | added).alias("labels"),
        F.coalesce(F.max(F.when(~whole, share)), F.lit(0.0)).alias("score"),
        F.max(F.when(whole, F.col("rows"))).cast("int").alias("rows"),
    )
    return per_doc.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("again", "rows", "text_hash")
