"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are windows of 128 words, one each 64 words, so that any 64 words in a row lie in one
block. A block matches a template when it holds at least `threshold` of the template's distinct
words. Template words are put in order of how many documents hold them, rarest first. Then
- prefix filter: a block that holds none of the rarest |T| - need + 1 words of T is out,
- length filter: so is one with fewer than `need` distinct template words,
- positional filter: so is one whose first shared word leaves too few words in T or the block.
What is left is verified by its full overlap, so that the join loses no match.

Everything is DataFrame expressions; one pass over texts counts words' documents, one more
finds phrases and candidate blocks. The templates are fixed, so their joined sides are small.

Defined results: a null text is empty and has no labels; rows that repeat a doc_id are scanned
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import ids_and_text, stored

# fixed values
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: sentences of well-known licenses, each of at most 64 words, in lower-case words
TEMPLATES = {
    "agpl": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "apache": "licensed under the apache license version 2 0",
    "apache-notice": "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "this work is licensed under the creative commons attribution sharealike 4 0 international license",
    "cc0": "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-line": "released under the mit license",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-rights": "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
}
#: What lower-casing would turn into letters a to z, though they are none.
OTHERS = "\u0130\u212a"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRIDE, BLOCK = 64, 128


def template_words() -> dict[str, list[str]]:
    return {k: sorted(set(t.split())) for k, t in TEMPLATES.items()}


def needed(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def spaced(text: Column) -> Column:
    """Lower-case words, one space between and around them. Of letters beyond A-Z none turns into a to z."""
    odd = F.contains(text, F.lit(OTHERS[0])) | F.contains(text, F.lit(OTHERS[1]))
    plain = F.when(odd, F.translate(text, OTHERS, "\ufffd\ufffd")).otherwise(text)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(plain), NOT_WORD, " ")), F.lit(" "))


def word_order(docs: DataFrame) -> list[str]:
    """The templates' words, fewest documents first (ties by word): a list as long as the templates make it."""
    vocabulary = sorted({w for words in template_words().values() for w in words})
    held = docs.select(F.explode(F.array_intersect(F.split(spaced(F.col("text")), " "), F.array(*map(F.lit, vocabulary)))).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def phrase_starts(words: Column) -> Column:
    def at(i: Column) -> Column:
        any_ = F.lit(False)
        for phrase in PHRASES:
            all_ = F.lit(True)
            for k, w in enumerate(phrase.split()):
                all_ = all_ & (F.coalesce(F.get(words, i + k), F.lit("")) == w)
            any_ = any_ | all_
        return any_

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), at)


def scan_licenses(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    score: the largest containment among matches, 1 where a phrase stands, else 0.
    """
    spark = docs.sparkSession
    src = ids_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    order = word_order(src)
    rank = {w: i for i, w in enumerate(order)}
    index, sets = [], []
    for name, words in template_words().items():
        words = sorted(words, key=rank.__getitem__)
        need = needed(len(words), threshold)
        sets.append((name, words, len(words), need))
        index += [(w, name, i) for i, w in enumerate(words[: len(words) - need + 1])]
    rare = sorted({w for w, _, _ in index})
    vocabulary = F.array(*map(F.lit, order))

    s = F.col("s")
    words = F.filter(F.split(s, " "), lambda w: w != "")
    has_phrase = F.lit(False)
    for p in PHRASES:
        has_phrase = has_phrase | F.contains(s, F.lit(f" {p} "))
    blocks = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)), F.lit(STRIDE)),
        lambda i: F.array_intersect(vocabulary, F.slice(F.col("w"), i, BLOCK)),  # in global order
    )
    least = min(need for *_, need in sets)
    scans = (
        src.select("doc_id", spaced(F.col("text")).alias("s"))
        .select(
            "doc_id", "s",
            (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) - 1).alias("gaps"),
            (has_phrase | s.rlike(" (?:" + "|".join(rare) + ") ")).alias("some"), has_phrase.alias("phrase"),
        )
        .select(
            "doc_id", "phrase", F.when(s == "  ", 0).otherwise(F.col("gaps")).cast("long").alias("n_words"),
            F.when(F.col("some"), words).alias("w"),
            F.array_sort(F.filter(F.array(*[F.when(F.contains(s, F.lit(f" {p} ")), F.lit(x)) for p, x in PHRASES.items()]), lambda x: x.isNotNull())).alias("base"),
        )
        .select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", "n_words", "base",
            F.when(F.col("phrase"), phrase_starts(F.col("w"))).alias("starts"),
            F.when(F.col("w").isNotNull(), F.filter(blocks, lambda b: F.size(b) >= least)).alias("blocks"),
        )
    )
    scans = stored(scans, "licenses")
    cand = scans.filter(F.size("blocks") > 0).select("row_id", F.posexplode("blocks").alias("block", "held"))
    prefixes = spark.createDataFrame(index, "word string, template string, place int")
    templates = spark.createDataFrame(sets, "template string, words array<string>, total int, need int")
    met = (
        cand.select("row_id", "block", "held", F.posexplode("held").alias("at", "word"))
        .join(prefixes, "word")
        .groupBy("row_id", "block", "template")
        .agg(F.min("place").alias("place"), F.min("at").alias("at"), F.first("held").alias("held"))
        .join(templates, "template")
        .filter((F.size("held") >= F.col("need")) & (F.col("total") - F.col("place") >= F.col("need")) & (F.size("held") - F.col("at") >= F.col("need")))
        .withColumn("overlap", F.size(F.array_intersect("held", "words")))
        .filter("overlap >= need")
    )
    best = met.groupBy("row_id").agg(F.collect_set("template").alias("found"), F.max(F.col("overlap") / F.col("total")).alias("best"))
    none = F.array().cast("array<string>")
    return scans.join(best, "row_id", "left").select(
        "doc_id", "n_words",
        F.coalesce(F.size("starts"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", none)))), ",").alias("labels"),
        F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle_sql(threshold: float = 0.8) -> str:
    """The same rows by comparing every block with every template."""
    rows = ", ".join(f"('{k}', {ws!r}, {len(ws)}, {needed(len(ws), threshold)})" for k, ws in template_words().items())
    starts = " OR ".join("(" + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p in PHRASES)
    labels = ", ".join(f"CASE WHEN contains(s, ' {p} ') THEN '{x}' END" for p, x in PHRASES.items())
    return f"""
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
        d AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t),
        b AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d) WHERE {starts} GROUP BY doc_id),
        templates(name, ws, total, need) AS (VALUES {rows}),
        blocks AS (SELECT doc_id, w[i:i + {BLOCK - 1}] AS held FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 1) + 1, {STRIDE})) AS i FROM d)),
        m AS (SELECT doc_id, name, len(list_intersect(held, ws)) AS overlap, total, need FROM blocks, templates),
        f AS (SELECT doc_id, list(DISTINCT name) AS found, max(overlap * 1e0 / total) AS best FROM m WHERE overlap >= need GROUP BY doc_id),
        l AS (SELECT doc_id, w, list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM d)
        SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
               array_to_string(list_sort(base), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
               greatest(CASE WHEN len(base) > 0 THEN 1e0 ELSE 0e0 END, coalesce(best, 0e0)) AS score
        FROM l LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)"""
