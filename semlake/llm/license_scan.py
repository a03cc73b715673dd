"""License scans by diagonal voting.

The words of licence templates give k-gram hashes with their positions; every rolling k-gram hash of every document is
joined with them in Spark. A match votes for the diagonal (position in the document minus position in the template);
neighbouring diagonals make one alignment with small insertions or losses. An alignment is verified gram by gram: each
voted with a second, independent hash as well, and only grams in the template's order whose diagonals drift little from
one to the next make a span (``runs``); a span stands if its grams cover enough of the template's words.

Short phrases are templates of two-word grams for which every word must be covered on a single diagonal: these are the
base places. Longer templates use five-word grams; whole licences come as their paragraphs, each a template, so that a
text which holds only a part is still told. The library is an argument.

Defined results: a null text counts as empty; rows are scanned one by one, so repeated rows have equal results; a text
without words or matches has no place, no label and score 0; ties between labels are listed in order; an empty table has
an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semlake.llm import textblock

#: (label, phrase): fixed by the contract.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: (label, text): paragraphs of public licences, and notices that name them. The licences' own words.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
               "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
             "Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
            "derived from this software without specific prior written permission."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
             "it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
                  "use, compile, sell, or distribute this software"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or "
            "her rights to the work worldwide under copyright law"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
]
GRAM, PHRASE_GRAM = 5, 2
#: Diagonals at most so many words apart are neighbours; a span drifts no more from one gram to the next.
DRIFT = 4
#: Share of a template's words that a span's grams must cover.
COVERED = 0.7
SPANS_DDL = "doc_id long, row long, template int, label string, base boolean, first_word long, last_word long, votes long, covered double"
SPANS = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (c.split() for c in SPANS_DDL.split(", "))])
#: The gram hash under which every row's number of words travels.
TOTAL = 0


def words_of(text: str) -> list[str]:
    """A text's words as the scan sees them."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _hashes(column: pa.Array, sizes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """For every gram of the given sizes: row, first word, size, hash, second hash; and each row's number of words."""
    data, at = textblock.utf8(column)
    row, one, two = textblock.words(data, at, hashes=2)
    begin = np.searchsorted(row, np.arange(len(column) + 1))
    out = []
    for k in sizes:
        first, h = textblock.grams(row, one, k)
        _, check = textblock.grams(row, two, k)
        r = row[first]
        out.append((r, first - begin[r], np.full(len(r), k), h, check))
    return (*[np.concatenate(x) for x in zip(*out, strict=True)], np.diff(begin))


def rolling(docs: DataFrame, sizes: tuple[int, ...] = (PHRASE_GRAM, GRAM)) -> DataFrame:
    """(doc_id, row, place, k, hash, check) for all grams of all rows; and one line a row with k = TOTAL and its number of
    words as place. row tells rows apart that share a doc_id: the number of the input split and the place in it, which a
    task that is run again finds again in files and written tables. Nothing outside of one query knows these numbers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for part in parts:
            for b in textblock.batches(part, "text"):
                row, place, k, h, check, n = _hashes(b.column(1), sizes)
                every = np.arange(b.num_rows)
                row = np.concatenate([every, row])
                lines = pa.array(row)
                columns = [
                    b.column(0).take(lines),
                    pa.array(row + at),
                    pa.array(np.concatenate([n, place]).astype(np.int32)),
                    pa.array(np.concatenate([0 * every + TOTAL, k]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(b.num_rows, np.uint64), h]).view(np.int64)),
                    pa.array(np.concatenate([np.zeros(b.num_rows, np.uint64), check]).view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "place", "k", "hash", "check"])
                at += b.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, place int, k int, hash long, check long")


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], phrases: list[tuple[str, str]]) -> DataFrame:
    """(k, hash, check, template, label, base, at, size) for every gram of every template; a bounded table, set by the call."""
    rows = [(TOTAL, 0, 0, -1, "", False, 0, 0)]
    for t, (base, (label, text)) in enumerate([(True, p) for p in phrases] + [(False, x) for x in templates]):
        k = PHRASE_GRAM if base else GRAM
        _, place, _, h, check, n = _hashes(pa.array([text]), (k,))
        for p, a, b in zip(place.tolist(), h.view(np.int64).tolist(), check.view(np.int64).tolist(), strict=True):
            rows.append((k, a, b, t, label, base, p, int(n[0])))
    return spark.createDataFrame(rows, "k int, hash long, check long, template int, label string, base boolean, at int, size int")


def runs(places: list[int], ats: list[int], k: int) -> list[tuple[int, int, int, int]]:
    """(first word, end, grams, words of the template covered) of each span among an alignment's grams (place in the
    document, position in the template), given in any order.

    Grams are taken in the order of the document. One continues a span if it lies further on in the template than the
    span's last and their diagonals differ by DRIFT at most; it joins the span it fits with the smallest drift, the later
    one among equals, and begins a span of its own if there is none. A template's positions only rise within a span, so a
    span is about as long as its template at most.
    """
    open_: list[list[int]] = []  # first place, last place, last position, grams, covered
    done = []
    for p, a in sorted(zip(places, ats, strict=True)):
        best = None
        for x in open_:
            drift = abs((p - a) - (x[1] - x[2]))
            if a > x[2] and p > x[1] and drift <= DRIFT and (best is None or drift <= best[0]):
                best = drift, x
        if best is None:
            open_.append([p, p, a, 1, k])
        else:
            x = best[1]
            x[4] += min(k, a - x[2])
            x[1], x[2], x[3] = p, a, x[3] + 1
        if len(open_) > 64:  # spans that lie further back than any gram reaches
            far = [x for x in open_ if p - x[1] > max(ats) + DRIFT]
            done, open_ = done + far, [x for x in open_ if p - x[1] <= max(ats) + DRIFT]
    return [(x[0], x[1] + k, x[3], x[4]) for x in done + open_]


def spans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """(doc_id, row, template, label, base, first_word, last_word, votes, covered) for verified spans, and a line with
    template -1 and the number of words as votes for every row."""
    known = template_grams(docs.sparkSession, templates, phrases)
    hits = rolling(docs).join(F.broadcast(known), ["k", "hash", "check"])
    # A diagonal's votes are combined before they move; nothing but matches moves at all.
    sums = hits.groupBy("doc_id", "row", "template", "label", "base", "size", "k", (F.col("place") - F.col("at")).alias("diagonal"))
    lines = sums.agg(F.collect_list("at").alias("ats"), F.max(F.when(F.col("template") < 0, F.col("place"))).alias("words"))  # at most the template's grams
    by_template = Window.partitionBy("doc_id", "row", "template")
    apart = F.when(F.col("base"), 0).otherwise(DRIFT)
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_template.orderBy("diagonal")) > apart, F.lit(True))
    merged = lines.withColumn("fresh", fresh.cast("int")).withColumn(
        "alignment", F.sum("fresh").over(by_template.orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0))
    )
    place = F.transform("ats", lambda a: a + F.col("diagonal"))
    found = merged.groupBy("doc_id", "row", "template", "label", "base", "size", "k", "alignment").agg(
        F.flatten(F.collect_list("ats")).alias("ats"), F.flatten(F.collect_list(place)).alias("places"), F.max("words").alias("words")
    )

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            out = []
            for r in b.to_pylist():
                if r["template"] < 0:
                    out.append((r["doc_id"], r["row"], -1, "", False, None, None, r["words"], 0.0))
                    continue
                for first, end, votes, covered in runs(r["places"], r["ats"], r["k"]):
                    if covered >= r["size"] * (1.0 if r["base"] else COVERED):
                        out.append((r["doc_id"], r["row"], r["template"], r["label"], r["base"], first, end - 1, votes, min(1.0, covered / r["size"])))
            columns = zip(*out, strict=True) if out else [[]] * len(SPANS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, SPANS.types, strict=True)], schema=SPANS)

    return found.mapInArrow(verify, SPANS_DDL)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row."""
    total, base = F.col("template") < 0, F.col("base")

    def labels(which):  # noqa: ANN001, ANN202
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return (
        spans(docs, templates, phrases)
        .groupBy("doc_id", "row")
        .agg(
            F.max(F.when(total, F.col("votes"))).alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first_word"))).alias("first_word"),
            F.max(F.when(base, F.col("first_word"))).alias("last_word"),
            labels(base).alias("base_labels"),
            labels(~total).alias("labels"),
            F.max("covered").alias("score"),
        )
        .drop("row")
    )
