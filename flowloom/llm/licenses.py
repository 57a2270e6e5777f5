"""License scans by diagonal voting (operator 11).

Every run of words of every text (all rolling k-grams, hashed) is joined in Spark to the places where license templates hold it. A match
at word p of the text and word q of the template votes for the diagonal p - q; votes are added up by diagonal. A phrase is found
where all of its k-grams vote for one diagonal. A longer template may have words added or left out: the votes of neighbouring
diagonals are taken together, and where there are enough, the text's words there are aligned with the template's. Each row is
read twice, once for its k-grams and once for the few words that its diagonals point at; a text's words are never shuffled where
the diagonals of all texts are few, as they are broadcast then.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LETTER_WORDS, Workspace, batches, grams, passes, release, table, word_hash, word_hashes, words_in

#: Words of a k-gram: of phrases and short notices, and of templates of LONG words or more.
SHORT_GRAM, LONG_GRAM, LONG = 2, 3, 12
#: Diagonals this far apart vote together: so many words may be added to or missing from what is matched.
DRIFT = 8
#: Share of a template's words that must align.
SHARE = 0.8
#: Rows of diagonals (some 40 bytes each) up to which they are broadcast; beyond, texts and diagonals are joined by a shuffle.
BROADCAST_ROWS = 500_000

# ---- Fixed values: phrases, notices and license texts with their labels. A phrase must stand word for word.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
# ---- End of fixed values.

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    exact: bool

    @property
    def gram(self) -> int:
        return min(LONG_GRAM if len(self.words) >= LONG else SHORT_GRAM, len(self.words))

    @property
    def grams(self) -> int:
        return len(self.words) - self.gram + 1

    @property
    def least(self) -> int:
        """Votes that neighbouring diagonals need: an edited word spoils no more than `gram` votes, and a span of SHARE has few such words."""
        return self.grams if self.exact else max(1, self.grams - self.gram * int((1 - SHARE) * len(self.words) + 1e-9))


def templates(phrases: dict[str, str] | None = None, notices=None) -> tuple[Template, ...]:
    """Phrases and then notices, ours unless given, each of one word or more."""
    of = lambda text: tuple(_WORD.findall(text.encode().lower()))
    ours = [Template(label, of(text), True) for text, label in (PHRASES if phrases is None else phrases).items()]
    ours += [Template(label, of(text), False) for label, text in (NOTICES if notices is None else notices)]
    if any(not t.words for t in ours):
        raise ValueError("a template needs a word")
    return tuple(ours)


def _sizes(known: tuple[Template, ...]) -> list[int]:
    return sorted({t.gram for t in known})


def places(spark: SparkSession, known: tuple[Template, ...]) -> DataFrame:
    """gram (hash), template, q: where templates hold each of their k-grams. A row a template word: a table of fixed size."""
    rows = []
    for i, t in enumerate(known):
        h = grams(np.array([word_hash(w, LETTER_WORDS) for w in t.words], np.uint64), t.gram)
        rows += [(int(x), i, q) for q, x in enumerate((h + np.uint64(t.gram)).view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, q int").coalesce(1)


def rolling(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, digest, gram, p: every run of so many words of every text, as a hash of its words, and where it begins.

    digest tells apart rows that share a doc_id, or have none.
    """

    def work(it):
        for batch in it:
            for at, n, data, offsets in passes(batch.column(2)):
                s, e, rows = words_in(data, offsets, LETTER_WORDS)
                words = word_hashes(data, s, e, LETTER_WORDS)
                cut = np.searchsorted(rows, np.arange(n + 1))
                hashes, starts = [], []
                for i in range(n):
                    mine = words[cut[i] : cut[i + 1]]
                    runs = [grams(mine, k) + np.uint64(k) for k in sizes]
                    hashes.append(np.concatenate(runs).view(np.int64))
                    starts.append(np.concatenate([np.arange(len(x), dtype=np.int32) for x in runs]))
                size = np.cumsum([0, *map(len, hashes)])
                lists = [pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate(x))) for x in (hashes, starts)]
                yield batches({"doc_id": batch.column(0).slice(at, n), "digest": batch.column(1).slice(at, n), "gram": lists[0], "p": lists[1]})

    listed = docs.mapInArrow(work, "doc_id long, digest long, gram array<long>, p array<int>")
    return listed.select("doc_id", "digest", F.inline(F.arrays_zip("gram", "p")))


def diagonals(docs: DataFrame, known: tuple[Template, ...]) -> DataFrame:
    """doc_id, digest, template, diagonal, votes: diagonals that may hold a template, with the votes of their neighbours.

    Votes of a diagonal are a set of template places, as rows that are repeated vote alike, and no larger than the template.
    """
    met = rolling(docs, _sizes(known)).join(F.broadcast(places(docs.sparkSession, known)), "gram")
    by = met.groupBy("doc_id", "digest", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.size(F.collect_set("q")).alias("own"))
    rules = docs.sparkSession.createDataFrame([(i, 0 if t.exact else DRIFT, t.least) for i, t in enumerate(known)], "template int, drift int, least int").coalesce(1)
    near = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    voted = by.join(F.broadcast(rules), "template").withColumn("votes", F.when(F.col("drift") == 0, F.col("own")).otherwise(F.sum("own").over(near).cast("int")))
    return voted.where("votes >= least").select("doc_id", "digest", "template", "diagonal", "votes")


def aligned(words: list[bytes], template: tuple[bytes, ...]) -> int:
    """Length of the longest common subsequence, a bit a template word."""
    masks: dict[bytes, int] = {}
    for q, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << q
    full = (1 << len(template)) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        v = (v + u | v - u) & full
    return len(template) - v.bit_count()


def verified(words: list[bytes], found: list[tuple[int, int, int]], known: tuple[Template, ...]) -> list[tuple[int, int, int, float]]:
    """(template, start, stop, share of its words) of the diagonals (template, diagonal, votes) of one text.

    Of neighbouring diagonals the one with the most votes stands for all; ties go to the smaller one.
    """
    out = []
    for i in sorted({x[0] for x in found}):
        t, mine = known[i], [x[1:] for x in found if x[0] == i]
        if t.exact:
            out += [(i, d, d + len(t.words), 1.0) for d in sorted({d for d, _ in mine}) if d >= 0 and tuple(words[d : d + len(t.words)]) == t.words]
            continue
        taken: set[int] = set()
        for d, _ in sorted(set(mine), key=lambda x: (-x[1], x[0])):
            if d in taken:
                continue
            taken.update(range(d - DRIFT, d + DRIFT + 1))
            start, stop = max(d - DRIFT, 0), min(d + len(t.words) + DRIFT, len(words))
            there = words[start:stop]
            share = aligned(there, t.words) / len(t.words)
            if share > 0:
                own = [k for k, w in enumerate(there) if w in t.words]
                out.append((i, start + own[0], start + own[-1] + 1, share))
    return out


SPANS = "array<struct<template: int, start: int, stop: int, share: double>>"


def scan(docs: DataFrame, known: tuple[Template, ...] | None = None) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_words, spans (template, start and stop in words, share of its words aligned).

    Spans of every share are returned where diagonals had enough votes; phrases have share 1. Null texts have no words; null and
    repeated ids and repeated rows get rows of their own; other columns are not read; an empty table gives no row.
    """
    known = templates() if known is None else known
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    found = Workspace(spark, "licenses").keep(diagonals(rows, known), "diagonals")
    few = found.count() <= BROADCAST_ROWS
    spots = found.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("template", "diagonal", "votes")).alias("found"))
    spots = spots.withColumnsRenamed({"doc_id": "_doc", "digest": "_digest"})
    both = rows.join(F.broadcast(spots) if few else spots, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left").select("doc_id", "text", "found")
    span = pa.list_(pa.struct([("template", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("share", pa.float64())]))

    def work(it):
        for batch in it:
            for at, n, data, offsets in passes(batch.column(1)):
                counts = np.bincount(words_in(data, offsets, LETTER_WORDS)[2], minlength=n)
                spans: list[list[dict]] = [[] for _ in range(n)]
                marks = batch.column(2).slice(at, n)
                for i in np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    words = _WORD.findall(data[offsets[i] : offsets[i + 1]].tobytes().lower())
                    got = verified(words, [(x["template"], x["diagonal"], x["votes"]) for x in marks[i].as_py()], known)
                    spans[i] = [dict(zip(("template", "start", "stop", "share"), x)) for x in got]
                yield batches({"doc_id": batch.column(0).slice(at, n), "n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, span)})
            release()

    return both.mapInArrow(work, f"doc_id long, n_words long, spans {SPANS}")


def digests(scanned: DataFrame, known: tuple[Template, ...] | None = None, share: float = SHARE) -> DataFrame:
    """Per row of scan(): places of phrases (n_base, first and last word, labels), labels of all spans of `share` or more, and the best share."""
    known = templates() if known is None else known
    names = F.array(*(F.lit(t.label) for t in known))
    exact = F.array(*(F.lit(t.exact) for t in known))
    base = F.filter("spans", lambda x: F.get(exact, x.template))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: F.get(names, x.template)))), ",")
    starts = F.transform(base, lambda x: x.start)
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.filter("spans", lambda x: x.share >= share)).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda x: x.share)), F.lit(0.0)).alias("score"),
    )


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(table(spark, sf_dir, "documents")))
