"""Licence scan: sparse TF-IDF cosine to notice templates, then inheritance along paths.

Spans of a file's words are compared with all templates by the cosine of TF-IDF vectors. A span
begins and ends anywhere, also inside a sentence or across lines, and has at most twice as many
words as the template, so words beside a notice don't count against it. The best span at or
above ``least`` is the file's own licence. Document frequencies are those of all terms over all
files. They are joined only to the terms of stretches that can hold such a span: where the
template's terms that occur within a span's length are, by themselves, at least ``least`` of its
vector. By Cauchy and Schwarz's inequality no other span reaches the threshold, whatever the
words between weigh, so nothing is lost.

A file without a licence of its own takes that of the nearest directory above it that has one.
A directory has the best licence of its licence files (LICENSE, COPYING, NOTICE and the like).
Directories are made distinct and their ancestors joined by path, so the work is per directory,
not per file.

Null and empty texts have no licence of their own and inherit. A null path has no directory and
inherits nothing. Repeated paths are files of their own. Ties go to the first licence by name,
then to the first place. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlytics.llm.helpers import texts_of
from pitchlytics.storage import settle

LEAST = 0.75
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying|notice|copyright)([.-][a-z0-9.-]*)?$"

# Licence identifiers and the notices that grant them.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def lowered(text: str) -> str:
    """Lower case with every letter in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def terms(text: str) -> list[str]:
    return TERM.findall(lowered(text))


class Scanner:
    """Templates as unit vectors under given document frequencies."""

    def __init__(self, files: int, counts: dict[str, int], templates=TEMPLATES, least: float = LEAST):
        self.least, self.files, self.counts = least, files, counts
        self.enough = least * least - 1e-9
        self.templates = []
        self.widths = []
        self.telling: set[str] = set()
        self.told_by: dict[str, set[int]] = {}
        for k, (name, text) in enumerate(templates):
            words = terms(text)
            vector = {t: n * self.idf(t) for t, n in Counter(words).items()}
            size = math.sqrt(sum(v * v for v in vector.values()))
            vector = {t: v / size for t, v in vector.items()}
            self.templates.append((name, vector))
            self.widths.append(2 * len(words))
            rest = 1.0
            for t, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                if math.sqrt(max(0.0, rest)) < least:
                    break
                self.telling.add(t)
                self.told_by.setdefault(t, set()).add(k)
                rest -= v * v
        self.vocabulary = {t for _, vector in self.templates for t in vector}

    def idf(self, term: str, others: dict[str, int] | None = None) -> float:
        n = self.counts.get(term)
        return math.log((1 + self.files) / (1 + (n if n is not None else (others or {}).get(term, 0)))) + 1

    def score(self, stretch: list[str]) -> tuple[float, str] | None:
        """The best template's cosine and licence, if it reaches the threshold."""
        vector = {t: n * self.idf(t) for t, n in Counter(stretch).items()}
        size = math.sqrt(sum(v * v for v in vector.values()))
        if not size:
            return None
        best = None
        for name, template in self.templates:
            cosine = min(1.0, sum(w * vector.get(t, 0.0) for t, w in template.items()) / size)
            if cosine >= self.least and (best is None or (-cosine, name) < (-best[0], best[1])):
                best = cosine, name
        return best

    def near(self, words: list[str]) -> list[int]:
        """Templates of whose vectors the words hold enough."""
        some = set(words)
        told = {k for t in self.telling & some for k in self.told_by[t]}
        return [k for k in sorted(told) if sum(v * v for t, v in self.templates[k][1].items() if t in some) >= self.enough]

    def stretches(self, text: str) -> list[tuple[int, int]]:
        """Places that hold every span that can reach the threshold."""
        low = lowered(text)
        words = TERM.findall(low)
        near = self.near(words)
        if not near:
            return []
        ranges = []
        for k in near:
            vector, width = self.templates[k][1], self.widths[k]
            at = [i for i, t in enumerate(words) if t in vector]
            held: Counter[str] = Counter()
            left, mass = 0, 0.0
            for i in at:
                held[words[i]] += 1
                if held[words[i]] == 1:
                    mass += vector[words[i]] ** 2
                while at[left] <= i - width:
                    gone = words[at[left]]
                    held[gone] -= 1
                    if not held[gone]:
                        mass -= vector[gone] ** 2
                    left += 1
                if mass >= self.enough:
                    ranges.append((at[left], i + 1))
        merged: list[list[int]] = []
        for a, b in sorted(ranges):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        places = [m.span() for m in TERM.finditer(low)]
        # A mark that ends the sentence belongs to the stretch.
        return [(places[a][0], places[b - 1][1] + (text[places[b - 1][1]:places[b - 1][1] + 1] in tuple(".!?"))) for a, b in merged]

    def best(self, words: list[str], weight: dict[str, float]) -> tuple[float, str, int, int] | None:
        """Cosine, licence, first and last word of the best span; at a tie the first licence by
        name, the first place, the longest span."""
        found = None
        for k in self.near(words):
            name, vector = self.templates[k]
            for i, first in enumerate(words):
                if first not in vector:
                    continue
                dot = norm = mass = 0.0
                held: dict[str, int] = {}
                for j in range(i, min(len(words), i + self.widths[k])):
                    t = words[j]
                    n, w = held.get(t, 0), weight[t]
                    held[t] = n + 1
                    norm += w * w * (2 * n + 1)
                    v = vector.get(t)
                    if v is None:
                        continue
                    dot += v * w
                    if not n:
                        mass += v * v
                    if mass >= self.enough and dot * dot >= self.enough * norm:
                        cosine = min(1.0, round(dot / math.sqrt(norm), 12))
                        if cosine >= self.least and (found is None or (-cosine, name, i, -j) < found):
                            found = (-cosine, name, i, -j)
        return None if found is None else (-found[0], found[1], found[2], -found[3])

    def hit(self, text: str, others: dict[str, int] | None = None) -> tuple[str, float, int, int] | None:
        """Licence, cosine and place of the best span of a stretch; ``others`` has the document
        frequencies of terms of no template."""
        places = [(m[0], *m.span()) for m in TERM.finditer(lowered(text))]
        words = [p[0] for p in places]
        got = self.best(words, {t: self.idf(t, others) for t in set(words)})
        if got is None:
            return None
        cosine, name, a, b = got
        stop = places[b][2]
        return name, cosine, places[a][1], stop + (text[stop:stop + 1] in tuple(".!?"))

    def pick(self, parts: list[tuple[int, str]], others: dict[str, int] | None = None) -> tuple[str, float, int, int] | None:
        """The best hit in stretches given by start and text."""
        hits = [(-h[1], h[0], start + h[2], start + h[3]) for start, text in parts if (h := self.hit(text, others))]
        if not hits:
            return None
        cosine, name, start, stop = min(hits)
        return name, -cosine, start, stop

    def find(self, text: str, others: dict[str, int] | None = None) -> tuple[str, float, int, int] | None:
        """Licence, cosine and place of the best span of the text."""
        return self.pick([(a, text[a:b]) for a, b in self.stretches(text)], others)


#: The worker's scanner.
_SCANNER: list[tuple] = []
FOUND = pa.struct([("licence", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())])
PARTS = pa.struct([("parts", pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string())]))), ("others", pa.list_(pa.string()))])
#: Terms that a task counts before it hands them on.
HELD_TERMS = 200_000


def frequencies(files: DataFrame, text_col: str) -> DataFrame:
    """Files that hold each term, and all files under the empty term: ``term``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return made

        for batch in batches:
            for text in texts_of(batch, "text"):
                counts[""] += 1
                counts.update(set(terms(text)))
                if len(counts) >= HELD_TERMS:
                    yield out()
        yield out()

    rows = files.select(F.col(text_col).alias("text")).mapInArrow(run, "term string, n long")
    return settle(rows.groupBy("term").agg(F.sum("n").alias("n")), "terms")


def chosen(counted: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """Files, and files that hold each term of the templates; one row per term at most."""
    found = {r["term"]: r["n"] for r in counted.where(F.col("term").isin(["", *sorted(vocabulary)])).collect()}
    return found.pop("", 0), found


def term_counts(files: DataFrame, vocabulary: set[str], text_col: str) -> tuple[int, dict[str, int]]:
    return chosen(frequencies(files, text_col), vocabulary)


def parent(path: Column) -> Column:
    """The directory of a path, empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licences(files: DataFrame, *, path_col: str = "path", text_col: str = "text", templates=TEMPLATES,
                  least: float = LEAST) -> DataFrame:
    """All columns but the text, with ``own_licence``, ``own_score``, ``own_start``,
    ``own_stop`` (code points), ``licence`` (own or inherited) and ``inherited_from`` (the
    directory). Input columns of these names are replaced."""
    vocabulary = {t for _, text in templates for t in terms(text)}
    counted = frequencies(files, text_col)
    n, counts = chosen(counted, vocabulary)
    added = ("own_licence", "own_score", "own_start", "own_stop", "licence", "inherited_from")
    kept = [c for c in files.columns if c != text_col and c not in added]

    def scanner() -> Scanner:
        given = (n, counts, templates, least)
        if not _SCANNER or _SCANNER[0][0] != given:
            _SCANNER[:] = [(given, Scanner(*given))]
        return _SCANNER[0][1]

    def cut(texts: pa.Array) -> pa.Array:
        tool, rows = scanner(), []
        for t in texts.to_pylist():
            parts = [(a, t[a:b]) for a, b in tool.stretches(t)] if t else []
            others = sorted({x for _, p in parts for x in terms(p)} - tool.vocabulary)
            rows.append({"parts": [{"start": a, "text": p} for a, p in parts], "others": others} if parts else None)
        return pa.array(rows, PARTS)

    def judge(parts: pa.Array, known: pa.Array) -> pa.Array:
        tool, rows = scanner(), []
        for p, k in zip(parts.to_pylist(), known.to_pylist(), strict=True):
            got = tool.pick([(x["start"], x["text"]) for x in p], {x["term"]: x["n"] for x in k or ()}) if p else None
            rows.append(None if got is None else dict(zip(("licence", "score", "start", "stop"), got, strict=True)))
        return pa.array(rows, FOUND)

    stretches = F.arrow_udf(cut, "parts array<struct<start:long,text:string>>, others array<string>")(F.col(text_col)).alias("_cut")
    cuts = settle(files.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(path_col).alias("_path"), stretches)
                  .withColumn("_key", F.monotonically_increasing_id()), "stretches")
    known = (
        cuts.select("_key", F.explode("_cut.others").alias("term")).join(counted, "term")
        .groupBy("_key").agg(F.collect_list(F.struct("term", "n")).alias("_known"))
    )
    own = F.arrow_udf(judge, "licence string, score double, start long, stop long")(F.col("_cut.parts"), F.col("_known")).alias("_own")
    held = cuts.where("_cut IS NOT NULL").join(known, "_key", "left").select("_row", "_path", own)
    none = F.lit(None).cast("struct<licence:string,score:double,start:long,stop:long>").alias("_own")
    scanned = settle(held.unionByName(cuts.where("_cut IS NULL").select("_row", "_path", none)), "licences")

    above = scanned.withColumn("dir", parent(F.col("_path")))
    declared = (
        above.where(F.col("_own").isNotNull() & F.regexp_like(F.regexp_extract("_path", "[^/]*$", 0), F.lit(LICENCE_FILE)))
        .groupBy(F.col("dir").alias("at"))
        .agg(F.min(F.struct(-F.col("_own.score"), F.col("_own.licence").alias("licence"))).getField("licence").alias("given"))
    )
    steps = F.split("dir", "/")
    levels = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    nearest = (
        above.select("dir").where("dir IS NOT NULL").distinct()
        .select("dir", F.explode(F.array_distinct(levels)).alias("at"))
        .join(declared, "at")
        .groupBy("dir").agg(F.max(F.struct(F.length("at").alias("depth"), "at", "given")).alias("near"))
        .select("dir", "near.at", "near.given")
    )
    joined = above.join(nearest, "dir", "left")
    inherits = F.col("_own").isNull()
    return joined.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in kept], F.col("_own.licence").alias("own_licence"), F.col("_own.score").alias("own_score"),
        F.col("_own.start").alias("own_start"), F.col("_own.stop").alias("own_stop"),
        F.coalesce("_own.licence", "given").alias("licence"), F.when(inherits, F.col("at")).alias("inherited_from"))
