"""Operator 6: licence scans.

Sparse TF-IDF vectors of passages and whole files are compared by cosine with licence templates: notices, the
paragraphs of short licences, the titles of long ones, and SPDX lines. A file whose own text states a licence has that
one; any other inherits from the licence file in its nearest ancestor directory, found by joining each file's ancestor
paths with the directories of licence files.

A passage is as many words as the template has, laid over the text so that a trigger stands in it where it stands in the
template; line breaks and comment marks do not matter. The triggers of a template are its telling words, as many as it
takes that no passage without one can reach the threshold (of an SPDX line its tag). So whole texts are scanned, and only those with a trigger are
cut into words.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scenelake.llm.common import checkpoint_dir, documents, free_names, texts_of

#: SPDX identifiers and the notices, titles and paragraphs that state them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Every identifier is also stated by its SPDX line, which is one only with its tag.
TAG = "spdx-license-identifier"
TEMPLATES += tuple((x, f"SPDX-License-Identifier: {x}") for x in sorted({x for x, _ in TEMPLATES}))
#: A licence that another one's passage is part of: where the longer one is found too, it holds.
PART_OF = {"BSD-2-Clause": "BSD-3-Clause"}
#: Least cosine of a match.
THRESHOLD = 0.8
#: Share of a text's words that passages must cover for it to be a licence file, and words at its start in which a passage makes it one.
DOMINANT, HEADER = 0.5, 12
#: Words that are triggers only where nothing else will do.
COMMON = frozenset("a an and any are as at be by code copy deal file files following for form forms free general hereby in into is it its may met name names of on option or person program software source subject terms that the this to under use used version with without work your".split())
#: File names of licence files, lower-cased.
LICENCE_FILE = r"^(licen[cs]e|copying|unlicense|notice)(\.(txt|md|rst))?$"

#: Templates that are titles of long licences: among the first words of a text they make it a licence file.
TITLE = re.compile(r"[A-Z]+(?: [A-Z]+)* LICENSE Version|Apache License Version|Mozilla Public License Version")

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


class Templates:
    def __init__(self, templates: tuple = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold, self.names = threshold, [x for x, _ in templates]
        self.titles = {i for i, (_, t) in enumerate(templates) if TITLE.match(t)}
        self.words = [_WORD.findall(t.lower()) for _, t in templates]
        documents_with = Counter(w for x in self.words for w in set(x))
        self.idf = {w: math.log((1 + len(self.words)) / (1 + n)) + 1 for w, n in documents_with.items()}
        self.unknown = math.log(1 + len(self.words)) + 1
        self.vectors = [self.vector(x) for x in self.words]
        # words without which a template's remaining length stays below the threshold, and where they stand in it
        rank = lambda w: (len(w) < 4 or w in COMMON, -min(len(w), 7), -self.idf[w], w)
        self.places: dict[str, list[tuple[int, int]]] = {}
        for t, v in enumerate(self.vectors):
            left = dict(v)
            for w in [TAG] if TAG in v else sorted(v, key=rank):
                if math.sqrt(sum(x * x for x in left.values())) < threshold:
                    break
                left.pop(w)
                self.places.setdefault(w, []).extend((t, j) for j, x in enumerate(self.words[t]) if x == w)
        self.triggers = sorted(self.places)

    def vector(self, words: list[str]) -> dict[str, float]:
        v = {w: n * self.idf.get(w, self.unknown) for w, n in Counter(words).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()} if length else {}

    def cosine(self, words: list[str], t: int) -> float:
        template = self.vectors[t]
        return sum(x * template.get(w, 0.0) for w, x in self.vector(words).items())

    def scan(self, text: str) -> tuple[str | None, float, bool]:
        """Licence and cosine of the best passage (the first template of equals), and whether the text is a licence as a whole."""
        lowered = text.lower()
        if not any(x in lowered for x in self.triggers):
            return None, 0.0, False
        words = _WORD.findall(lowered)
        laid = {(t, max(0, min(i - j, len(words) - len(self.words[t])))) for i, w in enumerate(words) if w in self.places for t, j in self.places[w]}
        best: dict[str, tuple[float, int]] = {}
        covered, header = [False] * len(words), False
        for t, at in laid:
            score = self.cosine(words[at : at + len(self.words[t])], t)
            if score >= self.threshold - 1e-9:
                best[self.names[t]] = max(best.get(self.names[t], (0.0, 0)), (score, -t))
                covered[at : at + len(self.words[t])] = [True] * len(words[at : at + len(self.words[t])])
                header |= at < HEADER and t in self.titles
        if not best:
            return None, 0.0, False
        name = max(best, key=lambda x: (round(best[x][0], 9), best[x][1]))
        name = PART_OF[name] if PART_OF.get(name) in best else name
        return name, min(1.0, best[name][0]), header or sum(covered) >= DOMINANT * len(words)


def scan_licences(files: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, text and further columns -> those but text, own, score, licence_file, licence, inherited_from.

    own is the licence the text states (null: none), licence that or the one inherited. A licence file states a licence
    and is named so, or consists of it by half; it covers its directory and those below, the nearest first, and of several
    in a directory the one of the least path. A null or empty text states nothing; a null path inherits nothing.
    Repeated rows are scanned each; an empty table gives an empty result. A further column with the name of a new one
    comes out under that name with _given appended.

    The texts are scanned once: what the scan finds is written with checkpoint(), without the texts.
    """
    model = Templates(templates, threshold)
    checkpoint_dir(files.sparkSession)
    others = [c for c in files.columns if c not in ("path", "text")]
    shown = free_names(others, ["path", "own", "score", "licence_file", "licence", "inherited_from"])
    packed = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"), F.struct(F.lit(None).cast("int").alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("rest"))

    def scan(batches):
        for b in batches:
            rows = [model.scan(x.decode("utf-8", "replace")) for x in texts_of(b)]
            name, score, whole = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("rest"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(whole, pa.bool_())], names=["path", "rest", "own", "score", "whole"])

    found = StructType().add("path", "string").add("rest", packed.schema["rest"].dataType).add("own", "string").add("score", "double").add("whole", "boolean")
    scanned = packed.mapInArrow(scan, found).checkpoint()
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    scanned = scanned.withColumn("licence_file", F.coalesce(F.col("own").isNotNull() & (F.col("whole") | name.rlike(LICENCE_FILE)), F.lit(False)))
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    covered = scanned.where(F.col("licence_file") & F.col("path").isNotNull()).groupBy(directory.alias("directory")).agg(F.min_by(F.struct("own", "path"), "path").alias("given"))
    # every ancestor of the directories that hold files without a licence: distinct, so that a full directory joins once
    wanting = scanned.where(F.col("own").isNull() & F.col("path").isNotNull()).select(directory.alias("of")).distinct()
    parts = F.split("of", "/")
    ancestors = wanting.select("of", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("above")).distinct()
    nearest = ancestors.join(covered, F.col("above") == F.col("directory")).groupBy("of").agg(F.max_by("given", F.length("above")).alias("given"))
    joined = scanned.withColumn("directory_", F.when(F.col("own").isNull(), directory)).join(nearest, F.col("directory_") == F.col("of"), "left")
    return joined.select("path", *[F.col("rest")[f"c{i}"].alias(c) for i, c in enumerate(shown)], "own", "score", "licence_file", F.coalesce("own", F.col("given.own")).alias("licence"), F.col("given.path").alias("inherited_from"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths of their own, so each stands in an invented tree: source, thousand and hundred of ids.

    One in ten is called LICENSE; it counts as a licence file where its text states a licence. Of those, one in four stands
    a directory higher, above ten others.
    """
    docs = documents(spark, sf_dir)
    part = lambda n: F.expr(f"cast(floor(doc_id / {n}) as string)")
    named = F.col("doc_id") % 10 == 3
    folder = F.when(named & (F.col("doc_id") % 40 == 3), part(1000)).otherwise(F.concat_ws("/", part(1000), part(100)))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), folder, F.when(named, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return scan_licences(docs.select(path.alias("path"), "text", "doc_id"))
