"""License scans: sparse TF-IDF cosine of text lines to license templates, then inheritance from directories.

Terms are the words of the templates; their document frequencies are counted over all lines of all texts, and a word
that no template has weighs as one that occurs once. Compared are the lines of a text, its header block (up to the first
blank line), a license file as a whole, and every span of a template's length anywhere in the text, also across line ends.
Each matches its nearest template at a cosine of THRESHOLD or more. A file takes the license of its own best match; a file without one takes that of the nearest directory above it
that has a license file, found by joining directories with their ancestors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gameline.llm.common import stored, table, text_batches

THRESHOLD = 0.6
#: Statements by which files name a license, the usual wording of each.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the "
        "BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright, all rights reserved, no part may be reproduced without permission."),
    ("Proprietary", "All rights reserved."),
)
_CONDITIONS = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.")
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version.")
#: Notices of several lines, and license texts or how they begin. They are compared with spans, headers and files only.
LONG_TEMPLATES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        'compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
        
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
        "REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", _CONDITIONS + ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY '
        'EXPRESS OR IMPLIED WARRANTIES'),
    ("BSD-3-Clause", _CONDITIONS + " Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."),
        
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
        
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        'rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit '
        'persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice '
        'and this permission notice shall be included in all copies or substantial portions of the Software.'),
        
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
#: Names that count only where no other license matches, as texts that grant a license reserve rights as well.
LAST = frozenset({"Proprietary"})
_DIR, _NEAR = "__license_dir", "__license_near"
_FILE = re.compile(r"(licen[sc]e|copying)([.-].*)?$", re.I)
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def _line_counts(vocabulary: list[str]):
    """Map: lines that have each word, and the number of lines with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = frozenset(vocabulary), Counter()
        for batch in text_batches(batches, "text"):
            for text in batch.column("text").to_pylist():
                for line in (text or "").lower().split("\n"):
                    if line and not line.isspace():
                        total[""] += 1
                        total.update(known.intersection(_WORD.findall(line)))
        yield pa.record_batch({"term": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def _better(best: tuple[float, str | None], found: tuple[float, str | None]) -> tuple[float, str | None]:
    """The one that counts; of equal ones the first."""
    if found[1] is None or best[1] is None:
        return best if found[1] is None else found
    if (found[1] in LAST) != (best[1] in LAST):
        return best if found[1] in LAST else found
    return found if found[0] > best[0] + 1e-12 else best


class Prefix:
    """Templates that a set of words can reach: a cosine is at most the length of the template's vector over the words
    it shares, so most texts end here."""

    def __init__(self, vectors: list[dict[str, float]], threshold: float) -> None:
        self.least = (threshold - 1e-9) ** 2
        self.known = frozenset(w for v in vectors for w in v)
        self.row = {w: i for i, w in enumerate(sorted(self.known))}
        self.squares = np.zeros((len(self.row), len(vectors)))
        for t, v in enumerate(vectors):
            for w, x in v.items():
                self.squares[self.row[w], t] = x * x

    def of(self, words: list[str]) -> list[int]:
        shared = self.known.intersection(words)
        if not shared:
            return []
        return np.flatnonzero(self.squares[[self.row[w] for w in shared]].sum(axis=0) >= self.least).tolist()

    def search(self, text: str) -> list[int]:
        return self.of(terms(text))


class Matcher:
    def __init__(self, templates, lines: int, df: dict[str, int], threshold: float, long=()) -> None:
        self.threshold = threshold
        self.other = float(np.log((1 + lines) / 2) + 1)
        self.idf = {w: float(np.log((1 + lines) / (1 + df.get(w, 0))) + 1) for _, t in (*templates, *long) for w in terms(t)}
        self.vectors = []
        for name, text in (*templates, *long):
            v = {w: n * self.idf[w] for w, n in Counter(terms(text)).items()}
            norm = float(np.sqrt(sum(x * x for x in v.values())))
            self.vectors.append((name, {w: x / norm for w, x in v.items()}, len(terms(text))))
        self.prefix = Prefix([v for _, v, _ in self.vectors], threshold)
        self.ids = {w: i for i, w in enumerate(self.idf)}
        self.squares = np.array([*(x * x for x in self.idf.values()), self.other**2])
        self.weights = np.zeros((len(self.vectors), len(self.squares)))
        for t, (_, v, _) in enumerate(self.vectors):
            for w, x in v.items():
                self.weights[t, self.ids[w]] = x * self.idf[w]

    def nearest(self, words: list[str], possible: list[int]) -> tuple[float, str | None]:
        """(cosine, template) of the nearest of the possible templates at the threshold or above."""
        counts = Counter(words)
        norm = float(np.sqrt(sum((n * self.idf.get(w, self.other)) ** 2 for w, n in counts.items())))
        best = (0.0, None)
        for t in possible:
            name, v, _ = self.vectors[t]
            s = sum(x * counts[w] * self.idf[w] for w, x in v.items() if w in counts) / norm if norm else 0.0
            if s >= self.threshold:
                best = _better(best, (s, name))
        return best

    def line(self, line: str) -> tuple[float, str | None]:
        words = terms(line)
        return self.nearest(words, self.prefix.of(words))

    def spans(self, words: list[str], possible: list[int]) -> tuple[float, str | None]:
        """(cosine, template) of the best span of each possible template's number of words."""
        ids = np.array([self.ids.get(w, len(self.ids)) for w in words], dtype=np.int64)
        square = np.concatenate([[0.0], np.cumsum(self.squares[ids])])
        best = (0.0, None)
        for t in possible:
            name, _, size = self.vectors[t]
            if len(words) < size:
                continue  # the header or the file as a whole
            dot = np.concatenate([[0.0], np.cumsum(self.weights[t][ids])])
            # words that repeat make the norm larger, so this is at least the cosine
            bound = (dot[size:] - dot[:-size]) / np.sqrt(square[size:] - square[:-size])
            near = np.flatnonzero(bound >= self.threshold - 1e-9)
            top = best[0] if (name in LAST) == (best[1] in LAST) else 0.0
            for i in near[np.argsort(-bound[near], kind="stable")].tolist():
                if bound[i] < top:
                    break
                found = self.nearest(words[i : i + size], [t])
                if found[1]:
                    best = _better(best, found)
                    top = max(top, found[0])
        return best

    def text(self, text: str | None, whole: bool = False) -> tuple[float, str | None]:
        best = (0.0, None)
        words = terms(text) if text else []
        possible = self.prefix.of(words)
        if possible:
            for line in text.split("\n"):
                best = _better(best, self.line(line))
            best = _better(best, self.line(re.split(r"\n[^a-zA-Z0-9\n]*\n", text.strip(), maxsplit=1)[0]))
            if whole:
                best = _better(best, self.nearest(words, possible))
            best = _better(best, self.spans(words, possible))
        return best


def _match(matcher):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, "text"):
            named = [bool(p and _FILE.match(p.rsplit("/", 1)[-1])) for p in batch.column("path").to_pylist()]
            found = [matcher.value.text(t, n) for t, n in zip(batch.column("text").to_pylist(), named)]
            yield pa.record_batch({**{c: batch.column(c) for c in batch.schema.names if c != "text"},
                "own_license": pa.array([n for _, n in found], pa.string()), "own_score": pa.array([s for s,
                _ in found], pa.float64())})

    return run


def license_scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, long=LONG_TEMPLATES) -> DataFrame:
    """The columns of files but text, with own_license, own_score (0 without a match), license and inherited_from.

    files has path and text. The name after the last slash decides: LICENSE, LICENCE or COPYING, with any ending, is a
    license file, and its directory and all below inherit its license where nothing nearer has one. Of several license
    files in one directory the best score counts, then the smaller name of the license. Null paths inherit nothing;
    null and empty texts match nothing; rows that repeat count each; an empty table gives no rows. Columns of files named
    like a result are replaced; all others stay.
    """
    spark = files.sparkSession
    files = files.drop("own_license", "own_score", "license", "inherited_from").withColumn("text", F.col("text").cast("string"))
    vocabulary = sorted({w for _, t in (*templates, *long) for w in terms(t)})
    df = {r["term"]: r["n"] for r in files.select("text").mapInArrow(_line_counts(vocabulary),
        "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each word of the templates
    matcher = spark.sparkContext.broadcast(Matcher(templates, df.get("", 0), df, threshold, long))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "text")
    own = files.mapInArrow(_match(matcher), f"{schema}, own_license string, own_score double")
    own = stored(own)  # read three times below
    own = own.withColumn(_DIR, F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$",
        "")).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))))
    named = F.regexp_extract("path", "[^/]*$", 0).rlike("^(?i)(licen[sc]e|copying)([.-].*)?$")
    best = F.min_by("own_license", F.struct(-F.col("own_score"), F.col("own_license")))
    licensed = own.where(named & F.col("own_license").isNotNull()).groupBy(F.col(_DIR).alias("up")).agg(best.alias("license"))
    dirs = own.select(_DIR).where(F.col(_DIR).isNotNull()).distinct()
    parts = F.split(_DIR, "/")
    above = dirs.withColumn("k", F.explode(F.sequence(F.lit(0), F.size(parts)))).select(_DIR, F.array_join(F.slice(parts,
        1, F.col("k")), "/").alias("up"), "k")
    nearest = above.join(licensed, "up").groupBy(_DIR).agg(F.max_by(F.struct("license", "up"), "k").alias("near"))
    near = own.join(nearest.toDF(_DIR, _NEAR), _DIR, "left")
    out = near.withColumns({"license": F.coalesce("own_license", f"{_NEAR}.license"),
        "inherited_from": F.when(F.col("own_license").isNull(), F.col(f"{_NEAR}.up"))})
    return out.drop(_DIR, _NEAR)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: a directory for each source and range of ids, with a license file at each level."""
    i = F.col("doc_id")
    name = F.when(i % 20 == 0, "LICENSE").otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    deep = F.concat(F.lit("/r"), F.floor(i / 1000).cast("string"), F.when(i % 100 != 0, F.concat(F.lit("/r"),
        F.floor(i / 100).cast("string"))).otherwise(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", deep, F.lit("/"), name).alias("path"))
    return license_scan(docs).select("doc_id", "path", "own_license", F.round("own_score", 6).alias("own_score"), "license", "inherited_from")
