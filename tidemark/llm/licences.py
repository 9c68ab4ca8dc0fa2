"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import PARTIAL_SUMS, SlotCounter, Workspace, session, sum_slots

# The notices by which the public licences are declared, and the openings of their texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
)


def _whole_texts() -> tuple[tuple[str, str], ...]:
    """The whole texts of licences, as their files have them."""
    names = ("MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0")
    texts = {n: pkgutil.get_data(__name__, f"licence_texts/{n}.txt").decode() for n in names}
    # the two that follow are others' texts but for a clause
    texts["BSD-2-Clause"] = re.sub(r"3\. Neither.*?permission\.\n", "", texts["BSD-3-Clause"], flags=re.DOTALL)
    remote = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this
License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely
through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source
of your version by providing access to the Corresponding Source from a network server at no charge, through some standard
or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source
for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following
paragraph.\n\n"""
    affero = re.sub(r"(?i)GNU General Public License", "GNU Affero General Public License", texts["GPL-3.0"])
    texts["AGPL-3.0"] = re.sub(r"13\. Use with the.*?(?=  Notwithstanding)", remote, affero, flags=re.DOTALL)
    return tuple(texts.items())


WHOLE_TEXTS = _whole_texts()
#: Least cosine of a match.
LEAST = 0.7
#: A document is a licence file if it matches as a whole, or if its best notice makes up at least this share of its words.
FILE_SHARE = 0.5
#: What every notice above holds some word of; blocks without are passed over.
CUE = re.compile(r"licen[sc]e|permission|redistribut|public domain|subject to the terms|free software", re.IGNORECASE)
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
TURN = re.compile(r"(?<=[.!?])\s+(?=[A-Z(])|\n\s*\n|\n")


def terms(text: str) -> list[str]:
    """Words and pairs of neighbours, so that 'BY-NC 4.0' and 'version 3' weigh as such."""
    words = WORD.findall(text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


VOCABULARY = {t: k for k, t in enumerate(sorted({t for _, text in TEMPLATES for t in terms(text)}))}
WHOLE_VOCABULARY = {t: k for k, t in enumerate(sorted({t for _, text in WHOLE_TEXTS for t in terms(text)}))}
#: Counter of each single word of the vocabularies, of which the documents that hold them are counted.
SLOT = {t: k for k, t in enumerate(sorted(t for t in {*VOCABULARY, *WHOLE_VOCABULARY} if " " not in t))}
WORDS = frozenset(SLOT)
#: Counters: one for each word, and the documents in the last one.
SLOTS = 1 << (len(SLOT) + 1).bit_length()


class Templates:
    """Unit TF-IDF vectors of the templates, as a term-by-template matrix."""

    def __init__(self, counts: np.ndarray, texts: Sequence[tuple[str, str]] = TEMPLATES, vocabulary: dict[str, int] = VOCABULARY):
        self.texts, self.vocabulary = texts, vocabulary
        docs = float(counts[SLOTS - 1])
        rare = lambda w: math.log((docs + 1) / (float(counts[SLOT[w]]) + 1)) + 1
        of = lambda t: sum(map(rare, t.split(" "))) / len(t.split(" "))
        self.idf = np.array([of(t) for t in vocabulary])
        self.unknown = math.log(docs + 1) + 1
        self.matrix = np.zeros((len(texts), len(vocabulary)))
        for k, (_, text) in enumerate(texts):
            for t, n in Counter(terms(text)).items():
                self.matrix[k, vocabulary[t]] = n * self.idf[vocabulary[t]]
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)

    def match(self, text: str) -> tuple[str, float]:
        """The best template's licence and the cosine; words outside the vocabulary count towards the length."""
        at, weights, rest = [], [], 0.0
        for t, n in Counter(terms(text)).items():
            k = self.vocabulary.get(t)
            if k is None:
                rest += (n * self.unknown) ** 2 if " " not in t else 0.0
            else:
                at.append(k)
                weights.append(n * self.idf[k])
        if not at:
            return "", 0.0
        w = np.array(weights)
        scores = self.matrix[:, at] @ w / math.sqrt(float(w @ w) + rest)
        best = int(scores.argmax())
        return self.texts[best][0], float(scores[best])


def may_match(text: str, vocabulary: dict[str, int], least: float) -> bool:
    """Whether a cosine of `least` is possible at all: no term weighs more than one outside the vocabulary does."""
    known = rest = 0
    for t, n in Counter(terms(text)).items():
        if t in vocabulary:
            known += n * n
        elif " " not in t:
            rest += n * n
    return known >= least**2 * (known + rest)


def blocks(text: str) -> list[str]:
    """What may be a notice: the sentences and lines of a text that hold a cue, each alone and with the next ones."""
    if not CUE.search(text):
        return []
    parts = [p for p in TURN.split(text) if p.strip()]
    out = []
    for k, p in enumerate(parts):
        if CUE.search(p):
            out += [" ".join(parts[k : k + n]) for n in (1, 2, 4) if k + n <= len(parts)] or [p]
            if k:
                out.append(" ".join(parts[k - 1 : k + 1]))
    return list(dict.fromkeys(out))


def wholes(text: str) -> Iterator[str]:
    """What may be the whole text of a licence inside another one: runs of parts from a cue on, half a run apart."""
    parts = [p for p in TURN.split(text) if p.strip()]
    cues = [k for k, p in enumerate(parts) if CUE.search(p)]
    for n in (4, 8, 16, 32):
        last = -n
        for k in cues:
            if k - last >= n // 2:
                yield " ".join(parts[k : k + n])
                last = k


def scan(df: DataFrame, ws: Workspace, key: str, path: Column, text: str, least: float) -> DataFrame:
    """One row per document with a notice: doc_id, path, licence, score, is_file.

    One pass over the texts counts in how many documents each vocabulary word stands (all documents) and keeps the
    blocks with a cue, and the whole of a text that may match as such or hold a licence's whole text; a second pass over
    those scores them. What matches as a whole is a licence file, of that licence; then come the whole texts of licences
    inside a document, then notices.
    """
    schema = f"doc_id long, path string, words long, block array<string>, whole string, {PARTIAL_SUMS}"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.binary())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = SlotCounter(SLOTS)
        for batch in batches:
            rows, slots = [], []
            for doc, where, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                t = x.as_py() or ""
                words = t.lower().split()
                slots += [SLOT[w] for w in {w.strip(".,;:()\"'") for w in set(words)} & WORDS]
                slots.append(SLOTS - 1)
                if found := blocks(t):
                    keep = may_match(t, VOCABULARY, least) or may_match(t, WHOLE_VOCABULARY, least) or any(may_match(w, WHOLE_VOCABULARY, least) for w in wholes(t))
                    rows.append((doc, where, len(words), found, t if keep else None, None, None, None))
            counter.add(np.array(slots, dtype=np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        sums = [(None, None, None, None, None, *r) for r in counter.rows()]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*sums, strict=True), kinds, strict=True)], names)

    docs = df.select(F.col(key).cast("long").alias("doc_id"), path.alias("path"), F.col(text).cast("string").alias("text"))
    gathered = ws.table(docs.mapInArrow(gather, schema), "gathered")
    counts = sum_slots(gathered.where("sums is not null").select("slice", "who", "sums"), SLOTS)
    templates = docs.sparkSession.sparkContext.broadcast(counts)  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, full = Templates(templates.value), Templates(templates.value, WHOLE_TEXTS, WHOLE_VOCABULARY)
        for batch in batches:
            rows = []
            for doc, where, words, found, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "path", "words", "block", "whole")], strict=True):
                if text is not None:
                    licence, value = max(known.match(text), full.match(text), key=lambda m: m[1])
                    if value >= least:
                        rows.append((doc, where, licence, value, True))
                        continue
                    licence, value = max((full.match(w) for w in wholes(text)), key=lambda m: m[1])
                    if value >= least:
                        rows.append((doc, where, licence, value, False))
                        continue
                best = max(((*known.match(b)[::-1], b) for b in found), key=lambda s: (s[0], -len(s[2]), s[1]))
                if best[0] >= least:
                    rows.append((doc, where, best[1], best[0], len(best[2].split()) >= FILE_SHARE * words))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "path", "licence", "score", "is_file"])

    some = gathered.where("sums is null").select("doc_id", "path", "words", "block", "whole")
    return ws.table(some.mapInArrow(score, "doc_id long, path string, licence string, score double, is_file boolean"), "scored")


def ancestors(path: Column) -> Column:
    """The directories above a path, the nearest last: a/b/c -> ['', 'a', 'a/b']."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def licence_documents(df: DataFrame, path: Column, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per input row: doc_id, licence, score, how ('file', 'header', 'inherited' or null), from_dir.

    A document's own licence comes first: that of its whole text, if its cosine to a template or a licence's whole text
    reaches `least`; else that of a licence's whole text inside it; else of its blocks, the one of largest cosine to a
    template (ties to the shorter block, then the later name). Documents without one inherit from the licence files in the nearest
    directory above them that has any; of several there, the best match counts (ties to the smaller id). Directories
    are joined by path: each document meets one row per directory above it, never other documents. Null texts and paths
    have no notice and no directory; rows that share an id share its best notice; repeated rows are kept; other columns
    are not read; an empty table gives an empty result.
    """
    ws = Workspace(session(df), "licences")
    scored = scan(df, ws, key, path, text, least)
    own = ws.table(scored.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("score", "licence", "is_file")).alias("_own")), "own")
    here = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "/$", "")
    files = scored.where("is_file and path is not null").select(here.alias("dir"), F.struct("score", (-F.col("doc_id")).alias("_i"), "licence").alias("_f"))
    files = ws.table(files.groupBy("dir").agg(F.max("_f").alias("_f")).select("dir", F.col("_f.licence").alias("_licence"), F.col("_f.score").alias("_score")), "files")
    rows = df.select(F.col(key).cast("long").alias("doc_id"), path.alias("path"))
    dirs = rows.where("path is not null").select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("dir"))
    nearest = dirs.join(files, "dir").groupBy("path").agg(F.max(F.struct(F.length("dir").alias("_d"), "dir", "_licence", "_score")).alias("_up"))
    nearest = ws.table(nearest, "nearest")
    out = rows.join(own, "doc_id", "left").join(nearest, "path", "left")
    o, up = F.col("_own"), F.col("_up")
    how = F.when(o.isNotNull(), F.when(o["is_file"], "file").otherwise("header")).when(up.isNotNull(), "inherited")
    return out.select("doc_id", F.coalesce(o["licence"], up["_licence"]).alias("licence"), F.coalesce(o["score"], up["_score"]).alias("score"), how.alias("how"), F.when(o.isNull(), up["dir"]).alias("from_dir"))
