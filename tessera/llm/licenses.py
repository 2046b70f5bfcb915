"""License scans: TF-IDF cosine to templates, then inheritance from directories.

Passages of a text are its lines, its paragraphs of several lines (a line without
terms ends one), and, for files that are named as licences, the whole text.  Each
passage is compared with each template: terms are weighed by their inverse frequency
among all lines of the corpus, and the cosine of the sparse vectors must reach
``least``.  A passage that matches must also hold one of the template's terms that no
other licence's templates have, or, where there is none, half of the template's
squared weights, so that wording which licences share names none.  No word list decides which passages are looked at: as a cosine is
at most the root of the share of a template's squared weights that the passage's terms
carry, passages below ``least`` by that bound are left out, and none other.

A file without a licence of its own inherits that of the nearest ancestor directory
that holds a licence file; distinct directories are joined with their ancestors'
licences by path.  A licence file is one whose name says so (LICENSE, LICENCE,
COPYING, NOTICE, with any extension), or that has a line feed and all words in
passages that match one licence; of a paragraph, only words that this licence's
templates have count.

Terms are runs of letters, digits, ``_`` and bytes beyond ASCII, joined by ``.`` or
``-``, with A-Z lower-cased; each is a 64-bit hash.

Defined results: a null or empty text has no licence of its own; a null path has no
directory and inherits nothing; of several own licences the best score counts, ties
by name; of several licence files in one directory likewise; repeated rows are
judged alike; extra columns stay; an empty table gives none.

Templates are a parameter of bounded size.  The frequencies of all terms are counted
by term and written to the shared folder as sorted hashes in PARTS files, which tasks
map and search; none are collected or broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise, often_and_seldom, pieces, read_file, shared_folder, text_buffer, write_file
from tessera.llm.words import LOWER, SPACE, find_words, hash_words

LEAST = 0.5
#: Distinct terms whose counts a task holds before it sends them on, and files of the frequencies.
MOST_COUNTED, PARTS = 500_000, 64
#: Key of the number of lines among the frequencies.
_LINES = 0
#: Notices of common licences, in the wording that files carry.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD-3-Clause": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
}
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)([.-][^/]*)?$"
_WORD = np.array([chr(i).isalnum() and i < 128 or i == 95 or i >= 128 for i in range(256)])
_JOIN = np.array([i in b".-" for i in range(256)])


class Terms:
    """Hashes of the terms of a buffer of texts, in order, with their text, line (unique in the buffer) and paragraph."""

    def __init__(self, column: pa.Array):
        data, offsets = text_buffer(column)
        inside, joins = _WORD[data], _JOIN[data]
        if len(data):
            joins[1:] &= inside[:-1]
            joins[:-1] &= inside[1:]
            edges = offsets[(offsets > 0) & (offsets < len(data))]
            joins[edges] = joins[edges - 1] = joins[0] = joins[-1] = False
        low = np.where(inside | joins, LOWER[data], np.uint8(32))
        start, end, self.ptr = find_words(low, offsets, SPACE)
        self.hash = hash_words(low, start, end)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.ptr))
        self.line = np.cumsum(data == 10)[start] + self.text if len(start) else start
        new = np.ones(len(start), bool)
        new[1:] = (self.text[1:] != self.text[:-1]) | (self.line[1:] - self.line[:-1] > 1)
        self.paragraph = np.cumsum(new)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins, and the end."""
    return np.concatenate((np.flatnonzero(np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1]))), [len(values)]))


def _distinct(unit: np.ndarray, hash: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (unit, hash), by unit, and how often each occurs."""
    order = np.lexsort((hash, unit))
    unit, hash = unit[order], hash[order]
    new = np.ones(len(unit), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (hash[1:] != hash[:-1])
    at = np.flatnonzero(new)
    return unit[at], hash[at], np.diff(np.append(at, len(unit)))


def count_terms(lines: DataFrame) -> DataFrame:
    """(key, n) over a DataFrame of one text column: the lines that hold each term, in parts to be added up; key _LINES counts the lines."""

    text = lines.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = 0
        for batch in batches:
            for piece in pieces(iter([batch]), text):
                t = Terms(piece.column(0))
                total += len(_runs(t.line)) - 1
                _, hash, _ = _distinct(t.line, t.hash)
                own, n = np.unique(hash, return_counts=True)
                keys, back = np.unique(np.concatenate((keys, own)), return_inverse=True)
                counts = np.bincount(back, np.concatenate((counts, n)), minlength=len(keys)).astype(np.int64)
                if len(keys) > MOST_COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])
                    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys.view(np.int64), _LINES)), pa.array(np.append(counts, total))], names=["key", "n"])

    return lines.mapInArrow(run, "key long, n long")


def write_frequencies(counted: DataFrame, folder: str) -> Frequencies:
    """Write the counts of (key, n) rows, by the last bits of the keys, to PARTS sorted files in ``folder``."""

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        key = table.column("key").to_numpy()
        return pa.table({"part": pa.array([int(key[0]) % PARTS], pa.int32()), "file": [write_file(folder, np.concatenate((key, table.column("n").to_numpy())).tobytes())]})

    totals = counted.groupBy("key").agg(F.sum("n").alias("n")).withColumn("part", F.pmod("key", F.lit(PARTS)))
    return Frequencies({r["part"]: r["file"] for r in totals.groupBy("part").applyInArrow(write, "part int, file string").collect()})  # PARTS rows at most


class Frequencies:
    """Counts of terms, from files that write_frequencies wrote; only what is looked up is read."""

    def __init__(self, files: dict[int, str]):
        self.files = files
        self.parts: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return {"files": self.files, "parts": {}}

    def part(self, k: int) -> np.ndarray:
        if k not in self.parts:
            self.parts[k] = read_file(self.files[k]).view(np.int64).reshape(2, -1) if k in self.files else np.zeros((2, 0), np.int64)
        return self.parts[k]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The counts of ``keys``; 0 for those that weren't counted."""
        keys = keys.view(np.int64)
        out = np.zeros(len(keys), np.int64)
        part = keys % PARTS
        for k in np.unique(part):
            known, n = self.part(int(k))
            own = np.flatnonzero(part == k)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
                out[own] = np.where(known[at] == keys[own], n[at], 0)
        return out


class Matcher:
    """Templates as unit vectors, for given frequencies."""

    def __init__(self, templates: dict[str, list[str]], frequency: Frequencies, least: float):
        self.frequency, self.least = frequency, least
        self.lines = int(frequency.get(np.array([_LINES], np.int64))[0])
        self.names = [name for name, some in sorted(templates.items()) for _ in some]
        t = Terms(pa.array([x for _, some in sorted(templates.items()) for x in some], pa.string()))
        text, hash, n = _distinct(t.text, t.hash)
        self.terms, at = np.unique(hash, return_inverse=True)
        weight = n * self.idf(hash)
        norm = np.sqrt(np.bincount(text, weight**2, minlength=len(self.names)))
        self.weights = np.zeros((len(self.terms), len(self.names)))
        self.weights[at, text] = weight / np.maximum(norm, 1e-300)[text]
        which = np.unique(self.names, return_inverse=True)[1] if self.names else np.zeros(0, np.int64)
        has = np.zeros((len(self.terms), max(which, default=-1) + 1), bool)
        has[at, which[text]] = True
        self.of_licence = has[:, which]
        self.own = (self.weights > 0) & (has.sum(1) == 1)[:, None]  # a template's terms that are of one licence only
        self.any_own = self.own.any(0)

    def idf(self, hash: np.ndarray) -> np.ndarray:
        return np.log((1 + self.lines) / (1 + np.maximum(self.frequency.get(hash), 1))) + 1

    def scores(self, unit: np.ndarray, hash: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, score, template) of each unit that matches some template; of several the best, ties by name."""
        none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        if not len(self.terms) or not len(hash):
            return none
        at = np.minimum(np.searchsorted(self.terms, hash), len(self.terms) - 1)
        some = np.flatnonzero(self.terms[at] == hash)
        known, place, _ = _distinct(unit[some], at[some].astype(np.uint64))
        if not len(known):
            return none
        begin = _runs(known)[:-1]
        carried = np.add.reduceat(self.weights[place.astype(np.int64)] ** 2, begin)
        alive = known[begin][np.sqrt(carried.max(1)) >= self.least * (1 - 1e-9)]
        if not len(alive):
            return none
        chosen = np.flatnonzero(alive[np.minimum(np.searchsorted(alive, unit), len(alive) - 1)] == unit)
        unit, hash, n = _distinct(unit[chosen], hash[chosen])
        begin = _runs(unit)[:-1]
        weight = n * self.idf(hash)
        norm = np.sqrt(np.add.reduceat(weight**2, begin))
        at = np.minimum(np.searchsorted(self.terms, hash), len(self.terms) - 1)
        weight = np.where(self.terms[at] == hash, weight, 0.0)
        cosine = np.add.reduceat(weight[:, None] * self.weights[at], begin) / norm[:, None]
        there = (weight > 0)[:, None]
        holds = np.add.reduceat(self.own[at] & there, begin, dtype=np.int64) > 0
        half = np.add.reduceat(self.weights[at] ** 2 * there, begin) >= 0.5
        cosine = np.where(np.where(self.any_own, holds, half), cosine, 0.0).round(9)
        best = cosine.argmax(1)  # templates are in the order of their names
        top = cosine[np.arange(len(best)), best]
        good = top >= self.least
        return unit[begin][good], top[good], best[good]

    def has_term(self, hash: np.ndarray, template: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, hash), len(self.terms) - 1)
        return (self.terms[at] == hash) & self.of_licence[at, template]

    def judge(self, column: pa.Array, named: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """(licence, score, whether the text is a licence file) of each text."""
        t = Terms(column)
        texts = len(column)
        found = []  # (text, score, template, first term, end)
        begin = _runs(t.paragraph)
        several = np.repeat(t.line[begin[1:] - 1] > t.line[begin[:-1]], np.diff(begin))
        for unit, used in ((t.line, None), (t.paragraph, several), (t.text, named[t.text])):
            at = np.arange(len(unit)) if used is None else np.flatnonzero(used)
            u, score, template = self.scores(unit[at], t.hash[at])
            first, end = np.searchsorted(unit, u), np.searchsorted(unit, u, side="right")
            found.append((t.text[first] if len(u) else u, score, template, first, end, np.full(len(u), unit is t.line), np.full(len(u), unit is t.text)))
        text, score, template, first, end, is_line, whole = (np.concatenate(x) for x in zip(*found))
        names, scores, files = [None] * texts, np.zeros(texts), np.zeros(texts, bool)
        order = np.lexsort((template, -score, text))
        for i in order[_runs(text[order])[:-1]].tolist() if len(order) else ():
            k = int(text[i])
            names[k], scores[k] = self.names[template[i]], min(score[i], 1.0)
            covered = np.zeros(t.ptr[k + 1] - t.ptr[k], bool)
            for j in order[np.searchsorted(text[order], k) : np.searchsorted(text[order], k, side="right")].tolist():
                if self.names[template[j]] == names[k] and not whole[j]:
                    place = slice(first[j], end[j])
                    covered[place.start - t.ptr[k] : place.stop - t.ptr[k]] |= is_line[j] | self.has_term(t.hash[place], template[j])
            files[k] = named[k] or bool(covered.all() and "\n" in column[k].as_py())
        return names, scores, files


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` with license, license_score, license_from (own, the directory that it is inherited from, or null); columns of these names are replaced."""
    named = files.drop("license", "license_score", "license_from")
    # numbers for names, so that no column is named as one made here
    names, spark = named.columns, files.sparkSession
    kept = named.toDF(*[f"c{i}" for i in range(len(names))])
    path, text = (f"c{names.index(c)}" for c in (path, text))
    own = kept.withColumn("__named", F.coalesce(F.col(path).rlike(FILE_NAME), F.lit(False)))
    frequency = write_frequencies(count_terms(own.select(text)), f"{shared_folder(spark)}/frequencies-{uuid.uuid4().hex}")
    matcher = spark.sparkContext.broadcast(Matcher(TEMPLATES if templates is None else templates, frequency, least))  # as large as the templates

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            name, score, is_file = matcher.value.judge(batch.column(batch.schema.get_field_index(text)), np.asarray(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(name, pa.string()), pa.array(score), pa.array(is_file)], names=[*batch.schema.names[:-1], "license", "license_score", "__file"])

    judged = own.mapInArrow(judge, T.StructType([*kept.schema.fields, T.StructField("license", T.StringType()), T.StructField("license_score", T.DoubleType()), T.StructField("__file", T.BooleanType())]))
    judged = judged.withColumn("__dir", F.when(F.col(path).isNotNull(), F.when(F.col(path).contains("/"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)).otherwise(F.lit(""))))
    return inherit(judged, kept.columns, path).toDF(*names, "license", "license_score", "license_from")


def inherit(judged: DataFrame, columns: list[str], path: str = "path") -> DataFrame:
    """Give files without a licence that of the nearest ancestor directory with a licence file.

    Directories of many files are sent to these; the rows of all others are dealt by directory.
    """
    rank = F.when(F.col("__file") & F.col("license").isNotNull(), F.struct(-F.col("license_score"), "license"))
    directories = judged.filter("__dir IS NOT NULL").groupBy("__dir").agg(F.count_if(F.col("license").isNull()).alias("k"), F.min_by(F.struct("license", "license_score"), rank).alias("__found"))
    directories = materialise(directories, "directories")  # one row for each directory
    holding = directories.filter("__found IS NOT NULL").select(F.col("__dir").alias("__from"), "__found")
    parts = F.split("__dir", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    nearest = (
        directories.filter("k > 0").select("__dir", "k", F.posexplode(steps).alias("__depth", "__from")).join(holding, "__from")
        .groupBy("__dir").agg(F.max_by(F.struct("__from", "__found"), "__depth").alias("__near"), F.max("k").alias("k"))
    )
    nearest = materialise(nearest, "nearest")
    often, seldom = often_and_seldom(nearest, nearest.agg(F.sum("k")).first()[0] or 0)
    asks = F.col("license").isNull() & F.col("__dir").isNotNull()
    met = judged.join(F.broadcast(often.select(F.col("__dir").alias("__d1"), F.col("__near").alias("__n1"))), asks & (F.col("__dir") == F.col("__d1")), "left")
    plain = [c for c in columns if not isinstance(judged.schema[c].dataType, (T.MapType, T.VariantType))]
    # rows that ask nothing get keys that no directory has, each its own
    key = F.when(asks & F.col("__d1").isNull(), F.concat(F.lit("d"), "__dir")).otherwise(F.concat(F.lit("n"), F.xxhash64(*plain).cast("string")))
    met = met.withColumn("__key", key).join(seldom.select(F.concat(F.lit("d"), "__dir").alias("__key"), F.col("__near").alias("__n2")), "__key", "left").withColumn("__near", F.coalesce("__n1", "__n2"))
    return met.select(
        *columns,
        F.coalesce("license", "__near.__found.license").alias("license"),
        F.when(F.col("license").isNotNull(), F.col("license_score")).otherwise(F.col("__near.__found.license_score")).alias("license_score"),
        F.when(F.col("license").isNotNull(), "own").otherwise(F.col("__near.__from")).alias("license_from"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source is a tree, with one directory for each language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return scan(docs).select("doc_id", "path", "license", "license_score", "license_from")
