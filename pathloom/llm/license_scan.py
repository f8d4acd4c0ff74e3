"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

``notices`` compares passages of each file with the templates as sparse TF-IDF vectors: its lines, its paragraphs, the comment that opens it, windows
of about a template's number of words (so a notice may be cut by blank lines or stand in a long line), and the whole text of a licence file. Document
frequencies of the templates' words come from all files. A passage that is similar enough gets a license only if the words that tell it from its
relatives (version, clauses, further conditions) are there and no denial is. ``inherit`` gives each file without a notice of its own the license of the
nearest directory above it that has a licence file: directories and their ancestors are joined by path, and only the table of directories is expanded.

What is not compared cannot be similar enough: by Cauchy and Schwarz, the squared weights of the words that a passage shares with a template add up to
the square of their cosine at least. So a text, or passage, whose shared words weigh less is passed over.

A licence file is one whose name says so (``LICENSE``, ``LICENCE``, ``COPYING``, ``NOTICE``, with any ending).

Defined cases: null text counts as empty and has no notice; null paths are files of the root; ties between templates go to the first name; of
several licence files in a directory the most similar counts, then the first name; repeated rows are judged alike; an empty table gives an empty
result; further columns are passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

LEAST_COSINE = 0.6

_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = (("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("AGPL", "Affero General Public License", ("3",)))
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_VERSIONS = {"3.0": "Unported", "4.0": "International"}


def _gnu(short: str, full: str, version: str) -> list[tuple[str, str]]:
    name = f"{short}-{version if '.' in version else version + '.0'}"
    return [
        (name, f"This work is licensed under the GNU {full}, version {version}."),
        (name, f"Licensed under the {short} version {version}."),
        (name, f"GNU {full} Version {version}"),
        (name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {full} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."),
    ]


#: Titles, notices and opening passages of well-known licenses.
TEMPLATES = (
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", "Released under the BSD License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD + _BSD_NAMES),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal."),
    *((f"CC-{k}-{v}", f"Licensed under CC {k} {v}.") for k in _CC for v in _CC_VERSIONS),
    *((f"CC-{k}-{v}", f"This work is licensed under a Creative Commons {_CC[k]} {v} {_CC_VERSIONS[v]} License.") for k in _CC for v in _CC_VERSIONS),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    *(t for short, full, versions in _GNU for v in versions for t in _gnu(short, full, v)),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
)


def _cc_marks(kind: str, version: str) -> tuple[str, str | None]:
    parts = {"SA": r"sharealike|share alike|sa", "NC": r"noncommercial|non commercial|nc", "ND": r"noderivatives|noderivs|no derivatives|no derivs|nd"}
    own = set(kind.split("-")[1:])
    wanted = "".join(rf"(?=.*\b(?:{parts[p]})\b)" for p in parts if p in own)
    return rf"{wanted}(?=.*\b{re.escape(version)}\b)(?=.*\b(?:cc|creative commons)\b)", rf"\b(?:{'|'.join(parts[p] for p in parts if p not in own)})\b" if len(own) < 3 else None


def _gnu_marks(short: str, version: str) -> tuple[str, str | None]:
    family = {"GPL": ("", r"\b(?:lesser|library|affero|lgpl|agpl)"), "LGPL": (r"(?=.*\b(?:lesser|library|lgpl))", r"\b(?:affero|agpl)"), "AGPL": (r"(?=.*\b(?:affero|agpl))", r"\b(?:lesser|lgpl)")}[short]
    number = re.escape(version) + ("" if "." in version else r"(?:\.0)?")
    return rf"{family[0]}(?=.*\b(?:version |{short.lower()} ?v? ?|v){number}(?![\w.]))", family[1]


#: What the words of a passage (lower case, joined by blanks) must match, and what they must not, to be of a license.
MARKS = {
    "Apache-1.1": (r"(?=.*\bapache\b)(?=.*\b1\.1\b)", None),
    "Apache-2.0": (r"(?=.*\bapache\b)(?=.*\b2(?:\.0)?\b)", r"\b1\.[01]\b"),
    "BSD-2-Clause": (r"(?=.*\b(?:2 clause|simplified)\b)|(?=.*\bredistributions\b)", r"\b(?:endorse|3 clause|4 clause)\b"),
    "BSD-3-Clause": (r"(?=.*\b(?:bsd|endorse)\b)", r"\b(?:2 clause|4 clause|simplified|advertising)\b"),
    "BSL-1.0": (r"(?=.*\bboost\b)", None),
    "CC0-1.0": (r"(?=.*\b(?:cc0|cc 0)\b)", None),
    **{f"CC-{k}-{v}": _cc_marks(k, v) for k in _CC for v in _CC_VERSIONS},
    "EPL-2.0": (r"(?=.*\beclipse\b)(?=.*\b2(?:\.0)?\b)", None),
    **{f"{short}-{v if '.' in v else v + '.0'}": _gnu_marks(short, v) for short, _, versions in _GNU for v in versions},
    "ISC": (r"(?=.*\bisc\b)|(?=.*\bpermission to use copy\b)", None),
    "MIT": (r"(?=.*\bmit\b)|(?=.*\bfree of charge\b)", None),
    "MPL-2.0": (r"(?=.*\bmozilla\b)(?=.*\b2(?:\.0)?\b)", None),
    "Unlicense": (r"(?=.*\bunencumbered\b)", None),
    "Zlib": (r"(?=.*\b(?:zlib|misrepresented|authors)\b)", None),
}
#: A license whose text holds that of another: where both are found, the fuller one counts.
FULLER = {"BSD-2-Clause": "BSD-3-Clause"}
DENIED = re.compile(r"\b(?:not|never|nor|neither|isn t|aren t) (?:\S+ ){0,2}?(?:licensed|released|distributed|covered|governed|available)\b")
_COMMENT = re.compile(r"[ \t]*(?:#|//|/\*|\*|--|;|%|<!--|$)")
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def document_frequencies(files: DataFrame, templates: tuple = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of files, and of those with each word of the templates. Each batch leaves one row a word."""
    known = frozenset(w for _, t in templates for w in words(t))

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        total, counts = 0, Counter()
        for (text,) in rows:
            total += 1
            counts.update(known.intersection(_WORD.findall(text.lower())))
        yield from [("", total), *counts.items()]

    found = map_rows(files.select(F.coalesce("text", F.lit(""))), "word string, n long", each).groupBy("word").agg(F.sum("n").alias("n"))
    counts = {r["word"]: r["n"] for r in found.collect()}  # as many rows as the templates have words
    return counts.pop("", 0) or 0, counts


class Matcher:
    """Cosine of sparse TF-IDF vectors with the templates, over an index from word to templates."""

    def __init__(self, total: int, counts: dict[str, int], templates: tuple = TEMPLATES, least: float = LEAST_COSINE):
        self.names, self.least = [name for name, _ in templates], least
        self.sizes = [len(words(t)) for _, t in templates]
        self.marks = {n: (re.compile(wanted), re.compile(barred) if barred else None) for n, (wanted, barred) in MARKS.items()}
        self.unseen = math.log1p(total)
        self.idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 0.1 for _, t in templates for w in words(t)}
        self.index: dict[str, list[tuple[int, float]]] = {}
        for k, (_, text) in enumerate(templates):
            vector = self._vector(Counter(words(text)))
            norm = math.sqrt(sum(v * v for v in vector.values()))
            for w, v in vector.items():
                self.index.setdefault(w, []).append((k, v / norm))

    def _vector(self, tf: Counter) -> dict[str, float]:
        return {w: (1 + math.log(n)) * self.idf.get(w, self.unseen) for w, n in tf.items()}

    def scores(self, passage: Iterable[str]) -> dict[int, float]:
        """Cosine with each template that shares a word."""
        vector = self._vector(Counter(passage))
        dots: dict[int, float] = {}
        for w, v in vector.items():
            for k, u in self.index.get(w, ()):
                dots[k] = dots.get(k, 0.0) + u * v
        norm = math.sqrt(sum(v * v for v in vector.values())) if dots else 1.0
        return {k: s / norm for k, s in dots.items()}

    def best(self, text: str) -> tuple[str | None, float]:
        """The most similar template, whatever its score and marks."""
        found = self.scores(words(text))
        if not found:
            return None, 0.0
        score, k = max((round(s, 12), -k) for k, s in found.items())
        return self.names[-k], found[-k]

    def possible(self, held: Iterable[str]) -> set[int]:
        """Templates that a passage with no words but those ``held`` (distinct ones) can be similar enough to."""
        shared: dict[int, float] = {}
        for w in held:
            for k, u in self.index.get(w, ()):
                shared[k] = shared.get(k, 0.0) + u * u
        return {k for k, s in shared.items() if s >= self.least * self.least - 1e-9}

    def judged(self, passage: tuple[str, ...], before: tuple[str, ...] = ()) -> dict[str, float]:
        """Licenses of a passage with their scores; ``before`` are words that stand in front of it, where a denial may begin."""
        if not self.possible(set(passage)):
            return {}
        found: dict[str, float] = {}
        for k, score in self.scores(passage).items():
            if score >= self.least:
                found[self.names[k]] = max(found.get(self.names[k], 0.0), score)
        if not found:
            return found
        joined = " ".join(passage)
        if DENIED.search(" ".join((*before, joined))):
            return {}
        marks = ((n, *self.marks.get(n, (None, None))) for n in found)
        return {n: found[n] for n, wanted, barred in marks if (not wanted or wanted.match(joined)) and not (barred and barred.search(joined))}

    def scan(self, text: str, whole: bool) -> tuple[str | None, float]:
        """The license of the most similar passage; with ``whole`` the text itself is one."""
        every = words(text)
        templates = self.possible(set(every))
        if not templates:
            return None, 0.0
        lines = text.split("\n")
        passages = {tuple(words(x)) for x in (*lines, *re.split(r"\n[ \t\r]*\n", text), opening(lines))}
        if whole:
            passages.add(tuple(every))
        found: dict[str, float] = {}
        for given in ((p, ()) for p in passages), self._windows(every, templates):
            for passage, before in given:
                for name, score in self.judged(passage, before).items():
                    found[name] = max(found.get(name, 0.0), score)
        for name, fuller in FULLER.items():
            if fuller in found:
                found.pop(name, None)
        score, name = min(((-round(s, 12), n) for n, s in found.items()), default=(0.0, None))
        return name, -score

    def _windows(self, every: list[str], templates: set[int]) -> Iterator[tuple[tuple[str, ...], tuple[str, ...]]]:
        """Windows of the words, and four words before each, as long as the longer of ``templates`` (up to a quarter), a quarter of their length apart."""
        sizes = {-(-self.sizes[k] // 8) * 8 for k in templates if self.sizes[k] > 12}
        for size in sorted(sizes):
            for at in range(0, max(1, len(every) - size + size // 4), size // 4):
                yield tuple(every[at : at + size]), tuple(every[max(0, at - 4) : at])


def opening(lines: list[str]) -> str:
    """The comment that opens a text, blank lines in it included; lines of an open block comment need no mark."""
    taken, close = [], ""
    for line in lines:
        shown = line.strip()
        if not close and not _COMMENT.match(line.rstrip()) and not shown.startswith(('"""', "'''")):
            break
        taken.append(line)
        for begin, end in (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''")):
            if not close and shown.startswith(begin) and end not in shown[len(begin) :]:
                close = end
                break
            if close == end and end in shown:
                close = ""
                break
    return "\n".join(taken)


def is_license_file(path: Column) -> Column:
    return F.rlike(F.element_at(F.split(path, "/"), -1), F.lit(r"^(?i:licen[cs]e|copying|notice)(?:[.-].*)?$"))


def notices(files: DataFrame, least: float = LEAST_COSINE, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, path, dir, license_file, own_license, own_score for each of ``files`` (doc_id, path, text)."""
    total, counts = document_frequencies(files, templates)

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        matcher = Matcher(total, counts, templates, least)
        for doc_id, path, folder, license_file, text in rows:
            name, score = matcher.scan(text, license_file)
            yield doc_id, path, folder, license_file, name, score if name else None

    path = F.coalesce("path", F.lit(""))
    folder = F.regexp_replace(path, "/?[^/]*$", "")
    rows = files.select(F.col("doc_id").cast("long"), path.alias("path"), folder.alias("dir"), F.coalesce(is_license_file(path), F.lit(False)), F.coalesce("text", F.lit("")))
    return map_rows(rows, "doc_id long, path string, dir string, license_file boolean, own_license string, own_score double", each)


def inherit(found: DataFrame) -> DataFrame:
    """``found`` (a written table from ``notices``) with license, origin (own, inherited or none) and from_dir."""
    holders = found.where("license_file and own_license is not null").groupBy("dir", "own_license").agg(F.max("own_score").alias("own_score"))
    holders = holders.groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("own_score"), "own_license")).alias("dir_license")).withColumnRenamed("dir", "from_dir")
    # A directory's ancestors: itself, its parents, and the root.
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = found.select("dir").distinct().select("dir", F.posexplode(F.array_distinct(ancestors)).alias("depth", "from_dir"))
    nearest = dirs.join(holders, "from_dir").groupBy("dir").agg(F.max_by(F.struct("dir_license", "from_dir"), "depth").alias("near"))
    # A written table: its size decides about a broadcast, and otherwise a hot directory's rows can be split by adaptive execution.
    out = found.join(written(nearest), "dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select(
        "doc_id", "path", "license_file", "own_license", "own_score",
        F.coalesce("own_license", "near.dir_license").alias("license"),
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("near.from_dir")).alias("from_dir"),
    )


def license_scan(files: DataFrame) -> DataFrame:
    return inherit(written(notices(files)))
