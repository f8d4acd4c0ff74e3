import math
from collections import Counter

import pytest

from pathloom.llm import license_scan as ls

MIT = next(t for n, t in ls.TEMPLATES if n == "MIT" and len(t) > 100)
FILES = [
    (1, "a/LICENSE", MIT), (2, "a/x.py", "print()"), (3, "a/b/c/y.py", "code\n\nmore"), (4, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (5, "a/b/c/d/z.py", ""),
    (6, "q/w.py", None), (7, "a/b/own.py", "# head\nReleased under the MIT License.\nbody " * 3), (8, "COPYING", "This work is licensed under the GNU General Public License, version 3."), (9, None, "x"),
    (10, "e/LICENSE", "words without any meaning here"), (11, "e/f.py", "a licence is not named here, only this long sentence about other things entirely"), (12, "e/f.py", "a licence is not named here, only this long sentence about other things entirely"),
    (13, "g/LICENSE", "Licensed under CC BY-NC 4.0."), (14, "g/NOTICE", MIT), (15, "g/h", "zz"), (None, "a/n.py", "n"),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(*f, "c") for f in FILES], "doc_id long, path string, text string, license string")
    return {(r["doc_id"], k): r for k, r in enumerate(sorted(ls.license_scan(df).collect(), key=lambda r: r["doc_id"] or 0))}


def test_inheritance(found):
    got = {d: (r["license"], r["origin"], r["from_dir"]) for (d, _), r in found.items()}
    assert got[1] == ("MIT", "own", None) and got[2] == ("MIT", "inherited", "a") and got[3] == ("Apache-2.0", "inherited", "a/b") and got[5] == ("Apache-2.0", "inherited", "a/b")
    assert got[6] == ("GPL-3.0", "inherited", "") and got[7] == ("MIT", "own", None) and got[9] == ("GPL-3.0", "inherited", "") and got[11] == got[12] == ("GPL-3.0", "inherited", "")
    assert got[15][0] in ("CC-BY-NC-4.0", "MIT") and got[None] == ("MIT", "inherited", "a") and len(found) == len(FILES)


def brute_cosine(text, template, total, counts):
    a, b = Counter(ls.words(text)), Counter(ls.words(template))
    known = {w for _, t in ls.TEMPLATES for w in ls.words(t)}
    idf = lambda w: math.log((1 + total) / (1 + counts.get(w, 0))) + 0.1 if w in known else math.log1p(total)
    vector = lambda c: {w: (1 + math.log(n)) * idf(w) for w, n in c.items()}
    x, y = vector(a), vector(b)
    return sum(x[w] * y[w] for w in x.keys() & y.keys()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_cosine_by_brute_force():
    total, counts = 50, {"license": 7, "the": 40, "version": 9}
    matcher = ls.Matcher(total, counts)
    for text in (MIT[:150], "Licensed under the Apache License, Version 2.0 and more words", "the license"):
        name, score = matcher.best(text)
        every = [(brute_cosine(text, t, total, counts), n) for n, t in ls.TEMPLATES]
        assert score == pytest.approx(max(every)[0]) and name in {n for s, n in every if s == pytest.approx(score)}


def test_document_frequencies(docs, rows):
    total, counts = ls.document_frequencies(docs)
    known = {w for _, t in ls.TEMPLATES for w in ls.words(t)}
    expected = Counter(w for _, t in rows for w in known & set(ls.words(t or "")))
    assert total == len(rows) and counts == dict(expected)


def test_documents_with_notices(spark, sf_dir):
    from pathloom.llm.queries import op1_license_scan

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    own = {r["doc_id"] for r in op1_license_scan(spark, sf_dir).where("origin = 'own'").collect()}
    assert own == {d for d, t in texts.items() if "icensed under" in t or "MIT License" in t}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, path string, text string")
    assert ls.license_scan(df).count() == 0


GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
HEADER = "\n".join(f"# {line}" if line else "" for line in ("Copyright 2020 Someone", "", "Permission is hereby granted, free of charge, to any person obtaining a copy", "", "of this software and associated documentation files (the Software), to deal in the", "", "Software without restriction, including without limitation the rights to use, copy,", "", "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."))
TOLD_APART = [
    (GPL.format("General Public License", "2"), "GPL-2.0"), (GPL.format("General Public License", "3"), "GPL-3.0"), (GPL.format("Lesser General Public License", "2.1"), "LGPL-2.1"),
    (GPL.format("Affero General Public License", "3"), "AGPL-3.0"), (ls._BSD, "BSD-2-Clause"), (ls._BSD + ls._BSD_NAMES, "BSD-3-Clause"), (ls._BSD + "\n\n" + ls._BSD_NAMES, "BSD-3-Clause"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"), ("Licensed under CC BY 3.0.", "CC-BY-3.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY 2.5.", None), ("Licensed under the Apache Software License, Version 1.1.", "Apache-1.1"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Not licensed under the MIT License.", None), ("This is not released under the MIT License.", None), ("Released under the MIT License.", "MIT"), ("", None), ("the the the", None),
    (HEADER + "\n\nimport os\n" + "x = 1\n" * 500, "MIT"), ("word " * 3000 + MIT.replace(" ", "\n\n") + " other" * 3000, "MIT"),
]


@pytest.mark.parametrize("text,expected", TOLD_APART)
def test_relatives_are_told_apart(text, expected):
    common = {"the": 900, "of": 900, "to": 900, "in": 900, "and": 900, "or": 700, "this": 700, "is": 800, "a": 900, "under": 300, "license": 60, "with": 800, "any": 400, "are": 700, "be": 700, "it": 800}
    assert ls.Matcher(1000, common).scan(text, False)[0] == expected


def test_what_is_passed_over_is_not_similar():
    matcher = ls.Matcher(50, {"license": 7, "the": 40, "version": 9})
    pieces = [t for _, t in ls.TEMPLATES] + ["the license of a thing", "version 2.0 of the software is free", "other words"]
    for k, text in enumerate(pieces):
        for passage in (ls.words(text), ls.words(text)[:4], ls.words(text + " " + pieces[k - 1])):
            assert {j for j, s in matcher.scores(passage).items() if s >= matcher.least} <= matcher.possible(set(passage))


def test_opening():
    assert ls.opening(["/* a", "b", "c */", "", "code"]) == "/* a\nb\nc */\n" and ls.opening(["code"]) == "" and ls.opening(["# a", "", "# b", "x"]) == "# a\n\n# b"
