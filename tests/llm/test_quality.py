import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from pathloom.llm import quality
from pathloom.llm.common import table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics(docs, rows, spark, sf_dir):
    got = quality.quality_rules(docs, table(spark, sf_dir, "labels"))
    found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got.collect())
    expected = Counter()
    for doc_id, text in rows:
        s = brute(text)
        expected[(doc_id, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert found == expected


@pytest.mark.parametrize("text", ["", "a b c a b c", "a a a a", "x y", "\x0b\x0c\r\t", "a b  c", "é # $ |\né # $ |\n\n \n"])
def test_statistics_of_odd_texts(text):
    assert quality.statistics(text) == brute(text)


def test_viterbi_is_the_best_labelling():
    r = np.random.default_rng(2)
    for n in range(1, 9):
        scores, stay = r.normal(size=n), 0.7
        value = lambda y: sum(s for s, v in zip(scores, y, strict=True) if v) + stay * sum(a == b for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        assert value(quality.viterbi(scores, stay)) == pytest.approx(max(map(value, product((False, True), repeat=n))))


def test_marginals_by_enumeration():
    scores, stay = np.array([0.5, -1.0, 2.0, 0.1]), 0.4
    weights = {y: np.exp(sum(s for s, v in zip(scores, y, strict=True) if v) + stay * sum(a == b for a, b in zip(y, y[1:], strict=False))) for y in product((0, 1), repeat=4)}
    total = sum(weights.values())
    content, equal = quality._marginals(scores, stay)
    assert content == pytest.approx([sum(w for y, w in weights.items() if y[k]) / total for k in range(4)])
    assert equal == pytest.approx(sum(w * sum(a == b for a, b in zip(y, y[1:], strict=False)) for y, w in weights.items()) / total)


def test_held_out_accuracy(spark, sf_dir):
    """Fitted on half of the labelled documents, the verdict agrees with the labels of the other half."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(quality.labelled_sample(docs, labels.where("doc_id % 2 = 0")))
    rows = quality.assess(docs, model).join(labels, "doc_id").where("doc_id % 2 = 1 and not base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * max(1, len(bad))


def test_filter_keeps_columns_and_defaults(docs, empty):
    model = quality.fit([])
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.keep_good(empty, model).count() == 0 and quality.assess(empty, model).count() == 0
