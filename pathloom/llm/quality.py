"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

``line_labels`` decodes the two labels of a document's lines with Viterbi; ``assess`` adds word statistics and the verdict: a document is
kept if it passes the base rules and lines marked content hold at least ``min_content_share`` of its words.

The field is fitted with stochastic gradient ascent on at most ``MAX_LABELLED`` labelled documents, those with the smallest hash of their id
(a bounded sample, which is a documented parameter), with all their lines; every line of a document gets the document's label. The driver gets
two bytes for each line, its features, and no texts. Without both labels present, fixed weights hold.

Defined cases: null text counts as empty; a text without words has content share 0 and fails the base rule on length; repeated rows are
assessed alike; an empty table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, python_stage

#: Most labelled documents used for fitting.
MAX_LABELLED = 2000
MIN_CONTENT_SHARE = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Phrases that mark notices rather than prose.
NOTICE = re.compile(r"licen[sc]ed? |copyright|all rights reserved|terms of (?:use|service)|cookie|subscribe|click here|privacy policy", re.I)

FEATURES = (
    "bias", "one word", "2-4 words", "5-9 words", "20 words or more", "symbols over 2 %", "symbols over 8 %", "half of the letters upper case",
    "digits over 20 %", "few distinct words", "line seen before", "a notice", "ends a sentence", "word repeated at once", "first line", "last line",
)
#: Weights for content against boilerplate where there are no labels to learn from.
DEFAULT = np.array([1.5, -1.0, -0.3, 0.2, 1.0, -1.5, -1.5, -2.0, -1.0, -2.0, -1.5, -1.5, 0.7, -1.5, 0.0, 0.0])
DEFAULT_STAY = 0.6


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split knows just these blanks."""
    return text.encode("utf-8", "replace").split()


def lines_of(text: str) -> list[tuple[str, list[bytes]]]:
    """The lines that have a word, with their words."""
    return [(line, ws) for line in text.split("\n") if (ws := words(line))]


def features(lines: list[tuple[str, list[bytes]]]) -> np.ndarray:
    """One row of 0/1 features for each line."""
    out = np.zeros((len(lines), len(FEATURES)), np.float64)
    seen: set[str] = set()
    for i, (line, ws) in enumerate(lines):
        n, size = len(ws), len(line)
        symbols = sum(map(line.count, SYMBOLS))
        letters = sum(map(str.isalpha, line)) if line.upper() == line else 0
        upper = letters and line.lower() != line
        digits = sum(map(line.count, "0123456789"))
        out[i] = (
            1, n == 1, 2 <= n <= 4, 5 <= n <= 9, n >= 20, symbols > 0.02 * size, symbols > 0.08 * size, bool(upper) or _mostly_upper(ws),
            digits > 0.2 * size, n >= 4 and len(set(ws)) < 0.5 * n, line in seen, NOTICE.search(line) is not None, line.rstrip().endswith((".", "!", "?", ":")),
            n >= 4 and sum(a == b for a, b in zip(ws, ws[1:], strict=False)) > 0.2 * n, i == 0, i == len(lines) - 1,
        )
        seen.add(line)
    return out


def _mostly_upper(ws: list[bytes]) -> bool:
    return 2 * sum(w == w.upper() and w != w.lower() for w in ws) > len(ws)


def viterbi(scores: np.ndarray, stay: float) -> list[bool]:
    """Best labels (True: content) where a line's score favours content by ``scores`` and equal neighbours gain ``stay``.

    Ties go to content.
    """
    content, junk, back = 0.0, 0.0, []
    for s in scores.tolist():
        from_content = (content + stay >= junk, content > junk + stay)
        content, junk = max(content + stay, junk) + s, max(junk + stay, content)
        back.append(from_content)
    label, out = content >= junk, []
    for to_content, to_junk in reversed(back):
        out.append(label)
        label = to_content if label else to_junk
    return out[::-1]


def packed(text: str) -> bytes:
    """The features of a text's lines, two bytes a line."""
    lines = lines_of(text)
    return np.packbits(features(lines).astype(bool), axis=1).tobytes() if lines else b""


def unpacked(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, 2), axis=1).astype(np.float64)


def fit(samples: list[tuple[bytes, int]], epochs: int = 6, rate: float = 0.2, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and the gain of equal neighbours, by gradient ascent on the conditional log-likelihood of (packed features, label)."""
    data = [(unpacked(lines), float(label)) for lines, label in samples if lines]
    if len({label for _, label in data}) < 2:
        return DEFAULT.copy(), DEFAULT_STAY
    weight, stay = DEFAULT.copy(), DEFAULT_STAY
    share = sum(label for _, label in data) / len(data)
    order = np.random.default_rng(7)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for k in order.permutation(len(data)):
            x, label = data[k]
            each = (0.5 / share if label else 0.5 / (1 - share)) / math.sqrt(len(x))
            content, equal = _marginals(x @ weight, stay)
            weight += step * (each * ((label - content) @ x) - penalty * weight)
            stay += step * (each * (len(x) - 1 - equal) - penalty * stay)
            stay = min(max(stay, 0.0), 3.0)
    return weight, stay


def _marginals(scores: np.ndarray, stay: float) -> tuple[np.ndarray, float]:
    """By the forward-backward algorithm: probability of content for each line; expected number of equal neighbours."""
    n, e = len(scores), math.exp(stay)
    s = np.exp(np.clip(scores, -30, 30)).tolist()
    forward, backward = [(0.0, 0.0)] * n, [(1.0, 1.0)] * n
    a, b = s[0], 1.0
    forward[0] = (a / (a + b), b / (a + b))
    for i in range(1, n):
        p, q = forward[i - 1]
        a, b = (p * e + q) * s[i], q * e + p
        forward[i] = (a / (a + b), b / (a + b))
    for i in range(n - 2, -1, -1):
        p, q = backward[i + 1][0] * s[i + 1], backward[i + 1][1]
        a, b = p * e + q, q * e + p
        backward[i] = (a / (a + b), b / (a + b))
    content, equal = np.empty(n), 0.0
    for i in range(n):
        p, q = forward[i][0] * backward[i][0], forward[i][1] * backward[i][1]
        content[i] = p / (p + q)
        if i:
            p, q = forward[i - 1]
            u, v = backward[i][0] * s[i], backward[i][1]
            same, other = e * (p * u + q * v), q * u + p * v
            equal += same / (same + other)
    return content, equal


def line_labels(text: str, weight: np.ndarray, stay: float) -> tuple[list[tuple[str, list[bytes]]], list[bool]]:
    lines = lines_of(text)
    return lines, viterbi(features(lines) @ weight, stay) if lines else []


def repeated_words(ws: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text has at least twice."""
    n = len(ws) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws))
    key = a[:n].copy()
    for k in range(1, width):  # ranks of longer and longer windows: no product of ids can overflow
        key = np.unique(key * len(ids) + a[k : n + k], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(ws), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    ws = words(text)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(ws), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ws)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[tuple[bytes, int]]:
    """(packed features, quality) of at most ``most`` labelled documents: those whose ids have the smallest hashes."""
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").alias("__label"))
    chosen = chosen.groupBy("doc_id").agg(F.max("__label").alias("__label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen has `most` rows at most

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for by_id, by_text, text, label in rows:
            yield by_id, by_text, packed(text), int(label > 0)

    found = found.select(F.xxhash64("doc_id"), F.xxhash64("text"), F.coalesce("text", F.lit("")), F.col("__label").cast("long"))
    rows = map_rows(found, "by_id long, by_text long, lines binary, label int", each)
    return [(bytes(r["lines"]), r["label"]) for r in rows.orderBy("by_id", "by_text", "lines").limit(most).collect()]


def verdict(text: str, model: tuple[np.ndarray, float], min_content_share: float = MIN_CONTENT_SHARE) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_lines, content_share."""
    n, *rest = statistics(text)
    lines, labels = line_labels(text, *model)
    content = sum(len(ws) for (_, ws), label in zip(lines, labels, strict=True) if label)
    share = content / n if n else 0.0
    failed = n < MIN_WORDS or 100 * rest[-1] > MAX_REPEAT_PERCENT * n
    return n, *rest, failed, not failed and share >= min_content_share, sum(labels), share


def assess(docs: DataFrame, model: tuple[np.ndarray, float], min_content_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """doc_id and the ``verdict`` on each row of ``docs`` (doc_id, text)."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, *verdict(text, model, min_content_share)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_lines long, content_share double"
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))), schema, each)


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], min_content_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is kept. Row by row: no join, no shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([verdict(text or "", model, min_content_share)[6] for text in batch.column(at).to_pylist()], pa.bool_()))

    python_stage(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled sample, then ``assess`` every document."""
    return assess(docs, fit(labelled_sample(docs, labels)))
