"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary pieces in a text; dynamic programming carries the best score and its number of pieces to every
position. No tokens are built. Ties follow the unigram tokenizer: pieces that end in one place are tried from the longest, and only a strictly
better score replaces an earlier one; a character that no one-character piece covers may also be unknown, scored ten below the lowest piece, and
costs as many tokens as it has UTF-8 bytes.

Spaces become ``▁`` and the text gets one in front. No piece of the vocabulary has ``▁`` behind another character or holds a line feed (``Counter``
checks it), so the best path of a text is that of its parts, and counts of parts are remembered.

The vocabulary is read from a sentencepiece file; its pieces and scores make the unigram model, and byte pieces serve unknown characters.

Defined cases: null text counts as empty and an empty text has no tokens; repeated rows are counted alike; an empty table gives an empty result;
further columns are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

BLANK = "▁"
REMEMBERED = 1 << 19


def pieces_of(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) for all ids of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class _Remembered(dict):
    """Counts of parts, computed when first asked for."""

    def __init__(self, count, prefix: str):
        self.count, self.prefix = count, prefix

    def __missing__(self, part: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[part] = n = self.count(self.prefix + part)
        return n


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        scores: dict[str, float] = {}
        for piece, score in pieces:
            scores[piece] = score  # of equal pieces the last counts
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores.values()) - 10
        self.single = {p for p in scores if len(p) == 1}
        self.separable = not any("\n" in p or re.search(f"[^{BLANK}]{BLANK}", p) for p in scores)
        self.with_blank, self.bare = _Remembered(self.viterbi, BLANK), _Remembered(self.viterbi, "")

    def viterbi(self, text: str) -> int:
        """Pieces on the best path over ``text``, in which blanks are already replaced."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        matches = self.automaton.iter(text)
        end, found = next(matches, (n, None))
        single, unknown = self.single, self.unknown
        for k in range(n):
            best, pieces = None, 0
            while end == k:  # from the longest piece
                length, own = found
                s = score[k + 1 - length] + own
                if best is None or s > best:
                    best, pieces = s, count[k + 1 - length] + 1
                end, found = next(matches, (n, None))
            if text[k] not in single and (best is None or score[k] + unknown > best):
                best, pieces = score[k] + unknown, count[k] + len(text[k].encode("utf-8", "surrogatepass"))
            score[k + 1], count[k + 1] = best, pieces
        return count[n]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if not self.separable:
            return self.viterbi(BLANK + text.replace(" ", BLANK))
        total, first = 0, True
        for line in text.split("\n"):
            if not first:
                total += self.bare["\n"]
            if BLANK in line or "  " in line or line[:1] == " " or line[-1:] == " " or (first and not line):
                # runs of blanks belong together and to what follows
                whole = (BLANK if first else "") + line.replace(" ", BLANK)
                total += sum(map(self.viterbi, re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", whole)))
            elif line:
                words = line.split(" ")
                total += (self.with_blank if first else self.bare)[words[0]] + sum(map(self.with_blank.__getitem__, words[1:]))
            first = False
        return total


_counters: dict[str, Counter] = {}


def counter(model_file: str) -> Counter:
    if model_file not in _counters:
        _counters[model_file] = Counter(pieces_of(model_file))
    return _counters[model_file]


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, n_chars for every row of ``docs``."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        count = counter(model_file)
        for doc_id, text in rows:
            yield doc_id, count(text), len(text)

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))), "doc_id long, n_tokens long, n_chars long", each)
