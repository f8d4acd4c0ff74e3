import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathloom.llm import packing
from pathloom.llm.queries import vocabulary


def by_piece(lengths, capacity):
    left, n = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(left, length)
        n += i == len(left)
        bisect.insort(left, (left.pop(i) if i < len(left) else capacity) - length)
    return n, Counter(left)


@given(st.lists(st.integers(1, 40), max_size=200), st.integers(40, 64))
def test_plan_equals_best_fit_decreasing(lengths, capacity):
    counts = Counter(lengths)
    plan = packing.best_fit_plan(counts, capacity)
    held = defaultdict(list)
    for length, n in counts.items():
        rows = plan[length]
        for rank in range(n):
            first, each, sequence, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
            held[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    n, left = by_piece(lengths, capacity)
    assert len(held) == n and Counter(capacity - sum(x for _, x in p) for p in held.values()) == left


@pytest.mark.parametrize(("size", "expected"), [(1, [(0, 1)]), (4, [(0, 4)]), (5, [(0, 1), (1, 4)]), (8, [(0, 4), (4, 4)])])
def test_cut(size, expected):
    assert packing.cut(size, 4) == expected


def test_pieces_and_places(docs, rows):
    found = packing.best_fit_packing(docs, vocabulary()).collect()
    slow = Tokenizer.from_file(vocabulary())
    expected = Counter()
    for doc_id, text in rows:
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            expected[(doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == by_piece([r["length"] for r in found], 1024)[0]


def test_both_libraries_agree():
    """Over all code points, and on runs and special tokens."""
    slow, encode = Tokenizer.from_file(vocabulary()), packing.encoder(vocabulary())
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}, {chr(c)} {chr(c)}\n" for c in range(lo, lo + 512) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x20000, 512)]
    texts += [" " * 5000, "a" * 5000, "x<|endoftext|>y", "", "\n" * 3000 + "a", " \t \n  b"]
    assert [encode(t) for t in texts] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_and_empty(docs, empty):
    one = packing.best_fit_packing(docs.where("doc_id = 1000005"), vocabulary(), with_ids=True).collect()
    assert [len(r["ids"]) for r in one] == [r["length"] for r in one]
    assert packing.best_fit_packing(empty, vocabulary()).collect() == []


def test_many_buckets(spark, monkeypatch):
    """Lengths of many buckets, among them one that nearly all pieces have, are packed as with one bucket."""
    parts = spark.createDataFrame([(k, 0, 0, 7 if k % 9 else 1 + k % 13) for k in range(900)], "doc_id long, piece int, start long, length long")
    for rows, most in ((4096, 100_000), (8, 100_000), (8, 20)):
        monkeypatch.setattr(packing, "BUCKET_ROWS", rows)
        monkeypatch.setattr(packing, "MOST_BUCKETS", most)
        places = defaultdict(list)
        for r in packing.pack(parts, 20).collect():
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(places) == by_piece([7 if k % 9 else 1 + k % 13 for k in range(900)], 20)[0]
        for pieces in places.values():
            ends = [0, *(o + n for o, n in sorted(pieces))]
            assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 20
