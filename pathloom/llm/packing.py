"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed capacity.

Best fit looks only at lengths, so the packing of any number of documents follows from how many pieces there are of each length: at most
``capacity`` numbers. ``best_fit_plan`` works through them from long to short. A segment tree over the remaining capacities gives the tightest
open bin in logarithmic time; bins that are alike, and pieces of one length that fill them alike, are placed together as ranges. Its result
equals best fit decreasing piece by piece. Each piece then finds its place from its rank among the pieces of its length.

The ranks are counted within (length, bucket of the id) and shifted by the earlier buckets' counts. A length has a bucket for each
``BUCKET_ROWS`` pieces (more where there would be over ``MOST_BUCKETS``), so no length is gathered in one task however many pieces it has, and the
driver gets at most ``capacity + MOST_BUCKETS`` counts. The plan grows with the capacity and not with the input.

Defined cases: null text counts as empty, and an empty text is its end token alone; a text of more than ``capacity`` tokens is cut into full
pieces behind a first one that may be shorter; repeated rows are packed once each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, python_stage, written

CAPACITY = 1024
END_ID = 2
BUCKET_ROWS = 4096
MOST_BUCKETS = 100_000


class CapacityTree:
    """Segment tree over the remaining capacities 0..capacity; a leaf holds the ranges of bins with just that much left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, first: int, count: int) -> None:
        if count:
            self.bins[left].append((first, count))
            self._set(left, True)

    def take(self, left: int) -> tuple[int, int]:
        found = self.bins[left].pop()
        if not self.bins[left]:
            self._set(left, False)
        return found

    def _set(self, left: int, value: bool) -> None:
        i = left + self.size
        self.open[i] = value
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that some bin has."""
        i = length + self.size
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces in each bin, first bin, offset in the bin), in the order of their ranks."""
    tree, opened, plan = CapacityTree(capacity), 0, {}
    for length in sorted(counts, reverse=True):
        rows, rank, left = [], 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                first, many = opened, -(-left // (capacity // length))
                opened += many
            else:
                first, many = tree.take(room)
            each = room // length
            full = min(many, left // each)
            if full:
                rows.append((rank, each, first, capacity - room))
                tree.add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if many > full and left:  # fewer pieces than fill this bin
                rows.append((rank, left, first + full, capacity - room))
                tree.add(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            tree.add(room, first + full, many - full)
        plan[length] = np.array(rows, np.int64)
    return plan


#: Texts with longer runs go to the slower library, whose time for them is known to be in proportion.
LONGEST_RUN = 2000
_ENCODERS: dict[str, tuple] = {}


def encoder(vocabulary: str):
    """text -> ids of the byte-level BPE in the tokenizer file ``vocabulary``.

    ``tokenizers`` gives the ids. Its vocabulary also runs in ``tiktoken``, several times as fast and with the same ids for every
    text without special tokens (the tests compare them over all code points); texts with extreme runs of blanks or letters stay with the first.
    """
    if vocabulary not in _ENCODERS:
        import json
        import os

        import public_tokenizers
        import tiktoken

        fast, slow = None, []
        ranks = re.sub(r"\.json$", ".tiktoken", vocabulary)
        if ranks != vocabulary and os.path.exists(ranks):
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        with open(vocabulary, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f).get("added_tokens", [])]

        def exact(text: str) -> list[int]:
            """The first library, loaded when a text needs it: it takes as much memory as all the rest."""
            if not slow:
                from tokenizers import Tokenizer

                os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
                slow.append(Tokenizer.from_file(vocabulary))
            return slow[0].encode(text, add_special_tokens=False).ids

        def encode(text: str) -> list[int]:
            if fast is None or any(s in text for s in special) or _long_run(text):
                return exact(text)
            return fast.encode_ordinary(text)

        _ENCODERS[vocabulary] = (encode,)
    return _ENCODERS[vocabulary][0]


def _long_run(text: str) -> bool:
    if len(text) <= LONGEST_RUN:
        return False
    return " " * LONGEST_RUN in text or "\n" * LONGEST_RUN in text or max(map(len, text.split()), default=0) > LONGEST_RUN or max(map(len, re.findall(r"\s{100,}", text)), default=0) > LONGEST_RUN


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, the first may be shorter."""
    first = size % capacity or min(size, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, size, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's pieces."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        encode = encoder(vocabulary)
        for doc_id, text in rows:
            ids = np.array([*encode(text), end_id], "<u4")
            for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                own = ids[start : start + length]
                yield (doc_id, piece, start, length, zlib.crc32(own.tobytes())) + ((own.tolist(),) if with_ids else ())

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))), schema, each)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``parts``, which has doc_id, piece, start and length and is read more than once."""
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # capacity rows at most
    size = max(BUCKET_ROWS, -(-sum(counts.values()) // MOST_BUCKETS))
    buckets = np.array([-(-counts.get(n, 0) // size) for n in range(capacity + 1)], np.int64)
    # The buckets of all lengths side by side: length n has those from first[n] on.
    first = np.concatenate([[0], np.cumsum(buckets)])
    own = F.element_at(F.lit(np.maximum(buckets, 1).tolist()), (F.col("length") + 1).cast("int"))
    bucketed = parts.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), own))
    before = np.zeros(first[-1], np.int64)
    for length, bucket, count in bucketed.groupBy("length", "__bucket").count().collect():  # capacity + MOST_BUCKETS rows at most
        before[first[length] + bucket] = count
    upto = np.concatenate([[0], np.cumsum(before)])
    before = upto[:-1] - np.repeat(upto[first[:-1]], buckets)
    plan = best_fit_plan(counts, capacity)
    names = [c for c in parts.columns if not c.startswith("__")]
    order = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "start")
    ranked = bucketed.withColumn("__rank", F.row_number().over(order) - 1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(names).schema) + ", sequence_id long, offset long"
    at = names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, bucket, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (at, batch.num_columns - 2, batch.num_columns - 1))
            rank += before[first[length] + bucket]
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own, rows = length == n, plan[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
                j = rank[own] - row[:, 0]
                sequence[own], offset[own] = row[:, 2] + j // row[:, 1], row[:, 3] + j % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    python_stage(parts.sparkSession)
    return ranked.select(*names, "__bucket", "__rank").mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places; the pieces are written once to the shared folder, as they are read twice."""
    return pack(written(pieces(docs, vocabulary, capacity, end_id, with_ids)), capacity)
