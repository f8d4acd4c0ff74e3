"""Language-model scoring with a gated recurrent network.

The model factors a word's probability by classes: p(word | history) = p(class | history) p(word | class, history). A gated recurrent unit (numpy,
trained by truncated backpropagation through time) carries the document's history: its state goes across windows, from the document's first token
to its end. The first factor is a softmax of the state. So is the second for the classes of embedded words, each of which has a vector of its own
beside its training count; in the classes by spelling, whose words are rare, it is the share of the counts with one added.

* ``word_counts``: training counts of all words, exact, as a written table.
* ``frequent_words``: the dictionary, the ``DICTIONARY`` most frequent of them.
* ``encode``: every document as word ids (written once). Other words, the *tail*, are kept by spelling with their counts in the document.
* ``tail_logs``: tail words joined with their training counts; the join's hot words are split by adaptive execution.
* ``profiles``: training counts of dictionary words, and a random projection of the documents each one occurs in; k-means on these gives the
  classes of the ``EMBEDDED`` most frequent words. The others belong to classes by spelling.
* ``train``: rounds over disjoint parts of the training documents, each as large as those before together or larger. In a round every task
  trains a copy of the model on its documents, and the copies are averaged by their tokens. All training tokens are used, once.
* ``score``: log10 probabilities of whole documents, and the base score, a unigram model with one added.

What goes to the driver or into closures (dictionary, class profiles, parameters) is bounded by the constants below. Results depend slightly on
how rows are dealt to tasks, as averaging does; the base score does not.

Defined cases: null text counts as empty and is just an end token; ids are not assumed unique; a null doc_id counts as the text "" for the split
into training and held-out rows; without training rows the counts are zero and the network stays as initialised; an empty table gives an empty
result; further columns are passed over.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_bytes, words_of, written

DICTIONARY = 60_000
EMBEDDED = 4_000
WORD_CLASSES = 40
SPELLING_CLASSES = 8
PROFILE = 16
HIDDEN = 8
WINDOW = 32
TRAIN_WINDOW = 16
WORD_RATE = 0.25  # of the learning rate, for the vectors of words
STREAMS = 512
LEAST_STREAM = 2048
BUFFER_TOKENS = 4_000_000
FOLDS, HELD_OUT = 7, 2
#: Remainders of the training documents of each round.
ROUNDS = ((0,), (1, 3), (4, 5, 6))
END = 0
TAIL = DICTIONARY + 1  # ids from here on: tail words by spelling class
UNKNOWN = 65_535
CLASSES = 1 + WORD_CLASSES + SPELLING_CLASSES  # the end token is a class of its own
CHUNK = 4096  # parameters in a row while copies are averaged
SHARES = 32  # in which the copies are added up first
FLUSH = 1 << 18  # distinct words that a task holds while it counts


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % FOLDS


def spelling(word: bytes) -> int:
    """Class of a word by its last letters."""
    return zlib.crc32(word[-3:]) % SPELLING_CLASSES


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), text_bytes())


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the count of every word in training documents. A task hands on what it has counted whenever it holds ``FLUSH`` words; no count is lost."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        counts: Counter = Counter()
        for doc_id, text in rows:
            if fold(doc_id) != HELD_OUT:
                counts.update(words_of(text))
                if len(counts) >= FLUSH:
                    yield from counts.items()
                    counts.clear()
        yield from counts.items()

    return written(map_rows(_tokens(docs), "word binary, n long", each).groupBy("word").agg(F.sum("n").alias("n")))


def frequent_words(counts: DataFrame, most: int = DICTIONARY) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words with their counts, most frequent first; ties by spelling.

    Numbers of words by size class of the count (eight to a doubling) tell first which words can be among them, so that few are sorted.
    """
    size = F.floor(F.log2(F.col("n")) * 8).cast("int")
    least, upto = 0, 0
    for k, n in sorted(counts.groupBy(size).count().collect(), reverse=True):  # some hundred rows
        least, upto = k, upto + n
        if upto >= most:
            break
    top = written(counts.where(size >= least).orderBy(F.desc("n"), "word").limit(most))
    return sorted(((bytes(r["word"]), r["n"]) for r in top.collect()), key=lambda x: (-x[1], x[0]))


def encode(docs: DataFrame, dictionary: list[bytes]) -> DataFrame:
    """key (unique), doc_id, fold, n_tokens, ids (16-bit, the end token last), tail words with their counts."""
    index = {w: k for k, w in enumerate(dictionary, 1)}

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        key = TaskContext.get().partitionId() << 40
        for doc_id, text in rows:
            words = words_of(text)
            ids = np.fromiter(map(index.get, words, repeat(UNKNOWN)), np.uint16, len(words))
            other = np.nonzero(ids == UNKNOWN)[0]
            rare = [words[k] for k in other.tolist()]
            ids[other] = np.fromiter(map(spelling, rare), np.uint16, len(rare)) + TAIL
            tail = Counter(rare)
            yield key, doc_id, fold(doc_id), len(words) + 1, ids.tobytes() + b"\0\0", list(tail), list(tail.values())
            key += 1

    schema = "key long, doc_id long, fold int, n_tokens long, ids binary, tail array<binary>, tail_n array<int>"
    return written(map_rows(_tokens(docs), schema, each, chunk=1024))


def tail_logs(encoded: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """key, logs (sum of log10(count + 1) over the document's tail tokens), known (those with a count). ``most``: what a tail word counts at most."""
    rows = encoded.select("key", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("key", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("own"))
    met = rows.join(counts.where(F.col("n") <= most), "word", "left")
    logs = F.sum(F.col("own") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("logs")
    return met.groupBy("key").agg(logs, F.sum(F.when(F.col("n") > 0, F.col("own")).otherwise(0)).cast("long").alias("known"))


def distinct_by_spelling(counts: DataFrame) -> np.ndarray:
    """Number of words in each class by spelling."""
    letters = F.expr("substring(word, greatest(length(word) - 2, 1), 3)")
    out = np.zeros(SPELLING_CLASSES, np.int64)
    for k, n in counts.groupBy(F.pmod(F.crc32(letters), F.lit(SPELLING_CLASSES))).count().collect():
        out[k] = n
    return out


def profiles(encoded: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of all ids; for the embedded ones, the mean of the random projections of the documents they occur in."""
    total = TAIL + SPELLING_CLASSES
    top = min(size, EMBEDDED) + 1

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        project = np.random.default_rng(11).standard_normal((top, PROFILE)).astype(np.float32)
        counts, sums = np.zeros(total, np.int64), np.zeros((top, PROFILE))
        for held in _buffers((ids,) for part, ids in rows if part != HELD_OUT):
            for (a,) in held:
                seen, n = np.unique(a[a < top], return_counts=True)
                n = np.log1p(n).astype(np.float32)[:, None]
                vector = (n * project[seen]).sum(0)
                sums[seen] += n * (vector / (np.linalg.norm(vector) + 1e-9))
            counts += np.bincount(np.concatenate([a for (a,) in held]), minlength=total)
        for k in np.nonzero(counts)[0].tolist():
            yield k, int(counts[k]), sums[k].tolist() if k < top else None

    rows = map_rows(encoded.select("fold", "ids"), "id int, n long, v array<double>", each)
    found = rows.groupBy("id").agg(F.sum("n").alias("n"), *(F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(PROFILE))).collect()  # one row an id
    counts, vectors = np.zeros(total, np.int64), np.zeros((top, PROFILE))
    for k, n, *v in found:
        counts[k] = n
        if k < top:
            vectors[k] = v
    return counts, vectors


def word_classes(counts: np.ndarray, vectors: np.ndarray, dictionary: list[bytes]) -> np.ndarray:
    """Class of every id: 0 for the end; k-means on the profiles for embedded words; by spelling for all others."""
    out = np.zeros(len(counts), np.int64)
    for k in range(len(vectors), len(dictionary) + 1):
        out[k] = 1 + WORD_CLASSES + spelling(dictionary[k - 1])
    out[TAIL:] = 1 + WORD_CLASSES + np.arange(SPELLING_CLASSES)
    if len(vectors) > 1:
        x = vectors[1:] / (np.linalg.norm(vectors[1:], axis=1, keepdims=True) + 1e-9)
        w = np.log1p(counts[1 : len(vectors)])[:, None]
        order = np.random.default_rng(5)
        centre = x[order.choice(len(x), min(WORD_CLASSES, len(x)), replace=False)]
        for _ in range(20):
            own = np.argmax(x @ centre.T, axis=1)
            for c in range(len(centre)):
                if (own == c).any():
                    mean = (w * x)[own == c].sum(0)
                    centre[c] = mean / (np.linalg.norm(mean) + 1e-9)
        out[1 : len(vectors)] = 1 + own
    return out


class Network:
    """Gated recurrent unit from word ids to class probabilities. ``inputs`` maps an id to a row of the embedding.

    With ``counts`` of the first ids, the words of their classes also have probabilities of their own. Arrays of a window are (time, feature,
    stream), so that each feature's streams lie together.
    """

    def __init__(self, inputs: np.ndarray, classes: np.ndarray, prior: np.ndarray, counts: np.ndarray | None = None):
        g = np.random.default_rng(3)
        rows = int(inputs.max()) + 1
        self.inputs, self.classes = inputs.astype(np.uint16), classes
        self.shapes = [(rows, 3 * HIDDEN), (3 * HIDDEN, HIDDEN), (CLASSES, HIDDEN), (CLASSES,)]
        e = g.standard_normal(self.shapes[0]).astype(np.float32) * 0.1
        e[:, :HIDDEN] -= 1.0  # the state changes slowly at first
        self.params = [e, g.standard_normal(self.shapes[1]).astype(np.float32) * 0.3, np.zeros(self.shapes[2], np.float32), np.log(prior).astype(np.float32)]
        self.members: list[tuple[int, np.ndarray, np.ndarray]] = []  # class, its ids, the logs of their shares
        if counts is not None and len(counts) > 1:
            self.shapes.append((len(counts), HIDDEN))
            self.params.append(np.zeros(self.shapes[4], np.float32))
            self.place = np.zeros(len(classes), np.int64)
            for c in np.unique(classes[1 : len(counts)]).tolist():
                ids = 1 + np.nonzero(classes[1 : len(counts)] == c)[0]
                self.place[ids] = np.arange(len(ids))
                n = counts[ids] + 1.0
                self.members.append((c, ids, np.log(n / n.sum()).astype(np.float32)))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, shape in enumerate(self.shapes):
            n = math.prod(shape)
            self.params[k] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n

    def window(self, given: np.ndarray, keep: list, h: np.ndarray, save: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each of the inputs ``given`` (time, stream), from the state ``h``; ``keep`` is 0 where a document begins."""
        e, u = self.params[:2]
        x = np.ascontiguousarray(e[given].transpose(0, 2, 1))
        states = np.empty((len(given), HIDDEN, given.shape[1]), np.float32)
        for t in range(len(given)):
            if keep[t] is not None:
                h = h * keep[t]
            a = u @ h
            zr = x[t, : 2 * HIDDEN] + a[: 2 * HIDDEN]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            c = r * a[2 * HIDDEN :]
            c += x[t, 2 * HIDDEN :]
            np.tanh(c, out=c)
            if save is not None:
                save.append((h, a[2 * HIDDEN :], z, r, c))
            h = h + z * (c - h)
            states[t] = h
        return states, h

    def steep(self) -> bool:
        """Whether a logit of a class can be beyond 40: states are between -1 and 1."""
        return bool((np.abs(self.params[2]).sum(1) + np.abs(self.params[3])).max() > 40)

    def log_classes(self, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log probability of each class (time, stream); all classes' probabilities times a total; the total."""
        logits = self.params[2] @ states
        logits += self.params[3][:, None]
        if self.steep():
            np.clip(logits, -40, 40, out=logits)
        own = np.take_along_axis(logits, classes[:, None], 1)[:, 0]
        np.exp(logits, out=logits)
        total = logits.sum(1)
        return own - np.log(total), logits, total

    def log_words(self, states: np.ndarray, ids: np.ndarray, grads: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Natural log probability of each word (time, stream) within its class; 0 for words that have none of their own.

        With ``grads`` (weight of each token, gradient of the vectors, gradient of the states as (token, feature)) also adds the loss's gradients.
        """
        out = np.zeros(ids.size, np.float32)
        flat, rows = ids.ravel(), np.ones((ids.size, HIDDEN + 1), np.float32)  # the last column takes the shares
        rows[:, :HIDDEN] = states.transpose(0, 2, 1).reshape(-1, HIDDEN)
        own = self.classes[flat]
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(CLASSES + 1))
        for c, members, shares in self.members:
            at = order[ends[c] : ends[c + 1]]
            if not len(at):
                continue
            x, v, place = rows[at], self.params[4][members], self.place[flat[at]]
            logits = x @ np.column_stack([v, shares]).T  # states and vectors are bounded, so no exponential overflows
            each = np.arange(len(at))
            mine = logits[each, place]
            np.exp(logits, out=logits)
            total = logits.sum(1)
            out[at] = mine - np.log(total)
            if grads is not None:
                weight, dv, dx = grads
                logits *= (weight[at] / total)[:, None]
                logits[each, place] -= weight[at]
                dv[members] += logits.T @ x[:, :HIDDEN]
                dx[at] = logits @ v
        return out.reshape(ids.shape)


@dataclass
class Streams:
    """Documents laid end to end in parallel streams, the longest stream first."""

    ids: np.ndarray  # (time, stream)
    begins: np.ndarray
    lengths: np.ndarray
    places: list[tuple[int, int, int]]  # stream, start and length of each document


def lay_out(docs: list[np.ndarray], most: int = STREAMS) -> Streams:
    """Each document, longest first, goes to the shortest stream."""
    import heapq

    sizes = [len(d) for d in docs]
    many = max(1, min(most, len(docs), -(-sum(sizes) // max(sizes))))
    heap, where = [(0, k) for k in range(many)], [(0, 0, 0)] * len(docs)
    for k in sorted(range(len(docs)), key=lambda k: -sizes[k]):
        used, s = heapq.heappop(heap)
        where[k] = (s, used, sizes[k])
        heapq.heappush(heap, (used + sizes[k], s))
    lengths = np.zeros(many, np.int64)
    for used, s in heap:
        lengths[s] = used
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(many, np.int64)
    rank[order] = np.arange(many)
    ids, begins = np.zeros((int(lengths.max()), many), np.uint16), np.zeros((int(lengths.max()), many), bool)
    places = [(int(rank[s]), at, n) for s, at, n in where]
    for d, (s, at, n) in zip(docs, places, strict=True):
        ids[at : at + n, s] = d
        begins[at, s] = True
    return Streams(ids, begins, lengths[order], places)


def even_streams(docs: list[np.ndarray], most: int = STREAMS) -> Streams:
    """For training: the documents end to end, cut into streams of one length. A document that is cut begins anew in the next stream."""
    total = sum(map(len, docs))
    many = max(1, min(most, total // LEAST_STREAM))
    size = -(-total // many)
    many = -(-total // size)
    ids, begins = np.zeros(size * many, np.uint16), np.zeros(size * many, bool)
    ids[:total] = np.concatenate(docs)
    begins[np.cumsum([0, *map(len, docs[:-1])])] = True
    begins[::size] = True
    lengths = np.full(many, size)
    lengths[-1] = total - size * (many - 1)
    return Streams(np.ascontiguousarray(ids.reshape(many, size).T), np.ascontiguousarray(begins.reshape(many, size).T), lengths, [])


def _windows(s: Streams, network: Network, width: int = WINDOW) -> Iterator[tuple]:
    """(start, stop, active streams, inputs, keep, targets) window by window."""
    shifted = np.vstack([np.zeros((1, s.ids.shape[1]), np.uint16), s.ids[:-1]])
    shifted[s.begins] = END
    for at in range(0, len(s.ids), width):
        stop = min(at + width, len(s.ids))
        n = int(np.searchsorted(-s.lengths, -at, "left"))
        begins = s.begins[at:stop, :n]
        keep = [(~row).astype(np.float32) if row.any() else None for row in begins]
        yield at, stop, n, network.inputs[shifted[at:stop, :n]], keep, network.classes[s.ids[at:stop, :n]]


def _weights(s: Streams, at: int, stop: int, n: int) -> np.ndarray:
    """1 for tokens inside their streams, over the number of these."""
    inside = (np.arange(at, stop)[:, None] < s.lengths[None, :n]).astype(np.float32)
    return inside / max(1.0, float(inside.sum()))


def learn(network: Network, s: Streams, slopes: list[np.ndarray], rate: float = 0.12) -> None:
    """One pass of truncated backpropagation with Adagrad over the streams; the state goes on from window to window."""
    h = np.zeros((HIDDEN, s.ids.shape[1]), np.float32)
    for at, stop, n, given, keep, targets in _windows(s, network, TRAIN_WINDOW):
        h, save = np.ascontiguousarray(h[:, :n]), []
        states, h = network.window(given, keep, h, save)
        weights = _weights(s, at, stop, n)
        _, d, total = network.log_classes(states, targets)
        d *= (weights / total)[:, None]
        np.put_along_axis(d, targets[:, None], np.take_along_axis(d, targets[:, None], 1) - weights[:, None], 1)
        e, u, w = network.params[:3]
        grads = [None, None, np.matmul(d, states.transpose(0, 2, 1)).sum(0), d.sum(2).sum(0)]
        back = w.T @ d
        if network.members:
            dv, dx = np.zeros(network.shapes[4], np.float32), np.zeros((weights.size, HIDDEN), np.float32)
            network.log_words(states, s.ids[at:stop, :n], (weights.ravel(), dv, dx))
            grads.append(dv)
            back = back + dx.reshape(len(given), n, HIDDEN).transpose(0, 2, 1)
        da_all, dx_all = np.empty((len(given), 3 * HIDDEN, n), np.float32), np.empty((len(given), 3 * HIDDEN, n), np.float32)
        dh = np.zeros((HIDDEN, n), np.float32)
        for t in range(len(given) - 1, -1, -1):
            before, own, z, r, c = save[t]
            dh = dh + back[t]
            dx, da = dx_all[t], da_all[t]
            dhz = dh * z
            dc = dhz * (1 - c * c)
            dx[:HIDDEN] = dhz * (c - before) * (1 - z)
            dx[HIDDEN : 2 * HIDDEN] = dc * own * r * (1 - r)
            dx[2 * HIDDEN :] = dc
            da[: 2 * HIDDEN] = dx[: 2 * HIDDEN]
            da[2 * HIDDEN :] = dc * r
            dh = dh - dhz + u.T @ da
            if keep[t] is not None:
                dh = dh * keep[t]
        grads[1] = np.matmul(da_all, np.stack([x[0] for x in save]).transpose(0, 2, 1)).sum(0)
        scale = min(1.0, 1.0 / (math.sqrt(sum(float((g * g).sum()) for g in grads[1:])) + 1e-9))
        for k in range(1, len(grads)):
            g = grads[k] * scale
            slopes[k] += g * g
            network.params[k] -= (WORD_RATE if k == 4 else 1) * rate * g / np.sqrt(slopes[k])
        if network.members:
            np.clip(network.params[4], -4, 4, out=network.params[4])
        rows = given.ravel()
        order = np.argsort(rows, kind="stable")
        first = np.r_[0, np.nonzero(np.diff(rows[order].astype(np.int32)))[0] + 1]
        touched = rows[order[first]]
        g = np.add.reduceat(dx_all.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order], first) * scale
        slopes[0][touched] += g * g
        e[touched] -= rate * g / np.sqrt(slopes[0][touched])


def _buffers(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows whose last field is the ids, in lists of about BUFFER_TOKENS tokens."""
    held, size = [], 0
    for *front, ids in rows:
        held.append((*front, np.frombuffer(ids, np.uint16)))
        size += len(held[-1][-1])
        if size >= BUFFER_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def train(encoded: DataFrame, network: Network) -> None:
    """Trains ``network`` in place."""
    for remainders in ROUNDS:
        start = network.flat()

        def copies(rows: Iterator[tuple], start: np.ndarray = start) -> Iterator[tuple]:
            network.load(start)
            slopes, tokens = [np.full(shape, 1e-4, np.float32) for shape in network.shapes], 0
            for held in _buffers(rows):
                docs = [ids for (ids,) in held]
                tokens += sum(map(len, docs))
                learn(network, even_streams(docs), slopes)
            if tokens:
                change = (network.flat() - start).astype(np.float64) * tokens
                for k in range(0, len(change), CHUNK):
                    yield k, TaskContext.get().partitionId() % SHARES, tokens, change[k : k + CHUNK].tobytes()

        def total(rows: Iterator[tuple]) -> Iterator[tuple]:
            at, tokens, change = None, 0, np.zeros(0)
            for k, share, n, data in rows:
                if (k, share) != at:
                    if at is not None:
                        yield *at, tokens, change.tobytes()
                    at, tokens, change = (k, share), 0, np.zeros(len(data) // 8)
                tokens, change = tokens + n, change + np.frombuffer(data)
            if at is not None:
                yield *at, tokens, change.tobytes()

        part = encoded.where(F.col("fold").isin(*remainders)).select("ids")
        schema = "k int, share int, tokens long, change binary"
        summed = written(map_rows(part, schema, copies))
        for whole in (False, True):  # within each share of the tasks, then over the shares
            rows = summed.withColumn("share", F.lit(0)) if whole else summed
            summed = map_rows(rows.repartition("k", "share").sortWithinPartitions("k", "share"), schema, total)
        flat = start.copy()
        for k, _, tokens, change in summed.collect():  # the size of the parameters
            flat[k : k + CHUNK] += (np.frombuffer(change) / tokens).astype(np.float32)
        network.load(flat)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs`` (doc_id, text)."""
    every = word_counts(docs)
    known_words = frequent_words(every)
    dictionary = [w for w, _ in known_words]
    encoded = encode(docs, dictionary)
    tails = tail_logs(encoded, every, known_words[-1][1] if known_words else 0)
    counts, vectors = profiles(encoded, len(dictionary))
    classes = word_classes(counts, vectors, dictionary)
    total = int(counts.sum())
    listed = counts[:TAIL] > 0
    tail_distinct = distinct_by_spelling(every) - np.bincount([spelling(w) for w in dictionary], minlength=SPELLING_CLASSES)
    distinct = int(listed.sum() + tail_distinct.sum())

    # Words of a class: its training tokens, and its distinct words; one more for those never seen.
    in_class = np.bincount(classes, weights=counts, minlength=CLASSES)
    kinds = np.bincount(classes[:TAIL][listed], minlength=CLASSES).astype(float)
    kinds[1 + WORD_CLASSES :] += tail_distinct
    word_logs = np.log10(counts + 1.0)
    word_logs[TAIL:] = 0.0  # the tail's logs come from tail_logs
    class_logs = word_logs - np.log10(in_class + kinds + 1)[classes]
    class_logs[: len(vectors)] = 0.0  # the network's second softmax; the end token is a class of its own

    inputs = np.arange(len(counts))
    rare = classes > WORD_CLASSES
    inputs[rare] = len(vectors) + classes[rare] - 1 - WORD_CLASSES
    inputs[(~rare) & (inputs >= len(vectors))] = 0
    network = Network(inputs, classes, (in_class + 1) / (in_class + 1).sum(), counts[: len(vectors)])
    train(encoded, network)
    start = network.flat()

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        network.load(start)
        for held in _buffers(rows):
            docs = [ids for *_, ids in held]
            s = lay_out(docs)
            logs = np.zeros(s.ids.shape, np.float64)
            h = np.zeros((HIDDEN, s.ids.shape[1]), np.float32)
            for at, stop, n, given, keep, targets in _windows(s, network):
                states, h = network.window(given, keep, h[:, :n])
                logs[at:stop, :n] = network.log_classes(states, targets)[0] + network.log_words(states, s.ids[at:stop, :n])
            for (key, doc_id, part, ids), (stream, at, n) in zip(held, s.places, strict=True):
                known = int((counts[ids[ids < TAIL]] > 0).sum())
                yield key, doc_id, part == HELD_OUT, n, known, float(word_logs[ids].sum()), float(logs[at : at + n, stream].sum() / math.log(10) + class_logs[ids].sum())

    schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, word_logs double, model_logs double"
    scored = map_rows(encoded.select("key", "doc_id", "fold", "ids"), schema, each).join(tails, "key", "left").na.fill({"logs": 0.0, "known": 0})
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("word_logs") + F.col("logs") - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("model_logs") + F.col("logs")).alias("score"),
    )
