"""Exact Jaccard join of word-shingle sets with signature trees.

Two documents link when their sets of five-word shingles have a Jaccard similarity of at least 0.8. The result names each document's
connected component. The steps (s, the first half of a set's fingerprint, names a set while candidates are sought; a clash there only joins
two groups):

1. ``fingerprints``: size and 128-bit fingerprint of every document's set. Documents with equal sets are one *set* from here on, so exact
   copies cost one row each.
2. ``shared_tokens``: the smallest tokens (hashes of shingles) of each set, 30 % of them. Linked sets share at least 80 % of each one's tokens,
   so by the prefix principle they share at least ``_least_shared`` of these. A set with fewer tokens that also occur in some other set links
   with nothing and drops out; most do. The same again over all tokens of the remaining sets, of which 80 % must be shared.
3. ``candidate_groups``: the remaining sets that share tokens, directly or in a chain, form a group; linked sets are always in one group.
   Groups come from stars around each token's smallest set, so no group of pairs is built.
4. ``tree_join``: a group with up to ``BLOCK`` sets is one task's work. A larger one is dealt twice, by different hashes, into cells of about that
   many sets of neighbouring size classes, and each cell is joined for itself (``two_dealings``). That leaves most of a large group connected, at the
   cost of shipping each set twice. Then only what is still apart can add a link (``completion``): the sets outside the group's largest component
   meet all sets of compatible sizes, cell by cell; pairs within that component are not compared again. A task builds a signature tree: leaves of sets alike in size, inner nodes
   with OR-combined token bitmaps and size ranges. A dual traversal prunes pairs of nodes by size and by the most overlap their bitmaps allow;
   what remains is compared exactly. Sets that are already connected need no comparison, so a group of a thousand near copies yields a
   thousand links and not half a million.
5. Components of the links, smallest doc_id first.

All of it is exact up to equal 64-bit hashes of different shingles; there is no cap on partners or candidates. In a large group the work grows in
proportion to its size where most of it is one component, as with near copies of a text, and else with the product of its cells. Defined cases: null or empty texts and texts without words have an empty set
and link with nothing; fewer than five words form one shingle; repeated rows fall in one component; rows without a doc_id
get the component of an equal set, if any, and null otherwise; an empty table gives an empty result; further columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, python_stage, text_bytes, words_of, written

WIDTH = 5
PERCENT = 80
PREFIX_PERCENT = 30
#: Sets in a task's tree at most (of the expectation: cells are dealt by hash).
BLOCK = 1024
BLOCK_TOKENS = 2048
LEAF = 16
#: Keys of up to this many bytes are broadcast to the scan of the texts.
BROADCAST_BYTES = 16 << 20
SALTS = 16

_MULTIPLIERS = [np.uint64(2 * int.from_bytes(hashlib.md5(b"shingle %d" % k).digest()[:8], "big") + 1 & (1 << 64) - 1) for k in range(64)]


class _WordHashes(dict):
    """Hashes of words, computed when first asked for; forgotten when there are very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit integers evenly (xor-shift and multiply)."""
    for shift in (np.uint64(31), np.uint64(29)):
        h = (h ^ (h >> shift)) * _MULTIPLIERS[63]
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = words_of(text)
    a = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(a) - width + 1
    if not len(a):
        return a
    if n < 1:
        return _mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64))
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h += a[k : n + k] * _MULTIPLIERS[k]
    return np.unique(_mixed(h))


def fingerprints(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, prefix_percent: int = PREFIX_PERCENT) -> DataFrame:
    """doc_id, n, f1, f2, prefix: set size, fingerprint and prefix tokens; f1 and f2 are null for empty sets."""

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            tokens = shingle_set(text, width)
            yield (doc_id, len(tokens), *(_fingerprint(tokens) if len(tokens) else (None, None)), tokens[: _prefix_size(len(tokens), percent, prefix_percent)].tobytes())

    return map_rows(docs.select(F.col("doc_id").cast("long"), text_bytes()), "doc_id long, n long, f1 long, f2 long, prefix binary", each)


def _fingerprint(tokens: np.ndarray) -> list[int]:
    return np.frombuffer(hashlib.md5(tokens.tobytes()).digest(), np.int64).tolist()


def _prefix_size(n: int, percent: int, prefix_percent: int) -> int:
    """At least the prefix that any link calls for, and ``prefix_percent`` where that is more."""
    return min(n, max(n - -(-percent * n // 100) + 1, prefix_percent * n // 100 + 1))


def _least_shared(n: str, percent: int, prefix_percent: int) -> str:
    """SQL: of its prefix, a set of n tokens that links with any other shares at least this many tokens.

    Two sets with overlap o hold k common tokens among the smallest n - o + k and m - o + k. With o >= percent of the larger size, a prefix of
    prefix_percent holds k > (percent + prefix_percent - 100) % of a set's own size, and the smaller set has percent of the larger's size.
    """
    if prefix_percent >= 100:
        return f"({percent} * {n} + 99) div 100"
    return f"greatest(1, ({max(0, percent + prefix_percent - 100) * percent} * {n} + 9999) div 10000)"


def token_rows(rows: DataFrame, width: int | None = None) -> DataFrame:
    """token, s (the set's f1), seen: a row for each token.

    ``rows`` has f1 and the tokens of sets, or, with ``width``, texts as bytes whose whole sets are meant. Within a batch each set comes once. A
    token that several sets of a batch have is known to be shared: all of them get a row with ``seen``, and only one further row goes on to
    meet the other batches.
    """

    def sets_of(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        if width is None:
            given = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            return {s: np.frombuffer(tokens, np.int64) for s, tokens in given if s is not None}
        every = (shingle_set(text, width) for text in batch.column(0).to_pylist())
        return {_fingerprint(tokens)[0]: tokens.view(np.int64) for tokens in every if len(tokens)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sets := sets_of(batch):
                s = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(t) for t in sets.values()])
                token = np.concatenate(list(sets.values()))
                order = np.argsort(token, kind="stable")
                s, token = s[order], token[order]
                first = np.r_[True, token[1:] != token[:-1]]
                many = np.diff(np.r_[np.nonzero(first)[0], len(token)])
                known = np.repeat(many > 1, many)
                for keep, seen in ((first, False), (known, True)):
                    a, b = token[keep], s[keep]
                    for k in range(0, len(a), 50_000):
                        own = a[k : k + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(b[k : k + 50_000]), pa.array(np.full(len(own), seen))], names=["token", "s", "seen"])

    python_stage(rows.sparkSession)
    return rows.mapInArrow(run, "token long, s long, seen boolean")


def shared_tokens(rows: DataFrame, sizes: DataFrame, percent: int, prefix_percent: int) -> tuple[DataFrame, DataFrame]:
    """Of ``token_rows``: (token, s) of prefix tokens that several sets have; the sets s that share enough of theirs to link at all."""
    of_token = Window.partitionBy("token")
    met = rows.where("not seen").select("token", "s").withColumn("low", F.min("s").over(of_token)).withColumn("high", F.max("s").over(of_token)).where("low != high")
    shared = written(met.select("token", "s").unionByName(rows.where("seen").select("token", "s")))
    per_set = shared.distinct().groupBy("s").agg(F.count("*").alias("common"))
    enough = per_set.join(sizes.groupBy("s").agg(F.min("n").alias("n")), "s").where(f"common >= {_least_shared('n', percent, prefix_percent)}")
    return shared, written(enough.select("s"))


def texts_of(docs: DataFrame, keys: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``keys`` with the text of their document ``rep`` as bytes.

    Up to ``most`` bytes the keys are broadcast; beyond that the join is a shuffle of the texts. A key counts what it takes at most in the hash table
    that is sent, whose slots and rows grow by doubling: 128 bytes, 16 a column, and for tasks 32 and 128 each.
    """
    keys = written(keys)
    weight = F.lit(128 + 16 * len(keys.columns)) + (32 + 128 * F.size("task") if "task" in keys.columns else F.lit(0))
    size = keys.agg(F.sum(weight)).first()[0] or 0
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_bytes().alias("text"))
    return texts.join(F.broadcast(keys) if size <= most else keys, "rep")


def candidate_groups(docs: DataFrame, prints: DataFrame, keys: DataFrame, width: int, percent: int, prefix_percent: int) -> DataFrame:
    """s, grp: the sets that may link, and the group in which all their links lie. ``keys`` has s, n and rep for each set."""
    _, enough = shared_tokens(token_rows(prints.select("f1", "prefix")), keys, percent, prefix_percent)
    left = keys.join(enough, "s")
    shared, enough = shared_tokens(token_rows(texts_of(docs, left.select("rep")).select("text"), width), left, percent, 100)
    # Stars among the remaining sets: the smallest set of each token is its hub. The join's hot tokens are split by adaptive execution.
    shared = shared.join(enough, "s")
    hub = written(shared.groupBy("token").agg(F.min("s").alias("hub")))  # a table, so that both sides of the join are shuffled for it and can be split
    edges = shared.join(hub, "token").where("s != hub").select("s", "hub").distinct()
    return components(edges, "s", "hub").withColumnRenamed("node", "s").withColumnRenamed("component", "grp")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its smallest node) of the graph, by alternating large and small stars until nothing changes.

    Each round is two aggregations and joins over the edges, written to the shared folder; only a count comes to the driver. A node with very
    many neighbours is never gathered: its smallest neighbour is an aggregate, and salts split its rows in the joins.
    """
    edges = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    before = None
    while True:
        # large star: a node's larger neighbours go to its smallest neighbour, or to itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("low"))
        large = _starred(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = _starred(large, low).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v")
        edges = written(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _starred(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges (u, v) with their u's ``low``; a hub's edges are dealt by salt."""
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(_every_salt(low), ["u", "salt"])


def _every_salt(per_key: DataFrame) -> DataFrame:
    """``per_key`` once for each salt, never to be broadcast: Spark takes its size as that before the salts, and would gather many times that in the driver."""
    return per_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


class Signatures:
    """The sets of one task as a tree: ``levels[0]`` are leaves of LEAF sets, each level above joins LEAF nodes.

    A node has the OR of its sets' token bitmaps, the range of their sizes, and the most tokens by which a set exceeds its bits.
    """

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        self.words = np.empty((len(sets), bits // 64), np.uint64)
        for k, tokens in enumerate(sets):
            row = np.zeros(bits, bool)
            row[tokens & np.uint64(bits - 1)] = True
            self.words[k] = np.packbits(row).view(np.uint64)
        self.excess = self.size - np.bitwise_count(self.words).sum(1, dtype=np.int64)
        node = (self.words, self.size, self.size, self.excess)
        self.levels = []
        while not self.levels or len(self.levels[-1][1]) > 1:
            at = np.arange(0, len(node[1]), LEAF)
            node = (np.bitwise_or.reduceat(node[0], at), np.minimum.reduceat(node[1], at), np.maximum.reduceat(node[2], at), np.maximum.reduceat(node[3], at))
            self.levels.append(node)


def _order(tokens: np.ndarray) -> tuple:
    """Like sets close together: by size class, then smallest token."""
    return len(tokens).bit_length(), int(tokens[0]), len(tokens)


def links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links between ``left`` and ``right`` (within ``left`` if None), as many as connect whatever is connected by any.

    Dual traversal of the two signature trees. Positions in ``right`` come after those in ``left``.
    """
    bits = 1 << min(16, max(8, (2 * max(map(len, [*left, *(right or [])]))).bit_length()))
    a = Signatures(left, bits)
    b = a if right is None else Signatures(right, bits)
    base, found = 0 if right is None else len(left), []
    root = [*range(base + len(b.sets))]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        words_a, low_a, high_a, excess_a = (x[i] for x in a.levels[la])
        words_b, low_b, high_b, excess_b = (x[j] for x in b.levels[lb])
        if 100 * high_a < percent * low_b or 100 * high_b < percent * low_a:
            continue
        # A common token sets a common bit; tokens beyond one a bit are at most the smaller excess.
        most = int(np.bitwise_count(words_a & words_b).sum()) + min(excess_a, excess_b)
        if most * (100 + percent) < percent * (low_a + low_b):
            continue
        if la or lb:
            own, da = (range(i * LEAF, min((i + 1) * LEAF, len(a.levels[la - 1][1]))), la - 1) if la >= lb else ((i,), la)
            other, db = (range(j * LEAF, min((j + 1) * LEAF, len(b.levels[lb - 1][1]))), lb - 1) if lb >= la else ((j,), lb)
            stack += [(da, x, db, y) for x in own for y in other if a is not b or y >= x]
            continue
        own, other = np.arange(i * LEAF, min((i + 1) * LEAF, len(left))), np.arange(j * LEAF, min((j + 1) * LEAF, len(b.sets)))
        roots_a, roots_b = [find(x) for x in own.tolist()], [find(base + y) for y in other.tolist()]
        if len({*roots_a, *roots_b}) == 1:
            continue
        most = np.bitwise_count(a.words[own][:, None] & b.words[other][None]).sum(2, dtype=np.int64) + np.minimum(a.excess[own][:, None], b.excess[other][None])
        sizes = a.size[own][:, None] + b.size[other][None]
        possible = (most * (100 + percent) >= percent * sizes) & (np.array(roots_a)[:, None] != np.array(roots_b)[None])
        for x, y in np.argwhere(possible).tolist():
            p, q = int(own[x]), int(other[y])
            if (a is b and q <= p) or find(p) == find(base + q):
                continue
            if linked(left[p], b.sets[q], percent):
                root[find(base + q)] = find(p)
                found.append((p, base + q))
    return found


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


_TASKS = "array<struct<c1:int,x1:int,c2:int,x2:int,side:int>>"


def _load(block: int) -> Column:
    """The sets of a group of rows in blocks: by their number or by their tokens."""
    return F.greatest(F.count("*") / block, F.sum("n") / (block * BLOCK_TOKENS))


def tree_join(docs: DataFrame, keys: DataFrame, groups: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """a1, a2, b1, b2: links between sets that connect each component. ``keys`` has s, f2, n and rep (a document) for each set."""
    sets = keys.join(groups, "s")
    # Size class c holds sizes in [r^c, r^(c+1)) with r = 100 / percent, so partners' classes differ by 1 at most.
    sets = sets.withColumn("cls", F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int"))
    total = sets.groupBy("grp").agg((_load(block) <= 1).alias("whole"))
    sets = written(_salted(sets, total, ["grp"]))
    found = _joined(docs, two_dealings(sets, block), width, percent)
    large = sets.where("not whole")
    if large.limit(1).count() == 0:
        return found
    found = written(found)
    return found.unionByName(_joined(docs, completion(large, found, block), width, percent))


def _salted(rows: DataFrame, per_key: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the columns of ``per_key``; rows of one key are dealt by salt, so that a hot key is no single task."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(_every_salt(per_key), [*key, "salt"]).drop("salt")


def two_dealings(sets: DataFrame, block: int) -> DataFrame:
    """``sets`` with their tasks: a group as a whole, or a cell in each of two dealings, over classes 2k and 2k + 1 and over classes 2k - 1 and 2k."""
    for k in range(2):
        pair = F.floor((F.col("cls") + k) / 2).cast("int")
        sets = sets.withColumn(f"p{k}", F.when(F.col("whole"), F.lit(0)).otherwise(pair))
        cells = sets.groupBy("grp", f"p{k}").agg(F.when(F.max("whole"), 1).otherwise(F.ceil(_load(block))).cast("int").alias(f"n{k}"))
        sets = _salted(sets, cells, ["grp", f"p{k}"])
        sets = sets.withColumn(f"x{k}", F.pmod(F.xxhash64("f2", "s", F.lit(k)), F.col(f"n{k}")).cast("int"))
    one, two = (F.struct((2 * F.col(f"p{k}") + k).alias("c1"), F.col(f"x{k}").alias("x1"), (2 * F.col(f"p{k}") + k).alias("c2"), F.col(f"x{k}").alias("x2"), F.lit(0).alias("side")) for k in range(2))
    task = F.when(F.col("whole"), F.array(one)).otherwise(F.array(one, two)).cast(_TASKS)
    return sets.select("rep", "s", "f2", "grp", task.alias("task"))


def completion(large: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """The sets of large groups with those tasks that can still join components: cells of sets outside the group's largest component, with all others.

    In each class the cells of sets outside come first, then those of the largest component; the latter do not meet each other.
    """
    linked = components(found, "a1", "b1").withColumnsRenamed({"node": "s"})
    sets = large.select("s", "f2", "n", "rep", "grp", "cls").join(linked, "s", "left").withColumn("component", F.coalesce("component", "s"))
    sizes = sets.groupBy("grp", "component").agg(F.count("*").alias("many"))
    top = sizes.groupBy("grp").agg(F.max_by("component", F.struct("many", "component")).alias("top"))
    sets = written(_salted(sets, top, ["grp"]).withColumn("out", F.col("component") != F.col("top")))
    load = lambda out: F.ceil(F.coalesce(F.greatest(F.count_if(F.col("out") == out) / block, F.sum(F.when(F.col("out") == out, F.col("n"))) / (block * BLOCK_TOKENS)), F.lit(0))).cast("int")
    per_class = sets.groupBy("grp", "cls").agg(load(True).alias("r"), load(False).alias("d"))
    near = lambda step, name: per_class.select("grp", (F.col("cls") + step).alias("cls"), F.col("r").alias(f"{name}_r"), (F.col("r") + F.col("d")).alias(f"{name}_all"))
    plan = per_class.join(near(-1, "above"), ["grp", "cls"], "left").join(near(1, "below"), ["grp", "cls"], "left").na.fill(0)
    placed = _salted(sets, plan, ["grp", "cls"])
    hashed = F.xxhash64("f2", "s")
    placed = placed.withColumn("cell", F.when(F.col("out"), F.pmod(hashed, F.greatest(F.col("r"), F.lit(1)))).otherwise(F.col("r") + F.pmod(hashed, F.greatest(F.col("d"), F.lit(1)))).cast("int"))
    empty = F.array().cast(_TASKS)

    def tasks(many: Column, task: Callable[[Column], Column]) -> Column:
        return F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), task)).otherwise(empty)

    def task(c1: Column, x1: Column, c2: Column, x2: Column, side: Column) -> Column:
        return F.struct(c1.alias("c1"), x1.alias("x1"), c2.alias("c2"), x2.alias("x2"), side.alias("side"))

    cls, cell = F.col("cls"), F.col("cell")
    met = lambda outside, inside: F.when(F.col("out"), outside).otherwise(inside)
    own = tasks(met(F.col("r") + F.col("d"), F.col("r")), lambda c: task(cls, F.least(cell, c), cls, F.greatest(cell, c), F.when(cell > c, 1).otherwise(0)))
    above = tasks(met(F.col("above_all"), F.col("above_r")), lambda c: task(cls, cell, cls + 1, c, F.lit(0)))
    below = tasks(met(F.col("below_all"), F.col("below_r")), lambda c: task(cls - 1, c, cls, cell, F.lit(1)))
    return placed.select("rep", "s", "f2", "grp", F.concat(own, above, below).alias("task")).where(F.size("task") > 0)


def _joined(docs: DataFrame, dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """The links that the tasks of ``dealt`` find. Task: (class, cell, class, cell), the smaller first; side 0 is the first cell, 1 the second."""

    def tokens(rows: Iterator[tuple]) -> Iterator[tuple]:
        for s, f2, grp, task, text in rows:
            own = shingle_set(text, width)
            if _fingerprint(own) == [s, f2]:  # else another row of that document id
                for t in task:
                    yield s, f2, grp, t["c1"], t["x1"], t["c2"], t["x2"], t["side"], own.tobytes()

    schema = "s long, f2 long, grp long, c1 int, x1 int, c2 int, x2 int, side int, tokens binary"
    full = map_rows(texts_of(docs, dealt).select("s", "f2", "grp", "task", "text"), schema, tokens)
    key = ["grp", "c1", "x1", "c2", "x2"]
    return _by_task(full.repartition(*key).sortWithinPartitions(*key, "side", "s", "f2"), percent)


def _by_task(full: DataFrame, percent: int) -> DataFrame:
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        key, held = None, {}
        for s, f2, *task, side, tokens in rows:
            if task != key:
                yield from _solve(held, percent)
                key, held = task, {}
            held.setdefault(-1 if task[1:3] == task[3:5] else side, {})[(s, f2)] = np.frombuffer(tokens, np.uint64)
        yield from _solve(held, percent)

    return map_rows(full, "a1 long, a2 long, b1 long, b2 long", run)


def _solve(held: dict[int, dict], percent: int) -> Iterator[tuple]:
    sides = [sorted(held[k].items(), key=lambda x: _order(x[1])) for k in sorted(held)]
    one_cell = -1 in held  # the pairs within a cell
    if not sides or (len(sides) < 2 and not one_cell):
        return
    names = [name for side in sides for name, _ in side]
    for p, q in links([t for _, t in sides[0]], None if one_cell else [t for _, t in sides[1]], percent):
        yield (*names[p], *names[q])


def jaccard_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, prefix_percent: int = PREFIX_PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    prints = written(fingerprints(docs, width, percent, prefix_percent))
    keys = written(prints.where("f1 is not null").groupBy(F.col("f1").alias("s"), "f2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")))
    groups = candidate_groups(docs, prints, keys, width, percent, prefix_percent)
    found = written(tree_join(docs, keys.where("rep is not null"), groups, width, percent, block))
    # components over representatives: the smallest doc_id of each set
    ends = keys.select("s", "f2", "rep")
    a = ends.select(F.col("s").alias("a1"), F.col("f2").alias("a2"), F.col("rep").alias("u"))
    b = ends.select(F.col("s").alias("b1"), F.col("f2").alias("b2"), F.col("rep").alias("v"))
    top = components(found.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]), "u", "v")
    classes = keys.join(top.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("s").alias("f1"), "f2", F.coalesce("component", "rep").alias("component_id"))
    joined = prints.drop("prefix").join(classes, ["f1", "f2"], "left")  # adaptive execution splits the rows of a hot set
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
