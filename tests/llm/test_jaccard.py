import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pathloom.llm import jaccard


def brute(rows, percent=80):
    """(doc_id, set size, component) by comparing all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        common = Counter(o for t in s for o in where[t])
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                root[find(k)] = find(o)
        for t in s:
            where[t].append(k)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return Counter((doc_id, len(sets[k]), least.get(find(k))) for k, (doc_id, _) in enumerate(rows))


def found(df, **more):
    return Counter(tuple(r) for r in jaccard.jaccard_join(df, **more).select("doc_id", "n_shingles", "component_id").collect())


def test_documents(docs, rows):
    assert found(docs) == brute(rows)


def near_copies(seed=1, groups=12):
    """Groups of near copies around the threshold, chains among them, and a passage that most texts share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    passage = " ".join(word() for _ in range(60))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice((6, 40, 150, 600)))]
        for _ in range(r.choice((1, 2, 30))):
            own = list(base)
            for _ in range(r.randrange(0, max(2, len(own) // 30))):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own) + (f" {passage}" if r.random() < 0.6 else ""))
            if r.random() < 0.3:
                base = own
    return [(k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [5, 2048])
def test_near_copies(spark, seed, block):
    """With small blocks, groups are split into cells."""
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, block=block) == brute(rows)


def test_large_keys_shuffle(spark, monkeypatch):
    """The join without a broadcast gives the same."""
    monkeypatch.setattr(jaccard.texts_of, "__defaults__", (0,))
    rows = near_copies(3, 6)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def broadcasts(df):
    """Whether the plan, as it was run, has a broadcast join; the rows."""
    rows = len(df.collect())
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString(), rows


def test_salted_keys_are_never_broadcast(spark):
    """Spark takes a table's size as that before the salts, so however small it seems, it must not be gathered in the driver."""
    sets = jaccard.written(spark.range(2000).selectExpr("id div 2 as grp", "id as rep"))
    total = sets.groupBy("grp").agg({"rep": "min"}).withColumnRenamed("min(rep)", "low")
    assert broadcasts(jaccard._salted(sets, total, ["grp"])) == (False, 2000)
    edges = sets.selectExpr("rep as u", "grp as v")
    assert broadcasts(jaccard._starred(edges, edges.groupBy("u").agg({"v": "min"}).withColumnRenamed("min(v)", "low"))) == (False, 2000)


def test_keys_count_as_in_the_hash_table(spark):
    """A key takes 64 bytes at least in the table that is sent."""
    docs, keys = spark.range(1000).selectExpr("id as doc_id", "'a' as text"), spark.range(1000).selectExpr("id as rep")
    none = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert broadcasts(jaccard.texts_of(docs, keys, 64_000)) == (False, 1000)
        assert broadcasts(jaccard.texts_of(docs, keys, 1 << 20)) == (True, 1000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", none)


def test_tree_links_equal_all_pairs():
    r = np.random.default_rng(4)
    sets = []
    for n in (3, 20, 90, 400, 2000):
        base = r.integers(0, 2**63, n).astype(np.uint64)
        for _ in range(25):
            own = base.copy()
            own[r.random(n) < r.choice([0.0, 0.05, 0.1, 0.2])] = r.integers(0, 2**63)
            sets.append(np.unique(own))
    sets.sort(key=jaccard._order)

    def classes(pairs):
        root = list(range(len(sets)))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [x if q == y else q for q in root]
        return {tuple(k for k, q in enumerate(root) if q == c) for c in set(root)}

    every = [(a, b) for a in range(len(sets)) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) * 180 >= 80 * (len(sets[a]) + len(sets[b]))]
    links = jaccard.links(sets, None, 80)
    assert set(map(tuple, map(sorted, links))) <= set(map(tuple, map(sorted, every))) and classes(links) == classes(every)
    half = len(sets) // 2
    across = jaccard.links(sets[:half], sets[half:], 80)
    assert classes(across) == classes([(a, b) for a, b in every if (a < half) != (b < half)])


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 4), (4, 5), (5, 6), (6, 7), (20, 20), (30, 29), (29, 28)] + [(100, k) for k in range(101, 160)]
    got = {r["node"]: r["component"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 1 for k in range(1, 8)}, 10: 10, 11: 10, **{k: 28 for k in (28, 29, 30)}, **{k: 100 for k in range(100, 160)}}


def test_empty(empty):
    assert found(empty) == Counter()
