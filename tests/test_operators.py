"""Flattening, statistics, histograms, pruning, sources and settings on small collections."""

import io
import json
import tarfile
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.config import EngineConfig, Prune, StatType, settings_grid
from pathloom.operators import enum_arrays, flatten, histogram, prune, stats
from pathloom.plans import experiment, truth
from pathloom.plans.estimate import predicate_frame
from pathloom.sources import documents


def docs_of(spark, docs):
    return flatten.parse_documents(spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "doc_id long, doc string"))


COLLECTION = [{"n": k % 4 or None, "w": {"t": f"x{k % 3}"}, "q": {"r": {"s": k / 2}}} for k in range(12)] + [{"w": None}, {}]


@pytest.mark.parametrize("kind", list(StatType))
def test_statistics_of_a_collection(spark, kind):
    found, meta = experiment.build(docs_of(spark, COLLECTION), EngineConfig(kind))
    rows = {r["path"]: r for r in found.collect()}
    got = {p: (r["count"], r["null_count"], r["min_num"], r["max_num"], r["min_str"]) for p, r in rows.items()}
    assert got == {
        "n": (12, 3, None, None, None), "n_num": (9, 0, 1, 3, None), "w": (13, 1, None, None, None), "w_obj": (12, 0, None, None, None), "w_obj.t": (12, 0, None, None, None),
        "w_obj.t_str": (12, 0, None, None, "x0"), **dict.fromkeys(("q", "q_obj", "q_obj.r", "q_obj.r_obj", "q_obj.r_obj.s"), (12, 0, None, None, None)), "q_obj.r_obj.s_num": (12, 0, 0, 5.5, None),
    }
    assert meta.first()["collection_size"] == len(COLLECTION)
    if kind is not StatType.BASIC:
        assert {p: r["ndv"] for p, r in rows.items() if r["ndv"]} == {"n_num": 3, "w_obj.t_str": 3, "q_obj.r_obj.s_num": 12}
    if kind is StatType.NDV_WITH_MODE:
        assert rows["n_num"]["mode"]["num_val"] == 1 and rows["n_num"]["mode"]["count"] == 3 and rows["w_obj.t_str"]["mode"]["str_val"] == "x0"


def test_deeper_documents_are_an_error(spark):
    from pyspark.errors import PySparkException

    docs = docs_of(spark, [{"a": {"b": 1}}, {"a": {"b": [{"c": 2}]}}])
    with pytest.raises(PySparkException, match="nested deeper than 2 levels"):
        flatten.flatten(docs, None, 2).count()
    assert flatten.flatten(docs, None, 2, paths=("a/b",)).count() == 2


def test_kinds_and_paths(spark):
    docs = docs_of(spark, [{"a": {"b'c": [1, "x", [True]]}, "d": None, "e": []}, {"a": [2]}])
    every = flatten.flatten(docs).collect()
    for kinds in (("arr",), ("num", "str"), ("null", "bool"), ("obj",)):
        assert sorted(map(str, flatten.flatten(docs, kinds=kinds).collect())) == sorted(str(r) for r in every if r["kind"] in kinds)
    paths = ("a", "a/b'c/1", "a/0", "zz/y")
    assert sorted(map(str, flatten.flatten(docs, paths=paths).collect())) == sorted(str(r) for r in every if "/".join(r["json_path"]) in paths)


def reference_nodes(doc):
    """Typed paths of a document, by plain recursion."""
    suffix = lambda v: "null" if v is None else "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "str" if isinstance(v, str) else "arr" if isinstance(v, list) else "obj"
    out = []

    def walk(v, path):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            base = f"{path}.{k}" if path else str(k)
            typed = base if x is None else f"{base}_{suffix(x)}"
            out.append(typed)
            if isinstance(x, (dict, list)):
                walk(x, typed)

    walk(doc, "")
    return out


JSON = st.recursive(st.none() | st.booleans() | st.integers(-10, 10) | st.sampled_from([0.5, 1.0, -2.25]) | st.text("ab\"é", max_size=2), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("xyz", min_size=1, max_size=2), x, max_size=3), max_leaves=8)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=st.lists(st.dictionaries(st.text("xyz", min_size=1, max_size=2), JSON, max_size=3) | st.lists(JSON, max_size=2), min_size=1, max_size=6))
def test_flatten_equals_recursion(spark, docs):
    nodes = flatten.flatten(docs_of(spark, docs))
    assert Counter(r[0] for r in nodes.select("typed_path").collect()) == Counter(p for d in docs for p in reference_nodes(d))


def test_large_integers_stay_apart(spark):
    nodes = flatten.flatten(docs_of(spark, [{"id": 307139025897152512}, {"id": 307139025897152513}, {"id": 1}, {"id": 1.0}]))
    assert stats.distinct_counts(stats.value_counts(nodes)).first()["ndv"] == 3
    assert [r["is_int"] for r in nodes.orderBy("doc_id").collect()] == [True, True, True, False]


def test_unparsable_and_null_documents(spark):
    df = spark.createDataFrame([(1, "{"), (2, None), (3, '{"a":1}'), (4, "5")], "doc_id long, doc string")
    assert [r["doc_id"] for r in flatten.flatten(flatten.parse_documents(df)).collect()] == [3]


def test_type_confusion(spark):
    cases = [([0.5, 7], 1), ([None, "p", "q"], 1), ([{"k": 1}, 6, {"k": 2}], 2), ([False, "no", None], 2), ([[], [3], {}, "z", 9], 4), ([3, "3", False, [3], {"3": 3}, None, 3.5], 5)]
    for values, expected in cases:
        nodes = flatten.flatten(docs_of(spark, [{"x": v} for v in values]))
        assert flatten.type_confusion(nodes).where("json_path = 'x'").first()["n_types"] == expected
        assert flatten.type_confusion(nodes, True).where("json_path = 'x'").first()["n_types"] == expected + (None in values)


def hist(spark, values, bins, **more):
    nodes = flatten.flatten(docs_of(spark, [{"v": v} for v in values]), None, 1)
    r = histogram.histograms(stats.value_counts(nodes), bins, **more).first()
    return r and (r["hist_type"], [(next((x for x in b[:3] if x is not None), None), b["count"], b["ndv"]) for b in r["buckets"]])


#: 4 values in buckets that close at 20 (of 58, 3 buckets): 12 + 9; 25; 6 + 1 + 5.
HEIGHTS = [v for v, n in ((2, 12), (3, 9), (4, 25), (8, 6), (11, 1), (12, 5)) for _ in range(n)]


@pytest.mark.parametrize("fold_most", [0, 1000])
def test_equi_height(spark, fold_most):
    assert hist(spark, HEIGHTS, 3, fold_most=fold_most) == ("EQUI_HEIGHT", [(3, 21, 2), (4, 25, 1), (12, 12, 3)])


def test_singleton_histograms(spark):
    for bins in (2, 9):
        assert hist(spark, [True] * 3 + [False] * 8, bins) == ("SINGLETON", [(False, 8, None), (True, 3, None)])
    assert hist(spark, list("qqqpqzqq"), 3) == ("SINGLETON", [("p", 1, None), ("q", 6, None), ("z", 1, None)])
    assert hist(spark, list("mmmmmmmkkgh"), 3) == ("SINGLETON_PLUS", [("m", 7, None), (None, 4, 3)])
    assert hist(spark, list("mmmmmmmkkgh"), 3, singleton_plus=False) is None
    assert hist(spark, list("tuvwxy"), 4) is None


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(0, 30), min_size=1, max_size=60), bins=st.integers(1, 8))
def test_histogram_keeps_all_values(spark, values, bins):
    kind, buckets = hist(spark, values, bins)
    assert sum(b[1] for b in buckets) == len(values) and len(buckets) <= bins
    assert kind == ("SINGLETON" if len(set(values)) <= bins else "EQUI_HEIGHT")
    assert hist(spark, values, bins, fold_most=0) == (kind, buckets)


def test_enum_arrays(spark):
    docs = [{"t": ["a", "b", "a"]}, {"t": ["a"]}, {"t": []}, {"t": ["a", 1]}, {"t": [1, 2]}, {"t": [1.5]}, {"t": [True]}, {"t": [None]}, {"u": [[1], [1, 3]]}]
    nodes = flatten.flatten(docs_of(spark, docs))
    rows = {r["path"]: r for r in enum_arrays.enum_stats(nodes, EngineConfig(StatType.NDV_WITH_MODE)).collect()}
    assert {p: (r["count"], r["ndv"]) for p, r in rows.items()} == {"t_arr[str]": (2, 2), "t_arr[num]": (1, 2), "t_arr[bool]": (1, 1), "u_arr.0_arr[num]": (1, 1), "u_arr.1_arr[num]": (1, 2)}
    assert rows["t_arr[str]"]["mode"]["str_val"] == "a" and rows["t_arr[str]"]["mode"]["count"] == 2


def test_array_predicates(spark):
    nodes = flatten.flatten(docs_of(spark, [{"a": [2, 4, 4, 9]}, {"a": []}, {"a": ["9", 4, None]}, {"a": [True]}]))
    asked = [("contains", [4], 2), ("contains", [9, 2], 1), ("contains", [4, 5], 0), ("contains", [], 4), ("overlaps", [9], 1), ("overlaps", [9, "9"], 2), ("overlaps", [], 0), ("memberof", 4, 2), ("memberof", "9", 1), ("memberof", True, 1)]
    preds = predicate_frame(spark, [(op, "a_arr", v) for op, v, _ in asked]).withColumn("json_path", F.lit("a"))
    got = {r["pred_id"]: r["truth"] for r in truth.truths(preds, nodes).collect()}
    assert [got[k] for k in range(len(asked))] == [n for *_, n in asked]


def test_unique_suffix(spark):
    paths = ["m_obj", "m_obj.k_num", "n_obj.k_num", "o_obj.u_obj", "o_obj.u_obj.v_str", "p_obj.tail", "p_obj.tail_arr.7_num", "solo_str"]
    rows = spark.createDataFrame([(p, 1) for p in paths], "path string, count long")
    short = {r["path"] for r in prune.unique_suffix(rows, EngineConfig()).collect()}
    assert short == {"m_obj", "m_obj.k_num", "n_obj.k_num", "u_obj", "v_str", "tail", "7_num", "solo_str"}
    wanted = spark.createDataFrame([("p_obj.tail_arr.7_num",), ("no.such",)], "path string")
    stored = spark.createDataFrame([(p,) for p in short], "path string")
    assert {r["path"]: r["stored"] for r in prune.lookup_paths(wanted, stored, EngineConfig()).collect()} == {"p_obj.tail_arr.7_num": "7_num", "no.such": "no.such"}


def test_estimates_are_exact_for_singletons(spark):
    docs = docs_of(spark, [{"x": k % 5, "s": "ab"[k % 2], "n": None if k % 3 else k} for k in range(60)])
    nodes = flatten.flatten(docs)
    rows = experiment.results(nodes, docs, EngineConfig()).collect()
    assert rows and all(r["truth"] == r["estimate"] for r in rows)


def test_sampling_counts_all_documents(spark):
    docs = docs_of(spark, [{"x": k} for k in range(2000)])
    found, meta = experiment.build(docs, EngineConfig(StatType.BASIC, 0.7))
    kept = found.where("path = 'x'").first()["count"]
    assert 450 < kept < 750 and meta.first()["collection_size"] == 2000


def test_empty_collection(spark):
    docs = docs_of(spark, [{"x": 1}]).where("false")
    for kind in StatType:
        found, meta = experiment.build(docs, EngineConfig(kind, enum_arrays=True, prune=frozenset({Prune.MIN_FREQ, Prune.MAX_NO_PATHS})), 2)
        assert found.count() == 0 and meta.first()["collection_size"] == 0 and meta.first()["highest_count_skipped"] == 0


def test_settings():
    with pytest.raises(ValueError, match="sampling_rate"):
        EngineConfig(sampling_rate=1.0)
    with pytest.raises(ValueError, match="exclude"):
        EngineConfig(prune=frozenset({Prune.MAX_PREFIX_LENGTH, Prune.UNIQUE_SUFFIX}))
    a, b = EngineConfig(StatType.BASIC, buckets=8), EngineConfig(StatType.BASIC, buckets=9)
    assert a.key() == b.key() and a.changed(stats_type=StatType.HISTOGRAM).key() != b.changed(stats_type=StatType.HISTOGRAM).key()
    with pytest.raises(TypeError):
        a.changed(nothing=1)
    assert len(settings_grid()) == 500


def test_cache(spark, tmp_path):
    docs, cache, config = docs_of(spark, COLLECTION), experiment.StatsCache(spark, str(tmp_path)), EngineConfig(StatType.BASIC)
    with pytest.raises(KeyError):
        cache.get("builder", config)
    first = cache.get_or_build("builder", docs, config)
    assert sorted(map(str, first[0].collect())) == sorted(map(str, cache.get("builder", config)[0].collect()))


def test_grid(spark, tmp_path):
    docs = docs_of(spark, COLLECTION)
    rows = experiment.run_grid(docs, [EngineConfig(StatType.BASIC), EngineConfig(StatType.HISTOGRAM, buckets=4)], str(tmp_path / "grid"))
    assert {r[0] for r in rows.select("stats_type").distinct().collect()} == {"BASIC", "HISTOGRAM"}


def values(df):
    return sorted((json.loads(r[0]) for r in df.select(F.to_json("doc")).collect()), key=str)


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": [2]}]')
    assert values(documents.json_array(spark, str(tmp_path / "a.json"))) == [{"a": 1}, {"a": [2]}]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": 3}\n')
    assert values(documents.json_lines(spark, str(tmp_path / "l.jsonl"))) == [{"a": 1}, {"a": 2}, {"a": 3}]
    assert documents.json_lines(spark, str(tmp_path / "l.jsonl"), 2).count() == 2
    with tarfile.open(tmp_path / "x.tar", "w") as archive:
        for name, text in (("d/part_first.json", '{"a": 1}\n{"a": 2}\n'), ("d/part_other.json", '{"b": 1}'), ("d/readme.txt", "no")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            archive.addfile(info, io.BytesIO(text.encode()))
    found = documents.json_lines_in_tar(spark, str(tmp_path / "x.tar"), 1)
    assert sorted(r["collection"] for r in found.collect()) == ["first", "other"]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,host_id,price,big,name,tags,flag\n007,12,1.50,12345678901234567890,"a, ""b""","[""x"", ""y""]",1_0\n8,x,nan,inf,,\'[]\',t\n')
    first, second = sorted(values(documents.csv_documents(spark, str(tmp_path / "a.csv"), ("tags",))), key=lambda d: d["id"])
    assert first == {"id": "007", "host_id": "12", "price": 1.5, "big": 12345678901234567890, "name": 'a, "b"', "tags": ["x", "y"], "flag": "1_0"}
    assert second["price"] == "nan" and second["big"] == "inf" and second["name"] == "" and second["id"] == "8"
    (tmp_path / "t.csv").write_text('u,i,r,s,json\n1,2,3,4,{"a": [1, 2], "b": "x,y"}\n')
    assert values(documents.json_in_csv(spark, str(tmp_path / "t.csv"))) == [{"a": [1, 2], "b": "x,y"}]


def test_sinks(spark, tmp_path):
    found, meta = experiment.build(docs_of(spark, COLLECTION), EngineConfig(StatType.BASIC))
    documents.write_stats(found, meta, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/stats")).count() == found.count()
    assert documents.first_documents(docs_of(spark, COLLECTION), 3).count() == 3


def test_result_filters(spark):
    from pathloom.functions import metrics

    rows = spark.createDataFrame([("eq", "HISTOGRAM", "", 8, 0.1, 10, 10), ("eq", "BASIC", "MIN_FREQ", 8, 0.1, 10, 20), ("lt", "HISTOGRAM", "MIN_FREQ", 16, 0.2, 0, 0)], "op string, stats_type string, prune string, buckets int, min_freq double, truth long, estimate long")
    assert metrics.filtered(rows, op="eq", prune="*").count() == 2 and metrics.filtered(rows, op=None).count() == 0
    assert metrics.matching(rows, op=("eq", "lt"), stats_type="HISTOGRAM", prune=None).count() == 2
    assert [r["min_freq"] for r in metrics.pruning_comparison(rows, "MIN_FREQ", "min_freq").collect()] == [0.1, 0.2]
    assert metrics.bucket_comparison(rows).count() == 2


def test_values_at_paths(spark):
    docs = docs_of(spark, [{"a": {"b c": [1, {"x'y": "z"}]}}, {"a": 5}, {}])
    assert [r[0] for r in docs.select(flatten.value_at(["a", "b c", 0], "bigint")).collect()] == [1, None, None]
    assert flatten.distinct_at(docs, ["a", "b c", 1, "x'y"], "string").first()["ndv"] == 1
