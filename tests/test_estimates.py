"""The estimators over statistics that are given directly, against the formulas written out in plain Python."""

import math

import pytest

from pathloom.config import EngineConfig, StatType
from pathloom.operators import stats
from pathloom.plans.estimate import estimates, predicate_frame

SCHEMA = f"path string, kind string, count bigint, null_count bigint, min_num double, max_num double, min_str string, max_str string, min_bool boolean, max_bool boolean, ndv bigint, mode {stats.MODE}, hist_type string, buckets {stats.BUCKETS}"


def row(path, kind="num", count=0, null=0, low=None, high=None, ndv=None, mode=None, hist=None, buckets=None):
    ends = {k: (low, high) if kind == k else (None, None) for k in ("num", "str", "bool")}
    shown = None if mode is None else tuple(mode[0] if kind == k else None for k in ("num", "str", "bool")) + (mode[1],)
    rows = None if buckets is None else [tuple(float(b[0]) if k == kind == "num" and b[0] is not None else b[0] if kind == k else None for k in ("num", "str", "bool")) + (b[1], b[2] if len(b) > 2 else None) for b in buckets]
    f = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return (path, None if kind == "base" else kind, count, null, *map(f, ends["num"]), *ends["str"], *ends["bool"], ndv, shown, hist, rows)


def check(spark, kind, rows, asked, rate=0.0, hcs=0, **config):
    preds = predicate_frame(spark, [a[:3] for a in asked])
    meta = spark.createDataFrame([(hcs,)], "highest_count_skipped long")
    got = estimates(preds, spark.createDataFrame(rows, SCHEMA), meta, EngineConfig(kind, rate, **config))
    found = {r["pred_id"]: r["estimate"] for r in got.collect()}
    assert [found[k] for k in range(len(asked))] == [a[3] for a in asked]


def up(value, rate=0.0):
    return math.ceil(value / (1 - rate))


#: A number path: documents with the key, nulls among them, range and distinct values.
TOTAL, NULLS, LOW, HIGH, NDV = 340, 40, 10, 250, 60
OPERANDS = (-7, 10, 11, 57.5, 128, 249, 250, 400)
RANGES = ((-50, -20), (0, 30), (10, 250), (40, 41), (100, 700), (249, 300), (300, 900), (77, 77))


def linear(op, x, valid):
    """The share of the range that lies below or above the operand, or in the asked range."""
    span = HIGH - LOW
    if op == "range":
        return max(0, min(HIGH, x[1]) - max(LOW, x[0])) / span * valid
    return max(0, min(x - LOW if op == "lt" else HIGH - x, span)) / span * valid


def asked_of_numbers(valid, equal, rate):
    inside = lambda x: equal if LOW <= x <= HIGH else 0
    rows = [(op, "p_num", x, up(linear(op, x, valid), rate)) for op in ("lt", "gt") for x in OPERANDS]
    rows += [("range", "p_num", x, up(linear("range", x, valid), rate)) for x in RANGES]
    return rows + [("eq", "p_num", x, up(inside(x), rate)) for x in OPERANDS] + [("exists", "p_num", None, up(valid, rate))]


@pytest.mark.parametrize("rate", [0.0, 0.25])
@pytest.mark.parametrize(("kind", "share"), [(StatType.BASIC, 0.1), (StatType.BASIC_NDV, 1 / NDV), (StatType.NDV_HYPERLOG, 1 / NDV)])
def test_number(spark, kind, share, rate):
    valid = TOTAL - NULLS
    base = [("is_null", "p", None, up(NULLS, rate)), ("not_null", "p", None, up(valid, rate)), ("exists", "p", None, up(TOTAL, rate))]
    check(spark, kind, [row("p", "base", TOTAL, NULLS), row("p_num", "num", valid, 0, LOW, HIGH, NDV)], base + asked_of_numbers(valid, valid * share, rate), rate)


def test_bool_and_string(spark):
    rows = [row("f_bool", "bool", 46, 0, False, True, 2), row("t_str", "str", 212, 12, "kiwi", "plum", 25)]
    check(spark, StatType.BASIC, rows, [("eq", "f_bool", True, 23), ("eq", "f_bool", False, 23), ("eq", "t_str", "lime", 20), ("eq", "t_str", "plum", 20), ("eq", "t_str", "quince", 0), ("eq", "t_str", "fig", 0)])
    check(spark, StatType.BASIC_NDV, rows, [("eq", "f_bool", False, 23), ("eq", "t_str", "lime", 8), ("eq", "t_str", "zebra", 0)])


@pytest.mark.parametrize("kind", list(StatType))
@pytest.mark.parametrize(("hcs", "rate"), [(50, 0.0), (25, 0.5)])
def test_missing_path(spark, kind, hcs, rate):
    asked = [("exists", "x", None, 50), ("is_null", "x", None, 5), ("not_null", "x", None, 45), ("eq", "x_num", 3, 5), ("lt", "x_num", 3, 15), ("gt", "x_num", 3, 15), ("range", "x_num", (3, 4), 15), ("eq", "x_bool", False, 25)]
    asked += [("contains", "x_arr", [], 50), ("overlaps", "x_arr", [], 0), ("contains", "x_arr", [4], 5), ("overlaps", "x_arr", [4, 9], 15), ("memberof", "x_arr", 4, 5)]
    check(spark, kind, [row("other", "base", 1)], asked, rate, hcs)


#: Equi-height buckets (upper bound, count, distinct values) over a range from 3.
BUCKETS = [(12, 70, 5), (13, 64, 1), (40, 90, 20), (95, 26, 4)]


def by_buckets(op, x):
    total, low, first = 0.0, 3, True
    for high, count, ndv in BUCKETS:
        if op == "lt":
            total += count if high < x else count * (x - low) / (high - low) if (first or low < x) and ndv > 1 and x > low else 0
        elif op == "gt":
            total += count if low > x else (count if ndv == 1 else count * (high - x) / (high - low)) if high > x else 0
        elif op == "range":
            total += max(0, min(high, x[1]) - max(low, x[0])) / (high - low) * count
        elif low < x <= high or (first and x == low):
            total = count / ndv
        low, first = high, False
    return total


@pytest.mark.parametrize("rate", [0.0, 0.5])
def test_equi_height(spark, rate):
    rows = [row("h_num", "num", 250, 0, 3, 95, 30, hist="EQUI_HEIGHT", buckets=BUCKETS)]
    outside = {"lt": {2: 0, 3: 0, 99: 250}, "gt": {2: 250, 95: 0, 99: 0}, "eq": {2: 0, 99: 0}}
    asked = [(op, "h_num", x, up(outside[op].get(x, by_buckets(op, x)), rate)) for op in outside for x in (2, 3, 7.5, 12, 12.5, 13, 21, 40, 94, 95, 99) if not (op == "gt" and x == 2)]
    asked += [("range", "h_num", x, up(by_buckets("range", x), rate)) for x in ((-9, 1), (3, 95), (5, 12), (12, 13), (13, 13), (20, 500), (0, 30), (200, 300))]
    check(spark, StatType.HISTOGRAM, rows, [*asked, ("exists", "h_num", None, up(250, rate))], rate)


def test_singletons(spark):
    words = [("ash", 7), ("elm", 31), ("elms", 2), ("oak", 16), ("yew", 4)]
    rows = [row("f_bool", "bool", 27, 0, False, True, 2, hist="SINGLETON", buckets=[(False, 21), (True, 6)]), row("t_str", "str", 60, 0, "ash", "yew", 5, hist="SINGLETON", buckets=words)]
    rows.append(row("p_str", "str", 90, 0, "a", "z", 13, hist="SINGLETON_PLUS", buckets=[("k", 54), (None, 36, 12)]))
    rows.append(row("n_num", "num", 22, 0, 2, 9, 4, hist="SINGLETON", buckets=[(2, 3), (5, 8), (6, 1), (9, 10)]))
    asked = [("eq", "f_bool", True, 6), ("eq", "f_bool", False, 21), *(("eq", "t_str", w, n) for w, n in words), ("eq", "t_str", "fir", 0), ("eq", "p_str", "k", 54), ("eq", "p_str", "m", 3)]
    check(spark, StatType.HISTOGRAM, rows, [*asked, ("gt", "n_num", 2, 19), ("lt", "n_num", 9, 12), ("lt", "n_num", 6, 11), ("gt", "n_num", 5.5, 11)])


def test_mode(spark):
    rows = [row("a_num", "num", 100, 0, 0, 10, 5, (4.0, 60)), row("one_num", "num", 7, 0, 3, 3, 1, (3.0, 7)), row("no_num", "num", 10, 0, 0, 9, 5)]
    asked = [("eq", "a_num", 4, 60), ("eq", "a_num", 5, 10), ("eq", "one_num", 3, 7), ("gt", "a_num", 2, 120), ("gt", "a_num", 8, 1), ("lt", "a_num", 5, 90), ("lt", "a_num", 2, 1), ("eq", "no_num", 3, 2), ("range", "a_num", (1, 2), None)]
    check(spark, StatType.NDV_WITH_MODE, rows, asked)


def test_arrays(spark):
    words = [("a", 50), ("b", 20), (None, 9, 30)]
    rows = [row("t_arr", "arr", 100, 10), row("t_arr[str]", "str", 80, ndv=32, mode=("a", 50), hist="SINGLETON_PLUS", buckets=words), row("u_arr", "arr", 40)]
    asked = [("memberof", "t_arr", "a", 50), ("memberof", "t_arr", "q", 9), ("memberof", "t_arr", 3, 10), ("memberof", "u_arr", "a", 4), ("contains", "t_arr", ["a", "b", "a"], 10), ("contains", "t_arr", ["a"], 50), ("contains", "t_arr", [], 90), ("overlaps", "t_arr", ["b", "q"], 20), ("overlaps", "t_arr", [], 0)]
    check(spark, StatType.HISTOGRAM, rows, asked)
    check(spark, StatType.NDV_WITH_MODE, rows, [("memberof", "t_arr", "a", 50), ("memberof", "t_arr", "b", math.ceil(30 / 31))])
    check(spark, StatType.BASIC_NDV, rows, [("memberof", "t_arr", "a", 3), ("memberof", "u_arr", "a", 4)])
    check(spark, StatType.BASIC, rows, [("memberof", "t_arr", "a", 8)])


def test_inner_paths_have_no_inequalities(spark):
    rows = [row("a", "base", 10, 2), row("a_obj", "obj", 8)]
    check(spark, StatType.BASIC, rows, [("gt", "a_obj", 1, None), ("lt", "a", 1, None), ("eq", "a_obj", 1, None), ("exists", "a_obj", None, 8), ("not_null", "a", None, 8)])


def test_ceil_is_binary(spark):
    check(spark, StatType.BASIC, [row("a", "base", 10)], [("exists", "a", None, 101)], rate=0.9)
