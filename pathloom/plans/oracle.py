"""SQL for DuckDB that gives the rows of the registered queries from the tables, independent of the engine's own operators.

The nodes of each collection are a UNION ALL over the tables, a term for each path.
"""

from __future__ import annotations

from ..config import Prune, StatType
from . import queries as q


def _term(source: str, path: str, base: str, kind: str, value: str = "NULL", where: str = "true") -> str:
    """Nodes of one path; ``path`` and ``base`` are SQL texts."""
    typed = base if kind == "null" else f"{base} || '_{kind}'"
    num, text, flag = (f"CAST({value if kind == k else 'NULL'} AS {t})" for k, t in (("num", "DOUBLE"), ("str", "VARCHAR"), ("bool", "BOOLEAN")))
    return f"SELECT d AS doc_id, {path} AS jp, {typed} AS typed, {base} AS base, '{kind}' AS kind, {num} AS num, {text} AS str, {flag} AS bool FROM {source} WHERE {where}"


def _plain(source: str, *columns: tuple[str, str]) -> list[str]:
    return [_term(source, f"'{c}'", f"'{c}'", k, c, f"{c} IS NOT NULL") for c, k in columns]


_SOURCES = {
    "events": (
        "src AS (SELECT event_id AS d, *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)",
        _plain("src", ("event_id", "num"), ("user_id", "num"), ("event_type", "str"), ("value", "num")) + [_term("src", "'props'", "'props'", "obj"), _term("src", "'props/k'", "'props_obj.k'", "num", "k")],
    ),
    "mixed": (
        "src AS (SELECT event_id AS d, *, event_id % 8 AS m FROM events)",
        _plain("src", ("event_id", "num")) + [
            _term("src", "'x'", "'x'", "num", "event_id % 100", "m = 0"), _term("src", "'x'", "'x'", "num", "CAST(event_id % 50 AS DOUBLE) / 4", "m = 1"),
            _term("src", "'x'", "'x'", "str", "event_type", "m = 2"), _term("src", "'x'", "'x'", "bool", "event_id % 3 = 0", "m = 3"), _term("src", "'x'", "'x'", "null", where="m = 4"),
            _term("src", "'x'", "'x'", "arr", where="m = 5"), _term("src", "'x/0'", "'x_arr.0'", "num", "user_id % 10", "m = 5"), _term("src", "'x/1'", "'x_arr.1'", "str", "event_type", "m = 5"),
            _term("src", "'x'", "'x'", "obj", where="m = 6"), _term("src", "'x/k'", "'x_obj.k'", "num", "event_id % 5", "m = 6"),
        ],
    ),
    "labels": (
        "src AS (SELECT a.doc_id AS d, a.doc_id, lang, source, n_chars, quality, toxic FROM documents a LEFT JOIN labels b USING (doc_id))",
        _plain("src", ("doc_id", "num"), ("lang", "str"), ("source", "str"), ("n_chars", "num"), ("quality", "num"), ("toxic", "num")),
    ),
    "orders": (
        """src AS (SELECT o_orderkey AS d, * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
            WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
        items AS (SELECT l_orderkey AS d, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1 AS VARCHAR) AS i, * FROM lineitem WHERE l_orderkey IN (SELECT d FROM src)),
        flags AS (SELECT d, l_returnflag AS v, CAST(row_number() OVER (PARTITION BY d ORDER BY l_returnflag) - 1 AS VARCHAR) AS i FROM (SELECT DISTINCT d, l_returnflag FROM items)),
        lines AS (SELECT d, l_linenumber AS v, i FROM items)""",
        _plain("src", ("o_orderkey", "num"), ("o_orderstatus", "str"), ("o_totalprice", "num")) + [
            _term("src", "'customer'", "'customer'", "obj"), _term("src", "'customer/c_custkey'", "'customer_obj.c_custkey'", "num", "c_custkey"),
            _term("src", "'customer/c_mktsegment'", "'customer_obj.c_mktsegment'", "str", "c_mktsegment"), _term("src", "'customer/nation'", "'customer_obj.nation'", "obj"),
            _term("src", "'customer/nation/n_name'", "'customer_obj.nation_obj.n_name'", "str", "n_name"), _term("src", "'customer/nation/region'", "'customer_obj.nation_obj.region'", "obj"),
            _term("src", "'customer/nation/region/r_name'", "'customer_obj.nation_obj.region_obj.r_name'", "str", "r_name"),
            _term("src", "'items'", "'items'", "arr"), _term("src", "'flags'", "'flags'", "arr"), _term("src", "'lines'", "'lines'", "arr"), _term("items", "'items/' || i", "'items_arr.' || i", "obj"),
            *(_term("items", f"'items/' || i || '/{c}'", f"'items_arr.' || i || '_obj.{c}'", k, c) for c, k in (("l_linenumber", "num"), ("l_quantity", "num"), ("l_returnflag", "str"))),
            _term("flags", "'flags/' || i", "'flags_arr.' || i", "str", "v"), _term("lines", "'lines/' || i", "'lines_arr.' || i", "num", "v"),
        ],
    ),
    "convs": (
        """turns AS (SELECT conv_id AS d, role, length(text) AS size, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) - 1 AS VARCHAR) AS i FROM conversations),
        src AS (SELECT DISTINCT d, d AS conv_id FROM turns)""",
        _plain("src", ("conv_id", "num")) + [
            _term("src", "'turns'", "'turns'", "arr"), _term("src", "'roles'", "'roles'", "arr"), _term("turns", "'turns/' || i", "'turns_arr.' || i", "obj"),
            _term("turns", "'turns/' || i || '/role'", "'turns_arr.' || i || '_obj.role'", "str", "role"), _term("turns", "'turns/' || i || '/size'", "'turns_arr.' || i || '_obj.size'", "num", "size"),
            _term("turns", "'roles/' || i", "'roles_arr.' || i", "str", "role"),
        ],
    ),
}


def _with(name: str, *more: str, where: str = "true", recursive: bool = False) -> str:
    source, terms = _SOURCES[name]
    whole = f"every AS ({' UNION ALL '.join(terms)}), nodes AS (SELECT * FROM every WHERE {where})"
    return f"WITH {'RECURSIVE ' * recursive}{', '.join([source, whole, *more])} "


VC = "vc AS (SELECT typed AS path, kind, num, str, bool, count(*) AS cnt FROM nodes WHERE kind IN ('num', 'str', 'bool') GROUP BY ALL)"
PC = """pc AS (SELECT base AS path, count(*) AS cnt, count(*) FILTER (kind = 'null') AS null_count FROM nodes GROUP BY base
    UNION ALL SELECT typed, count(*), 0 FROM nodes WHERE kind <> 'null' GROUP BY typed)"""
RANGES = "rg AS (SELECT path, min(num) AS min_num, max(num) AS max_num, min(str) AS min_str, max(str) AS max_str, min(bool) AS min_bool, max(bool) AS max_bool, count(*) AS ndv FROM vc GROUP BY path)"
MODES = "md AS (SELECT path, num AS mode_num, str AS mode_str, bool AS mode_bool, cnt AS mode_cnt FROM vc QUALIFY row_number() OVER (PARTITION BY path ORDER BY cnt DESC, num, str, bool) = 1)"


def _histogram(bins: int) -> list[str]:
    """hb: buckets of all paths. An equi-height bucket ends at the first value whose running count reaches that of the bucket before plus the target."""
    return [
        f"tot AS (SELECT path, any_value(kind) AS kind, CAST(sum(cnt) AS BIGINT) AS n, count(*) AS nd, CAST(ceil(sum(cnt) / {bins}.0) AS BIGINT) AS target FROM vc GROUP BY path)",
        f"single AS (SELECT path, 'SINGLETON' AS hist_type, row_number() OVER (PARTITION BY path ORDER BY num, str, bool) - 1 AS pos, num, str, bool, cnt, CAST(NULL AS BIGINT) AS ndv FROM vc JOIN tot USING (path) WHERE nd <= {bins})",
        f"often AS (SELECT vc.*, n, nd, row_number() OVER (PARTITION BY path ORDER BY str) - 1 AS pos FROM vc JOIN tot USING (path) WHERE nd > {bins} AND tot.kind = 'str' AND cnt * {bins} > n)",
        """plus AS (SELECT path, 'SINGLETON_PLUS' AS hist_type, pos, num, str, bool, cnt, CAST(NULL AS BIGINT) AS ndv FROM often
            UNION ALL SELECT path, 'SINGLETON_PLUS', count(*), NULL, NULL, NULL, any_value(n) - CAST(sum(cnt) AS BIGINT), any_value(nd) - count(*) FROM often GROUP BY path)""",
        f"runs AS (SELECT path, num, CAST(sum(cnt) OVER (PARTITION BY path ORDER BY num) AS BIGINT) AS cum, row_number() OVER (PARTITION BY path ORDER BY num) AS rn, n, target FROM vc JOIN tot USING (path) WHERE nd > {bins} AND tot.kind = 'num')",
        """ends AS (SELECT DISTINCT path, CAST(-1 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS cum FROM runs
            UNION ALL SELECT e.path, e.pos + 1, coalesce(min(CASE WHEN r.cum >= e.cum + r.target THEN r.cum END), max(r.cum)) FROM ends e JOIN runs r ON e.path = r.path AND r.cum > e.cum GROUP BY e.path, e.pos)""",
        """equi AS (SELECT e.path, 'EQUI_HEIGHT' AS hist_type, e.pos, r.num, CAST(NULL AS VARCHAR) AS str, CAST(NULL AS BOOLEAN) AS bool, r.cum - coalesce(lag(r.cum) OVER w, 0) AS cnt, r.rn - coalesce(lag(r.rn) OVER w, 0) AS ndv
            FROM ends e JOIN runs r ON e.path = r.path AND e.cum = r.cum WHERE e.pos >= 0 WINDOW w AS (PARTITION BY e.path ORDER BY e.pos))""",
        "hb AS (SELECT * FROM single UNION ALL SELECT * FROM plus UNION ALL SELECT * FROM equi)",
    ]


def inventory(name: str) -> str:
    return _with(name) + "SELECT typed AS typed_path, base AS base_path, kind, count(*) AS cnt FROM nodes GROUP BY ALL"


def basic(name: str) -> str:
    return _with(name, VC, PC, RANGES) + "SELECT path, cnt, null_count, min_num, max_num, min_str, max_str, min_bool, max_bool FROM pc LEFT JOIN rg USING (path)"


def ndv(name: str) -> str:
    return _with(name, VC) + "SELECT path, count(*) AS ndv FROM vc GROUP BY path"


def mode(name: str) -> str:
    return _with(name, VC, RANGES, MODES) + "SELECT path, ndv, mode_num, mode_str, mode_bool, mode_cnt FROM rg JOIN md USING (path)"


def buckets(name: str, bins: int) -> str:
    return _with(name, VC, *_histogram(bins), recursive=True) + "SELECT path, hist_type, CAST(pos AS INTEGER) AS pos, num, str, bool, cnt, ndv FROM hb"


def streamed() -> str:
    return buckets("events", q.BINS)


#: Arrays of one type: path, array's place, and element as text and number.
_ENUM = {
    "orders": "el AS (SELECT 'flags_arr[str]' AS path, d, v AS str, CAST(NULL AS DOUBLE) AS num FROM flags UNION ALL SELECT DISTINCT 'lines_arr[num]', d, CAST(NULL AS VARCHAR), CAST(v AS DOUBLE) FROM lines)",
    "convs": "el AS (SELECT DISTINCT 'roles_arr[str]' AS path, d, role AS str, CAST(NULL AS DOUBLE) AS num FROM turns)",
}
ENUM_COUNTS = "ec AS (SELECT path, num, str, count(*) AS cnt, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, num, str) AS r, count(*) OVER (PARTITION BY path) AS ndv FROM el GROUP BY path, num, str)"
ENUM_ARRAYS = "ea AS (SELECT path, count(DISTINCT d) AS cnt FROM el GROUP BY path)"


def enum_counts(name: str) -> str:
    return _with(name, _ENUM[name], ENUM_COUNTS, ENUM_ARRAYS) + "SELECT path, ea.cnt, ndv, num AS mode_num, str AS mode_str, ec.cnt AS mode_cnt FROM ea JOIN ec USING (path) WHERE r = 1"


def _enum_buckets(bins: int) -> str:
    return f"""eb AS (SELECT path, CASE WHEN ndv <= {bins} THEN 'SINGLETON' ELSE 'SINGLETON_PLUS' END AS hist_type, r - 1 AS pos, CASE WHEN ndv <= {bins} OR r < {bins} THEN num END AS num,
        CASE WHEN ndv <= {bins} OR r < {bins} THEN str END AS str, CAST(NULL AS BOOLEAN) AS bool, cnt, CASE WHEN ndv > {bins} AND r = {bins} THEN ndv - {bins - 1} END AS ndv FROM ec WHERE r <= {bins})"""


def enum_buckets(name: str, bins: int) -> str:
    return _with(name, _ENUM[name], ENUM_COUNTS, _enum_buckets(bins)) + "SELECT path, hist_type, CAST(pos AS INTEGER) AS pos, num, str, bool, cnt, ndv FROM eb"


def sample(rate: float) -> str:
    return f"((doc_id * 2654435761) % 1000003) / CAST(1000003 AS DOUBLE) >= CAST({rate} AS DOUBLE)"


def pruned(*strategies: Prune) -> str:
    """One strategy at a time."""
    size = "(SELECT count(*) FROM src)"
    head = _with(q.PRUNED, PC)
    own = {
        Prune.MIN_FREQ: f"SELECT path, cnt, null_count FROM pc WHERE cnt > floor(CAST({q.MIN_FREQ} AS DOUBLE) * {size})",
        Prune.NO_TYPED_INNER_NODES: "SELECT path, cnt, null_count FROM pc WHERE NOT suffix(path, 'arr') AND NOT suffix(path, 'obj')",
        Prune.MAX_NO_PATHS: f"SELECT path, cnt, null_count FROM pc ORDER BY cnt DESC, path LIMIT {q.MAX_PATHS}",
    }
    if strategies[0] is Prune.UNIQUE_SUFFIX:
        return _with(q.PRUNED, PC, *_suffixes()) + "SELECT coalesce(short, path) AS path, cnt, null_count FROM pc LEFT JOIN best USING (path)"
    if strategies[0] is Prune.MAX_PREFIX_LENGTH:
        cut = f"array_to_string(list_slice(string_split({{0}}, '.'), greatest(len(string_split({{0}}, '.')) - {q.MAX_PREFIX - 1}, 1), len(string_split({{0}}, '.'))), '.')"
        short = f"short AS (SELECT {cut.format('typed')} AS typed, {cut.format('base')} AS base, kind FROM nodes)"
        return _with(q.PRUNED, short, PC.replace("FROM nodes", "FROM short")) + "SELECT path, cnt, null_count FROM pc"
    return head + own[strategies[0]]


def _suffixes() -> list[str]:
    return [
        "parts AS (SELECT path, string_split(path, '.') AS p FROM pc)",
        "cand AS (SELECT path, k, array_to_string(list_slice(p, k, len(p)), '.') AS s FROM parts, generate_series(2, 12) g(k) WHERE k <= len(p))",
        "good AS (SELECT path, k, s FROM cand WHERE NOT EXISTS (SELECT 1 FROM pc o WHERE o.path <> cand.path AND suffix(o.path, cand.s)))",
        "best AS (SELECT path, arg_max(s, k) AS short FROM good GROUP BY path)",
    ]


def lookup() -> str:
    more = [
        *_suffixes(), "stored AS (SELECT coalesce(short, path) AS s FROM pc LEFT JOIN best USING (path))",
        "every_suffix AS (SELECT path, k, array_to_string(list_slice(p, k, len(p)), '.') AS s FROM parts, generate_series(1, 12) g(k) WHERE k <= len(p))",
        "hit AS (SELECT path, arg_min(s, k) AS stored FROM every_suffix WHERE s IN (SELECT s FROM stored) GROUP BY path)",
    ]
    return _with(q.PRUNED, PC, *more) + "SELECT path, coalesce(stored, path) AS stored FROM pc LEFT JOIN hit USING (path)"


def meta(*strategies: Prune) -> str:
    least = f"floor(CAST({q.MIN_FREQ} AS DOUBLE) * (SELECT count(*) FROM src))"
    kept = f"kept AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, path) AS r FROM pc WHERE cnt > {least})"
    top = Prune.MAX_NO_PATHS in strategies
    skipped = f"coalesce((SELECT cnt FROM kept WHERE r = {q.MAX_PATHS + 1}), CAST({least} AS BIGINT))" if top else f"CAST({least} AS BIGINT)"
    return _with(q.PRUNED, PC, kept) + f"""SELECT (SELECT count(*) FROM src) AS collection_size, (SELECT count(*) FROM pc) AS unique_key_paths_found,
        (SELECT count(*) FROM kept{f' WHERE r <= {q.MAX_PATHS}' * top}) AS unique_key_paths_stored, {skipped} AS highest_count_skipped, 'BASIC' AS stats_type, CAST(0 AS DOUBLE) AS sampling_rate"""


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)"


def _predicates(rows: list[tuple]) -> list[str]:
    scalar, elements = [], []
    for k, (op, path, v) in enumerate(rows):
        low, high = v if op == "range" else (None, None)
        own = v if v is not None and not isinstance(v, (list, tuple)) else None
        kind = None if own is None else "bool" if isinstance(own, bool) else "str" if isinstance(own, str) else "num"
        scalar.append(f"({k}, '{op}', '{path}', {_literal(kind)}, {_literal(own if kind == 'num' else None)}, {_literal(own if kind == 'str' else None)}, {_literal(own if kind == 'bool' else None)}, {_literal(low)}, {_literal(high)})")
        for x in dict.fromkeys(v if isinstance(v, list) else [v] if op == "memberof" else []):
            elements.append(f"({k}, '{'str' if isinstance(x, str) else 'num'}', {_literal(None if isinstance(x, str) else x)}, {_literal(x if isinstance(x, str) else None)})")
    typed = "SELECT CAST(id AS BIGINT) AS pred_id, op, path, CAST(k AS VARCHAR) AS kind, CAST(n AS DOUBLE) AS num, CAST(s AS VARCHAR) AS str, CAST(b AS BOOLEAN) AS bool, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi"
    out = [f"preds AS ({typed} FROM (VALUES {', '.join(scalar)}) v(id, op, path, k, n, s, b, lo, hi))"]
    values = ", ".join(elements) or "(NULL, NULL, NULL, NULL)"
    return [*out, f"els AS (SELECT CAST(id AS BIGINT) AS pred_id, CAST(k AS VARCHAR) AS ek, CAST(n AS DOUBLE) AS en, CAST(s AS VARCHAR) AS es FROM (VALUES {values}) v(id, k, n, s) WHERE id IS NOT NULL)"]


def estimates(name: str, kind: StatType, rate: float = 0.0, top: int | None = None) -> str:
    """The estimators over rows: sums over buckets are joins here."""
    v, width = "CAST(cnt - null_count AS DOUBLE)", "(max_num - min_num)"
    linear = {"gt": f"least(max_num - num, {width}) / {width} * {v}", "lt": f"least(num - min_num, {width}) / {width} * {v}"}
    if kind is StatType.NDV_WITH_MODE:
        for op, sign in (("gt", ">"), ("lt", "<")):
            linear[op] = f"greatest({linear[op]} + CASE WHEN mode_num {sign} num THEN mode_cnt - {v} / ndv ELSE {v} / ndv - mode_cnt END, 1)"
    eq = {
        StatType.BASIC: f"{v} * CASE WHEN kind = 'bool' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END",
        StatType.BASIC_NDV: f"{v} / ndv",
        StatType.NDV_WITH_MODE: f"CASE WHEN coalesce(mode_num = num, mode_str = str, mode_bool = bool) THEN mode_cnt WHEN ndv = 1 THEN 0 ELSE ({v} - mode_cnt) / (ndv - 1) END",
        StatType.HISTOGRAM: f"CASE WHEN h.path IS NULL THEN {v} / s.ndv WHEN h.hist_type = 'EQUI_HEIGHT' THEN h.equi_eq ELSE coalesce(h.exact, CASE WHEN h.hist_type = 'SINGLETON_PLUS' THEN h.rest ELSE 0 END) END",
    }[kind]
    ranged = f"CASE WHEN least(max_num, hi) - greatest(min_num, lo) < 0 THEN 0 WHEN {width} = 0 THEN {v} ELSE (least(max_num, hi) - greatest(min_num, lo)) / {width} * {v} END"
    if kind is StatType.NDV_WITH_MODE:
        ranged = "CAST(NULL AS DOUBLE)"
    if kind is StatType.HISTOGRAM:
        linear = {"gt": "h.gt", "lt": "h.lt"}
        ranged = "h.rng"
    more = [VC, PC, RANGES, MODES, *_histogram(q.BINS), *_predicates(q.PREDICATES[name])]
    stored = f"SELECT *, row_number() OVER (ORDER BY cnt DESC, path) AS r FROM pc{f' QUALIFY r <= {top}' if top else ''}"
    hcs = f"coalesce((SELECT cnt FROM (SELECT cnt, row_number() OVER (ORDER BY cnt DESC, path) AS r FROM pc) WHERE r = {top + 1}), 0)" if top else "0"
    more += [
        f"s AS (SELECT * EXCLUDE (r) FROM ({stored}) LEFT JOIN rg USING (path) LEFT JOIN md USING (path))",
        "hx AS (SELECT hb.*, coalesce(lag(hb.num) OVER (PARTITION BY hb.path ORDER BY pos), rg.min_num) AS low, lag(hb.num) OVER (PARTITION BY hb.path ORDER BY pos) AS prev FROM hb JOIN rg ON hb.path = rg.path)",
        """h AS (SELECT p.pred_id, hx.path, any_value(hist_type) AS hist_type,
            CASE any_value(hist_type) WHEN 'SINGLETON' THEN sum(CASE WHEN hx.num > p.num THEN CAST(cnt AS DOUBLE) ELSE 0 END) WHEN 'EQUI_HEIGHT' THEN sum(CASE WHEN low > p.num THEN CAST(cnt AS DOUBLE) WHEN hx.num > p.num THEN CASE WHEN ndv = 1 THEN CAST(cnt AS DOUBLE) ELSE cnt * ((hx.num - p.num) / (hx.num - low)) END ELSE 0 END ORDER BY pos) END AS gt,
            CASE any_value(hist_type) WHEN 'SINGLETON' THEN sum(CASE WHEN hx.num < p.num THEN CAST(cnt AS DOUBLE) ELSE 0 END) WHEN 'EQUI_HEIGHT' THEN sum(CASE WHEN hx.num < p.num THEN CAST(cnt AS DOUBLE) WHEN (prev IS NULL OR prev < p.num) AND ndv > 1 THEN cnt * ((p.num - low) / (hx.num - low)) ELSE 0 END ORDER BY pos) END AS lt,
            CASE any_value(hist_type) WHEN 'EQUI_HEIGHT' THEN sum(CASE WHEN hx.num = low THEN CASE WHEN hx.num BETWEEN p.lo AND p.hi THEN CAST(cnt AS DOUBLE) ELSE 0 END ELSE greatest(least(hx.num, p.hi) - greatest(low, p.lo), 0) / (hx.num - low) * cnt END ORDER BY pos) END AS rng,
            max(CASE WHEN coalesce(hx.num = p.num, hx.str = p.str, hx.bool = p.bool) THEN CAST(cnt AS DOUBLE) END) AS exact, coalesce(arg_min(cnt / CAST(ndv AS DOUBLE), pos) FILTER (hx.num >= p.num), 0) AS equi_eq, max(CASE WHEN ndv IS NOT NULL THEN cnt / CAST(ndv AS DOUBLE) END) AS rest
            FROM preds p JOIN hx ON p.path = hx.path GROUP BY p.pred_id, hx.path)""",
    ]
    missing = "hcs * CAST(CASE WHEN op = 'eq' AND kind = 'bool' THEN 0.5 WHEN op = 'exists' THEN 1 WHEN op = 'not_null' THEN 0.9 WHEN op IN ('is_null', 'eq', 'memberof', 'contains') THEN 0.1 ELSE 0.3 END AS DOUBLE)"
    value = f"""CASE WHEN s.path IS NULL THEN {missing} WHEN op = 'exists' THEN CAST(cnt AS DOUBLE) WHEN op = 'not_null' THEN {v} WHEN op = 'is_null' THEN CAST(null_count AS DOUBLE)
        WHEN op = 'gt' THEN CASE WHEN max_num IS NULL THEN NULL WHEN num >= max_num OR max_num = min_num THEN 0 ELSE {linear['gt']} END
        WHEN op = 'lt' THEN CASE WHEN max_num IS NULL THEN NULL WHEN num <= min_num OR max_num = min_num THEN 0 ELSE {linear['lt']} END
        WHEN op = 'range' THEN {ranged}
        WHEN coalesce(num > max_num OR num < min_num, str > max_str OR str < min_str, bool > max_bool OR bool < min_bool) THEN 0 ELSE {eq} END"""
    if name == "orders":
        more += [_ENUM[name], ENUM_COUNTS, ENUM_ARRAYS, _enum_buckets(q.BINS)]
        member = {
            StatType.BASIC: "coalesce(ea.cnt, s.cnt) * CAST(0.1 AS DOUBLE)",
            StatType.BASIC_NDV: "CASE WHEN ea.path IS NULL THEN s.cnt * CAST(0.1 AS DOUBLE) ELSE ea.cnt / CAST(m.ndv AS DOUBLE) END",
            StatType.NDV_WITH_MODE: "CASE WHEN ea.path IS NULL THEN s.cnt * CAST(0.1 AS DOUBLE) WHEN coalesce(m.num = en, m.str = es) THEN CAST(m.cnt AS DOUBLE) WHEN m.ndv = 1 THEN 0 ELSE (ea.cnt - m.cnt) / CAST(m.ndv - 1 AS DOUBLE) END",
            StatType.HISTOGRAM: "CASE WHEN ea.path IS NULL THEN s.cnt * CAST(0.1 AS DOUBLE) ELSE coalesce((SELECT CAST(max(cnt) AS DOUBLE) FROM eb WHERE eb.path = ea.path AND coalesce(eb.num = en, eb.str = es)), (SELECT CAST(max(cnt) AS DOUBLE) FROM eb WHERE eb.path = ea.path AND eb.ndv IS NOT NULL), s.cnt * CAST(0.1 AS DOUBLE)) END",
        }[kind]
        more.append(f"mem AS (SELECT e.pred_id, {member} AS m FROM els e JOIN preds p USING (pred_id) JOIN s ON s.path = p.path LEFT JOIN ea ON ea.path = p.path || '[' || ek || ']' LEFT JOIN (SELECT * FROM ec WHERE r = 1) m ON m.path = ea.path)")
        more.append("agg AS (SELECT pred_id, min(m) AS low, max(m) AS high, count(m) AS n FROM mem GROUP BY pred_id)")
        given = "(SELECT count(*) FROM els WHERE els.pred_id = p.pred_id)"
        value = f"""CASE WHEN op = 'overlaps' AND {given} = 0 THEN 0 WHEN s.path IS NULL THEN CASE WHEN op = 'contains' AND {given} = 0 THEN hcs ELSE {missing} END
            WHEN op = 'contains' AND {given} = 0 THEN {v} WHEN op = 'overlaps' THEN high WHEN op = 'contains' AND n > 1 THEN low / n ELSE low END"""
    extra = " LEFT JOIN agg ON agg.pred_id = p.pred_id" * (name == "orders")
    return _with(name, *more, where=sample(rate) if rate else "true", recursive=True) + f"""SELECT p.pred_id, op, p.path, CAST(ceil(({value}) / (1 - CAST({rate} AS DOUBLE))) AS BIGINT) AS estimate
        FROM preds p LEFT JOIN s ON s.path = p.path LEFT JOIN h ON h.pred_id = p.pred_id{extra}, (SELECT CAST({hcs} AS DOUBLE) AS hcs)"""


#: Arrays by collection: path, document, elements as texts with their kind.
_ARRAYS = {"mixed": "SELECT 'x' AS jp, d, ['num:' || CAST(CAST(user_id % 10 AS DOUBLE) AS VARCHAR), 'str:' || event_type] AS own FROM src WHERE m = 5"}


def truths(name: str, per_path: int = 25) -> str:
    more = [
        "v AS (SELECT jp, typed, kind, num, str, bool, coalesce(CAST(num AS VARCHAR), str, CAST(bool AS VARCHAR)) AS t, count(*) AS cnt FROM nodes WHERE kind IN ('num', 'str', 'bool') GROUP BY ALL)",
        f"o AS (SELECT *, row_number() OVER (PARTITION BY jp ORDER BY md5(t), kind, t) AS r FROM v QUALIFY r <= {per_path})",
        "c AS (SELECT jp, count(*) AS n, count(*) FILTER (kind = 'null') AS nulls FROM nodes GROUP BY jp)",
        f"arr AS ({_ARRAYS.get(name, 'SELECT NULL AS jp, NULL AS d, [NULL] AS own WHERE false')})",
        f"ao AS (SELECT jp, own, list_sort(list_transform(list_distinct(own), lambda x: md5(x) || x)) AS e FROM (SELECT DISTINCT jp, own FROM arr) QUALIFY row_number() OVER (PARTITION BY jp ORDER BY md5(array_to_string(own, ',')), own) <= {per_path})",
        "sub AS (SELECT jp, e[1:1] AS one, CASE WHEN len(list_filter(e, lambda x: x < '8')) > 0 THEN list_filter(e, lambda x: x < '8') ELSE e[1:1] END AS many FROM ao)",
        "ask AS (SELECT DISTINCT op, jp, list_transform(els, lambda x: substr(x, 33)) AS els FROM (SELECT 'memberof' AS op, jp, one AS els FROM sub WHERE len(one) > 0 UNION ALL SELECT 'contains', jp, many FROM sub UNION ALL SELECT 'overlaps', jp, many FROM sub))",
    ]
    none = "CAST(NULL AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS str, CAST(NULL AS BOOLEAN) AS bool"
    below = "coalesce((SELECT CAST(sum(cnt) AS BIGINT) FROM v WHERE v.jp = o.jp AND v.kind = 'num' AND v.num {} o.num), 0)"
    met = "CASE op WHEN 'overlaps' THEN list_has_any(own, els) ELSE list_has_all(own, els) END"
    return _with(name, *more) + f"""SELECT op, c.jp AS json_path, {none}, CAST(NULL AS VARCHAR) AS els, CASE op WHEN 'exists' THEN n WHEN 'is_null' THEN nulls ELSE n - nulls END AS truth FROM c, (VALUES ('exists'), ('not_null'), ('is_null')) x(op)
        UNION ALL SELECT 'eq', jp, num, str, bool, NULL, cnt FROM o UNION ALL SELECT 'lt', jp, num, str, bool, NULL, {below.format('<')} FROM o WHERE kind = 'num' UNION ALL SELECT 'gt', jp, num, str, bool, NULL, {below.format('>')} FROM o WHERE kind = 'num'
        UNION ALL SELECT op, jp, NULL, NULL, NULL, array_to_string(els, ','), (SELECT count(*) FROM arr WHERE arr.jp = ask.jp AND {met}) FROM ask"""


def array_truths() -> str:
    rows = [*q.PREDICATES["orders"], ("range", "o_totalprice_num", (1000, 150000)), ("contains", "flags_arr", ["A", "N", "R"]), ("overlaps", "flags_arr", ["Z"])]
    arrays = "el AS (SELECT DISTINCT 'flags_arr' AS path, d, v AS str, CAST(NULL AS DOUBLE) AS num FROM flags UNION ALL SELECT DISTINCT 'lines_arr', d, NULL, CAST(v AS DOUBLE) FROM lines)"
    sets = "arrs AS (SELECT DISTINCT path, d FROM el UNION ALL SELECT 'items_arr', d FROM src)"
    hits = "hits AS (SELECT e.pred_id, el.d, count(*) AS n FROM els e JOIN preds p USING (pred_id) JOIN el ON el.path = p.path AND coalesce(el.num = en, el.str = es) GROUP BY ALL)"
    wanted = "wanted AS (SELECT p.pred_id, count(en) + count(es) AS w FROM preds p LEFT JOIN els USING (pred_id) GROUP BY p.pred_id)"
    return _with("orders", *_predicates(rows), arrays, sets, hits, wanted) + """SELECT p.pred_id, op, path, CASE WHEN op = 'range' THEN (SELECT count(*) FROM src WHERE o_totalprice BETWEEN lo AND hi)
        WHEN op = 'contains' AND w = 0 THEN (SELECT count(*) FROM arrs a WHERE a.path = p.path) WHEN op = 'overlaps' THEN (SELECT count(*) FROM hits h WHERE h.pred_id = p.pred_id)
        ELSE (SELECT count(*) FROM hits h WHERE h.pred_id = p.pred_id AND h.n = w) END AS truth FROM preds p JOIN wanted USING (pred_id)"""


MADE = """WITH r AS (SELECT l_returnflag AS op, l_linestatus AS config_id, l_returnflag || l_linestatus AS path, CAST(CASE WHEN l_linenumber = 3 THEN 0 ELSE trunc(l_quantity) END AS DOUBLE) AS t,
    CAST(CASE WHEN l_extendedprice < 2000 THEN 0 ELSE floor(l_extendedprice / 1000) END AS DOUBLE) AS e FROM lineitem),
    x AS (SELECT *, abs(t - e) AS ab, CASE WHEN t = 0 THEN 1 ELSE t END AS t1, CASE WHEN least(t, e) = 0 THEN 1 ELSE least(t, e) END AS m1, CASE WHEN e = 0 THEN 1 ELSE 0 END AS sh FROM r),
    y AS (SELECT *, ab / t1 AS rel, ab / m1 AS mn, CASE WHEN t + e = 0 THEN 0 ELSE ab / ((t + e) / 2) END AS sy, CASE WHEN t + e = 0 THEN 0 ELSE ab / (t + e) END AS sa,
        log10((e + sh) / CASE WHEN t + sh = 0 THEN 1 ELSE t + sh END) AS lg, log10(CASE WHEN ab = 0 THEN 1 ELSE ab END) AS la, (t - e) * (t - e) AS sq FROM x) """

_MEANS = "round(avg(abs(lg)), 6) AS {0}_log, round(avg(rel), 6) AS {0}_mare"

_CUSTOMERS = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"

ORACLE_SQL: dict[str, str] = {
    **{f"path_inventory_{n}": inventory(n) for n in _SOURCES},
    **{f"basic_stats_{n}": basic(n) for n in _SOURCES},
    **{f"exact_ndv_{n}": ndv(n) for n in ("events", "mixed", "orders")},
    **{f"mode_{n}": mode(n) for n in ("events", "mixed", "labels")},
    **{f"histogram_{n}": buckets(n, q.BINS) for n in ("events", "mixed", "labels", "orders")},
    "histogram_plus_labels": buckets("labels", 5),
    "histogram_streamed_events": streamed(),
    **{f"hll_bound_{n}": _with(n, VC) + "SELECT DISTINCT path, true AS within FROM vc" for n in ("events", "orders")},
    **{f"type_confusion_{n}": _with(n) + "SELECT jp AS json_path, count(DISTINCT CASE WHEN kind <> 'null' THEN kind END) AS n_types FROM nodes GROUP BY jp" for n in ("mixed", "labels")},
    "key_paths_convs": _with("convs") + "SELECT DISTINCT typed AS typed_path, base AS base_path FROM nodes",
    **{f"enum_counts_{n}": enum_counts(n) for n in ("orders", "convs")},
    "enum_histogram_orders": enum_buckets("orders", 4),
    "enum_histogram_convs": enum_buckets("convs", 8),
    "sampled_stats_events": _with("events", VC, PC, RANGES, where=sample(q.RATE)) + "SELECT path, cnt, null_count, min_num, max_num, ndv FROM pc LEFT JOIN rg USING (path)",
    **{f"prune_{p.value.lower()}": pruned(p) for p in Prune},
    "suffix_lookup": lookup(),
    "meta_min_freq": meta(Prune.MIN_FREQ),
    "meta_max_no_paths": meta(Prune.MIN_FREQ, Prune.MAX_NO_PATHS),
    **{f"estimate_{shown}_{k.value.lower()}": estimates(n, k) for shown, n in (("events", "events"), ("mixed", "mixed"), ("arrays", "orders")) for k in StatType if k is not StatType.NDV_HYPERLOG},
    "estimate_events_sampled": estimates("events", StatType.HISTOGRAM, q.RATE),
    "estimate_events_pruned": estimates("events", StatType.BASIC_NDV, 0.0, 8),
    **{f"truth_{n}": truths(n) for n in ("events", "mixed", "labels")},
    "truth_arrays": array_truths(),
    "metric_points": MADE + "SELECT op, round(sum(ab), 6) AS absolute, round(sum(rel), 6) AS relative, round(sum(mn), 6) AS by_smaller, round(sum(sy), 6) AS symmetric, round(sum(sa), 6) AS symmetric_alt, round(sum(lg), 6) AS log_relative, round(sum(la), 6) AS log_absolute, round(sum(sq), 6) AS squared FROM y GROUP BY op",
    "metric_means": MADE + """SELECT op, round(avg(sq), 6) AS mse, round(sqrt(avg(sq)), 6) AS rmse, round(avg(ab), 6) AS mean_absolute, round(avg(mn), 6) AS mean_min, round(avg(lg), 6) AS mean_log, round(avg(abs(lg)), 6) AS mean_abs_log,
        round(avg(rel), 6) AS mare, round(avg(sy), 6) AS smare, round(avg(sy) / 2, 6) AS smare_alt, round(avg(rel) * 100, 6) AS mape, round(avg(sy) * 100, 6) AS smape FROM y GROUP BY op""",
    "metric_operator_summary": MADE + ", z AS (SELECT op, list_sort(list(rel)) AS l, count(*) AS n, avg(rel) AS mean FROM y GROUP BY op) SELECT op, n, round(mean, 6) AS mean, round(l[n // 2 + 1], 6) AS median, round(l[CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) + 1], 6) AS p90, round(l[n], 6) AS max FROM z",
    "metric_robust_log": MADE + "SELECT op, round(quantile_cont(abs(lg), 0.5), 6) AS median_abs_log, round(quantile_cont(abs(lg), 0.9), 6) AS p90_abs_log FROM y GROUP BY op",
    "metric_paired": MADE + f", a AS (SELECT op, {_MEANS.format('left')} FROM y WHERE config_id = 'F' GROUP BY op), b AS (SELECT op, {_MEANS.format('right')} FROM y WHERE config_id = 'O' GROUP BY op) SELECT * FROM a JOIN b USING (op)",
    "metric_high_errors": MADE + "SELECT path, round(max(rel), 6) AS err, count(*) AS n FROM y WHERE rel >= 5 GROUP BY path",
    "metric_error_histogram": MADE + "SELECT op, round(floor(lg / CAST(0.5 AS DOUBLE)) * CAST(0.5 AS DOUBLE), 6) AS bin, count(*) AS n FROM y GROUP BY ALL",
    "metric_error_by_size": MADE + ", p AS (SELECT config_id, op, avg(rel) AS m, count(*) AS n FROM y GROUP BY ALL) SELECT config_id, round(avg(m), 6) AS error, CAST(sum(n) AS BIGINT) AS stats_bytes FROM p GROUP BY config_id",
    "metric_trimmed": MADE + """, a AS (SELECT round(lg, 6) AS x FROM y), b AS (SELECT x FROM a WHERE x < (SELECT quantile_cont(x, 0.95) FROM a)), c AS (SELECT x FROM b WHERE x > (SELECT quantile_cont(x, 0.05) FROM b))
        SELECT count(*) AS n, round(min(x), 6) AS low, round(max(x), 6) AS high FROM c""",
    "metric_combined": MADE + "SELECT config_id, count(*) AS n, round(avg(lg), 6) AS mean, round(stddev_pop(lg), 6) AS spread, round(quantile_cont(lg, 0.25), 6) AS q1, round(quantile_cont(lg, 0.5), 6) AS q2, round(quantile_cont(lg, 0.75), 6) AS q3 FROM y WHERE op <> 'A' GROUP BY config_id",
    "metric_filtered": MADE + "SELECT op, config_id, count(*) AS n FROM y WHERE op = 'R' GROUP BY ALL",
    "distinct_at_paths": _with("orders") + """SELECT 'customer' AS name, count(DISTINCT c_custkey) AS ndv FROM src UNION ALL SELECT 'region', count(DISTINCT r_name) FROM src
        UNION ALL SELECT 'first', count(DISTINCT l_quantity) FROM items WHERE i = '0' UNION ALL SELECT 'none', 0""",
    "metric_pruning_comparison": MADE + "SELECT CASE WHEN t % 2 = 0 THEN CAST(0.01 AS DOUBLE) ELSE CAST(0.003 AS DOUBLE) END AS min_freq, op, round(quantile_cont(abs(lg), 0.5), 6) AS median_abs_log, round(quantile_cont(abs(lg), 0.9), 6) AS p90_abs_log FROM y WHERE config_id = 'F' GROUP BY ALL",
    "metric_bucket_comparison": MADE + """SELECT CAST(t % 3 AS BIGINT) AS buckets, CASE WHEN t % 2 = 0 THEN CAST(0.01 AS DOUBLE) ELSE CAST(0.003 AS DOUBLE) END AS min_freq, round(quantile_cont(abs(lg), 0.5), 6) AS median_abs_log,
        round(quantile_cont(abs(lg), 0.9), 6) AS p90_abs_log FROM y WHERE op <> 'A' GROUP BY ALL""",
    "metric_matching": MADE + "SELECT op, config_id, count(*) AS n FROM y WHERE op IN ('A', 'N') AND config_id = 'F' GROUP BY ALL",
    **{f"enum_hll_{n}": _with(n, _ENUM[n]) + "SELECT DISTINCT path, true AS within FROM el" for n in ("orders", "convs")},
    "estimate_events_hll_bound": f"SELECT CAST(range AS BIGINT) AS pred_id, true AS within FROM range({len(q.PREDICATES['events'])})",
    "source_json_lines": _CUSTOMERS,
    "source_json_in_csv": _CUSTOMERS,
    "source_json_array": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "source_csv": "SELECT s_suppkey, s_name, s_acctbal, CAST(s_nationkey AS VARCHAR) AS nation_id, 'STRING' AS id_type, 'n' || s_nationkey AS second_tag FROM supplier",
    "source_first_documents": "SELECT event_id AS doc_id FROM events ORDER BY event_id LIMIT 100",
    "sink_stats_events": basic("events"),
}
