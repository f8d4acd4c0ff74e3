"""Documents to nodes: every object member and array element at any depth, with its key paths.

Documents are VARIANT values, so one path may hold several types. Each level is an array of nodes, made of the containers of the level above; all
levels of a document become rows in one ``explode``. So everything runs in one stage, the documents are read once, and a task holds the nodes of
one document at a time.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig

NODE_COLUMNS = (
    "doc_id", "depth", "json_path", "parent_path", "typed_path", "base_path", "kind", "is_int", "num_val", "num_exact", "str_val", "bool_val", "arr",
)


def parse_documents(df: DataFrame, text: str = "doc", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, doc VARIANT) from JSON text; texts that do not parse become null and have no nodes."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.try_parse_json(text).alias("doc"))


def sampled(docs: DataFrame, config: EngineConfig) -> DataFrame:
    """Whole documents are left out with probability ``sampling_rate``, decided by arithmetic on the id: the same on any engine."""
    if not config.sampling_rate:
        return docs
    draw = F.expr(f"cast(pmod(doc_id * 2654435761 + {config.seed}, 1000003) as double) / 1000003.0D")
    return docs.where(draw >= F.lit(config.sampling_rate))


def max_depth(docs: DataFrame) -> int:
    """Deepest nesting of any document, from the brackets of its JSON text: one aggregate."""
    plain = F.regexp_replace(F.to_json("doc"), r'"(?:[^"\\]++|\\.)*+"', "")
    marks = F.split(F.regexp_replace(plain, r"[^\[\]{}]", ""), "")
    step = F.aggregate(
        marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: F.struct((now := s["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("now"), F.greatest(s["most"], now).alias("most")),
        lambda s: s["most"],
    )
    return docs.select(step.alias("d")).agg(F.max("d")).first()[0] or 0


def flatten(
    docs: DataFrame, config: EngineConfig | None = None, depth: int | None = None, keep: tuple[str, ...] = (), kinds: tuple[str, ...] = (), paths: Collection[str] | None = None
) -> DataFrame:
    """Nodes of ``docs`` (doc_id, doc), with its columns ``keep``.

    ``depth`` is the deepest nesting, found by ``max_depth`` if not given; a document with more is an error. ``kinds`` and ``paths`` (keys joined
    by /) restrict the nodes; what leads to none of the paths is not opened, nor are values looked at whose kind is not wanted.
    """
    config = config or EngineConfig()
    depth = max_depth(docs) if depth is None else depth
    ways = None if paths is None else {p: p.split("/") for p in paths}
    levels = depth if ways is None else min(depth, max(map(len, ways.values()), default=0))
    if not levels:
        return flatten(docs, config, 1, keep, paths=("",)).where("false")
    # A node is (own, m, a): what is kept of it, and its members or elements. The levels are nested lets in one expression, so that no level is copied.
    body = f"concat({', '.join(f'transform(n{k}, n -> n.own)' for k in range(1, levels + 1))})"
    if ways is None:
        left = f"exists(n{levels}, n -> size(n.m) > 0 or size(n.a) > 0)"
        body = f"if({left}, raise_error(concat('nested deeper than {levels} levels: document ', doc_id)), {body})"
    else:
        body = f"filter({body}, n -> array_join(n.keys, '/') in ({', '.join(map(_quoted, ways))}))"
    if kinds:
        body = f"filter({body}, n -> {_KIND.format('n.t')} in ({', '.join(map(_quoted, kinds))}))"
    for level in range(levels, 0, -1):
        wanted = None if ways is None else sorted({"/".join(w[:level]) for w in ways.values() if len(w) >= level})
        body = f"transform(array({_children(f'n{level - 1}', config, kinds, wanted)}), n{level} -> {body})[0]"
    root = f"array(named_struct('own', named_struct('keys', cast(array() as array<string>), 'typed', ''), {_OPENED.format('doc')}))"
    found = F.expr(f"transform(array({root}), n0 -> {body})[0]")
    return _described(docs.select("doc_id", *keep, F.explode(found).alias("n")).select("doc_id", *keep, "n.*"), keep)


_OPENED = "'m', try_variant_get({0}, '$', 'map<string,variant>'), 'a', try_variant_get({0}, '$', 'array<variant>')"
#: From a node's ``t``: obj, arr, or a scalar's ``schema_of_variant``.
_KIND = "case {0} when 'obj' then 'obj' when 'arr' then 'arr' when 'STRING' then 'str' when 'BOOLEAN' then 'bool' when 'VOID' then 'null' else 'num' end"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _children(above: str, config: EngineConfig, kinds: tuple[str, ...], wanted: list[str] | None) -> str:
    """SQL: the children of all containers in the array ``above``. Each value is opened once, which also tells what it is; only scalars are asked for their type."""
    raw = "coalesce(transform(map_entries(p.m), e -> named_struct('key', e.key, 'v', e.value)), transform(p.a, (x, i) -> named_struct('key', cast(i as string), 'v', x)))"
    if wanted is not None:
        raw = f"filter({raw}, c -> array_join(array_append(p.own.keys, c.key), '/') in ({', '.join(map(_quoted, wanted))}))"
    known = f"transform({raw}, c -> named_struct('key', c.key, 'v', c.v, {_OPENED.format('c.v')}))"
    scalar = "schema_of_variant(c.v)"
    if kinds and not set(kinds) - {"obj", "arr"}:
        known, scalar = f"filter({known}, c -> c.m is not null or c.a is not null)", "''"
    base = f"if(p.own.typed = '', c.key, concat(p.own.typed, {_quoted(config.key_sep)}, c.key))"
    typed = f"transform({known}, c -> named_struct('c', c, 'base', {base}, 't', case when c.m is not null then 'obj' when c.a is not null then 'arr' else {scalar} end))"
    path = f"if(x.t = 'VOID', x.base, concat(x.base, {_quoted(config.type_sep)}, {_KIND.format('x.t')}))"
    own = f"named_struct('keys', array_append(p.own.keys, x.c.key), 'parent', p.own.typed, 'base', x.base, 'typed', {path}, 'v', x.c.v, 't', x.t)"
    return f"flatten(transform(filter({above}, p -> p.m is not null or p.a is not null), p -> transform({typed}, x -> named_struct('own', {own}, 'm', x.c.m, 'a', x.c.a))))"


def _described(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    rows = rows.withColumn("kind", F.expr(_KIND.format("t")))
    num, string, flag = (F.col("kind") == k for k in ("num", "str", "bool"))
    # Casts of a variant change types silently, so each is guarded by the kind.
    is_int = F.when(num, (F.col("t") == "BIGINT") | F.rlike("t", F.lit(r"^DECIMAL\((?:19|[23]\d),0\)$")))
    return rows.select(
        "doc_id", *keep, F.size("keys").alias("depth"), F.col("keys").alias("json_path"), F.col("parent").alias("parent_path"), F.col("typed").alias("typed_path"),
        F.col("base").alias("base_path"), "kind", is_int.alias("is_int"), F.when(num, F.expr("try_variant_get(v, '$', 'double')")).alias("num_val"),
        F.when(num, F.expr("try_variant_get(v, '$', 'decimal(38,9)')")).alias("num_exact"), F.when(string, F.expr("try_variant_get(v, '$', 'string')")).alias("str_val"),
        F.when(flag, F.expr("try_variant_get(v, '$', 'boolean')")).alias("bool_val"), F.when(F.col("kind") == "arr", F.col("v")).alias("arr"),
    )


def last_components(path: Column, most: int, config: EngineConfig) -> Column:
    """The last ``most`` components of a path."""
    parts = F.split(path, f"\\Q{config.key_sep}\\E")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - most + 1, F.lit(1)), most), config.key_sep)


def windowed(nodes: DataFrame, config: EngineConfig) -> DataFrame:
    """Nodes with paths cut to the last ``max_prefix`` components."""
    return nodes.withColumns({c: last_components(F.col(c), config.max_prefix, config) for c in ("typed_path", "base_path")})


def json_path_to_key_path(keys: Column, kind: Column, config: EngineConfig | None = None) -> Column:
    """Typed key path of an untyped path. A parent counts as an array if the next key is a number, as an object otherwise."""
    c = config or EngineConfig()
    base = json_path_to_base_path(keys, c)
    return F.when(kind == "null", base).otherwise(F.concat(base, F.lit(c.type_sep), kind))


def json_path_to_base_path(keys: Column, config: EngineConfig | None = None) -> Column:
    c = config or EngineConfig()
    shown = F.transform(keys, lambda k, i: F.when(i == F.size(keys) - 1, k).otherwise(F.concat(k, F.lit(c.type_sep), F.when(F.rlike(F.get(keys, i + 1), F.lit("^[0-9]+$")), "arr").otherwise("obj"))))
    return F.array_join(shown, c.key_sep)


def path_inventory(nodes: DataFrame) -> DataFrame:
    """Every typed path: its base path, kind and occurrences."""
    return nodes.groupBy("typed_path", "base_path", "kind").agg(F.count("*").alias("cnt"))


def type_confusion(nodes: DataFrame, count_null: bool = False) -> DataFrame:
    """Number of distinct types at each untyped path."""
    kind = F.col("kind") if count_null else F.when(F.col("kind") != "null", F.col("kind"))
    return nodes.groupBy(F.array_join("json_path", "/").alias("json_path")).agg(F.countDistinct(kind).alias("n_types"))


def value_at(path: list[str | int], kind: str) -> Column:
    """The value at a path of keys and array places in ``doc``, cast to ``kind``; null where the path or the cast fails."""
    if any(isinstance(k, str) and "'" in k and '"' in k for k in path):
        raise ValueError("a key with both kinds of quotes cannot be written in a path")
    quoted = (f"[{k}]" if isinstance(k, int) else f'["{k}"]' if "'" in k else f"['{k}']" for k in path)
    steps = "".join(quoted)
    return F.try_variant_get("doc", f"${steps}", kind)


def distinct_at(docs: DataFrame, path: list[str | int], kind: str) -> DataFrame:
    """Number of distinct values at one path, without flattening."""
    return docs.agg(F.countDistinct(value_at(path, kind)).alias("ndv"))
