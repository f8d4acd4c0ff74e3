"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must contain (``trigram_query``, on the driver, from
the parsed expression). ``inverted_index`` has a posting for each document and each trigram that some rule asks for, over the lower-case text.
``candidates`` intersects the postings to a bit mask of rules for each document, and ``scan`` verifies candidates with the regular expressions.
Rules without a mandatory trigram scan every text.

Spans come from splitting a text at the matches: pieces and matches alternate, so running sums of their lengths are the positions, in code
points. Matches of a rule do not overlap and are leftmost. Running sums go by blocks (``_running``), and redaction cuts a text of fixed-width
characters, so that a text with very many spans takes time about in proportion.

Defined cases: null text counts as empty; an empty text has no spans; repeated rows are scanned alike; rows without a doc_id are candidates for
every rule; an empty table gives an empty result; further columns can be kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from re import _constants as op
from re import _parser as parser

from .common import written

#: Candidates of up to this many documents (two long columns each) are broadcast to the scan; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
PREFIX = "__secret_"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex`` whose ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The base rules. A run of hex digits is matched with its least length in the expression: runs are maximal either way.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: After the head of a private key: fields such as Proc-Type, and then all up to the END line, or the lines of base64 if there is none.
_BREAK = r"(?:\\[nr]|[\x09-\x0D\x20])"
_KEY_BODY = (
    rf"(?:{_BREAK}*[A-Za-z0-9-]+:\x20[^\x0A\x0D\\]*)*(?:[^-]*-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    rf"|(?:{_BREAK}+[A-Za-z0-9+/]{{16,}}={{0,2}})+(?:{_BREAK}+[A-Za-z0-9+/]+={{0,2}}(?![^\x09-\x0D\x20\\\"']))?)"
)
#: Published forms of further credentials.
FURTHER = (
    Rule("pem", rf"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:{_KEY_BODY})?"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"://[^\x00-\x20/:@]*:[^\x00-\x20/@]+@"),
)
RULES = BASE + FURTHER

#: Any of these conjunctions of trigrams; all clauses of a query must hold.
Clause = frozenset[frozenset[str]]
_MOST_STRINGS = 64


def trigram_query(regex: str) -> list[Clause]:
    """Clauses that the lower-case text of any match satisfies; none if nothing is mandatory."""
    _, clauses = _walk(parser.parse(regex))
    return sorted(set(clauses), key=lambda c: sorted(map(sorted, c)))


def _clause(strings: set[str]) -> list[Clause]:
    """Some string of the set occurs. Those under three characters ask for nothing."""
    if any(len(s) < 3 for s in strings):
        return []
    every = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
    return [frozenset(c for c in every if not any(o < c for o in every))]


def _walk(parsed) -> tuple[set[str] | None, list[Clause]]:
    """(all strings that it can match, if few; clauses)."""
    clauses: list[Clause] = []
    run: set[str] = {""}  # strings since the last part that could not be listed
    exact = True
    for what, value in parsed:
        strings, inner = _part(what, value)
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        clauses += _clause(run) + inner
        exact = False
        run = strings if strings is not None else {""}
    if exact:
        return run, _clause(run)
    return None, clauses + _clause(run)


def _part(what, value) -> tuple[set[str] | None, list[Clause]]:
    if what is op.LITERAL:
        return {chr(value).lower() if value < 128 else chr(value)} if value < 128 else None, []
    if what is op.IN:
        members = _members(value)
        return members, []
    if what is op.SUBPATTERN:
        return _walk(value[3])
    if what is op.BRANCH:
        parts = [_walk(b) for b in value[1]]
        if all(s is not None for s, _ in parts) and len(strings := set().union(*(s for s, _ in parts))) <= _MOST_STRINGS:
            return strings, _clause(strings)
        # every branch must ask for something: the OR of their first clauses
        firsts = [c[0] for _, c in parts if c]
        return None, [frozenset().union(*firsts)] if len(firsts) == len(parts) else []
    if what in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, clauses = _walk(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, []
        if low == high and strings is not None and len(strings) ** low <= _MOST_STRINGS:
            return reduce(lambda a, _: {x + y for x in a for y in strings}, range(low), {""}), []
        return None, clauses if low else []
    return ({""} if what is op.AT else None), []


def _members(value) -> set[str] | None:
    out: set[str] = set()
    for what, x in value:
        if what is op.LITERAL and x < 128:
            out.add(chr(x).lower())
        elif what is op.RANGE and x[1] < 128 and x[1] - x[0] < 8:
            out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def inverted_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) for the given trigrams."""
    low = docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("low")).where("doc_id is not null and low is not null")
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return low.select("doc_id", F.explode(found).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, rules: a bit for each rule whose trigram query the document's postings satisfy. Rules without a query have no bits."""
    terms, clauses = [], []
    for k, rule in enumerate(rules):
        query = trigram_query(rule.regex)
        for c, clause in enumerate(query):
            for conjunction in sorted(clause, key=sorted):
                clauses.append((len(clauses), k, 1 << c, (1 << len(query)) - 1, (1 << len(conjunction)) - 1))
                terms += [(t, len(clauses) - 1, 1 << b) for b, t in enumerate(sorted(conjunction))]
    spark = docs.sparkSession
    if not terms:
        return spark.createDataFrame([], "doc_id long, rules long")
    postings = inverted_index(docs, sorted({t for t, _, _ in terms}))
    # The tables made of the rules are as small as the rules.
    term = F.broadcast(spark.createDataFrame(terms, "trigram string, conjunction int, bit long"))
    clause = F.broadcast(spark.createDataFrame(clauses, "conjunction int, rule int, clause long, every long, all_bits long"))
    met = postings.join(term, "trigram").groupBy("doc_id", "conjunction").agg(F.bit_or("bit").alias("bits"))
    met = met.join(clause, "conjunction").where("bits = all_bits")
    met = met.groupBy("doc_id", "rule", "every").agg(F.bit_or("clause").alias("clauses")).where("clauses = every")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a column for each rule, PREFIX and its kind: its spans, an array of (start, end) in code points."""
    mask = written(candidates(docs, rules)).withColumnsRenamed({"doc_id": "__id", "rules": "__rules"})
    few = mask.count() <= BROADCAST_ROWS
    out = docs.join(F.broadcast(mask) if few else mask, docs["doc_id"].cast("long") == mask["__id"], "left")
    text = F.coalesce("text", F.lit(""))
    found, spans = {}, {}
    for k, rule in enumerate(rules):
        if trigram_query(rule.regex):
            may = F.col("doc_id").isNull() | (F.coalesce(F.getbit("__rules", F.lit(k)), F.lit(0)) == 1)
        else:
            may = F.lit(True)
        pattern = F.lit(rule.regex)
        hit = may & F.rlike(text, pattern)
        for name, value in (("match", F.regexp_extract_all(text, pattern, F.lit(0))), ("group", F.regexp_extract_all(text, pattern, F.lit(rule.group))), ("piece", F.split(text, rule.regex, -1))):
            if name != "group" or rule.group:
                found[f"__{name}_{k}"] = F.when(hit, value)
        spans[PREFIX + rule.kind] = _spans(F.col(f"__piece_{k}"), F.col(f"__match_{k}"), F.col(f"__{'group' if rule.group else 'match'}_{k}"), rule.least)
    # Two projections: what the second refers to several times is computed once.
    return out.withColumns(found).withColumns(spans).drop(*found, "__id", "__rules")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running results of ``join`` (a sum or a maximum of integers) up to and with each of ``values``.

    Appending to an array copies it; so the values are cut in blocks of the square root of their number, each is folded for itself, and then each
    block is joined with the result of all before it.
    """

    def fold(xs: Column) -> Column:
        step = lambda out, x: F.array_append(out, F.when(F.size(out) > 0, join(F.element_at(out, -1), x)).otherwise(x))
        return F.aggregate(xs, F.array().cast("array<int>"), step)

    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values)))).cast("int")
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda k: fold(F.slice(values, k * size + 1, size)))

    def joined(blocks: Column) -> Column:
        ends = fold(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return F.flatten(_let(ends, lambda e: F.transform(blocks, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: join(F.get(e, k - 1), x))))))

    return _let(blocks, joined)


def _spans(pieces: Column, matches: Column, tested: Column, least: int) -> Column:
    none = F.array().cast("array<struct<start:int,end:int>>")
    lengths = F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
    ends = _running(lengths, lambda a, b: a + b)
    spans = F.zip_with(ends, F.transform(matches, lambda m, i: F.struct(F.length(m).alias("n"), (F.length(F.get(tested, i)) >= least).alias("ok"))), lambda e, m: F.struct((e - m["n"]).alias("start"), e.alias("end"), m["ok"].alias("ok")))
    kept = F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(matches.isNull() | (F.size(matches) == 0), none).otherwise(kept)


def in_order(rules: tuple[Rule, ...]) -> Column:
    """All spans of the given rules' columns as (start, rule's place, end, kind), in order."""

    def tagged(place: int, kind: str) -> Column:
        return F.transform(F.col(PREFIX + kind), lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("rule"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*(tagged(k, r.kind) for k, r in enumerate(rules))))


def rendered(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (``in_order``) replaced by its kind in brackets; overlapping spans become one."""

    def whole(ends: Column) -> Column:
        """``ends``: the largest end of the spans up to each; a span that starts before the last of these is part of an earlier one."""
        at = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        places = F.transform(spans, lambda s, i: F.when(s["start"] >= at(i), F.struct(at(i).alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))))
        rest = F.array(F.struct(F.element_at(ends, -1).alias("from"), F.length(text).alias("to"), F.lit(None).cast("string").alias("kind")))
        # Four bytes a character, so that a piece is cut without reading what is before it.
        cut = lambda wide: F.transform(
            F.concat(F.array_compact(places), rest),
            lambda p: F.concat(F.decode(F.substr(wide, p["from"] * 4 + 1, (p["to"] - p["from"]) * 4), "UTF-32"), F.when(p["kind"].isNull(), F.lit("")).otherwise(F.concat(F.lit("["), F.upper(p["kind"]), F.lit("]")))),
        )
        return F.array_join(_let(F.encode(text, "UTF-32"), cut), "")

    ends = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) > 0, _let(ends, whole)).otherwise(text)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with all spans of the texts replaced (``redacted``); texts without spans, null too, stay as they are."""
    # in_order goes to a column, which is computed once.
    found = scan(docs, rules).withColumn("__spans", in_order(rules))
    return found.withColumn("text", redacted(F.col("text"), F.col("__spans"))).drop("__spans", *(PREFIX + r.kind for r in rules))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans."""
    found = scan(docs.select(F.col("doc_id").cast("long"), "text"))
    return found.select(
        "doc_id",
        *(F.size(PREFIX + r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE),
        F.sha2(rendered(in_order(BASE)), 256).alias("base_sha256"),
        rendered(in_order(RULES)).alias("spans"),
    )
