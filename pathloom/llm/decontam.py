"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts are cut into words of letters and digits, and numbers, names (capitalised words within a sentence, but not words in capitals) and units become typed placeholders,
one word for one word, so that a re-parameterised question has the same template. Every window of ``WIDTH`` template words of a benchmark
item is hash-joined with the documents' windows. Of those, only windows around an *anchor* are built: each benchmark window names its longest
literal word, and a document's window that equals it must have that word in the same place; so the join on single words loses nothing.

Windows are read in three ways, each joined with its like: as templates; as templates in which capitalised words that open sentences are names too;
and as plain lower-case words, so that a copy is found whatever its case.

Windows that match along one diagonal (same shift between document and item) form an occurrence. Its slots must be consistent: equal values in
the item's slots stand for equal values in the document's. In an inconsistent occurrence only the windows without slots count. A document is
contaminated by an item when at least ``RUN`` of the item's windows occur in it (about 13 words in a row), or half of them if it has fewer; or of
those windows alone that have enough literal words. Windows with fewer literal words than slots have no template and are matched word for word.

The benchmark's windows are broadcast while there are no more than ``BROADCAST_WINDOWS``; beyond that all windows of the documents are hashed
and joined by a shuffle, with the same result.

Defined cases: null text counts as empty and matches nothing; items with fewer than ``least``
words are passed over (``LEAST`` by default; the registered query and the pipeline pass over none); items with fewer than ``LEAST`` words are matched
word for word alone, as so short a template would fit clean texts; items shorter than a window are one window; repeated rows count once; rows without doc_id or
item_id are passed over; empty tables give an empty result; further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WIDTH = 8
LEAST = 5
RUN = 6
BROADCAST_WINDOWS = 200_000

#: Placeholders. Words that begin with a digit are numbers, so these three cannot come from a text.
NUMBER, NAME, UNIT = "0", "1", "2"
#: How a window's words are read: TEMPLATE and OPENERS have slots, EXACT has the words in lower case.
TEMPLATE, OPENERS, EXACT = 0, 1, 2
#: Units that may follow a number.
UNITS = (
    "mm cm m km mi ft in inch inches foot feet yd mile miles metre metres meter meters kilometre kilometres kilometers g kg mg lb lbs oz pound pounds gram grams "
    "kilograms ton tons tonnes l ml litre litres liter liters s sec seconds min minutes h hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent mph kmh degrees celsius fahrenheit w kw kwh v hz khz mhz ghz kb mb gb tb"
)


def _plain(text: Column) -> Column:
    """Decimal points and thousands separators inside numbers go, so that a number is one word."""
    return F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", "")


def _cut(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def marked_words(text: Column) -> Column:
    """Words in lower case, each in one place for all readings: numbers as 0..0, names as 1.., units as 2..0, words that only their place at the start
    of a sentence may have capitalised as 3.., all others as they are."""
    t = _plain(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])(?<v>[0-9][\p{L}\p{N}]*)", "0${v}0")
    t = F.regexp_replace(t, rf"(?<n>(?<![\p{{L}}\p{{N}}])0[\p{{L}}\p{{N}}]*[  ])(?<u>(?i:{'|'.join(sorted(UNITS.split(), key=len, reverse=True))}))(?![\p{{L}}\p{{N}}])", "${n}2${u}0")
    t = F.regexp_replace(t, r"(?<=[\p{Ll}0-9,][ ])(?<w>\p{Lu}\p{Ll}[\p{L}\p{N}]*)", "1${w}")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])(?<w>\p{Lu}\p{Ll}[\p{L}\p{N}]*)", "3${w}")
    return _cut(t)


def _first(word: Column) -> Column:
    return F.substring(word, 1, 1)


def _value(word: Column) -> Column:
    """The word itself, without marks."""
    first = _first(word)
    return F.when(first.isin("0", "2"), F.substr(word, F.lit(2), F.length(word) - 2)).when(first.isin("1", "3"), F.substring(word, 2, 1 << 30)).otherwise(word)


def _read(word: Column, reading: Column) -> Column:
    """A marked word in a reading: TEMPLATE, OPENERS (words that open sentences are names too), or EXACT (numbers keep their marks)."""
    first = _first(word)
    slot = F.when(first == "3", F.when(reading == OPENERS, NAME).otherwise(_value(word))).when(first.isin(NUMBER, NAME, UNIT), first).otherwise(word)
    return F.when(reading == EXACT, F.when(first == NUMBER, word).otherwise(_value(word))).otherwise(slot)


def template_words(text: Column) -> Column:
    """Template words; in the same places as ``plain_words``."""
    return F.transform(marked_words(text), lambda w: _read(w, F.lit(TEMPLATE)))


def plain_words(text: Column) -> Column:
    return F.transform(marked_words(text), _value)


def _is_slot(word: Column) -> Column:
    return word.isin(NUMBER, NAME, UNIT)


def benchmark_windows(benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """item_id, q (place), n_windows, n_rich (those with enough literal words), rich, reading, win (words in that reading), plain, slots, anchor (literal word), off."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    items = items.select("item_id", marked_words(F.col("text")).alias("m")).where(F.size("m") >= max(1, least))
    width = F.least(F.lit(WIDTH), F.size("m"))
    spots = items.select("item_id", "m", F.explode(F.sequence(F.lit(0), F.size("m") - width)).alias("q"), width.alias("width"), (F.size("m") < LEAST).alias("short"))
    spots = spots.select("item_id", "q", F.expr("slice(m, q + 1, width)").alias("m"), "short")
    readings = F.explode(F.when(F.col("short"), F.array(F.lit(EXACT))).otherwise(F.array(*(F.lit(x) for x in (TEMPLATE, OPENERS, EXACT)))))
    spots = spots.withColumn("rich", _rich(F.transform("m", lambda w: _read(w, F.lit(TEMPLATE))))).withColumn("reading", readings)
    # Without names and openers the two templates are one.
    spots = spots.where((F.col("reading") != OPENERS) | F.exists("m", lambda w: _first(w).isin("1", "3")))
    spots = spots.withColumn("win", F.transform("m", lambda w: _read(w, F.col("reading")))).withColumn("plain", F.transform("m", _value))
    literal = F.filter(F.transform("win", lambda w, i: F.struct(F.length(w).alias("n"), w.alias("word"), i.alias("off"))), lambda x: ~_is_slot(x["word"]))
    spots = spots.withColumn("literal", literal).where((F.col("reading") == EXACT) | _rich(F.col("win")))
    best = F.array_max("literal")
    spots = spots.select("item_id", "q", "rich", "reading", "win", "plain", F.exists("win", _is_slot).alias("slots"), best["word"].alias("anchor"), best["off"].alias("off"))
    many = spots.groupBy("item_id").agg(F.countDistinct("q").alias("n_windows"), F.countDistinct(F.when(F.col("rich"), F.col("q"))).alias("n_rich"))
    return spots.join(many, "item_id")


def _rich(win: Column) -> Column:
    """At least half of the words are literal."""
    return F.size(F.filter(win, lambda w: ~_is_slot(w))) * 2 >= F.size(win)


def matches(docs: DataFrame, windows: DataFrame, by_broadcast: bool, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, q, rich, n_windows, n_rich, reading, start, slots, dplain, plain, win: windows of documents that equal windows of items."""
    words = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), marked_words(F.col("text")).alias("m"))
    if by_broadcast:
        # The marks that the anchor may have in a document: a name or unit is literal in the exact reading alone, an opener also in the template.
        unit = F.when((F.col("reading") == EXACT) & F.rlike("anchor", F.lit("^[^0]")), F.array(F.concat(F.lit("1"), "anchor"), F.concat(F.lit("2"), "anchor", F.lit("0"))))
        opener = F.when((F.col("reading") != OPENERS) & F.rlike("anchor", F.lit("^[^0]")), F.array(F.concat(F.lit("3"), "anchor")))
        none = F.array().cast("array<string>")
        forms = F.concat(F.array("anchor"), F.coalesce(unit, none), F.coalesce(opener, none))
        anchors = windows.select(F.explode(forms).alias("anchor"), "off", F.size("win").alias("width"), "reading").distinct()
        # outer: else Spark adds a filter that cuts the text a second time
        placed = words.select("doc_id", "m", F.posexplode_outer("m").alias("pos", "anchor")).join(F.broadcast(anchors), "anchor")
        placed = placed.where("pos >= off and pos - off + width <= size(m)").select("doc_id", "reading", (F.col("pos") - F.col("off")).alias("start"), F.expr("slice(m, greatest(pos - off + 1, 1), width)").alias("m"))
    else:
        widths = F.array(*(F.lit(w) for w in range(max(1, least), WIDTH + 1)))
        placed = words.select("doc_id", "m", F.explode(widths).alias("width")).where("width <= size(m)")
        placed = placed.select("doc_id", "m", "width", F.explode(F.sequence(F.lit(0), F.size("m") - F.col("width"))).alias("start"))
        placed = placed.select("doc_id", "start", F.expr("slice(m, start + 1, width)").alias("m"))
        placed = placed.withColumn("reading", F.explode(F.array(*(F.lit(x) for x in (TEMPLATE, OPENERS, EXACT)))))
        placed = placed.where((F.col("reading") != OPENERS) | F.exists("m", lambda w: _first(w).isin("1", "3")))
    # Never null, or Spark tests that inside the join on anchors, which then copies whole texts for each word.
    placed = placed.withColumn("win", F.coalesce(F.transform("m", lambda w: _read(w, F.col("reading"))), F.array().cast("array<string>")))
    hashed = windows.withColumn("h", F.xxhash64("reading", "win")).withColumnsRenamed({"win": "item_win", "reading": "item_reading"}).drop("anchor", "off")
    found = placed.withColumn("h", F.xxhash64("reading", "win")).join(F.broadcast(hashed) if by_broadcast else hashed, "h").where("win = item_win and reading = item_reading")
    # Values of the slots are wanted only where the window has some.
    own = F.when(F.col("slots"), F.transform("m", _value))
    return found.select("doc_id", "item_id", "q", "rich", "n_windows", "n_rich", "reading", "start", "slots", own.alias("dplain"), "plain", "win")


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS, least: int = LEAST) -> DataFrame:
    """A row for each contaminated document and item.

    doc_id, item_id, n_hits (of the item's windows), n_windows, changed (slot values differ from the item's), n_occurrences.
    """
    windows = written(benchmark_windows(benchmark, least))
    found = matches(docs, windows, windows.count() <= broadcast_windows, least)
    pairs = F.when(F.col("slots"), F.filter(
        F.zip_with("win", F.zip_with("plain", "dplain", lambda a, b: F.struct(a.alias("item"), b.alias("doc"))), lambda w, v: F.struct(w.alias("kind"), v["item"].alias("item"), v["doc"].alias("doc"))),
        lambda x: _is_slot(x["kind"]),
    ))
    place = F.struct("q", "rich")
    # An item has few windows, so what is gathered for an occurrence is small.
    # Each of the two templates must be consistent for itself; exact windows have no slots and count with either.
    runs = found.groupBy("doc_id", "item_id", "n_windows", "n_rich", (F.col("start") - F.col("q")).alias("shift"), (F.col("reading") == OPENERS).alias("openers")).agg(
        F.collect_set(place).alias("all_q"),
        F.collect_set(F.when(~F.col("slots"), place)).alias("literal_q"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
    )
    sources = F.size(F.array_distinct(F.transform("pairs", lambda x: F.struct(x["kind"], x["item"]))))
    runs = runs.withColumn("consistent", sources == F.size("pairs"))
    runs = runs.select("doc_id", "item_id", "n_windows", "n_rich", "shift", F.when(F.col("consistent"), F.col("all_q")).otherwise(F.col("literal_q")).alias("q"), (F.col("consistent") & F.exists("pairs", lambda x: x["item"] != x["doc"])).alias("changed"))
    hits = runs.where(F.size("q") > 0).groupBy("doc_id", "item_id", "n_windows", "n_rich").agg(
        F.flatten(F.collect_set("q")).alias("q"), F.max("changed").alias("changed"), F.size(F.collect_set("shift")).cast("long").alias("n_occurrences")
    )
    rich = F.size(F.array_distinct(F.transform(F.filter("q", lambda x: x["rich"]), lambda x: x["q"])))
    hits = hits.withColumn("n_hits", F.size(F.array_distinct(F.transform("q", lambda x: x["q"]))).cast("long")).withColumn("rich_hits", rich)
    enough, enough_rich = (F.least(F.lit(RUN), F.ceil(F.col(n) / 2)) for n in ("n_windows", "n_rich"))
    found = (F.col("n_hits") >= enough) | ((F.col("n_rich") > 0) & (F.col("rich_hits") >= enough_rich))
    return hits.where(found).select("doc_id", "item_id", "n_hits", "n_windows", "changed", "n_occurrences")
