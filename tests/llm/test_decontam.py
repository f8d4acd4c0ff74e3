import re

import pytest

from pathloom.llm import decontam

ITEMS = {
    1: "A farmer named Otto has 12 red apples and gives 5 apples to his neighbour Anna, who then sells 3 kg of flour for 20 dollars at the market in town.",
    2: "The train leaves with 30 people, stops, and 30 people get off before the next 8 wagons arrive with coal.",
    3: "seven words are all this item has",
    4: "too short an",
    5: None,
    6: "",
    7: "1 2 3 4 5 6 7 8 9 10 11 12 13 14",
}
DOCS = {
    10: ("Intro here. A farmer named Karl has 40 red apples and gives 7 apples to his neighbour Berta, who then sells 9 lb of flour for 11.50 euros at the market in town. And more.", {1}),
    11: ("x y z the train leaves with 41 people, stops, and 41 people get off before the next 9 wagons arrive with coal.", {2}),
    12: ("x y z the train leaves with 41 people, stops, and 55 people get off before the next 9 wagons arrive with coal.", set()),
    13: ("well: Seven words  are\nall this ITEM has, no more", {3}),
    14: ("seven words are all this item had", set()),
    15: (None, set()),
    16: ("", set()),
    17: ("9 8 7 6 5 4 3 2 1 9 8 7 6 5 4 3 2 1", set()),
    18: ("too short an", set()),
    19: ("A farmer named Otto has 12 red apples and nothing else to tell of, so this is clean text about the market in town.", set()),
    20: (ITEMS[1] + " " + ITEMS[1] + " " + ITEMS[2], {1, 2}),
}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in DOCS.items()] + [(10, DOCS[10][0], "x"), (None, ITEMS[1], "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*ITEMS.items(), (1, ITEMS[1]), (None, "an item that has no id at all here")], "item_id long, text string")
    return docs, items


@pytest.mark.parametrize("most", [200_000, 0], ids=["broadcast", "shuffle"])
def test_parameters_and_slots(tables, most):
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.decontaminate(*tables, most).collect()}
    assert set(got) == {(k, i) for k, (_, items) in DOCS.items() for i in items}
    assert got[10, 1]["changed"] and got[11, 2]["changed"] and not got[20, 1]["changed"] and got[20, 1]["n_occurrences"] == 2


def test_planted_passages(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(t.lower().split())
    whole = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items.collect() if plain(i["text"]) in plain(d["text"])}
    found = {(r["doc_id"], r["item_id"]) for r in decontam.decontaminate(docs, items).collect()}
    assert whole and found == whole


def test_words_keep_their_places(spark):
    text = "In May 1,234.5 km and 7 kg, then Mr Ångström-Ösel paid 3 dollars. Next: 5km x2"
    df = spark.createDataFrame([(text,)], "text string")
    t, p = df.select(decontam.template_words(df["text"]), decontam.plain_words(df["text"])).first()
    assert len(t) == len(p)
    assert [x for x, y in zip(p, t, strict=True) if y == "0"] == ["12345", "7", "3", "5km"]
    assert [x for x, y in zip(p, t, strict=True) if y == "2"] == ["km", "kg", "dollars"]
    assert [x for x, y in zip(p, t, strict=True) if y == "1"] == ["may", "mr", "ångström"] or [x for x, y in zip(p, t, strict=True) if y == "1"] == ["may", "mr"]


def test_no_python_and_empty(tables, docs, empty):
    _, items = tables
    plan = decontam.decontaminate(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert decontam.decontaminate(empty, items).count() == 0 and decontam.decontaminate(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("most", [200_000, 0], ids=["broadcast", "shuffle"])
def test_case_and_names_that_open_sentences(spark, most):
    german = "Der alte Müller trug am Morgen seinen Sack mit Mehl durch den Wald zum Markt in der Stadt und traf dort den Bauern und dessen Frau."
    tom = "Tom has 5 apples and pears. Tom gives 2 apples away. Tom buys 4 more pears. Tom eats 3 apples now. Tom keeps the rest."
    anna = "Anna has 7 apples and pears. Anna gives 6 apples away. Anna buys 8 more pears. Anna eats 9 apples now. Anna keeps the rest."
    mixed = anna.replace("Anna gives", "Berta gives").replace("Anna buys", "Carla buys")
    items = spark.createDataFrame([(1, german), (2, tom)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so: " + german.lower()), (2, german.upper()), (3, anna), (4, mixed), (5, tom.lower())], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.decontaminate(docs, items, most).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (5, 2)}
    assert got[3, 2]["changed"] and not got[1, 1]["changed"] and got[1, 1]["n_occurrences"] == 1


@pytest.mark.parametrize("most", [200_000, 0], ids=["broadcast", "shuffle"])
def test_items_of_numbers_and_names(spark, most):
    sums, few = "12 + 7 = 19; 15 + 6 = 21; 30 + 4 = 34; 41 + 8 = 49; 52 + 5 = 57", "2 4 8 16 32"
    items = spark.createDataFrame([(1, sums), (2, ITEMS[7]), (3, few)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"see {sums}, yes"), (2, "Count: " + ITEMS[7] + " done"), (3, f"powers {few} 64"), (4, sums.replace("5", "6")), (5, "2 4 8 16 33")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.decontaminate(docs, items, most).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


@pytest.mark.parametrize("most", [200_000, 0], ids=["broadcast", "shuffle"])
def test_short_items_word_for_word(spark, most):
    items = spark.createDataFrame([(1, "Name the capital."), (2, "2 + 2 = 4"), (3, "Zyx?"), (4, "!?")], "item_id long, text string")
    texts = ["so: name THE capital", "name the river", "first 2 + 2 = 4 then", "2 + 3 = 5", "a zyx b", "zyxw", "name a the capital", "!?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.decontaminate(docs, items, most, least=1).collect()}
    assert got == {(0, 1), (2, 2), (4, 3)}


def _brute_template(text):
    """Words with their kind (0 number, 1 name, 2 unit, 3 opener, '' other) and value, by scanning the text once."""
    text = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "", text)
    out, units = [], set(decontam.UNITS.split())
    for m in re.finditer(r"[^\W_]+", text):
        w, before = m[0], text[: m.start()]
        if w[0].isdigit():
            kind = "0"
        elif w.lower() in units and out and out[-1][0] == "0" and before.endswith(" ") and not before.endswith("  ") and before[:-1].lower().endswith(out[-1][1]):
            kind = "2"
        elif w[0].isupper() and len(w) > 1 and w[1].islower():
            kind = "1" if len(before) > 1 and before[-1] == " " and (before[-2].islower() or before[-2] in "0123456789,") else "3"
        else:
            kind = ""
        out.append((kind, w.lower()))
    return out


def _brute(doc, item):
    """Windows of the item found in the document, by comparing all windows in all readings and checking the slots of each shift."""
    d, i = _brute_template(doc), _brute_template(item)
    width = min(decontam.WIDTH, len(i))
    read = {
        decontam.TEMPLATE: lambda k, v: k if k in ("0", "1", "2") else v,
        decontam.OPENERS: lambda k, v: "1" if k == "3" else k if k in ("0", "1", "2") else v,
        decontam.EXACT: lambda k, v: "n" + v if k == "0" else v,
    }
    rich = lambda ws: 2 * sum(w not in ("0", "1", "2") for w in ws) >= len(ws)
    spots, n_rich, hits = range(len(i) - width + 1), 0, {}
    for q in spots:
        good = rich([read[decontam.TEMPLATE](*w) for w in i[q : q + width]])
        n_rich += good
        for reading, f in read.items():
            win = [f(*w) for w in i[q : q + width]]
            if reading != decontam.EXACT and (not rich(win) or len(i) < decontam.LEAST):
                continue
            for start in range(len(d) - width + 1):
                if [f(*w) for w in d[start : start + width]] == win:
                    pairs = {(k, i[q + x][1], d[start + x][1]) for x, k in enumerate(win) if k in ("0", "1", "2")}
                    hits.setdefault((start - q, reading == decontam.OPENERS), []).append((q, good, pairs))
    found = set()
    for rows in hits.values():
        pairs = set().union(*(p for *_, p in rows))
        consistent = len({(k, a) for k, a, _ in pairs}) == len(pairs)
        found |= {(q, good) for q, good, p in rows if consistent or not p}
    enough, rich_hits = min(decontam.RUN, -(-len(spots) // 2)), sum(good for _, good in found)
    return len(found) >= enough or (n_rich and rich_hits >= min(decontam.RUN, -(-n_rich // 2)))


def test_templates_and_slots_by_brute_force(spark):
    """Random questions, with numbers, names and units changed consistently or not, inside other text, against a comparison of all windows."""
    import random

    draw = random.Random(8)
    names, units, plain = ["Otto", "Anna", "Karl", "Berta"], ["kg", "km", "dollars"], "the farmer gives apples to his friend and then sells some flour at market for each of them".split()

    def question():
        return [draw.choice([draw.choice(plain)] * 5 + [draw.choice(names), str(draw.randrange(9)), f"{draw.randrange(9)} {draw.choice(units)}"]) for _ in range(draw.randrange(3, 22))]

    def changed(words):
        swap = {w: draw.choice(names) if w in names else str(draw.randrange(9)) for w in {x for w in words for x in w.split()} if w in names or w.isdigit()}
        loose = draw.random() < 0.3
        return [" ".join((draw.choice([swap[x], "7"]) if loose and x.isdigit() else swap.get(x, x)) for x in w.split()) for w in words]

    items = [question() for _ in range(14)]
    docs = []
    for words in items * 4:
        body = draw.choice([words, changed(words), words[: len(words) // 2], [w.lower() for w in words]])
        docs.append(" ".join(draw.sample(plain, draw.randrange(4))) + draw.choice([". ", ", ", " "]) + " ".join(body) + draw.choice(["", " and more.", ", yes"]))
    items = [" ".join(w) for w in items]
    table = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.decontaminate(table(docs, "doc_id"), table(items, "item_id"), least=1).collect()}
    expected = {(a, b) for a, d in enumerate(docs) for b, i in enumerate(items) if _brute(d, i)}
    assert got == expected and len(expected) > 20
