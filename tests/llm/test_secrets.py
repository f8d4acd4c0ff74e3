import hashlib
import re
import string
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pathloom.llm import secrets

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
HARD = [
    'é Token : "abcdefghijk" passwd=x secret=abcdefgh/+ AKIAAKIA1234567890 password=secret:abcdefghij', "TOKEN=12345678 x 😀 api_key='a.b-c_d=/+'", "0" * 40 + " " + "a" * 31 + "g" + "f" * 33,
    "apikey = AAAAAAAA API_KEY=bbbbbbbb", "tokentoken:token=12345678", "ſecret=abcdefgh toKen=abcdefgh", "gh" + "p_" + "a1B2" * 9 + " https://me:pw@host/x", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abc",
]


def spans(text, rules):
    out = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        out += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(out)


def shown(found):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def test_scan(spark, docs, rows):
    extra = [(2 * 10**6 + k, t) for k, t in enumerate(HARD)]
    df = docs.select("doc_id", "text", "match").unionByName(spark.createDataFrame([(*e, "x") for e in extra], "doc_id long, text string, match string"))
    got = Counter(tuple(r) for r in secrets.secret_scan(df).collect())
    every = [(r.kind, re.compile(r.regex, re.A), r.group, r.least) for r in secrets.RULES]
    expected = Counter()
    for doc_id, text in rows + extra:
        base = spans(text or "", BASE)
        n = Counter(s[3] for s in base)
        expected[(doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans(text or "", every)))] += 1
    assert got == expected


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_matches_satisfy_the_trigram_query(rule):
    pattern = re.compile(rule.regex, re.A)

    @given(st.from_regex(pattern, fullmatch=True, alphabet=string.printable))
    def check(text):
        low = text.lower()
        assert all(any(all(t in low for t in conjunction) for conjunction in clause) for clause in secrets.trigram_query(rule.regex))

    check()


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{32,}") == [] and secrets.trigram_query("ab|cde") == [] and secrets.trigram_query("(abc)*") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [frozenset({frozenset({"aki", "kia"})})]
    assert secrets.trigram_query("(abc|xyz)+q.*") == [frozenset({frozenset({"abc"}), frozenset({"xyz"})})]
    assert secrets.trigram_query("(?i:ab)[cd]x?$") == [frozenset({frozenset({"abc"}), frozenset({"abd"})})]


def test_shuffled_join_and_redaction(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(1, HARD[0], "k"), (2, None, "k"), (3, "no secrets", "k"), (4, "token=" + "0" * 40, "k")], "doc_id long, text string, access string")
    got = {r["doc_id"]: (r["text"], r["access"]) for r in secrets.redact(df).collect()}
    assert got[1] == ("é [ASSIGN]\" passwd=x [ASSIGN] [ACCESS] password=secret:abcdefghij", "k")
    assert got[2] == (None, "k") and got[3] == ("no secrets", "k") and got[4] == ("[ASSIGN]", "k")


def test_no_python_on_executors(docs, empty):
    plan = secrets.secret_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert secrets.secret_scan(empty).count() == 0


def test_whole_keys_and_long_tokens(spark):
    body = "\n".join("Ab1+/" * 12 + "wxyz" for _ in range(400))
    head, tail = "-----BEGIN RSA PRIVATE " + "KEY-----", "-----END RSA PRIVATE KEY-----"
    fields = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123\n\n"
    long, chat = "p" * 300, "xox" + "b-" + "1234567890-" * 30
    texts = {
        f"a {head}\n{body}\nab==\n{tail} b": "a [PEM] b",
        f"a {head}\n{fields}{body}\n{tail} b": "a [PEM] b",
        f"a {head}\n{body}\nab==\nThis is text": "a [PEM]\nThis is text",
        f"a {head}\\n{body[:64]}\\n{tail}\\n": "a [PEM]\\n",
        f"a {head} is a line": "a [PEM] is a line",
        f"postgres://u:{long}@host {chat} redis://:pw@host": "postgres[LOGIN]host [CHAT] redis[LOGIN]host",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert [got[k] for k in range(len(texts))] == list(texts.values())
    found = {r["doc_id"]: r["spans"] for r in secrets.secret_scan(df).collect()}
    every = [(r.kind, re.compile(r.regex, re.A), r.group, r.least) for r in secrets.RULES]
    assert all(found[k] == shown(spans(t, every)) for k, t in enumerate(texts))


def test_redaction_by_brute_force(spark):
    """Spans that touch, overlap and lie in each other, over characters of one to four bytes."""
    import random

    from pyspark.sql import functions as F

    draw, rows = random.Random(4), []
    for k in range(60):
        text = "".join(draw.choice("aé漢😀 \n") for _ in range(draw.randrange(1, 60)))
        spans = sorted((s, draw.randrange(3), min(len(text), s + draw.randrange(1, 9)), draw.choice(["hex", "pem"])) for s in (draw.randrange(len(text)) for _ in range(draw.choice([0, 1, 2, 5, 40]))))
        rows.append((k, text, spans))
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,rule:int,end:int,kind:string>>")
    got = {r[0]: r[1] for r in df.select("doc_id", secrets.redacted(F.col("text"), F.col("spans"))).collect()}
    for k, text, spans in rows:
        out, at = "", 0
        for start, _, end, kind in spans:
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert got[k] == out + text[at:]
