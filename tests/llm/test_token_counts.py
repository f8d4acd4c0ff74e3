import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, normalizers

from pathloom.llm import token_counts as tc
from pathloom.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
ODD = ["", " ", "  a  b", "a\n\n b", "\n", " \n ", "漢字 ☃☃ x", "▁ x▁y", "\t\ta", "a" * 300, "x<0x0A>y", "é" * 50, "a  \n  b", "😀😀", "<s> </s> <unk>", "ab ab\nab"]


def tokenizer(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def test_documents(docs, rows):
    slow = tokenizer(tc.pieces_of(MODEL))
    expected = sorted((str(d), len(slow.encode(t or "", add_special_tokens=False).ids), len(t or "")) for d, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_chars"]) for r in tc.token_counts(docs, MODEL).collect()) == expected


def test_odd_texts():
    slow, count = tokenizer(tc.pieces_of(MODEL)), tc.counter(MODEL)
    assert [count(t) for t in ODD] == [len(slow.encode(t, add_special_tokens=False).ids) for t in ODD]


BYTES = [(f"<0x{b:02X}>", -50.0) for b in range(256)]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("ab▁\n", min_size=1, max_size=4), st.integers(-4, 0).map(float), max_size=12), st.lists(st.text("ab \n☃", max_size=14), max_size=6))
def test_ties_and_pieces_across_blanks(pieces, texts):
    """Small scores make many ties; pieces with blanks or line feeds inside rule out the division into parts."""
    vocabulary = [("<unk>", 0.0), *BYTES, *pieces.items()]
    slow, count = tokenizer(vocabulary), tc.Counter(vocabulary)
    assert [count(t) for t in texts] == [len(slow.encode(t, add_special_tokens=False).ids) for t in texts]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 3)
    count = tc.Counter(tc.pieces_of(MODEL))
    text = "one two three four five one two"
    assert count(text) == tc.counter(MODEL)(text) and len(count.with_blank) <= 3


@pytest.mark.parametrize("column", ["text"])
def test_empty(empty, column):
    assert column in empty.columns and tc.token_counts(empty, MODEL).count() == 0
