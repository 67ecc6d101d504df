"""Words, windows, tokens and the id coding against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.llm import token_output, tokens
from wavemill.llm.common import raw_text, slices
from wavemill.llm.words import Windows, Words, window_starts

TEXTS = st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x0b\x0c\rabcAB.,é  "), st.characters(codec="utf-8")), max_size=40), max_size=8)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    raw, off = raw_text(pa.array(texts, pa.string()))
    w = Words(raw, off)
    whole = raw.tobytes()
    got = [whole[a:b].decode() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
    assert [got[w.first[k] : w.first[k + 1]] for k in range(len(texts))] == [WORD.findall(t) for t in texts]
    h = w.span_hash(w.start, w.end)
    assert len(set(zip(got, h.tolist(), strict=True))) == len(set(got))
    seq = Windows(h)
    starts, count = window_starts(w.first, 2)
    pairs = [tuple(got[s : s + 2]) for s in starts.tolist()]
    assert len(pairs) == sum(max(len(WORD.findall(t)) - 1, 0) for t in texts) == count.sum()
    assert len(set(zip(pairs, seq.at(starts, 2).tolist(), strict=True))) == len(set(pairs))


def test_case_folding_is_ascii_only():
    raw, off = raw_text(pa.array(["Ab aB É é"]))
    w = Words(raw, off, fold_case=True)
    h = w.span_hash(w.start, w.end)
    assert h[0] == h[1] and h[2] != h[3]


def test_slices_cover_all_rows():
    off = np.cumsum([0, 5, 0, 100, 3, 0, 2])
    parts = list(slices(off, 8))
    assert parts[0][0] == 0 and parts[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


SPECIAL = ["", " ", "<|endoftext|> a", "x<|startoftext|>y", "İstanbul ΟΔΟΣ ς", "été Å", "it's they'LL 'S don't", "a b c\x1cd\x85e", "1,234.5 a1b2", "漢字かな 🙂🙂 a🙂b", "\x01\x02 !!! ***word### Ω", "ß ẞ ŉ ǰ"]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_ids_are_those_of_whole_texts(texts):
    enc = tokens.encoder(tokens.default_path())
    texts = texts + SPECIAL
    want = [e.ids for e in enc.whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == want


def test_full_dictionaries_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    monkeypatch.setattr(tokens, "KEPT_PIECES", 10)
    enc, rng = tokens.Encoder(tokens.default_path()), random.Random(1)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcdé.,X") for _ in range(rng.randint(1, 6))) for _ in range(12)) for _ in range(4)]
        want = [e.ids for e in enc.whole.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in enc.encode([t.encode() for t in texts])] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=50))
def test_coding_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = token_output.pack(v)
    assert len(control) == -(-len(v) // 4)
    assert token_output.unpack(control, data, len(v)).tolist() == values


def test_frequent_ids_take_one_byte():
    control, data = token_output.pack(np.arange(256))
    assert len(data) == 256 and set(control) == {0}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_raw_text_of_slices_and_nulls(n):
    column = pa.array(["x", None, "yz", "", "é"] * 2).slice(1, n)
    raw, off = raw_text(column)
    assert [raw[a:b].tobytes().decode() for a, b in zip(off, off[1:], strict=False)] == [x or "" for x in column.to_pylist()]
