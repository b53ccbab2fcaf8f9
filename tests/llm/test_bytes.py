"""Pieces that run inside tasks, against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spatialq.llm import decontam, near, nbsvm, tokens, warc
from spatialq.llm.suffixes import suffix_array
from spatialq.llm.words import labelled, shingles, word_hashes


@given(st.lists(st.integers(1, 4), max_size=40), st.integers(1, 3))
@settings(max_examples=400, deadline=None)
def test_suffix_array(text, times):
    text = text * times
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300))
@settings(max_examples=200, deadline=None)
def test_simple8b_round_trip(ids):
    a = np.array(ids, np.uint64)
    assert tokens.unpack(tokens.pack(a), len(a)).tolist() == ids
    assert tokens.read_ids(tokens.file_bytes(a, block_ids=37)).tolist() == ids


def test_simple8b_packs_densely():
    assert len(tokens.pack(np.ones(600, np.uint64))) == 10
    assert len(tokens.pack(np.full(400, 32_000, np.uint64))) == 100


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_banded_alignment_decides_exactly():
    random.seed(5)
    for _ in range(1500):
        a = [random.randint(0, random.choice([3, 90])) for _ in range(random.randint(1, 30))]
        b = list(a)
        for _ in range(random.randint(0, 8)):
            k = random.randrange(len(b))
            if random.random() < 0.3 and len(b) > 1:
                b.pop(k)
            else:
                b.insert(k, random.randint(0, 5))
        m = lcs(a, b)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert near.similar(x, y, 0.8) == (m / (len(a) + len(b) - m) >= 0.8 - 1e-12)


def test_word_hashes_follow_the_words():
    texts = ["", "One two,two!", "ONE", "ciónja ü", "a" * 50, "b", ""]
    raw = [t.encode() for t in texts]
    edges = np.cumsum([0, *map(len, raw)])
    h, cuts = word_hashes(np.frombuffer(b"".join(raw), np.uint8), edges)
    words = [decontam.words_of(r) for r in raw]
    assert [b - a for a, b in zip(cuts, cuts[1:])] == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    for i, x in enumerate(flat):
        for j, y in enumerate(flat):
            assert (h[i] == h[j]) == (x == y)


def test_labelled_shingles_are_distinct():
    s = shingles(np.array([1, 2] * 20, np.uint64))
    assert len(set(s.tolist())) == 2 and len(set(labelled(s).tolist())) == len(s)


def test_memo_encoder_equals_the_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    own, whole = tokens.WordEncoder(Tokenizer.from_file(path), 40, 30), Tokenizer.from_file(path)
    texts = ["", " ", "It's  the\n\nCIÓN x\tÄÖ ", "a<|endoftext|> b 12 3.4", "é ́ \x1c  z", "ΣΑΣ ΣΑΣ.", "J̌.J̌ ǰ, İ! A.b. x., ..! Don't!! 's.'re, <|endoftext|>. ½. ² Ⅷ,", *("w%d v%d" % (i, i) for i in range(60))]
    for t in texts:
        for got, text in zip(own.encode([t, t + " end"]), [t, t + " end"]):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_least_span():
    assert decontam.least_span([np.array([5]), np.array([1, 9]), np.array([7])]) in ((5, 5), (1, 7))


def test_features_of_empty_text():
    shapes = nbsvm.Shapes()
    assert len(nbsvm.features(np.empty(0, np.uint8), "", shapes)) == 1


def test_record_round_trip_keeps_odd_urls():
    import io

    row = {"page_id": 3, "url": "http://x/a b\r\nc", "payload": b"\r\n\r\nWARC/1.1", "payload_bytes": 12, "payload_digest": "D", "record_type": "response", "refers_to": None}
    heads, block, raw = warc.parse_record(io.BytesIO(warc.record_bytes(row)))
    assert heads["warc-target-uri"] == "http://x/a%20b%0D%0Ac" and block.endswith(b"\r\n\r\nWARC/1.1")
    assert raw == warc.record_bytes(row)
