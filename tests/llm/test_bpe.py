import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewell.llm import bpe

PATH = bpe.default_vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.Encoder(PATH, most_words=300)


def ids(texts):
    found, at = OURS.encode_block([t.encode() for t in texts])
    return [found[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8", max_codepoint=0x3100), st.sampled_from(" \n\t\x0b\x1c\x85\xa0'sdtmlre  aAé1½")), max_size=60), max_size=4))
def test_as_the_library(texts):
    assert ids(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_long_words_ties_and_special_tokens():
    rnd = random.Random(4)
    texts = ["a" * 5000, "ab" * 3001, "".join(rnd.choice("the an") for _ in range(9000)), "x<|endoftext|> y <|endoftext|><|endoftext|>", "", " ", "  a  b \n c ", "".join(rnd.choice("abc") for _ in range(4097))]
    assert ids(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [OURS.v.decode(np.array(x, np.int64)).decode() for x in ids(texts)] == texts


def test_round_trip(spark):
    rows = [(1, "The theory\nof  things", "x"), (2, None, "y"), (None, "", "z"), (1, "The theory\nof  things", "x"), (3, "naïve ß " * 700, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.round_trip(df).collect(), key=str)
    want = []
    for i, t, _ in rows:
        x = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = bpe.decoded(bpe.encoded(df)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_nul_in_text():
    texts = ["a \0b", "\0", " \0", "\0a \0\0 \0", "x<|endoftext|> \0b", "b", "\0b", "a  \0b \0b"]
    assert ids(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [OURS.v.decode(np.array(x, np.int64)).decode() for x in ids(texts)] == texts


def test_a_word_of_a_megabyte():
    rnd = random.Random(7)
    text = "".join(rnd.choice("etaoinshrdlu") for _ in range(1_000_000))
    assert ids([text, "b"]) == [e.ids for e in LIBRARY.encode_batch([text, "b"], add_special_tokens=False)]


def test_endings_and_blanks():
    texts = ["it's 's ''s '\'s a'll 're x've'd'm1't 'r e' 'r", "a'", "'", "'s", " 's", "x\n's", "x \n y\n\nz  \n", "\u2003a \u2003b\u2003 c"]
    assert ids(texts) == [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    for t in texts:
        assert ids([t]) == [LIBRARY.encode(t, add_special_tokens=False).ids]


def test_merging_one_by_one(monkeypatch):
    rnd = random.Random(5)
    words = [bytes(rnd.choice(b"aab e") for _ in range(700)) for _ in range(5)]
    want = [x.tolist() for x in bpe.merge_words(words, OURS.v)]
    assert OURS.v.ordered
    monkeypatch.setattr(OURS.v, "ordered", False)
    assert [x.tolist() for x in bpe.merge_words(words, OURS.v)] == want
