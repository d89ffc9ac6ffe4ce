import os

import pytest

from panelforge.llm import tokenize as t

PATH = f"{t.TOKENIZERS}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no tokenizer files")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return lambda x: tok.encode(x, add_special_tokens=False).ids


TEXTS = [
    None, "", " ", "\n\n  \n", "a", "<|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaa", "The quick brown fox's 3 friends didn't; it'll rain!!", "Straße  naïve é ﬁ ſ 🗞🗞", "Привет, мир — 東京 x\x85y\x1cz",
    "tab\t\tand\r\nline  \r\n", "l1l1l1 ■■ ¬¬ ½ 1250", "'s'S 'll 'LL", "﻿​", "xyz " * 5000 + "end",
]


def test_equals_the_library(spark, reference, monkeypatch):
    for docs, words in ((4_000, 400_000), (3, 5)):
        monkeypatch.setattr(t, "BLOCK_DOCS", docs)
        monkeypatch.setattr(t, "REPLAY_WORDS", words)
        df = spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(TEXTS)], "doc_id bigint, text string, words string, block int").repartition(3)
        got = {r.doc_id: list(r.ids) for r in t.encode(df).collect()}
        for i, x in enumerate(TEXTS):
            assert got[i] == (reference(x) if x else []), x


def test_repeated_rows_null_keys_and_empty(spark, reference):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "other")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in t.encode(df).collect())
    assert got == [(0, reference("other")), (1, reference("same text")), (1, reference("same text"))]
    assert t.encode(df.limit(0)).count() == 0


def test_replay_of_overlaps(reference):
    words = ["a" * n for n in range(1, 40)] + ["abababab", " aaaa", "zzzzzz"]
    ids, lengths = t.load(PATH).replay([w.encode() for w in words])
    at = 0
    for w, n in zip(words, lengths):
        assert ids[at : at + n].tolist() == reference(w)
        at += n


def test_vocabulary_round_trip():
    import json

    vocab = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]
    m = t.load(PATH)
    assert len(set(m.byte_ids.tolist())) == 256 and max(m.made) < len(vocab)
