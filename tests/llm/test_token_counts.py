"""Counts by heap and list against the library and against merging pair by pair."""

import random

import pytest
from tokenizers import Tokenizer

from kerbline.llm import common, token_counts
from kerbline.llm.queries import QUERIES, vocabulary


@pytest.fixture(scope="module")
def merges():
    return token_counts.pair_merges(vocabulary()[0])


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary()[0])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_random_texts(merges, library):
    r = random.Random(1)
    some = "ab  \n\t'stll1՘é漢\U0001f600 \xa0..,,"
    for _ in range(5000):
        n = r.randint(0, 40)
        parts = [r.choice(some) if r.random() < 0.9 else r.choice(["<|endoftext|>", "'ll", chr(r.randint(0x20, 0xD7FF)), chr(r.randint(0xE000, 0x10FFFF))]) for _ in range(n)]
        text = "".join(parts)
        assert merges.count(text) == library(text), repr(text)


def test_long_pieces(merges, library):
    for text in ("x" * 100_000, "ab" * 50_000, " " * 5000, "é" * 10_000, "<|endoftext|>" * 300):
        assert merges.count(text) == library(text)


def test_one_merge_after_the_other(merges):
    """The heap gives what repeated search for the lowest rank gives."""
    r = random.Random(2)
    for _ in range(300):
        piece = "".join(r.choice("abcdeinrst") for _ in range(r.randint(1, 60))).encode()
        symbols = [merges.symbol[b] for b in piece]
        while True:
            ranks = [(merges.rank.get(a << 32 | b, 1 << 40), k) for k, (a, b) in enumerate(zip(symbols[:-1], symbols[1:], strict=True))]
            if not ranks or min(ranks)[0] == 1 << 40:
                break
            rank, k = min(ranks)
            symbols[k : k + 2] = [merges.made[rank]]
        assert merges.merged(piece) == len(symbols)


def test_forgotten_pieces_change_nothing(monkeypatch, library):
    monkeypatch.setattr(token_counts, "MOST_PIECES", 5)
    small = token_counts.PairMerges(vocabulary()[0])
    for text in ("one two three four five six", "seven eight  nine\tten", "one two one"):
        assert small.count(text) == library(text)


def test_every_document(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] or "" for r in common.documents(spark, sf_dir).collect()}
    got = QUERIES["op11_token_counts"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        n = library(docs[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 1024)


def test_odd_rows(odd_docs, no_docs, library):
    got = token_counts.report(odd_docs, vocabulary()[0])
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), library(r["text"] or "")) for r in odd_docs.collect()), key=repr)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got.collect()), key=repr) == want
    assert token_counts.report(no_docs, vocabulary()[0]).count() == 0
    kept = token_counts.counts(odd_docs, vocabulary()[0], ("doc_id", "kept", "n"))
    assert kept.columns == ["doc_id", "kept", "n", "n_bytes", "n_tokens"] and kept.count() == 10
