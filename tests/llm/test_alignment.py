"""Aligned tokens and their counts against a plain walk over bytes with whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyarrow import fs
from tokenizers import Tokenizer

from kerbline.llm import alignment, common
from kerbline.llm.queries import QUERIES, vocabulary

(A, RANKS), B = vocabulary(), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Plain:
    """Whole texts, byte by byte."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.a_bytes = {i: bytes(letters[c] for c in s) for s, i in self.a.get_vocab().items()}

    def b_bytes(self, i):
        s = self.b.id_to_piece(i)
        return bytes([int(s[3:5], 16)]) if len(s) == 6 and s[:3] == "<0x" and s[5] == ">" else s.replace("▁", " ").encode()

    def of(self, text):
        """a, b, the groups and the links, or None."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_of, b_of = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if not b"".join(a_of) == b"".join(b_of) == (" " + text).encode():
            return None
        a_at = [i for i, x in zip(range(len(a)), a_of) for _ in x]
        b_at = [i for i, x in zip(range(len(b)), b_of) for _ in x]
        links = list(dict.fromkeys(zip(a_at, b_at)))
        groups, own = [], ([], [])
        for k in range(len(a_at)):
            for x, at, ids in ((own[0], a_at, a), (own[1], b_at, b)):
                if k == 0 or at[k] != at[k - 1]:
                    x.append(str(ids[at[k]]))
            if k + 1 == len(a_at) or (a_at[k + 1] != a_at[k] and b_at[k + 1] != b_at[k]):
                groups.append(f"{','.join(own[0])}|{','.join(own[1])}")
                own = ([], [])
        return len(a), len(b), groups, [(a[i], b[j]) for i, j in links]


def brute(rows):
    plain = Plain()
    made = [(doc, plain.of(text)) for doc, text in rows]
    counts = Counter(pair for _, m in made if m for pair in set(m[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for doc, m in made:
        if m is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        digest = hashlib.sha256(";".join(m[2]).encode()).hexdigest()
        out.append((doc, m[0], m[1], len(m[2]), len(m[3]), sum(counts[p] == best[p[0]] for p in m[3]), sum(counts[p] for p in m[3]), digest))
    return sorted(out, key=repr), counts


def rows(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


ODD = ["a ▁b", "x <0x41> y", "</s> and <|endoftext|> <s>", "tab\there", "new \u0558 \uab6c letters", "\u2003wide\u2003 space\u2003", "two  spaces", "end ", " begin", "\n", "a\n\nb", "é漢\U0001f600 \xa0", "ﬁ ligature ① ½", "one two one", " ", "zero\x00byte", "don't stop"]


def test_random_texts_part_as_whole_texts():
    r, plain, both = random.Random(3), Plain(), alignment.aligner(A, RANKS, B)
    some = ["word", "Wort", "'s", "é", "漢字", "<|endoftext|>", "12345", "\n", " ", "  ", "▁", "\t", "x" * 30, ",", "😀"]
    texts = ODD + ["".join(r.choice(some) + r.choice(["", " "]) for _ in range(r.randint(1, 25))) for _ in range(1500)]
    zeros = 0
    for text in texts:
        want, got = plain.of(text), both.align(text)
        assert (want is None) == (got is None), repr(text)
        if want is None:
            zeros += 1
            continue
        assert (got.n_a, got.n_b, got.n_groups, got.groups) == (want[0], want[1], len(want[2]), ";".join(want[2])), repr(text)
        assert got.keys.tolist() == [x << 32 | y for x, y in want[3]]
    assert 0 < zeros < len(texts)


def test_every_document(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    want, _ = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows(QUERIES["op12_alignment"](spark, sf_dir)) == want


def test_small_memory_and_many_shards(spark, monkeypatch):
    """With bounds so low that every task forgets words and gives its table out again and again."""
    monkeypatch.setattr(alignment, "MOST_WORDS", 3)
    monkeypatch.setattr(alignment, "MOST_KEYS", 40)
    monkeypatch.setattr(alignment, "BATCH_ROWS", 16)
    r = random.Random(4)
    texts = [" ".join(r.choice(["alpha", "Beta's", "gamma,", "δέλτα", "epsilon42", "zeta\nzeta"]) for _ in range(r.randint(0, 30))) for _ in range(150)] + ODD
    data = [(k, t) for k, t in enumerate(texts)] + [(7, "alpha alpha"), (7, "alpha alpha")]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    want, counts = brute(data)
    assert rows(alignment.report(docs, A, RANKS, B)) == want
    found = alignment.count_pairs(alignment.linked(docs, A, RANKS, B))
    table = {(x["a"], x["b"]): (x["documents"], x["best"]) for x in alignment.table(spark, found).collect()}
    assert {k: v[0] for k, v in table.items()} == dict(counts)
    best = {a: max(n for (x, _), n in counts.items() if x == a) for a, _ in counts}
    assert all(v[1] == (v[0] == best[a]) for (a, _), v in table.items())
    assert sorted(found.firsts.tolist()) == found.firsts.tolist()


def test_odd_rows(odd_docs, no_docs):
    want, _ = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert rows(alignment.report(odd_docs, A, RANKS, B)) == want
    assert rows(alignment.report(no_docs, A, RANKS, B)) == []


def test_shards_in_a_store_that_is_no_mounted_path(tmp_path, monkeypatch):
    """They are copied to where they can be mapped, under no name that would stay."""
    table = np.array([[3, 9, 12], [1, 1, 4]])
    np.save(tmp_path / "00000000.npy", table)
    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    monkeypatch.setattr(alignment, "_files", lambda folder: (store, "."))
    monkeypatch.setattr(alignment.tempfile, "tempdir", str(tmp_path / "own"))
    (tmp_path / "own").mkdir()
    assert store.type_name != "local"
    got = alignment._shard("store://x", "00000000.npy")
    assert isinstance(got, np.memmap) and (got == table).all() and not list((tmp_path / "own").iterdir())
    found = alignment.PairCounts("store://x", ("00000000.npy",), np.array([3]), np.zeros(1, np.int64))
    assert alignment.Lookup(found).counts(np.array([9, 12])).tolist() == [1, 4]
