"""Token counts of whole texts by byte-pair merging with a heap and a linked list; no ids are made.

A text is split at the vocabulary's added tokens, each one token, and what lies between by the vocabulary's pattern. The bytes of a
piece are a linked list of symbols, and all neighbours that may merge lie in a heap by rank and place. The lowest rank is popped
again and again; an entry whose symbols have changed meanwhile is passed over. A piece has as many tokens as symbols at first, less
the merges. Counts of short pieces are remembered in the worker, so most of a text is looked up.

Nothing is shuffled: every text is counted in the task that reads it, and a task holds one text and a bounded memory of pieces.

Defined cases: a null text counts as empty, and an empty text has no tokens; repeated rows and rows without an id are counted each
on its own; an empty table gives an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import tokens

#: Pieces remembered in a worker; at the limit the memory starts anew. Longer pieces than this many characters are not remembered.
MOST_PIECES = 700_000
LONGEST_PIECE = 64
#: Tokens that a document may have without being over the limit.
LIMIT = 1024
_READY: dict[str, "PairMerges"] = {}


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: bytes that print stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class PairMerges:
    """The merges of a byte-level vocabulary file."""

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            said = json.load(f)
        byte, ids = byte_letters(), said["model"]["vocab"]
        added = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
        if any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added tokens of {vocabulary} look at what stands around them")
        self.added = regex.compile("|".join(map(regex.escape, added)) or "(?!)")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.own_split = Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str
        self.symbol = [0] * 256
        for letter, b in byte.items():
            self.symbol[b] = ids[letter]
        #: Rank of a pair of symbols, by both in one number, and the symbol that each rank makes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, (left, right) in enumerate(said["model"]["merges"]):
            self.rank[ids[left] << 32 | ids[right]] = k
            self.made.append(ids[left + right])
        self.known: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """The number of tokens of one piece."""
        rank, made, n = self.rank, self.made, len(piece)
        if n == 1:
            return 1
        symbols: list[int] = [self.symbol[b] for b in piece]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        # Rank and place in one number: the lowest rank first, of equal ones the first place.
        heap = [r << 32 | at for at, (a, b) in enumerate(pairwise(symbols)) if (r := rank.get(a << 32 | b)) is not None]
        heapq.heapify(heap)
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            top = pop(heap)
            r, at = top >> 32, top & 0xFFFFFFFF
            right = after[at]
            # A place that was swallowed holds -1, for which no pair has a rank.
            if right == n or rank.get(symbols[at] << 32 | symbols[right]) != r:
                continue
            symbol = symbols[at] = made[r]
            symbols[right] = -1
            far, near = after[right], before[at]
            after[at] = far
            merges += 1
            if far < n:
                before[far] = at
                if (x := rank.get(symbol << 32 | symbols[far])) is not None:
                    push(heap, x << 32 | at)
            if near >= 0 and (x := rank.get(symbols[near] << 32 | symbol)) is not None:
                push(heap, x << 32 | near)
        return n - merges

    def pieces(self, text: str) -> list[str]:
        """The text by the vocabulary's pattern. Character classes differ between libraries only where one knows a character that
        the other does not; a text with a character that is unassigned here is split by the vocabulary's own library."""
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [text[s:e] for _, (s, e) in self.own_split(text)]
        return self.pattern.findall(text)

    def _between(self, text: str) -> int:
        """Tokens of a text without added tokens. Where single spaces part it, each space opens a part that is counted alone."""
        if tokens.OTHER_SPACE.search(text):
            parts = self.pieces(text)
        else:
            head, *rest = text.split(" ")
            parts = [head, *[" " + x for x in rest]]
        known = self.known
        if len(known) > MOST_PIECES:
            known.clear()
        new = set(parts).difference(known)
        long = {}
        for p in new:
            k = sum(self.merged(x.encode()) for x in self.pieces(p))
            (known if len(p) <= LONGEST_PIECE else long)[p] = k
        if not long:
            return sum(map(known.__getitem__, parts))
        return sum(long[p] if p in long else known[p] for p in parts)

    def count(self, text: str) -> int:
        total, at = 0, 0
        for m in self.added.finditer(text):
            total += self._between(text[at : m.start()]) + 1
            at = m.end()
        return total + self._between(text[at:] if at else text)


def pair_merges(vocabulary: str) -> PairMerges:
    """One per Python worker and vocabulary."""
    if vocabulary not in _READY:
        _READY[vocabulary] = PairMerges(vocabulary)
    return _READY[vocabulary]


def counts(docs: DataFrame, vocabulary: str, carried: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns, n_bytes (of the text in UTF-8) and n_tokens, a row per document."""
    rows = docs.select(*carried, text)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = pair_merges(vocabulary)
        for b in batches:
            sizes, found = [], []
            for cell in b.column(b.num_columns - 1):
                t = cell.as_py() or ""
                sizes.append(len(t.encode()))
                found.append(merges.count(t))
            columns = [*b.columns[:-1], pa.array(sizes, pa.int64()), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-1], "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, ", ".join([*kinds, "n_bytes long", "n_tokens long"]))


def report(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, and whether a document has more tokens than the limit."""
    rows = docs.select(docs["doc_id"].cast("long"), "text")
    return counts(rows, vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)
