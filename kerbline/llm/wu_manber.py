"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items: 13 consecutive words, or the whole of a shorter item. Patterns of one length m
share a shift table over blocks of two words: the block that ends at a position tells how far the search may move on. Where the
shift is zero, the bucket of the suffix block and the words before it gives the patterns that are compared directly, word by word
and then by bytes. Patterns are places in the items' words: no window is held as text of its own.

Texts stay in their Arrow buffers: bytes are classified, words hashed and positions advanced with numpy, many stretches of
words at a time. The index is broadcast in blocks of about BLOCK_BYTES of benchmark text, which are built one after the other; a
larger benchmark takes further passes over the rows of each task, and after BLOCKS_AT_ONCE blocks what is found so far is stored and
their indexes are given up. Nothing is shuffled.

Defined cases: a null or empty text has no words and no hits; a null benchmark text has no window; repeated items count once
per item_id; an empty benchmark gives no hits; extra columns are carried through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kerbline.llm import common

WINDOW = 13
#: Benchmark text in one broadcast index, which takes about ten times as much, and indexes that one pass over the rows uses.
BLOCK_BYTES, BLOCKS_AT_ONCE = 4 << 20, 4
#: Bytes hashed at once, and window ends that one lane of the search covers.
CHUNK, LANE = 1 << 20, 256
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(max(n + 1, CHUNK + 1), base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each word of data, A-Z taken as a-z; no word crosses an offset in breaks."""
    hashes, starts, ends, at, n = [], [], [], 0, len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[breaks[breaks <= n]] = True
    while at < n:
        to = min(at + CHUNK, n)
        while to < n and _IS_WORD[data[to]] and _IS_WORD[data[to - 1]] and not cut[to]:  # to a word's end
            step = data[to : to + 4096]
            stop = np.flatnonzero(~_IS_WORD[step] | cut[to : to + len(step)])
            to = to + int(stop[0]) if len(stop) else to + len(step)
            if len(stop):
                break
        part = _LOWER[data[at:to]]
        inside = _IS_WORD[part]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        first = inside & (~before | cut[at:to])
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:] & ~cut[at + 1 : to]
        last = inside & ~after
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            up, down = _powers(len(part))
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
            h = (total[e] - total[s]) * down[s]
            h ^= h >> np.uint64(29)
            h *= _MIX
            h ^= h >> np.uint64(32)
            hashes.append(h)
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _BASE + b
    h ^= h >> np.uint64(31)
    return h * _MIX


def _blocks(w: np.ndarray, m: int) -> np.ndarray:
    """The block that ends at each word: two words, or one for patterns of one word."""
    if m == 1:
        return w * _MIX
    out = np.empty_like(w)
    out[:1] = 0
    out[1:] = _joined(w[:-1], w[1:])
    return out


class Patterns:
    """The windows of one length, as places in the items' words: shift table, and buckets by suffix block and rest of the window."""

    def __init__(self, m: int, items: Items, starts: np.ndarray) -> None:
        self.m, self.items = m, items
        w = items.hashes
        blocks = _blocks(w, m)
        used = starts[:, None] + np.arange(min(m, 2) - 1, m)[None, :]
        size = 1 << max(12, int(np.ceil(np.log2(16 * len(np.unique(used)) + 1))))
        self.mask, most = np.uint64(size - 1), m - min(m, 2) + 1
        self.shift = np.full(size, most, dtype=np.uint8)
        for j in range(min(m, 2) - 1, m):
            np.minimum.at(self.shift, blocks[starts + j] & self.mask, np.uint8(m - 1 - j))
        key = self._key(w, blocks, starts + m - 1)
        order = np.argsort(key, kind="stable")
        self.keys, self.starts = key[order], starts[order].astype(np.int32)

    def _key(self, w: np.ndarray, blocks: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the windows that end at these words: their suffix block joined with the words before it."""
        key = blocks[last]
        for j in range(2, self.m):
            key = _joined(key, w[last - j])
        return key

    def bytes_(self) -> int:
        return self.shift.nbytes + self.keys.nbytes + self.starts.nbytes

    def ends(self, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of last words and numbers of the patterns that may end there; first: where each text's words begin, with the end."""
        m, block = self.m, _blocks(w, self.m)
        low, high = first[:-1] + m - 1, first[1:]
        low, high = low[high > low], high[high > low]
        lanes = -(-(high - low) // LANE)
        k = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(low, lanes) + k * LANE
        end = np.minimum(at + LANE, np.repeat(high, lanes))
        hits = []
        while len(at):
            s = self.shift[block[at] & self.mask]
            hits.append(at[s == 0])
            at = at + np.maximum(s, 1)
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
        pos = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        key = self._key(w, block, pos)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        n = hi - lo  # items that share the window
        which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        who, which = np.repeat(pos, n), self.starts[which]
        same = np.ones(len(who), dtype=bool)
        for j in range(m):
            same &= w[who - m + 1 + j] == self.items.hashes[which + j]
        return who[same], which[same]


class Items:
    """Words of some benchmark items: one buffer of lower-cased bytes, word hashes, starts and ends, and the item of each word."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        texts = [(t or "").encode() for _, t in items]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.hashes, s, e = word_hashes(data, offsets)
        self.data, self.start, self.end = _LOWER[data].tobytes(), s.astype(np.int32), e.astype(np.int32)
        self.first = np.searchsorted(s, offsets)
        self.ids = [i for i, _ in items]
        self.of = np.repeat(np.arange(len(items), dtype=np.int32), np.diff(self.first))

    def said(self, first: int, m: int) -> list[bytes]:
        return [self.data[self.start[k] : self.end[k]] for k in range(first, first + m)]


def build(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[Patterns]:
    own = Items(items)
    n = np.diff(own.first)
    length = np.minimum(n, window)
    sets = []
    for m in np.unique(length[length > 0]).tolist():
        some = np.flatnonzero(length == m)
        count = n[some] - m + 1
        starts = np.repeat(own.first[some] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        sets.append(Patterns(m, own, starts))
    return sets


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; nulls are empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if a.null_count:
        a = a.fill_null("")
    _, off, data = a.buffers()
    width = np.int64 if pa.types.is_large_string(a.type) else np.int32
    o = np.frombuffer(off, width)[a.offset : a.offset + len(a) + 1].astype(np.int64) if off is not None and len(a) else np.zeros(len(a) + 1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def _groups(offsets: np.ndarray, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def search(data: np.ndarray, offsets: np.ndarray, sets: list[Patterns]) -> tuple[np.ndarray, list[np.ndarray], list[set[int]]]:
    """For each text: its words, the hit words' positions, and the items found."""
    w, s, e = word_hashes(data, offsets)
    first = np.searchsorted(s, offsets)
    covered = np.zeros(len(w) + 1, dtype=np.int64)
    items: list[set[int]] = [set() for _ in range(len(offsets) - 1)]
    for own in sets:
        pos, which = own.ends(w, first)
        if not len(pos):
            continue
        text = np.searchsorted(first, pos, "right") - 1
        for p, q, t in zip(pos.tolist(), which.tolist(), text.tolist(), strict=True):
            k = p - own.m + 1
            if [_LOWER[data[s[x] : e[x]]].tobytes() for x in range(k, p + 1)] == own.items.said(q, own.m):
                covered[k] += 1
                covered[p + 1] -= 1
                if (item := own.items.ids[own.items.of[q]]) is not None:
                    items[t].add(item)
    hit = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
    cuts = np.searchsorted(hit, first)
    return np.diff(first), [hit[a:b] - f for a, b, f in zip(cuts[:-1], cuts[1:], first[:-1], strict=True)], items


def _blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len((row[1] or "").encode())
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, prefix: str = "", window: int = WINDOW) -> DataFrame:
    """Adds n_words, hits (positions of hit words) and items (ids of items with an occurring window), each with the prefix."""
    spark = docs.sparkSession
    names = [f"{prefix}{x}" for x in ("n_words", "hits", "items")]
    kinds = [T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    width = len(docs.columns)
    text_at = docs.columns.index("text")
    out = docs
    held = []
    for k, block in enumerate(chain(_blocks_of(benchmark), [[]])):
        if k and not block:
            break
        if len(held) == BLOCKS_AT_ONCE:
            out = common.stored(out)
            for done in held:
                done.unpersist()
            held = []
        index = spark.sparkContext.broadcast(build(block, window))
        held.append(index)

        def scan(batches: Iterator[pa.RecordBatch], index=index, later: bool = k > 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = _strings(batch.column(text_at))
                counts, hits, items = [], [], []
                for i, j in _groups(offsets):
                    n, h, t = search(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], index.value)
                    counts.append(n)
                    hits += h
                    items += t
                if later:  # what the blocks before have found
                    hits = [np.union1d(a, np.array(b, np.int64)) for a, b in zip(hits, batch.column(width + 1).to_pylist(), strict=True)]
                    items = [a | set(b) for a, b in zip(items, batch.column(width + 2).to_pylist(), strict=True)]
                made = [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array([x.astype(np.int32) for x in hits], pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=schema.names)

        out = out.mapInArrow(scan, schema)
    return out


def item_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
