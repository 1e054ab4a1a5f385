"""Packing into token windows by Karmarkar-Karp multiway differencing.

Each task cuts whole windows off long documents and pools the rest. When the pool holds BATCH windows, differencing spreads its
pieces over them: the two partial partitions of the largest spread are merged again and again, the largest sums of one onto the
smallest of the other. Sums come out nearly equal; what exceeds the capacity is cut off and moved to windows that lack as much,
so every window of a batch is full. The last tokens of a task fill windows of powers of two, which need no padding.
Where pieces may not be cut (``windows``), the window count rises until no window exceeds the capacity.

Rows are not shuffled; memory holds one batch of documents and one pool.

Defined cases: null and empty texts have the end id alone; repeated rows are packed row by row; an empty table gives no row;
extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kerbline.llm import tokens

CAPACITY = 1024
END_ID = 0
#: Windows that one differencing fills.
BATCH = 64
#: Bits of a sequence id that number the sequences of a task.
TASK_BITS = 34
SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))])


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of positions in sizes, with nearly equal sums."""
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for i, x in enumerate(sizes):
        heap.append((-x, i, [(x, [i])]))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        # Both hold their sums in descending order, zeros left out; the largest of one meets the smallest of the other.
        short = k - len(a)
        if len(b) <= short:
            merged = a + b
        else:
            merged = a[: k - len(b)] if len(b) < k else []
            met = a[k - len(b) :]
            tail = b[::-1]  # ascending: meets a's sums in descending order, after the zeros
            pair = met + [(0, [])] * (len(tail) - len(met))
            merged = merged + [(x + y, p + q) for (x, p), (y, q) in zip(pair, tail, strict=True)]
        merged.sort(key=lambda s: -s[0])
        least = merged[-1][0] if len(merged) == k else 0
        if least:
            merged = [(x - least, p) for x, p in merged]
        n += 1
        heapq.heappush(heap, (-merged[0][0], n, merged))
    out = [p for _, p in heap[0][2]] if heap else []
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of whole pieces, none over the capacity unless a single piece is."""
    k = max(1, -(-sum(sizes) // capacity))
    most = max([capacity, *sizes])
    while True:
        out = karmarkar_karp(sizes, k)
        if all(sum(sizes[i] for i in w) <= most for w in out):
            return [w for w in out if w]
        k += 1


Piece = tuple[int | None, int, int, int, bytes]  # doc_id, start, length, doc_tokens, ids


def _cut(p: Piece, at: int) -> tuple[Piece, Piece]:
    doc, start, length, total, ids = p
    return (doc, start, at, total, ids[: 4 * at]), (doc, start + at, length - at, total, ids[4 * at :])


def level(pieces: list[Piece], k: int, capacity: int = CAPACITY) -> list[list[Piece]]:
    """k windows of exactly the capacity from pieces of k times the capacity."""
    full, over, lacking = [], [], []
    for own in karmarkar_karp([p[2] for p in pieces], k):
        w, size = [], 0
        for i in own:
            p = pieces[i]
            if size + p[2] > capacity:
                if size < capacity:
                    p, rest = _cut(p, capacity - size)
                    w.append(p)
                    size = capacity
                    over.append(rest)
                else:
                    over.append(p)
            else:
                w.append(p)
                size += p[2]
        (full if size == capacity else lacking).append(w)
    for w in lacking:
        need = capacity - sum(p[2] for p in w)
        while need:
            p = over.pop()
            if p[2] > need:
                p, rest = _cut(p, need)
                over.append(rest)
            w.append(p)
            need -= p[2]
    return full + lacking


class Packer:
    def __init__(self, capacity: int, batch: int) -> None:
        self.capacity, self.batch = capacity, batch
        self.pool: list[Piece] = []
        self.pooled = 0

    def add(self, doc: int | None, ids: bytes) -> Iterator[list[Piece]]:
        """Windows that are complete with this document."""
        n, c = len(ids) // 4, self.capacity
        for at in range(0, n - c + 1, c):
            yield [(doc, at, c, n, ids[4 * at : 4 * (at + c)])]
        if rest := n % c:
            self.pool.append((doc, n - rest, rest, n, ids[4 * (n - rest) :]))
            self.pooled += rest
            if self.pooled >= self.batch * c:
                yield from self._spread(self.batch)

    def _spread(self, k: int) -> Iterator[list[Piece]]:
        after = self.pooled - k * self.capacity
        back, kept = self._split_last(after)
        self.pool.extend(back)
        yield from level(self.pool, k, self.capacity)
        self.pool, self.pooled = kept, after

    def _split_last(self, after: int) -> tuple[list[Piece], list[Piece]]:
        """Takes `after` tokens off the pool's end: what goes back, what is kept."""
        kept: list[Piece] = []
        while after:
            p = self.pool.pop()
            if p[2] > after:
                p, rest = _cut(p, p[2] - after)
                return [p], [rest, *kept]
            kept.insert(0, p)
            after -= p[2]
        return [], kept

    def rest(self) -> Iterator[list[Piece]]:
        """Full windows of what is left, then windows of powers of two."""
        if q := self.pooled // self.capacity:
            yield from self._spread(q)
        left, size = self.pool, self.pooled
        while size:
            need = 1 << (size.bit_length() - 1)
            size -= need
            w: list[Piece] = []
            while need:
                p = left.pop()
                if p[2] > need:
                    p, r = _cut(p, need)
                    left.append(r)
                w.append(p)
                need -= p[2]
            yield w
        self.pool, self.pooled = [], 0


def pack(docs: DataFrame, vocabulary: str, ranks: str, capacity: int = CAPACITY, batch: int = BATCH, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the piece's ids."""
    end = END_ID.to_bytes(4, "little")
    schema = T.StructType([*SCHEMA.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc, packer = tokens.ids(vocabulary, ranks), Packer(capacity, batch)
        sequence, rows = TaskContext.get().partitionId() << TASK_BITS, []

        def laid(made: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for w in made:
                offset = 0
                for doc, start, length, total, ids in w:
                    rows.append((doc, start, length, zlib.crc32(ids), total, sequence, offset, *([np.frombuffer(ids, "<u4").astype("i4")] if with_ids else [])))
                    offset += length
                sequence += 1

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids, strict=True)], names=schema.names)
            rows.clear()
            return made

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                laid(packer.add(doc, enc.of(text.as_py() or "") + end))
                if len(rows) >= 8192:
                    yield out()
        laid(packer.rest())
        if rows:
            yield out()

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, schema)
