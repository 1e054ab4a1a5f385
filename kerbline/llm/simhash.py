"""SimHash near-duplicates: fingerprints, all links within a Hamming distance, components.

Links are found between distinct fingerprints only. With four blocks of sixteen bits, two fingerprints within two bits agree on
two blocks at least, so six bucket keys a fingerprint bring every linked pair together. Inside a bucket a Gray-order
hierarchical index finds the links: fingerprints sorted by Gray rank, bits that neighbours share factored into upper nodes as a
mask and a pattern, pairs of nodes dropped as soon as the differences counted so far exceed the distance. A bucket of over
HOT_BUCKET fingerprints is split by a second pair of blocks out of its other 32 bits, after which it cannot hold more than 2^16.
A task emits a spanning forest of each bucket, never its pairs.

Defined cases: a text without words (null, empty, white space) has fingerprint zero and links like any other; repeated rows
share a fingerprint; rows without an id take part, and their component has the smallest id that is not null; an empty table gives
an empty result; extra columns are ignored. Of each component one row is kept, the first by (doc_id, fingerprint, text hash), ids
that are null last; rows that share an id stand for themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm import common, components

SHINGLE, SEED, DISTANCE = 3, 42, 2
HOT_BUCKET = 4096
#: Ids of dropped documents that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Children of a node of the Gray-order index.
FANOUT = 16
_P = "__sh_"
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    h, counts = np.array(hashes, dtype="<u8"), np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long), th (the text's hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py()) for x in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), b.column(2)], names=["doc_id", "fp", "th"])

    return docs.select(docs["doc_id"].cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, fp long, th long")


def gray_rank(fp: Column) -> Column:
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def _keys(fp: Column, blocks: list[tuple[int, int]]) -> Column:
    """The six (pair, key) of four blocks, each (lowest bit, width)."""
    part = lambda at, width: F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1)
    return F.array(*[F.struct(F.lit(k).alias("c"), F.shiftleft(part(*blocks[i]), blocks[j][1]).bitwiseOR(part(*blocks[j])).alias("key")) for k, (i, j) in enumerate(_PAIRS)])


_WIDE = [(16 * i, 16) for i in range(4)]


def _buckets(fps: DataFrame) -> DataFrame:
    """c, key, fp: rows of one (c, key) are to be compared."""
    keys = fps.select("fp", F.inline(_keys(F.col("fp"), _WIDE)))
    hot = common.stored(keys.groupBy("c", "key").count().filter(F.col("count") > HOT_BUCKET).select("c", "key"))
    if hot.isEmpty():
        return keys
    parts = [keys.join(hot, ["c", "key"], "left_anti")]
    for k, pair in enumerate(_PAIRS):
        # What the bucket does not fix: two blocks of sixteen bits, as four of eight.
        rest = [(at + half, 8) for b in range(4) if b not in pair for at, half in ((16 * b, 0), (16 * b, 8))]
        own = keys.join(hot.filter(F.col("c") == k), ["c", "key"], "left_semi")
        finer = own.select("fp", "key", F.inline(_keys(F.col("fp"), rest)).alias("d", "low"))
        parts.append(finer.select((F.lit(6 + 6 * k) + F.col("d")).cast("int").alias("c"), F.shiftleft("key", 16).bitwiseOR(F.col("low")).alias("key"), "fp"))
    out = parts[0].select("c", "key", "fp")
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def near(fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the distance, of fingerprints sorted by Gray rank: a descent of the index against itself."""
    levels = [(fp, np.full(len(fp), ~np.uint64(0)))]
    while len(levels[-1][0]) > FANOUT:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), FANOUT)
        differs = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[at], np.diff(np.append(at, len(pattern)))), at)
        shared = np.bitwise_and.reduceat(mask, at) & ~differs
        levels.append((pattern[at] & shared, shared))
    n = len(levels[-1][0])
    a, b = (x.astype(np.int64) for x in np.triu_indices(n))
    for depth in range(len(levels) - 1, -1, -1):
        pattern, mask = levels[depth]
        keep_a, keep_b = [], []
        for k in range(0, len(a), 1 << 20):
            i, j = a[k : k + (1 << 20)], b[k : k + (1 << 20)]
            if depth < len(levels) - 1:  # children of the pairs that were kept above
                step = np.arange(FANOUT)
                i, j = (i[:, None, None] * FANOUT + step[:, None] + 0 * step).ravel(), (j[:, None, None] * FANOUT + step + 0 * step[:, None]).ravel()
                inside = (i <= j) & (j < len(pattern)) & (i < len(pattern))
                i, j = i[inside], j[inside]
            close = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= distance
            keep_a.append(i[close])
            keep_b.append(j[close])
        a, b = np.concatenate(keep_a), np.concatenate(keep_b)
    apart = a != b
    return a[apart], b[apart]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position in each position's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links_of(runs: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (positions) inside the runs, given by their bounds."""
    length = np.diff(runs)
    a, b = [], []
    for k in range(1, FANOUT):  # short runs are a single leaf: all of them at once
        some = (length > k) & (length <= FANOUT)
        for m in np.unique(length[some]):
            at = (runs[:-1][some & (length == m)][:, None] + np.arange(m - k)).ravel()
            close = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= DISTANCE]
            a.append(close)
            b.append(close + k)
    for s, e in zip(runs[:-1][length > FANOUT], runs[1:][length > FANOUT], strict=True):
        i, j = near(fp[s:e])
        a.append(i + s)
        b.append(j + s)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    root = forest(len(fp), a, b)
    joined = np.flatnonzero(root != np.arange(len(fp)))
    return joined, root[joined]


def links(fps: DataFrame) -> DataFrame:
    """a, b: links that connect every two distinct fingerprints within the distance."""
    keyed = _buckets(fps)
    dealt = keyed.repartition("c", "key").sortWithinPartitions("c", "key", gray_rank(F.col("fp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, key, fp = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def found(runs: np.ndarray) -> pa.RecordBatch:
            i, j = _links_of(runs, fp[: runs[-1]])
            return pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], names=["a", "b"])

        for batch in batches:
            c, key = np.concatenate([c, batch.column(0).to_numpy()]), np.concatenate([key, batch.column(1).to_numpy()])
            fp = np.concatenate([fp, batch.column(2).to_numpy().view(np.uint64)])
            runs = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (key[1:] != key[:-1])]))
            if len(runs) > 1:  # the last run may go on in the next batch
                yield found(runs)
                c, key, fp = c[runs[-1] :], key[runs[-1] :], fp[runs[-1] :]
        if len(fp):
            yield found(np.array([0, len(fp)]))

    return dealt.select(F.col("c").cast("int"), "key", "fp").mapInArrow(run, "a long, b long")


def least_of_components(own: DataFrame, value: Column) -> DataFrame:
    """fp, least: the smallest value of the rows of the fingerprint's component."""
    fps = common.stored(own.groupBy("fp").agg(F.min(value).alias("least")))
    tree = components.components(links(fps.select("fp")))
    rooted = fps.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("lowest"))
    return rooted.join(lowest, "root").select("fp", F.col("lowest").alias("least"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id."""
    own = common.stored(with_fingerprint(docs))
    return own.join(least_of_components(own, F.col("doc_id")), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The documents of which each component keeps one row, the first by (doc_id, fingerprint, text hash), ids that are null last,
    with their columns; of rows with the same id and text one stays."""
    own = common.stored(with_fingerprint(docs))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "th")
    made = own.select("doc_id", "fp", "th", row.alias("row")).join(least_of_components(own, row), "fp")
    gone = common.stored(made.filter(F.col("row") != F.col("least")).select(*_row_of("doc_id", "th")).distinct())
    kept = docs.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, _same_row(docs), "left_anti")
    twice = common.stored(made.filter(F.col("row") == F.col("least")).groupBy("doc_id", "th").count().filter("count > 1").select(*_row_of("doc_id", "th")))
    if not twice.isEmpty():
        again = kept.join(twice, _same_row(docs), "left_semi").withColumn(f"{_P}text", F.xxhash64("text")).dropDuplicates(["doc_id", f"{_P}text"])
        kept = kept.join(twice, _same_row(docs), "left_anti").unionByName(again.select(*docs.columns))
    return kept.select(*docs.columns)


def _row_of(doc_id: str, th: str) -> list[Column]:
    return [F.col(doc_id).alias(f"{_P}id"), F.col(th).alias(f"{_P}th")]


def _same_row(docs: DataFrame) -> Column:
    return docs["doc_id"].cast("long").eqNullSafe(F.col(f"{_P}id")) & (F.xxhash64(docs["text"]) == F.col(f"{_P}th"))
