"""Training-order materialisation of token ids into shards of fixed stride.

The ids of an input partition's documents, END after each, run on and are cut into sequences of LENGTH, so only a partition's last
sequence can be shorter. A first pass over the texts' byte lengths gives every partition a range of numbers that is long enough (no
text has more ids than bytes). A keyed Feistel network, walked until it falls inside, permutes all numbers, used or not: this is the
training order, and a sequence's global slot is its rank in it, without gaps. Sequences are dealt by ranges of that order; a task
sorts its range and writes it as one shard of records of one stride. A shard is written under a name of the attempt and then
renamed, so a repeated task replaces it by the same bytes; what an attempt that failed left behind starts with a dot and is never
read. The manifest, written last, says that the shards are whole and at which slot each begins: a reader seeks any slot and goes on
from there. A record names the document its first id is from, and how many ids of that document come before; END parts the rest.

The texts are tokenized once and their ids shuffled once. The two passes must see one partitioning of the input, as file scans
give; a task that finds other lengths than the first pass fails rather than write wrong slots.

Defined cases: null and empty texts have END alone; rows without an id are written with the least long; repeated rows have ids of
their own; an empty table has a manifest and no shard; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import common, tokens

LENGTH, KEY = 256, 0x5EED_0F_70_4E45
END = 50_256
#: Numbers of a shard at least (about half of them are used), and shards at most; beyond, a shard has more numbers.
SPAN, MOST_SHARDS = 32_768, 1_000_000
RECORD = np.dtype([("doc_id", "<i8"), ("at", "<i8"), ("n", "<u4"), ("ids", "<u2", (LENGTH,))])
NO_ID = -(1 << 63)
MANIFEST = "manifest.json"


def _round(x: np.ndarray, key: int) -> np.ndarray:
    h = (x + np.uint64(key & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def permuted(numbers: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0 ... size - 1."""
    half = np.uint64(max(1, -(-max(1, size - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = numbers.astype(np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():
        x = out[walk]
        left, right = x >> half, x & mask
        for k in range(4):
            left, right = right, left ^ (_round(right, key * (2 * k + 1) + k) & mask)
        out[walk] = (left << half) | right
        walk = out >= size
    return out.astype(np.int64)


def _bytes(texts: pa.Array) -> int:
    """Bytes of the texts, and one more for each."""
    return int(pc.sum(pc.binary_length(texts)).as_py() or 0) + len(texts)


def _ranges(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Each input partition's least and last number, and the count of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = sum(_bytes(b.column(0)) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([-(-size // LENGTH)], pa.int64())], names=["part", "n"])

    told = docs.select("text").mapInArrow(run, "part int, n long").toPandas()  # one row per input partition
    most = np.zeros(int(told["part"].max()) + 1 if len(told) else 0, np.int64)
    most[told["part"]] = told["n"]
    last = np.cumsum(most)
    return last - most, last, int(most.sum())


def sequences(docs: DataFrame, vocabulary: tuple[str, str], key: int = KEY) -> tuple[DataFrame, int]:
    """place (in the training order), doc_id, at, ids (little-endian 16-bit numbers): a sequence, the document that its first id is
    from, and that document's ids before; and the number of places."""
    first, last, total = _ranges(docs)
    shared = docs.sparkSession.sparkContext.broadcast((first, last))
    width = 2 * LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, part = tokens.ids(*vocabulary), np.array([END], "<u2").tobytes(), TaskContext.get().partitionId()
        number, until = (int(x[part]) if part < len(x) else 0 for x in shared.value)
        done: list[tuple[int, int, bytes]] = []
        rest, rest_doc, rest_at, size, given = b"", NO_ID, 0, 0, until - number

        def out() -> pa.RecordBatch:
            doc, at, ids = zip(*done, strict=True)
            place = permuted(np.arange(number, number + len(done)), total, key)
            return pa.RecordBatch.from_arrays([pa.array(place), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(ids, pa.binary())], names=["place", "doc_id", "at", "ids"])

        for b in batches:
            size += _bytes(b.column(1))
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc, whole, p = NO_ID if i is None else i, np.frombuffer(enc.of(x.as_py() or ""), "<u4").astype("<u2").tobytes() + end, 0
                if rest:
                    p = width - len(rest)
                    rest += whole[:p]
                    if len(rest) < width:
                        continue
                    done.append((rest_doc, rest_at, rest))
                last = p + (len(whole) - p) // width * width
                done += [(doc, q // 2, whole[q : q + width]) for q in range(p, last, width)]
                rest, rest_doc, rest_at = whole[last:], doc, last // 2
                if len(done) > 8192:
                    yield out()
                    number, done = number + len(done), []
        if -(-size // LENGTH) != given:
            raise RuntimeError("the input's partitions changed between the two passes")
        if rest:
            done.append((rest_doc, rest_at, rest))
        if done:
            yield out()

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "place long, doc_id long, at long, ids binary"), total


def _name(shard: int) -> str:
    return f"shard-{shard:09d}.bin"


def write(made: DataFrame, places: int, to: str, key: int = KEY) -> dict:
    """Writes the shards into the folder, a URI that all machines reach, then the manifest, which is returned."""
    span = max(SPAN, -(-places // MOST_SHARDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(to)
        store.create_dir(root, recursive=True)
        at = sink = None
        temporary, n = "", 0

        def done() -> pa.RecordBatch:
            sink.close()
            store.move(temporary, f"{root}/{_name(at)}")
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n], pa.int64())], names=["shard", "records"])

        for b in batches:
            shard = b.column(0).to_numpy() // span
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if shard[s] != at:
                    if sink is not None:
                        yield done()
                    at, n, temporary = int(shard[s]), 0, f"{root}/.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(temporary)
                own = b.slice(s, e - s)
                records = np.zeros(e - s, RECORD)
                records["doc_id"], records["at"] = own.column(1), own.column(2)
                ids = own.column(3).to_pylist()
                records["n"] = [len(x) // 2 for x in ids]
                records["ids"] = np.frombuffer(b"".join(x.ljust(2 * LENGTH, b"\0") for x in ids), "<u2").reshape(-1, LENGTH)
                sink.write(records.tobytes())
                n += e - s
        if sink is not None:
            yield done()

    dealt = made.repartitionById(max(1, -(-places // span)), F.expr(f"CAST(place DIV {span} AS INT)")).sortWithinPartitions("place")
    wrote = common.stored(dealt.mapInArrow(run, "shard long, records long")).orderBy("shard").toPandas()  # MOST_SHARDS rows at most
    first = np.cumsum(wrote["records"]) - wrote["records"]
    told = {"records": int(wrote["records"].sum()), "length": LENGTH, "stride": RECORD.itemsize, "end": END, "key": key, "shards": wrote["shard"].tolist(), "first_slots": first.astype(int).tolist()}
    store, root = fs.FileSystem.from_uri(to)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{MANIFEST}") as f:
        f.write(json.dumps(told).encode())
    return told


def manifest(at: str) -> dict:
    store, root = fs.FileSystem.from_uri(at)
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def read(spark: SparkSession, at: str, start: int = 0, end: int | None = None) -> DataFrame:
    """slot, shard, doc_id, at, n_tokens, ids of the records from slot start up to end; each shard is read from its place on."""
    told = manifest(at)
    start, stop = max(start, 0), told["records"] if end is None else min(end, told["records"])
    shards, firsts = np.array(told["shards"], np.int64), np.array([*told["first_slots"], told["records"]], np.int64)
    low, high = (int(np.searchsorted(firsts, start, "right")) - 1, int(np.searchsorted(firsts[:-1], stop))) if start < stop else (0, 0)
    shared = spark.sparkContext.broadcast((shards, firsts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(at)
        named, begins = shared.value
        for b in batches:
            for k in b.column(0).to_pylist():
                shard, slot, until = int(named[k]), max(start, int(begins[k])), min(stop, int(begins[k + 1]))
                with store.open_input_file(f"{root}/{_name(shard)}") as source:
                    source.seek((slot - int(begins[k])) * RECORD.itemsize)
                    while slot < until:
                        r = np.frombuffer(source.read(min(8192, until - slot) * RECORD.itemsize), RECORD)
                        ids = pa.array([x[:n].tobytes() for x, n in zip(r["ids"], r["n"].tolist(), strict=True)], pa.binary())
                        doc = pa.array(r["doc_id"], mask=r["doc_id"] == NO_ID)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slot, slot + len(r))), pa.array(np.full(len(r), shard, np.int64)), doc, pa.array(r["at"]), pa.array(r["n"].astype(np.int32)), ids], names=["slot", "shard", "doc_id", "at", "n_tokens", "ids"])
                        slot += len(r)

    return spark.range(low, high, 1, max(1, min(high - low, 100_000))).mapInArrow(run, "slot long, shard long, doc_id long, at long, n_tokens int, ids binary")


def materialise(docs: DataFrame, vocabulary: tuple[str, str], to: str, key: int = KEY) -> dict:
    return write(*sequences(docs, vocabulary, key), to, key)


def report(docs: DataFrame, vocabulary: tuple[str, str]) -> DataFrame:
    """Writes the shards into the shared folder and reads them back: one row per record, with the CRC-32 of its ids."""
    spark: SparkSession = docs.sparkSession
    to = f"{common.shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    materialise(docs, vocabulary, to)
    return read(spark, to).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
