"""Two tokenizers aligned by bytes, and how many documents of the corpus link each pair of their ids.

A text is encoded by both vocabularies. Each token covers a range of bytes; where tokens of both end at one byte, a group ends. The
ends of both lists together cut the text into stretches that lie in one token of each: every linked pair of tokens is one stretch.

Every text is encoded once: what it links, as sorted int64 keys of a pair of ids each with the number of its links, is stored in
the shared folder. The count of an id pair is the number of documents that hold it linked. Every task counts its documents' keys
with np.unique and gives them out whenever many are held, so it holds a bounded table. The partial counts are range-partitioned and
sorted by key, equal keys are summed as runs, and each range becomes one shard: a sorted array of keys and counts in the shared
folder. Tasks of the last pass map the shards into memory and look keys up by binary search, so no task loads the whole table and
workers of one machine share its pages. A shard is written under a name of its own attempt and then renamed, so a task that is run
again writes the same shard again. To the driver go only the shards' names and first keys, and the highest count of each id.

A text whose white space is single spaces and line feeds is encoded word by word, as neither vocabulary has a token that crosses
the space before a word; a word's ids are remembered in the worker, up to a bound. Other texts are encoded whole.

Defined cases: null and empty texts, and texts that one of the vocabularies does not give back byte by byte, have no tokens: zeros
and an empty digest; each row is a document, so repeated rows count as often as they stand; an empty table gives an empty result and
no shards; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import tempfile
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from kerbline.llm import common, tokens
from kerbline.llm.token_counts import byte_letters

#: Words remembered in a worker; at the limit the memory starts anew. Longer words than this many characters are not remembered.
MOST_WORDS = 700_000
LONGEST_WORD = 64
#: Keys that a task holds before they are counted or looked up, and counted keys before they are given out.
MOST_KEYS = 1_000_000
#: Rows of an Arrow batch that leaves a task.
BATCH_ROWS = 1 << 16
#: Bits of the second id in a key.
B_BITS = 32
_READY: dict[tuple[str, str], "Aligner"] = {}
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Aligned(NamedTuple):
    """What one text gives: tokens of both, groups, their text, and the key of every link in order of bytes."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    keys: np.ndarray


class Aligner:
    """a: a byte-level vocabulary of the tokenizers library, and the same as ranks, whose library is quicker on words; b: a model of
    sentencepiece that sets a space before the text."""

    def __init__(self, a: str, ranks: str, b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.word = tokens.ids(a, ranks).piece
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        byte = byte_letters()
        entries = {i: e for e, i in self.a.get_vocab(with_added_tokens=True).items()}
        plain = {i: bytes(map(byte.__getitem__, e)) if all(c in byte for c in e) else e.encode() for i, e in entries.items()}
        self.a_bytes = [plain.get(i, b"") for i in range(max(plain) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        #: Whether a space always begins a piece of b, so that words can be encoded apart.
        self.apart = not any(b" " in s.lstrip(b" ") for s in self.b_bytes)
        self.a_sizes, self.b_sizes = (np.array([*map(len, of)], np.int64) for of in (self.a_bytes, self.b_bytes))
        # Each id as text with what follows it: inside a group, and at the end of the group's part.
        self.a_said, self.b_said = (np.array([[f"{i}{end}" for i in range(len(of))] for end in ends], object) for of, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")))
        #: Ids of words with their leading space, as bytes of int32; None where a vocabulary doesn't give back the bytes.
        self.a_known: dict[str, bytes | None] = {}
        self.b_known: dict[str, bytes | None] = {}

    def _a_ids(self, text: str) -> list[int]:
        # The two libraries class characters alike but for those that one of them doesn't know.
        if text.isascii() or not any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self.word(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _encoded(self, texts: list[str]) -> Iterator[tuple[bytes | None, bytes | None]]:
        """Ids of texts with their leading space."""
        of_a, of_b = self.a_bytes, self.b_bytes
        for text, b in zip(texts, self.b.encode([t[1:] for t in texts], num_threads=1) if texts else [], strict=True):
            a, data = self._a_ids(text), text.encode()
            same = b"".join([of_a[i] for i in a]) == data == b"".join([of_b[i] for i in b])
            yield (array("i", a).tobytes(), array("i", b).tobytes()) if same else (None, None)

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and the text by both; None if it has no tokens."""
        if not text:
            return None
        whole = " " + text
        # An empty word has no tokens of its own in b: a space at the end goes with what stands before it.
        if not self.apart or whole[-1] == " " or tokens.OTHER_SPACE.search(whole):
            ((a, b),) = self._encoded([whole])
        else:
            words, a_known, b_known = text.split(" "), self.a_known, self.b_known
            if len(a_known) > MOST_WORDS:
                a_known.clear()
                b_known.clear()
            new = list(set(words).difference(a_known))
            long = [w for w in new if len(w) > LONGEST_WORD]
            for w, (a, b) in zip(new, self._encoded([" " + w for w in new]), strict=True):
                a_known[w], b_known[w] = a, b
            try:
                a, b = b"".join(map(a_known.__getitem__, words)), b"".join(map(b_known.__getitem__, words))
            except TypeError:  # a word without ids
                a = b = None
            for w in long:
                del a_known[w], b_known[w]
        return None if a is None or b is None else (np.frombuffer(a, np.int32), np.frombuffer(b, np.int32))

    def align(self, text: str | None) -> Aligned | None:
        """None if the text has no tokens."""
        both = self.ids(text)
        if both is None:
            return None
        a, b = both
        a_ends, b_ends = self.a_sizes[a].cumsum(), self.b_sizes[b].cumsum()
        ending = np.zeros((2, a_ends[-1] + 1), bool)
        ending[0, a_ends] = ending[1, b_ends] = True
        # The stretches, by their ends: whether a token of a or of b ends there, or both and so a group.
        ends = np.flatnonzero(ending[0] | ending[1])
        is_a, is_b = ending[0, ends], ending[1, ends]
        cut = is_a & is_b
        keys = a.astype(np.int64)[is_a.cumsum() - is_a] << B_BITS | b[is_b.cumsum() - is_b]
        group = cut.cumsum() - cut
        a_group, b_group, n = group[is_a], group[is_b], int(cut.sum())
        said = np.empty(len(a) + len(b), object)
        # A group's tokens of a come after the tokens of b of all groups before it, those of b after the tokens of a up to its own.
        said[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = self.a_said[cut[is_a].astype(np.int8), a]
        said[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = self.b_said[cut[is_b].astype(np.int8), b]
        return Aligned(len(a), len(b), n, "".join(said.tolist())[:-1], keys)


def aligner(a: str, ranks: str, b: str) -> Aligner:
    """One per Python worker and pair of vocabularies."""
    if (a, b) not in _READY:
        _READY[a, b] = Aligner(a, ranks, b)
    return _READY[a, b]


def linked(docs: DataFrame, a: str, ranks: str, b: str) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its pairs: steps (from each sorted key to the
    next, from 0) and times (links of each key)."""
    kinds = [*[pa.int64()] * 5, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, rows, held = aligner(a, ranks, b), [], 0
        for part in batches:
            for doc, cell in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                made = both.align(cell.as_py())
                if made is None:
                    rows.append((doc, 0, 0, 0, 0, "", [], []))
                else:
                    keys, times = np.unique(made.keys, return_counts=True)
                    digest = hashlib.sha256(made.groups.encode()).hexdigest()
                    rows.append((doc, *made[:3], len(made.keys), digest, np.diff(keys, prepend=0), times.astype(np.int32)))
                    held += len(keys)
                if held > MOST_KEYS or len(rows) >= BATCH_ROWS:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    schema = ", ".join([*[f"{n} long" for n in names[:5]], "groups_sha256 string", "steps array<long>", "times array<int>"])
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, schema)


class PairCounts(NamedTuple):
    """Sorted shards of counted pairs: their names, their first keys, and the highest count of each id of the first vocabulary."""

    folder: str
    names: tuple[str, ...]
    firsts: np.ndarray
    highest: np.ndarray


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _batches(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), BATCH_ROWS):
        part = slice(at, at + BATCH_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(counts[part])], names=["key", "n"])


def _keys(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each row's keys, from its steps."""
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    for low, high in pairwise(offsets.tolist()):
        yield values[low:high].cumsum()


def _partial(links: DataFrame) -> DataFrame:
    """key, n: how many of a task's documents hold a pair, one row per key and task, or more where a task sees very many keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def counted() -> tuple[np.ndarray, np.ndarray]:
            new = np.unique(np.concatenate(waiting), return_counts=True)
            return _summed(np.r_[keys, new[0]], np.r_[counts, new[1]])

        for batch in batches:
            for own in _keys(batch.column(0)):
                waiting.append(own)
                n += len(own)
                if n > MOST_KEYS:
                    keys, counts = counted()
                    waiting, n = [], 0
                    if len(keys) > MOST_KEYS:
                        yield from _batches(keys, counts)
                        keys, counts = keys[:0], counts[:0]
        if waiting:
            keys, counts = counted()
        yield from _batches(keys, counts)

    return links.select("steps").mapInArrow(run, "key long, n long")


def _files(folder: str):
    """The file system of the shared folder, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def count_pairs(links: DataFrame) -> PairCounts:
    """Counts over all documents of linked(), as shards in the shared folder."""
    folder = f"{common.shared_dir(links.sparkSession)}/{uuid.uuid4().hex}"
    # Stored, as choosing the ranges reads the rows once more.
    rows = common.stored(_partial(links)).repartitionByRange("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for batch in batches:
            k, n = _summed(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            # A run may go on in the next batch.
            if keys and len(k) and keys[-1][-1] == k[0]:
                counts[-1][-1] += n[0]
                k, n = k[1:], n[1:]
            if len(k):
                keys.append(k)
                counts.append(n.copy())
        if not keys:
            return
        table = np.array([np.concatenate(keys), np.concatenate(counts)])
        files, path = _files(folder)
        name, own = f"{TaskContext.get().partitionId():08d}.npy", f"{uuid.uuid4().hex}.part"
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/{own}") as out:
            np.save(out, table)
        files.move(f"{path}/{own}", f"{path}/{name}")
        ids = table[0] >> B_BITS
        heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        best = np.maximum.reduceat(table[1], heads)
        columns = [pa.array([name] * len(heads)), pa.array([int(table[0, 0])] * len(heads)), pa.array(ids[heads]), pa.array(best)]
        yield pa.RecordBatch.from_arrays(columns, names=["name", "first", "id", "best"])

    # One row per id of the vocabulary and shard that holds it: ids stand together, so at most the vocabulary's size and one a shard.
    told = rows.mapInArrow(run, "name string, first long, id long, best long").toPandas()
    shards = told[["name", "first"]].drop_duplicates().sort_values("first")
    highest = np.zeros(int(told["id"].max()) + 1 if len(told) else 0, np.int64)
    np.maximum.at(highest, told["id"].to_numpy(), told["best"].to_numpy())
    return PairCounts(folder, tuple(shards["name"]), shards["first"].to_numpy(np.int64), highest)


def _shard(folder: str, name: str) -> np.ndarray:
    """Keys and counts of one shard, mapped into memory: from the shared folder where that is a mounted one, else from a copy that
    has no name any more, so that nothing of it outlives the worker."""
    files, path = _files(folder)
    if files.type_name == "local":
        return np.load(f"{path}/{name}", mmap_mode="r")
    with tempfile.NamedTemporaryFile() as copy, files.open_input_stream(f"{path}/{name}") as there:
        shutil.copyfileobj(there, copy)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")


class Lookup:
    """Counts by key in one task; a shard is mapped when the first key of its range comes."""

    def __init__(self, found: PairCounts) -> None:
        self.found = found
        self.shards: dict[int, np.ndarray] = {}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted keys that all were counted."""
        parts, cuts = [], np.searchsorted(keys, self.found.firsts)
        for k, (low, high) in enumerate(pairwise([*cuts.tolist(), len(keys)])):
            if low < high:
                if k not in self.shards:
                    self.shards[k] = _shard(self.found.folder, self.found.names[k])
                table = self.shards[k]
                parts.append(table[1][np.searchsorted(table[0], keys[low:high])])
        return np.concatenate(parts)


def against_counts(links: DataFrame, found: PairCounts) -> DataFrame:
    """The rows of linked() with n_best and count_sum in place of the pairs."""
    plain = [f.name for f in links.schema.fields if f.name not in ("steps", "times")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(found)

        def sums(docs: list[np.ndarray], times: np.ndarray) -> Iterator[tuple[int, int]]:
            """n_best and count_sum of some documents, whose keys are looked up together."""
            keys, back = np.unique(np.concatenate(docs), return_inverse=True)
            counts = lookup.counts(keys)
            best = counts == found.highest[keys >> B_BITS]
            at = np.cumsum([0, *map(len, docs)])
            n_best, total = (np.r_[0, (x[back] * times).cumsum()] for x in (best, counts))
            yield from zip((n_best[at[1:]] - n_best[at[:-1]]).tolist(), (total[at[1:]] - total[at[:-1]]).tolist(), strict=True)

        for batch in batches:
            steps, times = batch.column(len(plain)), batch.column(len(plain) + 1)
            all_times, first = times.values.to_numpy(), times.offsets.to_numpy()
            out, docs, begun, held = [], [], 0, 0
            for k, own in enumerate(_keys(steps)):
                docs.append(own)
                held += len(own)
                if held and (held > MOST_KEYS or k + 1 == len(steps)):
                    out += sums(docs, all_times[first[begun] : first[k + 1]])
                    docs, begun, held = [], k + 1, 0
            out += [(0, 0)] * len(docs)  # none of them has a key
            columns = [*batch.columns[: len(plain)], *(pa.array([x[c] for x in out], pa.int64()) for c in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*plain, "n_best", "count_sum"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in links.schema.fields if f.name in plain]
    return links.select(*plain, "steps", "times").mapInArrow(run, ", ".join([*kinds, "n_best long", "count_sum long"]))


def report(docs: DataFrame, a: str, ranks: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per document."""
    links = common.stored(linked(docs, a, ranks, b))
    made = against_counts(links, count_pairs(links))
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def table(spark: SparkSession, found: PairCounts) -> DataFrame:
    """a, b, documents, best: the counted pairs, a task per shard; best where no other pair of the same a has a higher count."""
    names = spark.createDataFrame([(n,) for n in found.names], "name string").repartition(max(1, len(found.names)))
    folder, highest = found.folder, found.highest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                keys, counts = _shard(folder, name)
                for at in range(0, len(keys), BATCH_ROWS):
                    k, n = keys[at : at + BATCH_ROWS], counts[at : at + BATCH_ROWS]
                    columns = [pa.array(k >> B_BITS), pa.array(k & ((1 << B_BITS) - 1)), pa.array(n), pa.array(n == highest[k >> B_BITS])]
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "documents", "best"])

    return names.mapInArrow(run, "a long, b long, documents long, best boolean")
