"""Toxicity by a linear-chain conditional random field over words.

Learning reads a bounded sample of labelled rows, at most MOST_TOXIC toxic and MOST_CLEAN other ones, the first by a hash of the
id, one text of at most MOST_CHARS characters an id, and MOST_TOTAL characters in all. A word is labelled toxic where its document is and where the word, or a stem of it, is far commoner in toxic documents.
A chain of two states with hashed features of word, stems and ending is fitted to these words in numpy; a logistic curve over a
document's marginals is fitted to the documents' labels. Scoring then runs over every text: forward-backward gives each word's
probability, and their sum and maximum give the score; words of at least SPAN_LEVEL are offending, with their offsets.

Only the model is broadcast; its size is fixed by FEATURES. Rows are not shuffled.

Defined cases: null and empty texts have no words and get the score of no evidence; rows without an id are scored and belong to
fold 0; repeated ids and rows are scored one by one; labels given twice count as toxic if either says so; without labels of both
kinds every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm import chain, common

MOST_TOXIC, MOST_CLEAN = 1000, 2000
#: Characters of a text that the sample may hold; a longer labelled text is scored but not learnt from.
MOST_CHARS = 100_000
#: Characters that all learnt texts hold together: some 450 MB on the driver while the model is fitted.
MOST_TOTAL = 8_000_000
FEATURES = 1 << 18
ROUNDS = 30
#: A feature marks words as toxic from this many toxic documents and this ratio of rates.
LEAST_DOCS, LEAST_RATIO = 4, 25.0
LEVEL, SPAN_LEVEL = 0.7, 0.5
#: Words remembered in a worker.
MOST_WORDS = 400_000
_LETTERS = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(rb"[^\x20\x09-\x0d]+")


def features(word: str) -> list[str]:
    return [f"w{word}", f"3{word[:3]}", f"4{word[:4]}", f"5{word[:5]}", f"s{word[-3:]}"]


def _slots(word: str) -> list[int]:
    return [crc32(f.encode()) % FEATURES for f in features(word)]


class Model:
    def __init__(self) -> None:
        self.w, self.bias = np.zeros(FEATURES, np.float32), 0.0
        self.a, self.begin = np.ones((2, 2)), np.ones(2)
        self.curve = np.array([-50.0, 0.0, 0.0])  # score 0 where nothing could be learnt

    def emission(self, word: str) -> float:
        return float(self.w[_slots(word)].sum()) + self.bias

    def token(self, raw: bytes) -> float:
        """Of a run without white space: its most toxic word."""
        found = _LETTERS.findall(raw.decode(errors="replace").lower())
        return max(map(self.emission, found), default=self.bias - 10.0)

    def score(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * np.log1p(total) + self.curve[2] * most)))


def by_text(p: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and maximum of the words' probabilities in each text."""
    total, most = np.zeros(len(lengths)), np.zeros(len(lengths))
    some = lengths > 0
    at = (np.cumsum(lengths) - lengths)[some]
    if len(at):
        total[some], most[some] = np.add.reduceat(p, at), np.maximum.reduceat(p, at)
    return total, most


def _psi(e: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(e, -15, 15))


def fit(texts: list[str], toxic: list[int]) -> Model:
    model = Model()
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    if not n1 or not n0:
        return model
    words = [_LETTERS.findall((t or "").lower()) for t in texts]
    seen = {1: Counter(), 0: Counter()}
    for own, y in zip(words, toxic, strict=True):
        seen[y].update({f for w in set(own) for f in features(w) if f[0] in "w45"})
    marks = {f for f, c in seen[1].items() if c >= LEAST_DOCS and c / n1 >= LEAST_RATIO * (seen[0][f] + 0.5) / n0}
    vocabulary: dict[str, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for own in words for w in own), np.int64)
    lengths = np.array([len(own) for own in words])
    slots = np.array([_slots(w) for w in vocabulary]).reshape(-1, 5)
    marked = np.array([any(f in marks for f in features(w)) for w in vocabulary], dtype=bool)
    y = marked[ids] & np.repeat(np.array(toxic, bool), lengths) if len(ids) else np.zeros(0, bool)
    if not y.any():
        return model
    first = np.zeros(len(ids), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    theta = {"w": np.zeros(FEATURES), "b": np.array(np.log(y.mean() / (1 - y.mean()))), "a": np.zeros((2, 2)), "s": np.zeros(2)}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in theta.items()}
    pair = ~first[1:]
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[:-1][pair].astype(int), y[1:][pair].astype(int)), 1)
    rate, scale = 0.3, 1 / max(1, y.sum())
    for k in range(1, ROUNDS + 1):
        e = theta["w"][slots].sum(axis=1) + theta["b"]
        psi, a, s = _psi(e[ids]), np.exp(theta["a"]), np.exp(theta["s"])
        p, forward, backward = chain.marginals(psi, first, a, s)
        f, q, x = forward[:-1][pair], backward[1:][pair], psi[1:][pair]
        cells = [a[0, 0] + 0 * f, a[0, 1] * x * q, f * a[1, 0], f * a[1, 1] * x * q]
        z = sum(cells)
        expected = np.array([(c / z).sum() for c in cells]).reshape(2, 2)
        residual = np.bincount(ids, weights=p - y, minlength=len(vocabulary))
        begun = np.array([((~y[first]).sum() - (1 - p[first]).sum()), (y[first].sum() - p[first].sum())])
        gradient = {"w": scale * np.bincount(slots.ravel(), weights=np.repeat(residual, 5), minlength=FEATURES) + 1e-4 * theta["w"], "b": np.array(scale * residual.sum()), "a": scale * (expected - gold) + 1e-3 * theta["a"], "s": -scale * begun + 1e-3 * theta["s"]}
        for name, g in gradient.items():  # Adam
            m, v = state[name]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            theta[name] = theta[name] - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model.w, model.bias, model.a, model.begin = theta["w"].astype(np.float32), float(theta["b"]), np.exp(theta["a"]), np.exp(theta["s"])
    p, _, _ = chain.marginals(_psi((theta["w"][slots].sum(axis=1) + theta["b"])[ids]), first, model.a, model.begin)
    total, most = by_text(p, lengths)
    # Documents of which no word is marked say nothing about the curve: their labels hold for other reasons.
    has = by_text(marked[ids].astype(float), lengths)[1] > 0
    t = np.array(toxic, float)
    use = has | (t == 0)
    x = np.stack([np.ones(len(t)), np.log1p(total), most], axis=1)[use]
    beta = np.zeros(3)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (mu - t[use]) + 1e-2 * beta
        h = (x * (mu * (1 - mu))[:, None]).T @ x + 1e-2 * np.eye(3)
        beta = beta - np.linalg.solve(h, g)
    model.curve = beta
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    own = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(common.fold(F.col("doc_id"), 3) != 1)
    first = lambda toxic, most: own.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = first(1, MOST_TOXIC).unionAll(first(0, MOST_CLEAN))
    # One text an id, the first by hash; MOST_TOTAL bounds what comes to the driver.
    texts = docs.select("doc_id", "text").filter(F.length("text") <= MOST_CHARS).join(F.broadcast(sample), "doc_id")
    first = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    rows = common.bounded(texts.groupBy("doc_id", "toxic").agg(first.alias("text")), "doc_id", MOST_TOTAL).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [int(r["toxic"]) for r in rows])


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, spans (offending words, in code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[bytes, float] = {}

        def group(texts: list[bytes], tokens: list[list[bytes]]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
            if len(known) > MOST_WORDS:
                known.clear()
            flat = [t for own in tokens for t in own]
            for t in set(flat).difference(known):
                known[t] = m.token(t)
            lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
            e = np.fromiter(map(known.__getitem__, flat), np.float64, len(flat))
            first = np.zeros(len(flat), bool)
            starts = np.cumsum(lengths) - lengths
            first[starts[lengths > 0]] = True
            p = chain.marginals(_psi(e), first, m.a, m.begin)[0] if len(flat) else e
            total, most = by_text(p, lengths)
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            for i in np.flatnonzero(most >= SPAN_LEVEL):
                hot = set(np.flatnonzero(p[starts[i] : starts[i] + lengths[i]] >= SPAN_LEVEL).tolist())
                at = before = 0
                for k, t in enumerate(_TOKEN.finditer(texts[i])):
                    if k in hot:
                        at += len(texts[i][before : t.start()].decode())
                        spans[i].append((at, at + len(t.group().decode())))
                        before = t.start()
            return m.score(total, most), spans

        for batch in batches:
            scores, spans, texts, tokens, n = [], [], [], [], 0
            for x in batch.column(1):
                t = (x.as_py() or "").encode()
                texts.append(t)
                tokens.append(t.split())
                n += len(tokens[-1])
                if n >= 200_000:
                    s, o = group(texts, tokens)
                    scores.append(s)
                    spans += o
                    texts, tokens, n = [], [], 0
            s, o = group(texts, tokens)
            spans = [[{"start": a, "end": b} for a, b in own] for own in spans + o]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*scores, s])), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=SCHEMA.names)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, learn(docs, labels))
    return out.select("doc_id", (common.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= LEVEL).cast("int").alias("predicted"), "spans")
