"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans, which stay. In the gaps between them, other runs that look like numbers or addresses are
candidates. Base spans and candidates of a document, in order, are the nodes of a field: neighbours form a chain, and nodes of one
normal form (the last digits of a number, the local part of an address) are joined by skip links, each to the next of its form, so
links grow as nodes. Base nodes hold their kind; loopy sum-product message passing carries it to the candidates, and a candidate
whose probability of one kind reaches LEVEL becomes a span of that kind. The field runs in every document that has a candidate.

Learning reads a bounded sample of documents, MOST_TRAIN at most by a hash of the id, of texts up to MOST_CHARS long and MOST_TOTAL in all. Weights of
shapes, of the chain and of the skip links are fitted together in numpy by pseudo-likelihood. Examples of a kind are the base spans
and copies of them whose mark is hidden, as the patterns would miss them (an address with its at sign spelt out, a phone number
without its country code, a card in dotted groups), once beside their original and once alone, and beside it also their digits in
any groups. Examples of no entity are the
candidates of the sample and drawn runs of digits; a candidate that shares the form of a base span is no example of either. Only
the small model is broadcast; nothing is shuffled.

Defined cases: null and empty texts have no spans; repeated rows and ids are scored one by one; without base spans in the sample
no span is added; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm import common

KINDS = ("email", "ip", "card", "phone")
MOST_TRAIN, MOST_CHARS = 2000, 100_000
#: Characters that all learnt texts hold together.
MOST_TOTAL = 8_000_000
#: Probability from which a candidate becomes a span, and rounds of messages.
LEVEL, ROUNDS = 0.5, 12
#: Drawn runs of digits for each base span, steps of the fit, and the weight of its penalty.
DRAWN, STEPS, PENALTY = 2, 600, 1e-3

# Leftmost starts only: a run that fails from its first character fails from each later one, so nothing is tried twice.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: What may be an entity without matching a pattern: number-like runs, and words around an at sign or its spelt-out forms.
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}")
_AT = re.compile(r"(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)(?=[A-Za-z0-9])")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
_SIGNS = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    if not _SIGNS.search(text):
        return []
    out = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs in the gaps between base spans, in order; where an address and a number overlap, the address."""
    out, low = [], 0
    for start, end in [*sorted((s, e) for _, s, e in base), (len(text), len(text))]:
        if start > low:
            out += _in_gap(text, low, start)
        low = max(low, end)
    return out


def _in_gap(text: str, low: int, high: int) -> list[tuple[int, int]]:
    out, done = [], low
    for at in _AT.finditer(text, low, high):
        start = at.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at.start() and (host := _HOST.match(text, at.end(), high)):
            out.append((start, host.end()))
            done = host.end()
    edges = [low, *[x for pair in out for x in pair], high]
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out += [m.span() for m in _NUMBER.finditer(text, a, b)]
    return sorted(out)


def form(text: str) -> str:
    """The normal form that repeated or similar nodes share."""
    local = re.split(r"@|[\[(](?:at|AT)[\])]", text, maxsplit=1)
    if len(local) > 1:
        return "a" + re.sub(r"[^a-z0-9]", "", local[0].lower())
    return "n" + _NOT_DIGIT.sub("", text)[-7:]


def shape(text: str, glued: bool = False) -> np.ndarray:
    """Features of a node's text; glued: a letter or digit touches it."""
    digits = _NOT_DIGIT.sub("", text)
    n, at = len(digits), re.search(r"@|[\[(](?:at|AT)[\])]", text) is not None
    dots, long = text.count("."), 13 <= len(digits) <= 19
    marks = [1, at, text.startswith("+"), "(" in text, dots == 3, dots > 0, " " in text, "-" in text, "/" in text, glued]
    return np.array([*marks, n < 9, 9 <= n <= 12, long, n > 19, long and luhn(digits)], dtype=float)


WIDTH = len(shape("0"))


def hidden(kind: int, text: str) -> str | None:
    """A span of a kind as the patterns would miss it; None where there is no such form."""
    if kind == 0:
        return text.replace("@", " [at] ")
    if kind == 2:
        digits = _NOT_DIGIT.sub("", text)
        return ".".join(digits[k : k + 4] for k in range(0, len(digits), 4))
    if kind == 3:
        return re.sub(r"^\+[0-9]{1,3}(?:[\x20.-]|(?=\())", "", text).lstrip("+")
    return None


def grouped(digits: str, r: random.Random) -> str:
    """The digits in one piece or in groups of any size, with one sign between."""
    sign, out = r.choice(["", "", " ", "-", ".", "/"]), []
    while digits:
        k = r.randint(1, 5) if sign else len(digits)
        out.append(digits[:k])
        digits = digits[k:]
    return sign.join(out)


def drawn(r: random.Random) -> str:
    """A run of digits that stands for nothing."""
    return grouped("".join(r.choice("0123456789") for _ in range(r.randint(7, 20))), r)


def _glued(text: str, start: int, end: int) -> bool:
    return (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())


def _links(forms: list[str]) -> np.ndarray:
    """Skip links: each node with the next one of its form, neighbours aside."""
    last: dict[str, int] = {}
    out = []
    for i, f in enumerate(forms):
        if f in last:
            out.append((last[f], i))
        last[f] = i
    return np.array(out, np.int64).reshape(-1, 2)


class Model:
    """Weights of shapes by label (0: no entity, then the kinds), of the chain by left and right label, and of skip links."""

    def __init__(self) -> None:
        self.w, self.chain, self.skip = np.zeros((5, WIDTH)), np.zeros((5, 5)), np.zeros((5, 5))
        self.learnt = False

    def beliefs(self, unary: np.ndarray, forms: list[str], rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product: log messages over both directions of every link, damped by half."""
        n = len(unary)
        near = np.stack([np.arange(n - 1), np.arange(1, n)], axis=1)
        skip = _links(forms)
        edges = np.concatenate([near, skip])
        kind = np.repeat([0, 1], [len(near), len(skip)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.stack([self.chain, self.skip])
        potential = np.concatenate([table[kind], table[kind].transpose(0, 2, 1)])
        m, back = np.zeros((len(source), 5)), np.roll(np.arange(len(source)), len(edges))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, target, m)
            into = total[source] - m[back]
            x = into[:, :, None] + potential
            top = x.max(axis=1, keepdims=True)
            new = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            m = 0.5 * m + 0.5 * new
        total = unary.copy()
        np.add.at(total, target, m)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans."""
        base = base_spans(text)
        if not self.learnt or not (more := candidates(text, base)):
            return base, base
        nodes = sorted([(s, e, k + 1) for k, s, e in base] + [(s, e, 0) for s, e in more])
        said = [text[s:e] for s, e, _ in nodes]
        unary = np.stack([shape(text[s:e], _glued(text, s, e)) for s, e, _ in nodes]) @ self.w.T
        for i, (_, _, k) in enumerate(nodes):
            if k:
                unary[i] = -50.0
                unary[i, k] = 0.0
        p = self.beliefs(unary, [form(t) for t in said])
        added = [(int(q.argmax()) - 1, s, e) for (s, e, k), q in zip(nodes, p, strict=True) if not k and q.argmax() and q.max() >= LEVEL]
        return base, sorted([*base, *added])


def _examples(text: str, r: random.Random) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(label, shape, labels to the left, to the right, over skip links) of each example of a text."""
    base = base_spans(text)
    nodes = sorted([(s, e, k + 1) for k, s, e in base] + [(s, e, 0) for s, e in candidates(text, base)])
    said, known = [text[s:e] for s, e, _ in nodes], {form(text[s:e]) for _, s, e in base}
    forms = [form(t) for t in said]
    label = [k if k or f not in known else None for (_, _, k), f in zip(nodes, forms, strict=True)]
    one, none = np.eye(5), np.zeros(5)
    mark = [none if k is None else one[k] for k in label]
    over = [none.copy() for _ in nodes]
    for i, j in _links(forms):
        over[i] += mark[j]
        over[j] += mark[i]
    left, right = [none, *mark[:-1]], [*mark[1:], none]
    for i, (s, e, _) in enumerate(nodes):
        if label[i] is not None:
            yield label[i], shape(said[i], _glued(text, s, e)), left[i], right[i], over[i]
    for i, k in enumerate(label):
        if k and (copy := hidden(k - 1, said[i])):
            yield k, shape(copy), mark[i], right[i], mark[i]
            yield k, shape(copy), none, none, none
        if k and k > 1:  # digits of a span, written in any way: the link alone tells
            yield k, shape(grouped(_NOT_DIGIT.sub("", said[i]), r)), mark[i], right[i], mark[i]
    for _ in range(DRAWN * len(base)):
        x, i = shape(drawn(r)), r.randrange(len(nodes))
        yield 0, x, mark[i], right[i], none
        yield 0, x, none, none, one[0]


def fit(texts: list[str]) -> Model:
    """The model by pseudo-likelihood: the label of each example given those of its neighbours, by gradient steps on all weights."""
    model, r = Model(), random.Random(7)
    found = [e for text in texts for e in _examples(text, r)]
    if not any(e[0] for e in found):
        return model
    gold = np.eye(5)[[e[0] for e in found]]
    x, left, right, over = (np.stack([e[k] for e in found]) for k in range(1, 5))
    for _ in range(STEPS):
        z = x @ model.w.T + left @ model.chain + right @ model.chain.T + over @ model.skip
        p = np.exp(z - z.max(axis=1, keepdims=True))
        off = (p / p.sum(axis=1, keepdims=True) - gold) / len(x)
        skip = over.T @ off
        model.w -= off.T @ x + PENALTY * model.w
        model.chain -= left.T @ off + off.T @ right + PENALTY * model.chain
        model.skip -= (skip + skip.T) / 2 + PENALTY * model.skip
    model.learnt = True
    return model


def learn(docs: DataFrame) -> Model:
    told = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= MOST_CHARS))
    rows = common.bounded(common.hash_sample(told, "doc_id", MOST_TRAIN), "doc_id", MOST_TOTAL)
    return fit([r["text"] for r in rows.orderBy("doc_id", "text").collect()])  # bounded by MOST_TOTAL


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType()), T.StructField("n_added", T.LongType())])


def report(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and all spans with their number."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                base, spans = shared.value.spans(x.as_py() or "")
                counts = [0, 0, 0, 0]
                for k, _, _ in base:
                    counts[k] += 1
                out.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans), len(spans), len(spans) - len(base)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=SCHEMA.names)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)
