"""Odd rows and empty tables through every operator."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kerbline.llm import chat_format, decontaminate, line_dedup, lm_score, packing, pii, quality_rules, simhash, token_shards, toxicity
from kerbline.llm.queries import vocabulary


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over a lazy dog near the old river bank while seven"), (2, None), (3, ""), (None, "one two"), (4, "grey")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def per_document(benchmark, labels):
    return {
        "quality": quality_rules.quality_counts,
        "toxicity": lambda d: toxicity.report(d, labels),
        "pii": pii.report,
        "decontaminate": lambda d: decontaminate.report(d, benchmark),
        "lm": lambda d: lm_score.report(d, vocabulary()),
        "lines": line_dedup.report,
        "simhash": simhash.report,
    }


@pytest.mark.parametrize("name", ["quality", "toxicity", "pii", "decontaminate", "lm", "lines", "simhash"])
def test_one_row_per_document(odd_docs, no_docs, benchmark, labels, name):
    operator = per_document(benchmark, labels)[name]
    assert operator(odd_docs).count() == 10
    assert operator(no_docs).count() == 0


def filters(benchmark):
    return {"quality": quality_rules.quality_filter, "lines": line_dedup.cleaned, "simhash": simhash.representatives, "decontaminate": lambda d: decontaminate.clean(d, benchmark)}


@pytest.mark.parametrize("name", ["quality", "lines", "simhash", "decontaminate"])
def test_columns_are_carried(odd_docs, no_docs, benchmark, name):
    operator = filters(benchmark)[name]
    out = operator(odd_docs)
    assert out.dtypes == odd_docs.dtypes
    assert all(r["line"] == "t" for r in out.collect())
    assert operator(no_docs).count() == 0


def test_repeated_ids_leave_one_row(odd_docs):
    kept = [r["doc_id"] for r in simhash.representatives(odd_docs).collect()]
    assert kept.count(1) == 1 and 4 not in kept and 5 not in kept  # 3, 4, 5 have no words: 3 stays for them
    assert 3 in kept


def test_each_component_keeps_one_row(spark):
    x, y, z = ("".join(f"{w}{k} " for k in range(60)) for w in ("ash", "birch", "cedar"))
    rows = [
        # Id 3 stands in the components of x and of y: its row in x is the first there, the one in y gives way to id 1.
        (3, x), (3, y), (1, y), (5, x),
        # Two rows of one id that are not near copies stay both; identical rows leave one.
        (7, z), (7, "one text of its own"), (7, z),
        # Copies without an id leave one row, and none where a copy has an id.
        (None, "nobody owns this text"), (None, "nobody owns this text"), (None, y), (None, "nor this one"),
    ]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.representatives(docs).collect()), key=repr)
    want = [(3, x), (1, y), (7, z), (7, "one text of its own"), (None, "nobody owns this text"), (None, "nor this one")]
    assert got == sorted(want, key=repr)


def test_contaminated(odd_docs, benchmark):
    got = {r["doc_id"]: r for r in decontaminate.report(odd_docs, benchmark).collect()}
    assert got[1]["contaminated"] and got[1]["n_items"] == 2 and not got[6]["contaminated"]
    assert got[7]["n_hit"] == 2 and got[7]["n_items"] == 0


def test_packing(odd_docs, no_docs):
    rows = packing.pack(odd_docs, *vocabulary()).collect()
    assert packing.pack(no_docs, *vocabulary()).count() == 0
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 1
    size = {}
    for r in rows:
        size[r["sequence_id"]] = size.get(r["sequence_id"], 0) + r["length"]
    assert max(size.values()) <= 1024


def test_shards(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_shards, "SPAN", 400)
    plain, length = Tokenizer.from_file(vocabulary()[0]), token_shards.LENGTH
    docs = odd_docs.repartition(3).persist()
    numbered, first = [], 0
    for part in docs.select("doc_id", "text").rdd.glom().collect():
        ids = [(r["doc_id"], k, t) for r in part for k, t in enumerate([*plain.encode(r["text"] or "", add_special_tokens=False).ids, token_shards.END])]
        numbered += [(first + k // length, ids[k : k + length]) for k in range(0, len(ids), length)]
        first += -(-sum(len((r["text"] or "").encode()) + 1 for r in part) // length)
    order = token_shards.permuted(np.arange(first), first)
    want = [s for _, s in sorted(numbered, key=lambda x: order[x[0]])]
    to = f"file://{tmp_path}/shards"
    told = token_shards.materialise(docs, vocabulary(), to)
    assert told["records"] == len(want) and len(told["shards"]) > 2
    rows = {r["slot"]: r for r in token_shards.read(spark, to).collect()}
    assert sorted(rows) == list(range(len(want)))
    for slot, ids in enumerate(want):
        r = rows[slot]
        assert np.frombuffer(r["ids"], "<u2").tolist() == [t for _, _, t in ids]
        assert (r["doc_id"], r["at"], r["n_tokens"]) == (*ids[0][:2], len(ids))
    # A reader goes on from any slot.
    for start, end in [(30, 95), (0, 1), (told["first_slots"][1], told["first_slots"][2]), (5, 5), (len(want) - 1, None), (len(want), None), (0, 10**9)]:
        part = token_shards.read(spark, to, start, end).collect()
        assert sorted(r["slot"] for r in part) == list(range(start, len(want) if end is None else min(end, len(want)))) and all(r == rows[r["slot"]] for r in part)
    assert token_shards.report(no_docs, vocabulary()).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "system", "be <brief> & kind", 1), (1, 1, "user", None, 1), (1, 2, None, "x", 1), (1, 2, None, "x", 1), (1, 3, "assistant", "<|end|> &lt; [INST]", 1), (None, 0, "assistant", "", 1), (2, 0, "assistant", "w " * 9000, 1), (2, 1, "assistant", "tail", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    made = chat_format.windows(df.select("conv_id", "turn", "role", "text", "window"))
    back = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    assert [t["text"] for t in back[1]["turns"]] == ["be <brief> & kind", "", "x", "x", "<|end|> &lt; [INST]"]
    assert back[1]["loss_text"] == "<|end|> &lt; [INST]"
    assert back[2]["loss_text"] == "w " * 9000 + "tail"
    assert made.filter("conv_id = 2").count() == 2
    assert chat_format.conversation_digest(df.filter(F.lit(False))).count() == 0


def test_windows_keep_the_budget(spark):
    """By the operator's own measure of a turn, over conversations with short, long and no system turns."""
    r = random.Random(6)
    rows = []
    for conv in range(120):
        system = r.choice([0, 0, 40, 1200, 3600, 5000])
        if system:
            rows.append((conv, 0, "system", "s" * system))
        rows += [(conv, k, r.choice(["user", "assistant"]), "".join(r.choice("ab&<") for _ in range(r.choice([20, 400, 400, 900])))) for k in range(1, r.randint(2, 60))]
    made = chat_format.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    size = lambda text: -(-len(text.encode()) // chat_format.BYTES_PER_TOKEN) + chat_format.TURN_TOKENS
    filled = []
    for w in made:
        turns = re.findall(r"<\|(turn|seen)\|>([^<]*)<\|text\|>([^<]*)<\|end\|>", w["formatted"])
        total = sum(size(text) for _, _, text in turns)
        own = [size(text) for kind, role, text in turns if kind == "turn"]
        system = sum(size(text) for _, role, text in turns if role == "system")
        left = max(chat_format.BUDGET - system, 0)
        room = left - min(int(chat_format.BUDGET * chat_format.HISTORY_SHARE), left // 4)
        assert total <= chat_format.BUDGET or len(own) == 1 and own[0] > room, (w["conv_id"], w["window"], total)
        filled.append((w["conv_id"], w["window"], total))
    last = {c: w for c, w, _ in sorted(filled)}
    inner = [t for c, w, t in filled if w < last[c]]
    assert sum(inner) / len(inner) > 0.55 * chat_format.BUDGET
