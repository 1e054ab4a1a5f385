"""Kernels and models against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import attention, chain, line_dedup, lm_score, packing, pii, simhash, token_shards, tokens, toxicity, wu_manber
from kerbline.llm.queries import vocabulary


def test_chain_marginals():
    r = np.random.default_rng(1)
    n, a, b = 700, np.exp(r.normal(size=(2, 2))), np.exp(r.normal(size=2))
    psi, first = np.exp(r.normal(size=n)), r.random(n) < 0.02
    first[0] = True
    p, _, _ = chain.marginals(psi, first, a, b)
    starts = [*np.flatnonzero(first).tolist(), n]
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        alpha = [b * [1, psi[s]]]
        for t in range(s + 1, e):
            alpha.append((alpha[-1] / alpha[-1].sum()) @ a * [1, psi[t]])
        beta = np.ones(2)
        for t in range(e - 1, s - 1, -1):
            m = alpha[t - s] * beta
            assert p[t] == pytest.approx(m[1] / m.sum(), abs=1e-9)
            beta = a @ (beta * [1, psi[t]])
            beta /= beta.sum()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.report(docs, labels).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").toPandas()
    caught = got[got.toxic == 1].predicted.mean()
    false = got[got.toxic == 0].predicted.mean()
    assert caught > 0.85 and false < 0.01


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


def test_base_spans():
    r = random.Random(0)
    for _ in range(20_000):
        t = "".join(r.choice("ab1234567890.@+-% ()é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == spans(t)


def personal_texts(n):
    """Texts that each say one or two personal data, plain numbers between."""
    r = random.Random(5)
    out = []
    for _ in range(n):
        said = [f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", f"w{r.randint(1, 99)}.x@mail{r.randint(1, 9)}.example.com", "4425679706863800", ".".join(str(r.randint(1, 255)) for _ in range(4))]
        out.append(f"word {r.choice(said)} and {r.randint(10**15, 10**16)} then, {r.choice(said)} end")
    return out


def test_skip_links_carry_labels():
    model = pii.fit(personal_texts(300))
    text = "call +1 (988) 555-0546 now. or 988 555 0546, card 4425679706863800 and 4425.6797.0686.3800; x.34@mail7.example.com then x.34 [at] mail7.example.com; 2020-01-01 12000"
    base, every = model.spans(text)
    added = {text[s:e] for _, s, e in set(every) - set(base)}
    assert added == {"988 555 0546", "4425.6797.0686.3800", "x.34 [at] mail7.example.com"}


def test_the_field_finds_data_without_a_base_span():
    model = pii.fit(personal_texts(300))
    text = "john.2 [at] mail3.example.com or (988) 555-0546; 1234567890123456 and 2020-01-01 stay, 1234567890123456 twice"
    base, every = model.spans(text)
    assert not base
    assert [(k, text[s:e]) for k, s, e in every] == [(0, "john.2 [at] mail3.example.com"), (3, "(988) 555-0546")]


def test_candidates_lie_between_base_spans():
    text = "988 555 0546 4425679706863800 988 555 0547"
    base = pii.base_spans(text) or [(2, 13, 29)]
    for s, e in pii.candidates(text, [(2, 13, 29)]):
        assert e <= 13 or s >= 29
    assert len(pii.candidates(text, [(2, 13, 29)])) == 2 and base


def test_messages_give_exact_marginals_on_a_tree():
    r = np.random.default_rng(3)
    model = pii.Model()
    model.chain = r.normal(size=(5, 5))
    unary = r.normal(size=(4, 5))
    exact = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        weight = np.exp(sum(unary[i, k] for i, k in enumerate(y)) + sum(model.chain[a, b] for a, b in zip(y[:-1], y[1:], strict=True)))
        for i, k in enumerate(y):
            exact[i, k] += weight
    exact /= exact.sum(axis=1, keepdims=True)
    assert np.allclose(model.beliefs(unary, ["a", "b", "c", "d"], rounds=60), exact, atol=1e-6)


def test_wu_manber_finds_what_a_scan_finds():
    r = random.Random(2)
    word = lambda: r.choice(["a", "Bb", "ccc", "é", "d4"])
    items = [(k, " ".join(word() for _ in range(r.choice([1, 2, 5, 13, 14, 20])))) for k in range(12)]
    sets = wu_manber.build(items)
    texts = [", ".join(word() for _ in range(r.randint(0, 60))) + " " + r.choice(items)[1] for _ in range(60)] + ["", "!!"]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    n, hits, found = wu_manber.search(np.frombuffer(b"".join(data), np.uint8), offsets, sets)
    for k, t in enumerate(texts):
        w = pattern.findall(t.translate(low))
        want, ids = set(), set()
        for i, s in items:
            own = pattern.findall(s.translate(low))
            m = min(13, len(own))
            for p in (own[j : j + m] for j in range(len(own) - m + 1)):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == p:
                        want |= set(range(j, j + m))
                        ids.add(i)
        assert (n[k], set(hits[k].tolist()), found[k]) == (len(w), want, ids)


def bigrams(texts, n):
    """Statistics of texts over the symbols below n, of which the last is the end."""
    pairs = Counter((a, x) for s in texts for a, x in zip([n - 1, *s], [*s, n - 1]))
    counts, company = np.zeros(n), np.zeros(n)
    for (_, x), c in pairs.items():
        counts[x] += c
        company[x] += 1
    keys = sorted(pairs)
    return attention.Statistics(counts, company, np.array([a << 16 | x for a, x in keys], np.uint32), np.array([pairs[k] for k in keys], float)), pairs


@pytest.mark.parametrize("at_once", [4, 1])
def test_several_blocks_of_the_benchmark(spark, monkeypatch, at_once):
    r = random.Random(4)
    words = lambda n: " ".join(r.choice(["ash", "Birch", "cedar", "é1"]) for _ in range(n))
    items = [(k, words(r.choice([1, 3, 13, 15]))) for k in range(30)]
    docs = spark.createDataFrame([(k, words(40) + " " + items[k % 30][1]) for k in range(60)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, wu_manber.find(docs, bench).select("doc_id", "n_words", "hits", "items").collect()))
    monkeypatch.setattr(wu_manber, "BLOCK_BYTES", 200)
    monkeypatch.setattr(wu_manber, "BLOCKS_AT_ONCE", at_once)
    assert len([*wu_manber._blocks_of(bench)]) > 3
    assert sorted(map(tuple, wu_manber.find(docs, bench).select("doc_id", "n_words", "hits", "items").collect())) == want


def test_index_of_the_benchmark_stays_small():
    r = random.Random(5)
    text = [(k, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200))) for k in range(200)]
    import pickle

    assert len(pickle.dumps(wu_manber.build(text))) < 16 * sum(len(t) for _, t in text)


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append(texts) or toxicity.Model())
    docs = spark.createDataFrame([(2, f"text {k % 3}") for k in range(500)] + [(3, "x" * (toxicity.MOST_CHARS + 1)), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0) for k in (2, 3, 4)], "doc_id long, toxic int")
    toxicity.learn(docs, labels)
    assert len(seen[0]) <= 2


def test_attention_scores_and_gradients():
    r = np.random.default_rng(0)
    n, size, width = 300, attention.BLOCK, attention.WIDTH
    texts = [r.integers(0, n - 1, k).astype(np.int32) for k in (0, 1, size - 1, size, size + 1, 70)]
    by, pairs = bigrams([t.tolist() for t in texts[1:]] * 2, n)
    m = attention.Model(by)
    m.p["w2"] += r.normal(size=m.p["w2"].shape).astype(np.float32) * 0.3
    m.p["r"] += r.normal(size=2 * size).astype(np.float32)
    p = {k: v.astype(float) for k, v in m.p.items()}

    def naive(s, settle=None):
        ins, targets, total, loss = [n - 1, *s], [*s, n - 1], 0.0, 0.0
        x = p["e"][by.row[ins]]
        q, k, v = x @ p["q"] / width**0.5, x @ p["k"], x @ p["v"]
        for t in range(len(ins)):
            lo = max(0, (t // size - 1) * size)
            w = np.exp([q[t] @ k[j] + p["r"][t - j] for j in range(lo, t + 1)])
            h = np.concatenate([x[t], w / w.sum() @ v[lo : t + 1]])
            o = np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"]
            plain = np.exp(by.log_pairs(np.full(n, ins[t]), np.arange(n)).astype(float))
            assert plain.sum() == pytest.approx(1, abs=1e-4)
            full = plain * np.exp(o)[by.head]
            full /= full.sum()
            total += np.log(full[targets[t]])
            loss -= np.log(np.bincount(by.head, weights=full)[by.head[targets[t]]])
        return total, loss

    lengths = np.array([len(t) for t in texts])
    got = m.score(np.concatenate(texts), lengths, n - 1)
    assert got == pytest.approx([naive(t)[0] for t in texts], abs=1e-2)
    layout = attention.Layout(np.concatenate(texts), lengths, n - 1)
    blocks = (layout.inputs, layout.before(), layout.first, layout.targets)
    loss, g = m.gradient(*blocks)
    places = int((lengths + 1).sum())
    sums = m.output_sums(layout)
    m.p = {k: v.astype(float) for k, v in m.p.items()}  # steps small enough to stay clear of the hidden layer's bends
    loss, g = m.gradient(*blocks)
    assert loss == pytest.approx(sum(naive(t)[1] for t in texts) / places, abs=1e-3)
    for name in ("e", "q", "k", "v", "r", "w1", "b1", "w2", "b2"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), m.p[name].shape)
        old = m.p[name][at]
        sides = []
        for d in (1e-5, -1e-5):
            m.p[name][at] = old + d
            sides.append(m.gradient(*blocks)[0])
        m.p[name][at] = old
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(g[name][at], rel=0.01, abs=1e-6), name
    assert sums[:-1, : attention.CLASSES] / places == pytest.approx(g["w2"], abs=1e-5)
    m.settle(sums)
    assert m.gradient(*blocks)[0] < loss
    assert len(pairs)


def test_gradient_of_consecutive_blocks():
    r = np.random.default_rng(6)
    texts = [r.integers(0, 299, k).astype(np.int32) for k in (0, 1, 7, 8, 9, 70, 33)]
    by, _ = bigrams([t.tolist() for t in texts], 300)
    m = attention.Model(by)
    m.p = {k: v.astype(float) + r.normal(size=v.shape) * 0.1 for k, v in m.p.items()}
    layout = attention.Layout(np.concatenate(texts), np.array([len(t) for t in texts]), 299)
    for a, b in ((0, len(layout.inputs)), (0, 1), (3, 9), (7, 16)):
        want, by_name = m.gradient(layout.inputs[a:b], layout.before()[a:b], layout.first[a:b], layout.targets[a:b])
        loss, n, got = m.gradient_sums(layout, a, b)
        assert loss / n == pytest.approx(want) and n == (layout.targets[a:b] >= 0).sum()
        assert got.keys() == by_name.keys()
        for name in got:
            assert got[name] == pytest.approx(by_name[name], abs=1e-9), name


def test_every_block_trains_all_weights(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "MOST_BLOCKS", 0)  # none to start with
    r = random.Random(8)
    texts = [" ".join(r.choice(["ash", "birch", "cedar", "elm", f"w{k}"]) for _ in range(60)) for k in range(40)] + ["zebra quartz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ready = lm_score.prepared(docs, vocabulary(), {})
    symbols = np.zeros(lm_score.END + 1)
    for row in ready.collect():
        np.add.at(symbols, [*np.frombuffer(row["symbols"], "<u2"), lm_score.END], 1)
    models = [lm_score.trained(ready.repartition(k), symbols) for k in (1, 5)]
    new = attention.Model(models[0].by)
    seen = np.unique(new.by.row[np.flatnonzero(symbols)])
    assert (models[0].p["e"] != new.p["e"]).all(axis=1)[seen].all()
    assert all((models[0].p[k] != new.p[k]).mean() > 0.9 for k in ("q", "k", "v", "r", "w1", "w2", "b2"))
    assert all(models[0].p[k] == pytest.approx(models[1].p[k], abs=1e-5) for k in new.p)


def test_lookup_finds_every_key():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32))
    table = attention.Lookup(keys[::2], np.arange(len(keys[::2])))
    out = np.full(len(keys), -1, np.float32)
    table.get(keys, out)
    assert out[::2].tolist() == list(range(len(keys[::2]))) and (out[1::2] == -1).all()


def test_pair_counts_cover_every_position(spark):
    texts = ["grey geese fly", "the old river bank " * 400, "a quick brown fox", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = tokens.ids(*vocabulary())
    ids = [[x for w in (t or "").split() for x in enc.piece(" " + w)] for t in texts]
    ready = lm_score.prepared(docs, vocabulary(), {b"geese": -2.0, b"river": -1.5})
    got = {r["doc_id"]: r for r in ready.collect()}
    assert [np.frombuffer(got[k]["symbols"], "<u2").tolist() for k in range(4)] == ids
    assert [(got[k]["n_words"], got[k]["known"], got[k]["base"]) for k in range(4)] == [(3, 1, -2.0), (1600, 400, -600.0), (4, 0, 0.0), (0, 0, 0.0)]
    assert {bytes(r["word"]): r["n"] for r in got[1]["rare"]} == {b"the": 400, b"old": 400, b"bank": 400}
    want = Counter((a << 16 | x) for s in ids for a, x in zip([lm_score.END, *s], [*s, lm_score.END]))
    counts, sample = lm_score.pair_counts(ready, 1.0)
    assert {r["pair"]: r["n"] for r in counts.collect()} == want
    assert len(sample) == sum(-(-(len(s) + 1) // attention.BLOCK) for s in ids)  # the level takes all of so few


def test_model_scores_held_out_text_above_word_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sums = []
    for parts in (4, 40):
        out = lm_score.report(docs.repartition(parts), vocabulary()).filter("held_out")
        sums.append(out.agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first())
    (score, base, n), (again, _, _) = sums
    assert score / n > base / n + 0.1
    assert score == pytest.approx(again, rel=1e-4)


def test_base_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in lm_score.report(docs, vocabulary()).collect()}
    rows = [(r["doc_id"], [*r["text"].encode().lower().split(), None]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, own in rows if not held(i) for w in own)
    n, v = sum(c.values()), len(c)
    for i, own in rows:
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(own), sum(c[w] > 0 for w in own), n, held(i))


def test_karmarkar_karp_balances():
    r = random.Random(1)
    sizes = [r.randint(1, 1000) for _ in range(150)]
    parts = packing.karmarkar_karp(sizes, 40)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(150)) and max(sums) - min(sums) < 300
    assert all(sum(sizes[i] for i in w) <= 1024 for w in packing.windows(sizes))


def fresh_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary()[0])


def test_packing_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    enc = fresh_tokenizer()
    special = spark.createDataFrame([(-1, "a <|endoftext|> b", None, None, None), (-2, "<|endoftext|>", None, None, None)], docs.schema)
    docs = docs.unionByName(special)
    pieces = {}
    used = {}
    for r in packing.pack(docs, *vocabulary(), with_ids=True).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"], r["ids_crc32"]))
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for r in docs.collect():
        own = sorted(pieces[r["doc_id"]])
        ids = [x for _, p, _ in own for x in p]
        assert ids == [*enc.encode(r["text"], add_special_tokens=False).ids, 0]
        assert all(zlib.crc32(np.array(p, "<u4").tobytes()) == c for _, p, c in own)
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0


def test_pieces_and_whole_texts_have_the_same_ids(spark):
    enc = tokens.Ids(*vocabulary())
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["a  b\n\n c \n d", "a\n b", "it's  don't ' s", "  lead", "trail  ", "a \n", " ", "\n", "", "²½ x１２ ٣٤", "tab\tx y", "a\n \nb", "<|endoftext|> hi", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext"]
    plain = fresh_tokenizer()
    for t in texts:
        assert np.frombuffer(enc.of(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_permutation_is_one():
    for n in (1, 2, 3, 5, 100, 4097):
        assert sorted(token_shards.permuted(np.arange(n), n)) == list(range(n))


def near_variants(r, n):
    """Variants of few lines, within and beyond the edits, and a large group that differs from one line by an inserted word each."""
    base = ["".join(r.choice("abcd ") for _ in range(40)) for _ in range(10)]
    lines = set(base)
    for _ in range(n):
        b = list(r.choice(base))
        for _ in range(r.randint(1, 3)):
            i = r.randint(0, len(b))
            b[i : i + r.randint(0, 1)] = r.choice(["", "x", "é"])
        lines.add("".join(b))
    one = base[0] + " the same end of every line of this group"
    for _ in range(n):
        i = r.randint(0, len(one))
        lines.add(one[:i] + "".join(r.choice("pqrs") for _ in range(4)) + one[i:])
    return sorted(lines)


@pytest.mark.parametrize(("bucket", "group"), [(16, 512), (1, 7), (10_000, 1)])
def test_near_lines(spark, monkeypatch, bucket, group):
    monkeypatch.setattr(line_dedup, "HOT_BUCKET", bucket)
    monkeypatch.setattr(line_dedup, "HOT_GROUP", group)
    lines = near_variants(random.Random(3), 150)
    d = spark.createDataFrame(list(enumerate(lines)), "h long, line string").withColumns({"len": F.length("line"), "g": F.lit(0), "first": F.col("h")})
    pairs = line_dedup.candidates(d)
    got = {tuple(sorted(x)) for x in line_dedup.verified(pairs, d).select("a.h", "b.h").collect()}
    want = d.alias("x").join(d.alias("y"), F.col("x.h") < F.col("y.h"))
    want = want.filter(F.levenshtein("x.line", "y.line") <= line_dedup.EDITS).select("x.h", "y.h").collect()
    assert got == {tuple(x) for x in want}
    assert pairs.groupBy("a", "b").count().filter("count > 1").count() == 0


def test_automaton(spark):
    """Against the plain distance, also where nothing or all is left between the common ends."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(0, 7)))
    d = spark.createDataFrame([(word(), word()) for _ in range(3000)], "a string, b string")
    ends = d.select("a", "b", line_dedup._common_length(F.col("a"), F.col("b"), F.least(F.length("a"), F.length("b"))).alias("n"))
    for x in ends.collect():
        assert x["n"] == next((k for k, (y, z) in enumerate(zip(x["a"], x["b"])) if y != z), min(len(x["a"]), len(x["b"])))
    near = d.select("a", "b", line_dedup.within(line_dedup._letters(F.col("a")), line_dedup._letters(F.col("b"))).alias("near"), (F.levenshtein("a", "b") <= 2).alias("want"))
    assert near.filter("near <> want").count() == 0


def test_short_lines_go_as_exact_copies(spark):
    texts = ["Read more\n\nown first line", "Read more\n \nRead mor", "a\n\n\nRead more", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(docs).collect()}
    assert got == {0: texts[0], 1: " \nRead mor", 2: "a\n\n", 3: None, 4: ""}


def test_gray_index_finds_every_pair():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 20, dtype=np.uint64)
    x = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 64, 20).astype(np.uint64)) for _ in range(40)]))
    rank = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    x = x[np.argsort(rank)]
    a, b = simhash.near(x)
    want = {(i, int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2) + i + 1}
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == want


@pytest.mark.parametrize("hot", [4096, 2])
def test_components_of_fingerprints(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in docs.collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, f) in enumerate(rows):
        for j, g in rows[:k]:
            if (f ^ g).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.report(docs).collect()}
    assert got == {i: (format(f, "016x"), find(i)) for i, f in rows}


def test_bounded_samples(spark):
    """Samples depend on rows only, not on how they lie, and their texts keep to the bound."""
    from kerbline.llm import common

    rows = [(k % 70, "x" * (k * 37 % 400)) for k in range(300)] + [(500, None), (500, "y" * 50), (500, "y" * 50), (None, "z")]
    taken = []
    for parts in (1, 9):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        some = common.bounded(df, "doc_id", 9_000).collect()
        assert len({(r["doc_id"], r["text"]) for r in some}) == len(some)
        assert 8_600 <= sum(len(r["text"] or "") for r in some) <= 9_000
        drawn = common.hash_sample(df, "doc_id", 40).collect()
        assert len(drawn) <= 40
        taken.append((sorted(map(repr, some)), sorted(map(repr, drawn))))
        assert {tuple(r) for r in common.bounded(df, "doc_id", 1_000_000).collect()} == set(rows)
        assert common.bounded(df.filter("doc_id = 500 AND text IS NOT NULL"), "doc_id", 49).count() == 0
    assert taken[0] == taken[1]
