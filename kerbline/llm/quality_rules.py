"""Quality rules with thresholds that adapt to each language and source.

One pass over the texts gives a short row of counts per document. Mergeable KLL sketches of a few ratios are built for
every (language, source), merged upwards per language and over all, and give an upper fence for each ratio; the fences are
joined back to the documents. A small group takes the fences of its language, a small language those of all documents.

Defined cases: a null text has no words and fails; null lang or source form groups of their own; repeated rows and
repeated ids are judged row by row; an empty table gives an empty result; extra columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm import common

#: Items that a sketch level keeps: rank error of about 0.1 per cent, exact for groups up to that many rows.
SKETCH_K = 2048
#: Rows below which a group takes the fences of its parent.
LEAST_GROUP = 100
#: A ratio is rejected above Q3 + FENCE * max(Q3 - Q1, least spread).
FENCE = 3.0
#: Ratio: least spread, in the ratio's own unit.
LEAST_SPREAD = {"symbol_share": 0.01, "capital_share": 0.05, "shout_share": 0.02, "word_length": 0.75, "duplicate_line_share": 0.15, "repeat_share": 0.1}
BASE_LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_P = "__qr_"


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")).cast("long")


def _same_window(x: Column, y: Column, bits: Column, words: Column) -> Column:
    """Whether two packed windows have one hash and the same three words."""
    p, q = x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int"), y.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
    same = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
    for k in range(3):
        same = same & (F.get(words, p + k) == F.get(words, q + k))
    return same


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the five counts, and the capitals and exclamation marks, as long columns, each with the prefix."""
    whole = F.coalesce(docs[text], F.lit(""))
    d = docs.select("*", whole.alias(f"{_P}text"), common.words(whole).alias(f"{_P}words"))
    w, t = F.col(f"{_P}words"), F.col(f"{_P}text")
    n = F.size(w)
    # A window of three words is packed as its hash above its position; sorting the packed numbers brings equal windows together.
    d = d.withColumn(f"{_P}bits", F.when(n < 1 << 20, F.lit(20)).otherwise(F.lit(28)))
    bits = F.col(f"{_P}bits")
    packed = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")))
    d = d.withColumn(f"{_P}sorted", F.sort_array(packed))
    s = F.col(f"{_P}sorted")
    hits = F.filter(s, lambda x, i: F.coalesce(_same_window(x, F.get(s, i + 1), bits, w), F.lit(False)) | F.coalesce(_same_window(x, F.get(s, i - 1), bits, w), F.lit(False)))
    at = F.sort_array(F.transform(hits, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    covered = F.aggregate(at, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    d = d.withColumn(f"{_P}lines", lines)
    chars = F.length(t).cast("long")
    made = {
        "n_words": n.cast("long"),
        "word_chars": _without(t, " \t\n\x0b\f\r"),
        "n_symbols": chars - _without(t, SYMBOLS),
        "n_dup_lines": (F.size(f"{_P}lines") - F.size(F.array_distinct(f"{_P}lines"))).cast("long"),
        "n_repeat_words": covered,
        "n_capitals": chars - _without(t, CAPITALS),
        "n_shouts": chars - _without(t, "!"),
        "n_lines": F.size(f"{_P}lines").cast("long"),
    }
    # inline() gives the counts a row of their own: a filter on one of them does not bring back, and repeat, what made it.
    return d.select(*docs.columns, F.inline(F.array(F.struct(*[c.alias(f"{prefix}{name}") for name, c in made.items()]))))


def _ratios(prefix: str) -> dict[str, Column]:
    """Null where there is no word, so that such rows stay out of the sketches."""
    c = lambda name: F.col(f"{prefix}{name}").cast("double")
    words, chars, lines = (F.when(c(x) > 0, c(x)) for x in ("n_words", "word_chars", "n_lines"))
    return {
        "symbol_share": c("n_symbols") / chars,
        "capital_share": c("n_capitals") / chars,
        "shout_share": c("n_shouts") / chars,
        "word_length": chars / words,
        "duplicate_line_share": c("n_dup_lines") / lines,
        "repeat_share": c("n_repeat_words") / words,
    }


def thresholds(counted: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """One row per (lang, source): an upper fence for each ratio, from the narrowest level with LEAST_GROUP rows."""
    k, names = F.lit(SKETCH_K), list(LEAST_SPREAD)
    sketch = counted.select(F.col(lang).alias(f"{_P}lang"), F.col(source).alias(f"{_P}source"), *[c.alias(x) for x, c in _ratios(prefix).items()])
    group = common.stored(sketch.groupBy(f"{_P}lang", f"{_P}source").agg(F.count(names[0]).alias("n"), *[F.kll_sketch_agg_double(x, k).alias(x) for x in names]))

    def merged(of: DataFrame, *by: str) -> DataFrame:
        return of.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(x, k).alias(x) for x in names])

    def fences(of: DataFrame, level: str, *by: str) -> DataFrame:
        out = []
        for x in names:
            low, high = (F.kll_sketch_get_quantile_double(x, F.lit(q)) for q in (0.25, 0.75))
            out.append(F.when(F.col("n") > 0, high + FENCE * F.greatest(high - low, F.lit(LEAST_SPREAD[x]))).alias(x))
        return of.select(*by, F.struct(F.col("n"), *out).alias(level))

    by_lang = merged(group, f"{_P}lang")
    own, parent, root = fences(group, "own", f"{_P}lang", f"{_P}source"), fences(by_lang, "parent", F.col(f"{_P}lang").alias(f"{_P}parent_lang")), fences(merged(group), "root")
    levels = own.join(parent, F.col(f"{_P}lang").eqNullSafe(F.col(f"{_P}parent_lang"))).join(root, F.lit(True), "left")  # root is one row
    return levels.select(f"{_P}lang", f"{_P}source", *[F.when(F.col("own.n") >= LEAST_GROUP, F.col(f"own.{x}")).when(F.col("parent.n") >= LEAST_GROUP, F.col(f"parent.{x}")).otherwise(F.col(f"root.{x}")).alias(f"{_P}fence_{x}") for x in names])


def judged(counted: DataFrame, fences: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """Adds base_failed and kept. The fences are one short row per group; Spark broadcasts them if their size allows, else it splits hot groups."""
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    failed = (n < BASE_LEAST_WORDS) | (100 * repeat > 50 * n)
    within = F.lit(True)
    for x, ratio in _ratios(prefix).items():
        within = within & F.coalesce(ratio <= F.col(f"{_P}fence_{x}"), F.lit(True))
    joined = counted.join(fences, counted[lang].eqNullSafe(F.col(f"{_P}lang")) & counted[source].eqNullSafe(F.col(f"{_P}source")), "left")
    return joined.select(*counted.columns, failed.alias(f"{prefix}base_failed"), (~failed & within).alias(f"{prefix}kept"))


def quality_counts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: its counts and verdict. The counts are stored once; texts are read once."""
    counted = common.stored(with_counts(docs.select(id_col, "text", "lang", "source")).drop("text"))
    verdict = judged(counted, thresholds(counted))
    return verdict.select(id_col, *_COUNTS, "base_failed", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns. Texts are counted once: they are stored with their counts, of which the fences
    need the counts alone."""
    counted = common.stored(with_counts(docs, prefix=_P))
    fences = common.stored(thresholds(counted, prefix=_P))
    return judged(counted, fences, prefix=_P).filter(f"{_P}kept").select(*docs.columns)
