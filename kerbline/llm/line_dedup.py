"""Line dedup across documents by a segment-partition edit join, with DataFrame functions only.

A line with a character that is not white space is removed where the same line stands earlier, in the order of (doc_id, text hash,
position). A line of LEAST_CHARS characters or more is also removed where a line within EDITS edits has its first place earlier.
Blank lines stay.

All copies of a line are one row before the join. Lines are cut into EDITS + 1 segments: two lines within EDITS edits share one
segment at nearly the same place. A line's segments, keyed by length, number and hash, are the index; its substrings, at the few
starts that the difference in length allows, probe it. A bucket of more than HOT_BUCKET index entries yields no pairs there: its
lines are split into groups of that size, every group meets every line that probes the bucket in a task of its own, and only pairs
whose two-letter parities agree within what EDITS edits can change are made. Candidate pairs are verified, between the longest
common beginning and end, by an edit automaton whose states are the bits of one band of 2 * EDITS + 1 diagonals, for each number
of errors.

Defined cases: a null text has no lines and stays null; a text of which every line goes is empty; identical rows (id and text)
count as one and keep what one of them keeps; rows without an id come first; an empty table gives an empty result; extra columns
are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm import common

EDITS = 2
#: Characters from which a line may be a near copy of another; shorter lines go as exact copies only.
LEAST_CHARS = 30
#: Index entries of a bucket that become pairs in the first join, and those of one group of a larger bucket.
HOT_BUCKET = 16
HOT_GROUP = 512
#: Hashes of lines that are broadcast, eight bytes each; beyond that number the same joins shuffle.
MOST_BROADCAST = 1_000_000
#: Pieces of the test before verification.
PIECES = 10
#: Bits of each of the two words of a parity.
PARITY_BITS = 62
_P = "__ld_"


def places(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: place (doc_id, text hash, position), line and its two hashes."""
    lines = docs.filter(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    place = F.struct("doc_id", "th", "pos").alias("place")
    return lines.filter(F.rlike("line", F.lit(r"[^\x20\x09-\x0D]"))).select(
        place, "line", F.xxhash64("line").alias("h"), F.hash("line").alias("g")
    )


def distinct_lines(docs: DataFrame) -> DataFrame:
    """h, g, line, len, its first place and the number of its places: one row for all copies of a line."""
    by_line = places(docs).groupBy("h", "g", "line").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return by_line.withColumn("len", F.length("line"))


def _key(line: Column, length: Column, segment: Column, shift: Column, edits: int) -> Column:
    """Hash of length, segment number and what stands, shifted, where a line of that length has the segment. Of its edits + 1
    segments the later ones are longer by one where the length doesn't divide."""
    k = edits + 1
    longer = length % k
    size = ((length - longer) / k).cast("int")
    plain = F.lit(k) - longer
    start = segment * size + F.greatest(segment - plain, F.lit(0)) + 1
    return F.xxhash64(length, segment, F.substring(line, start + shift, size + F.when(segment >= plain, 1).otherwise(0)))


def _keyed(lines: DataFrame, spots: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """key, h, len: one row per line and spot: the shorter line's deficit in length, the segment, its shift."""
    names = ("less", "segment", "shift")
    rows = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(spot, names, strict=True)]) for spot in spots])
    spread = lines.select("h", "line", "len", F.inline(rows))
    return spread.select(_key(F.col("line"), F.col("len") - F.col("less"), F.col("segment"), F.col("shift"), edits).alias("key"), "h", "len")


def _index_spots(edits: int) -> list[tuple[int, int, int]]:
    return [(0, i, 0) for i in range(edits + 1)]


def _probe_spots(edits: int) -> list[tuple[int, int, int]]:
    """Where a line may hold a segment of a line shorter by d: shifted by what the edits left of it and right of it allow. The spots
    of a line's own index keys are among them."""
    spots = []
    for d in range(edits + 1):
        for i in range(edits + 1):
            spots += [(d, i, shift) for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]
    return spots


def _ordered(a: Column, b: Column, a_len: Column, b_len: Column) -> Column:
    """Each pair once, the shorter line first."""
    return (a_len < b_len) | ((a_len == b_len) & (a < b))


def _parities(line: Column) -> list[Column]:
    """For each of twice PARITY_BITS classes of two neighbouring characters, whether their number is odd. An edit takes away or adds
    four such neighbours at most, so lines within the edits differ in 4 * edits bits at most."""
    letters = F.split(line, "")
    n = F.size(letters) - 1
    two = F.zip_with(F.slice(letters, 1, n), F.slice(letters, 2, n), lambda x, y: F.pmod(F.xxhash64(x, y), F.lit(2 * PARITY_BITS)).cast("int"))
    one = F.lit(1).cast("long")

    def word(low: int) -> Column:
        inside = lambda k: (k >= low) & (k < low + PARITY_BITS)
        bit = lambda k: F.call_function("shiftleft", one, k - low)
        return F.aggregate(F.filter(two, inside), F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(bit(k)))

    return [word(0), word(PARITY_BITS)]


def _of(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """The lines with one of the hashes."""
    hashes = common.stored(hashes.distinct())
    return lines.join(F.broadcast(hashes) if hashes.count() <= MOST_BROADCAST else hashes, "h", "left_semi")


def _hot_pairs(met: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """Pairs of the large buckets, from the lines (key, b) that probe them."""
    at = met.select("key", F.col("b").alias("h")).distinct().join(_of(lines, met.select(F.col("b").alias("h"))), "h")
    low, high = _parities(F.col("line"))
    own = [_key(F.col("line"), F.col("len"), F.lit(i), F.lit(0), edits) for i in range(edits + 1)]
    member = F.array_contains(F.array(*own), F.col("key"))
    at = common.stored(at.select("key", "h", "len", low.alias("low"), high.alias("high"), member.alias("member")))
    groups = at.filter("member").groupBy("key").agg(F.ceil(F.count("*") / HOT_GROUP).alias("groups"))
    dealt = at.join(groups, "key")
    index = dealt.filter("member").select("key", F.pmod("h", "groups").alias("group"), *[F.col(c).alias(f"a_{c}") for c in ("h", "len", "low", "high")])
    probe = dealt.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"), "h", "len", "low", "high")
    differing = F.bit_count(F.col("low").bitwiseXOR(F.col("a_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("a_high")))
    alike = (differing <= 4 * edits) & _ordered(F.col("a_h"), F.col("h"), F.col("a_len"), F.col("len"))
    both = probe.alias("p").join(index.alias("i"), (F.col("p.key") == F.col("i.key")) & (F.col("p.group") == F.col("i.group")) & alike)
    return both.select(F.col("a_h").alias("a"), F.col("h").alias("b"))


def candidates(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """a, b: hashes of distinct lines (h, line, len) that share a segment, each pair once; the shorter line first."""
    index = _keyed(lines, _index_spots(edits), edits).toDF("a_key", "a", "a_len")
    by_key = Window.partitionBy("a_key")
    index = index.withColumns({"entries": F.count("*").over(by_key), "number": F.row_number().over(by_key.orderBy("a"))})
    # A large bucket has one row here, which tells the lines that probe it from all others.
    hot = F.col("entries") > HOT_BUCKET
    index = index.filter(~hot | (F.col("number") == 1)).select("a_key", F.when(~hot, F.col("a")).alias("a"), "a_len").hint("shuffle_hash")
    probes = _keyed(lines, _probe_spots(edits), edits).toDF("key", "b", "b_len")
    wanted = F.col("a").isNull() | _ordered(F.col("a"), F.col("b"), F.col("a_len"), F.col("b_len"))
    met = common.stored(probes.join(index, (F.col("key") == F.col("a_key")) & wanted).select("key", "a", "b"))
    return met.filter("a IS NOT NULL").select("a", "b").union(_hot_pairs(met.filter("a IS NULL"), lines, edits)).distinct()


def _alike(a: Column, b: Column, a_len: Column, edits: int) -> Column:
    """A short test that every pair within the edits passes: each edit breaks one of PIECES pieces of a at most, and the others stand in b, shifted by the edits at most."""
    size = F.floor(a_len / PIECES).cast("int")
    found = F.lit(0)
    for k in range(PIECES):
        at = size * k + 1
        # A window that would begin before b begins at its first character.
        low = F.greatest(at - edits, F.lit(1))
        found = found + F.contains(F.substring(b, low, at + size + edits - low), F.substring(a, at, size)).cast("int")
    return found >= PIECES - edits


def within(left: Column, right: Column, edits: int = EDITS) -> Column:
    """Whether two lines, given as arrays of their characters, are within the edits: bit d of R[e] says that, after j characters
    of the second, the first j + d - edits characters of the first are matched with e errors at most."""
    width = 2 * edits + 1
    band = (1 << width) - 1
    m, n = F.size(left), F.size(right)

    def inside(d_bits: Column, j: Column) -> Column:
        """Clears the bits of lengths below 0 or above that of a."""
        low = F.greatest(F.lit(edits) - j, F.lit(0))
        high = F.least(m - j + edits, F.lit(width - 1))
        ones = lambda k: F.call_function("shiftleft", F.lit(1), k) - 1
        return d_bits.bitwiseAND(ones(high + 1)).bitwiseAND(F.bitwise_not(ones(low)))

    # Before any character of b: a's first e characters deleted.
    zero = F.struct(F.lit(0).alias("j"), *[F.lit(((1 << (e + 1)) - 1) << edits & band).alias(f"r{e}") for e in range(edits + 1)])

    def step(s: Column, c: Column) -> Column:
        j = s["j"]
        match = F.lit(0)
        for d in range(width):
            match = match.bitwiseOR(F.when(F.get(left, j + (d - edits)) == c, 1 << d).otherwise(0))
        out, above = [], None
        for e in range(edits + 1):
            r = s[f"r{e}"].bitwiseAND(match)
            if e:
                old = s[f"r{e - 1}"]
                r = r.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(above, 1))
            r = inside(r, j + 1)
            above = r
            out.append(r.alias(f"r{e}"))
        # With no bit left nothing can match any more.
        return F.when(s[f"r{edits}"] == 0, s).otherwise(F.struct((j + 1).alias("j"), *out))

    last = F.aggregate(right, zero, step, lambda s: s[f"r{edits}"])
    at = m - n + edits
    return (F.abs(m - n) <= edits) & (F.call_function("shiftright", last, at).bitwiseAND(1) == 1)


def _common_length(a: Column, b: Column, most: Column) -> Column:
    """Length of the longest common beginning, at most `most`: its binary digits, from the highest."""
    digits = F.transform(F.sequence(F.floor(F.log2(most + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    more = lambda n, k: (n + k <= most) & (F.substring(a, n + 1, k) == F.substring(b, n + 1, k))
    return F.aggregate(digits, F.lit(0), lambda n, k: n + F.when(more(n, k), k).otherwise(0))


def _letters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def verified(pairs: DataFrame, lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """The pairs within the edits, with h, g and first of both lines (h, g, line, len, first) as structs a and b."""
    place = F.struct("h", "g", "first")
    one, two = (lines.select(F.col("h").alias(x), place.alias(f"{x}_at"), F.col("line").alias(f"{x}_line"), F.col("len").alias(f"{x}_len")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").filter(_alike(F.col("a_line"), F.col("b_line"), F.col("a_len"), edits))
    # inline() holds a value in a row of its own, so that what follows doesn't count it again.
    held = lambda df, **made: df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))
    a, b = F.col("a_line"), F.col("b_line")
    least = F.least("a_len", "b_len")
    both = held(both, begun=_common_length(a, b, least))
    both = held(both, ended=_common_length(F.reverse(a), F.reverse(b), least - F.col("begun")))
    between = lambda x, n: _letters(F.substring(x, F.col("begun") + 1, n - F.col("begun") - F.col("ended")))
    both = held(both, x=between(a, F.col("a_len")), y=between(b, F.col("b_len")))
    return both.filter(within(F.col("x"), F.col("y"), edits)).select(F.col("a_at").alias("a"), F.col("b_at").alias("b"))


def decided(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """One row per removed line's place: doc_id, th, pos, exact and near (why it is removed)."""
    lines = common.stored(distinct_lines(docs))
    long = lines.filter(F.col("len") >= LEAST_CHARS)
    pairs = common.stored(candidates(long, edits))
    some = common.stored(_of(long, pairs.select(F.explode(F.array("a", "b")).alias("h"))))
    near = verified(pairs, some, edits)
    later = F.when(F.col("a.first") < F.col("b.first"), F.col("b")).otherwise(F.col("a"))
    gone = near.select(later.alias("x")).select("x.h", "x.g").distinct().withColumn("near", F.lit(True))
    verdict = lines.join(gone, ["h", "g"], "left").select("h", "g", "first", "n", F.coalesce("near", F.lit(False)).alias("near")).filter("n > 1 OR near")
    out = places(docs).select("place", "h", "g").join(verdict, ["h", "g"])
    return out.select("place.*", (F.col("place") != F.col("first")).alias("exact"), "near").filter("exact OR near")


def deduped(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents without their removed lines; n_exact and n_near count them, under the prefix."""
    out = decided(docs, edits).distinct()
    by = out.groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_list("pos")).alias("gone"),
        F.sum(F.col("exact").cast("long")).alias("n_exact"),
        F.sum((F.col("near") & ~F.col("exact")).cast("long")).alias("n_near"),
    )
    by = by.select(*[F.col(x).alias(f"{_P}{x}") for x in ("doc_id", "th", "gone", "n_exact", "n_near")])
    same = docs["doc_id"].eqNullSafe(F.col(f"{_P}doc_id")) & (F.xxhash64(docs["text"]) == F.col(f"{_P}th"))
    joined = docs.join(by, same, "left")
    gone = F.col(f"{_P}gone")
    # inline() holds the lines in a row of their own, so that a step over them doesn't split the text again.
    split = F.when(gone.isNotNull(), F.split("text", "\n", -1)).alias(f"{_P}lines")
    joined, lines = joined.select("*", F.inline(F.array(F.struct(split)))), F.col(f"{_P}lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    left = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    counts = [F.coalesce(f"{_P}{x}", F.lit(0)).cast("long").alias(f"{_P}{x}") for x in ("n_exact", "n_near")]
    return joined.select(*[left.alias("text") if c == "text" else F.col(c) for c in docs.columns], *counts)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, lines removed as copies and as near copies, what is left."""
    out = deduped(docs.select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        F.col(f"{_P}n_exact").alias("n_exact"),
        F.col(f"{_P}n_near").alias("n_near"),
        F.length(text).cast("long").alias("kept_chars"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents with the removed lines taken out of text and, if there is such a column, n_chars counted anew."""
    out = deduped(docs)
    chars = lambda kind: F.coalesce(F.length("text"), F.lit(0)).cast(kind).alias("n_chars")
    return out.select(*[chars(docs.schema[c].dataType) if c == "n_chars" else F.col(c) for c in docs.columns])
