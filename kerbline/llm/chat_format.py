"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions only.

A window's room is what the system turn and the share for repeated turns leave of the budget. Prefix sums of turn tokens assign
every turn to a cell; cells are as wide as the room less the longest turn that takes half the room at most, and longer turns stand
alone. So a window exceeds the budget only where one turn exceeds its room. Every later window repeats the system turn and up to
HISTORY of the turns before it, when they are short; repeated turns carry a marker of their own and stay outside the loss mask.

Template: ``<|turn|>role<|text|>text<|end|>``, with ``<|seen|>`` in place of ``<|turn|>`` for a repeated turn. In roles and
texts & and < are written &amp; and &lt;, so that no marker can occur inside them.

One row per turn is shuffled once, by conversation. A conversation is brought together, as the digest of a conversation needs
all of it; nothing else is.

Defined cases: null text or role is empty; ties of a turn number are ordered by role and text; repeated rows are turns of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a window, of which HISTORY_SHARE may be repeated turns other than the system turn, and a quarter at most of what that leaves.
BUDGET = 1024
HISTORY = 2
HISTORY_SHARE = 0.25
#: Bytes that count as one token, and the tokens of a turn's markers.
BYTES_PER_TOKEN, TURN_TOKENS = 4, 4


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, loss (start and length of each masked-in text, in code points of formatted)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "text")
    rows = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tokens = F.ceil(F.octet_length(escape(F.col("text"))) / BYTES_PER_TOKEN) + TURN_TOKENS
    t = t.withColumn("n", F.row_number().over(order)).withColumn("tokens", tokens)
    system = F.first(F.struct("role", "text", "tokens")).over(rows)
    t = t.withColumn("first", system).withColumn("system", F.when(F.col("first.role") == "system", F.col("first"))).drop("first")
    left = F.greatest(F.lit(budget) - F.coalesce("system.tokens", F.lit(0)), F.lit(0))
    t = t.withColumn("share", F.least(F.lit(int(budget * HISTORY_SHARE)), F.floor(left / 4))).withColumn("room", F.greatest(left - F.col("share"), F.lit(1)))
    t = t.withColumn("half", F.floor(F.col("room") / 2)).withColumn("long", F.col("tokens") > F.col("half"))
    longest = F.max(F.when(~F.col("long"), F.col("tokens"))).over(whole)
    t = t.withColumn("width", F.col("room") - F.coalesce(longest, F.lit(0)))
    t = t.withColumn("prefix", F.sum("tokens").over(rows)).withColumn("longs", F.sum(F.col("long").cast("long")).over(rows))
    cell = F.struct(F.floor((F.col("prefix") - 1) / F.col("width")).alias("cell"), "longs", "long")
    t = t.withColumn("cell", cell).withColumn("fresh", F.coalesce(F.col("cell") != F.lag("cell").over(order), F.lit(True)))
    t = t.withColumn("window", F.sum(F.col("fresh").cast("long")).over(rows) - 1)
    # A turn is history for the windows that begin within the next turns.
    ahead = F.array_distinct(F.array_compact(F.array(*[F.lead("window", k).over(order) for k in range(1, history + 1)])))
    short = F.col("tokens") * max(history, 1) <= F.col("share")
    is_system = F.col("system").isNotNull() & (F.col("n") == 1)
    again = F.when(short & ~is_system, F.filter(ahead, lambda w: w != F.col("window"))).otherwise(F.array().cast("array<bigint>"))
    t = t.withColumn("at", F.concat(F.array(F.struct(F.col("window").alias("w"), F.lit(False).alias("seen"))), F.transform(again, lambda w: F.struct(w.alias("w"), F.lit(True).alias("seen")))))
    t = t.select("conv_id", "n", "role", "text", "system", F.inline("at"))
    # The first turn of a later window brings the system turn along.
    in_window = Window.partitionBy("conv_id", "w").orderBy("n")
    t = t.withColumn("k", F.row_number().over(in_window))

    def piece(marker: str | Column, role: Column | str, text: Column | str) -> Column:
        return F.concat(marker if isinstance(marker, Column) else F.lit(marker), escape(F.col(role)), F.lit("<|text|>"), escape(F.col(text)), F.lit("<|end|>"))

    lead = F.when((F.col("k") == 1) & (F.col("w") > 0) & F.col("system").isNotNull(), piece("<|seen|>", "system.role", "system.text")).otherwise(F.lit(""))
    t = t.withColumn("piece", F.concat(lead, piece(F.when(F.col("seen"), "<|seen|>").otherwise("<|turn|>"), "role", "text")))
    t = t.withColumn("end", F.sum(F.length("piece")).over(in_window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    length = F.length(escape(F.col("text")))
    loss = F.when((F.col("role") == "assistant") & ~F.col("seen"), F.struct((F.col("end") - F.lit(len("<|end|>")) - length).cast("int").alias("start"), length.alias("length")))
    parts = F.sort_array(F.collect_list(F.struct("k", "piece", loss.alias("loss"))))
    made = t.groupBy("conv_id", "w").agg(parts.alias("parts"))
    return made.select("conv_id", F.col("w").alias("window"), F.array_join("parts.piece", "").alias("formatted"), F.array_compact("parts.loss").alias("loss"))


def read_back(made: DataFrame) -> DataFrame:
    """From windows back to conversations: turns (role, text) in order, and the text under the loss mask."""
    turn = F.regexp_extract_all("formatted", F.lit(r"<\|turn\|>([^<]*<\|text\|>[^<]*)<\|end\|>"), F.lit(1))
    read = made.select(
        "conv_id",
        "window",
        F.length("formatted").cast("long").alias("chars"),
        F.transform(turn, lambda x: F.struct(unescape(F.substring_index(x, "<|text|>", 1)).alias("role"), unescape(F.substring_index(x, "<|text|>", -1)).alias("text"))).alias("turns"),
        F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"]))), "").alias("loss"),
    )
    by = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return by.select("conv_id", F.flatten("w.turns").alias("turns"), F.array_join("w.loss", "").alias("loss_text"), "formatted_chars")


def conversation_digest(turns: DataFrame) -> DataFrame:
    back = read_back(windows(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
