"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, only its reply is
trainable. Turns after a conversation's last assistant turn (or all, without one) become one more example
without a trainable span, so that no turn is lost.

Template of a turn: `### role: text</turn>\\n`. The control strings `### ` and `</turn>`, the backslash and,
in roles, the colon are escaped in what stands between, and only there, so the output can be read back.

Defined cases: a null text or role counts as empty; turns are ordered by turn (null first), then role, then
text, and repeated rows are repeated turns; rows with a null conv_id form one conversation; texts of any length are
kept whole (a conversation is one row, so it must fit one); further columns don't pass and may have any name; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: control strings and their escapes. The backslash comes first when escaping and last when reading.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\t"), ("### ", "\\h"), (":", "\\c"))
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"


def escape(col: Column, role: bool = False) -> Column:
    for raw, code in ESCAPES if role else ESCAPES[:3]:
        col = F.replace(col, F.lit(raw), F.lit(code))
    return col


def unescape(col: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        col = F.replace(col, F.lit(code), F.lit(raw))
    return col


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), escape(role, role=True), F.lit(COLON), escape(text), F.lit(TAIL))


def expand(conversations: DataFrame, target: str = "assistant") -> DataFrame:
    """Rows of (conv_id, turn, role, text) -> one row per example: conv_id, example, target_turn, formatted,
    loss_start, loss_end (0-based code points; both null if nothing is trainable).
    """
    turns = conversations.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    rendered = convs.select("conv_id", "turns", F.transform("turns", lambda t: render(t.role, t.text)).alias("parts"))
    last = F.size("turns") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("turns", i).role == target) | (i == last))
    ex = rendered.select("conv_id", "turns", "parts", F.posexplode(ends).alias("example", "at"))
    formatted = F.array_join(F.slice("parts", F.lit(1), F.col("at") + 1), "")
    trains = F.get("turns", F.col("at")).role == target
    ex = ex.select("conv_id", "example", F.get("turns", F.col("at")).turn.alias("target_turn"), trains.alias("_trains"), F.get("turns", F.col("at")).text.alias("_reply"), formatted.alias("formatted"))
    end = F.length("formatted") - len(TAIL)
    return ex.select(
        "conv_id", "example", "target_turn", "formatted",
        F.when(F.col("_trains"), end - F.length(escape(F.col("_reply")))).alias("loss_start"), F.when(F.col("_trains"), end).alias("loss_end"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped: array of (role, text)."""
    pieces = F.filter(F.split(formatted, TAIL, -1), lambda p: p != "")
    cut = F.transform(pieces, lambda p: F.struct(F.substr(p, F.lit(len(HEAD) + 1)).alias("p"), F.instr(F.substr(p, F.lit(len(HEAD) + 1)), COLON).alias("i")))
    return F.transform(cut, lambda x: F.struct(unescape(F.left(x.p, x.i - 1)).alias("role"), unescape(F.substr(x.p, x.i + len(COLON))).alias("text")))


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    return unescape(F.substr(formatted, start + 1, end - start))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of conversations, from the formatted examples alone."""
    masked = examples.select(
        "conv_id", "example", "formatted", F.length("formatted").cast("long").alias("chars"),
        F.coalesce(loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")), F.lit("")).alias("loss"),
    )
    per_conv = masked.groupBy("conv_id").agg(
        F.max(F.struct("example", "formatted")).formatted.alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    parsed = per_conv.withColumn("turns", parse(F.col("whole")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
