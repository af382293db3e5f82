"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes its own example: all preceding turns are context,
only that reply is trainable. The template is ``<|im_start|>role\\ntext<|im_end|>\\n``.
Control strings inside texts and roles are escaped reversibly: a backslash is
doubled, then ``<|`` becomes ``<\\|`` and, in roles, a newline becomes ``\\n``.

Defined results: a null text or role is empty; turns go by (turn, role, text),
null turns first; repeated rows are repeated turns; an empty table gives an
empty result; other columns are ignored. A conversation that does not end with
an assistant turn gets one more row, whose context is the whole conversation
and whose reply is null (nothing trainable), so that no turn is lost.
A conversation is one row while it is formatted, as its digest needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    """Pairs of backslashes are found first, from the left, so that what stands between holds only inserted ones."""

    def part(x: Column) -> Column:
        x = F.replace(x, F.lit("<\\|"), F.lit("<|"))
        return F.replace(x, F.lit("\\n"), F.lit("\n")) if role else x

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, example_no from 1, context, reply, closing); rendered text is context || reply || closing."""
    rows = turns.select(F.col(conv), F.struct(F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t")).alias("_x"))
    talks = rows.groupBy(conv).agg(F.array_sort(F.collect_list("_x")).alias("_turns"))
    piece = lambda x: F.concat(F.lit(START), escape(x["r"], True), F.lit("\n"), escape(x["t"]), F.lit(END))
    talks = talks.select(
        conv,
        F.transform("_turns", piece).alias("_pieces"),
        F.transform("_turns", lambda x: F.when(x["r"] == "assistant", escape(x["t"]))).alias("_replies"),
    )
    n = F.size("_pieces")
    at = F.filter(F.sequence(F.lit(1), n + 1), lambda i: (i == n + 1) & F.element_at("_replies", n).isNull() | (i <= n) & F.get("_replies", i - 1).isNotNull())
    at = talks.select(conv, "_pieces", "_replies", F.posexplode(at).alias("_no", "_at"))
    before = F.array_join(F.slice("_pieces", 1, F.col("_at") - 1), "")
    reply = F.get("_replies", F.col("_at") - 1)
    return at.select(
        conv,
        (F.col("_no") + 1).alias("example_no"),
        F.when(reply.isNull(), before).otherwise(F.concat(before, F.lit(f"{START}assistant\n"))).alias("context"),
        reply.alias("reply"),
        F.when(reply.isNotNull(), F.lit(END)).alias("closing"),
    )


def read_turns(rendered: Column) -> Column:
    """Array of (role, text) from rendered text."""
    pieces = F.split(rendered, r"<\|im_start\|>")
    pieces = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        return F.struct(
            unescape(F.substring(x, F.lit(1), cut - 1), True).alias("role"),
            unescape(F.substring(x, cut + 1, F.length(x) - cut - len(END))).alias("text"),
        )

    return F.transform(pieces, turn)


def digest_chat(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What each conversation's examples hold, read back from them."""
    rendered = F.concat("context", F.coalesce("reply", F.lit("")), F.coalesce("closing", F.lit("")))
    each = examples.select(conv, "example_no", rendered.alias("_all"), F.when(F.col("reply").isNotNull(), F.struct("example_no", unescape(F.col("reply")).alias("t"))).alias("_loss"))
    whole = each.groupBy(conv).agg(F.max_by("_all", "example_no").alias("_all"), F.array_sort(F.collect_list("_loss")).alias("_loss"), F.sum(F.length("_all")).alias("formatted_chars"))
    whole = whole.select(conv, "formatted_chars", read_turns(F.col("_all")).alias("_turns"), F.array_join(F.transform("_loss", lambda x: x["t"]), "").alias("_loss"))
    joined = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return whole.select(
        conv,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
