"""Chat formatting with Spark expressions only.

Rows of turns become one string per conversation.  The turns of a conversation are collected as
structs and sorted by (turn, role, text); adjacent turns of the same role share one block:

    <s>[INST]role[/INST]text[NEXT]text</s>

Control strings inside roles and texts are escaped reversibly: one backslash goes between the
first character of a control string and the rest, and behind backslashes that are there already.
The loss mask is a list of code point ranges of the formatted string, one for each text of a
role under loss.

Defined results: null roles and texts are empty; a null turn sorts first; ties in turn are
ordered by role and text, and repeated rows stay; a null conv_id is a conversation of its own;
an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.llm.common import with_starts

OPEN, ROLE, NEXT, CLOSE = "<s>[INST]", "[/INST]", "[NEXT]", "</s>"
#: Control strings of the template, without their first character.
_TAILS = r"/?s>|/?INST\]|NEXT\]"
_ESCAPE = rf"([<\[])(\\*)({_TAILS})"
_UNESCAPE = rf"([<\[])\\(\\*)({_TAILS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, r"$1$2$3")


def format_chats(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted (string), loss (array of struct(start, end): code points, end exclusive)."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    df = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # Blocks: indexes (from 0) at which the role changes.
    t = lambda i: F.get("turns", i)
    first = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (t(i)["role"] != t(i - 1)["role"]))
    df = df.withColumn("first", first)
    end = lambda k: F.coalesce(F.get("first", k + 1), F.size("turns"))
    block = lambda b, k: F.struct(
        escape(t(b)["role"]).alias("role"),
        t(b)["role"].isin(*loss_roles).alias("loss"),
        F.transform(F.slice("turns", b + 1, end(k) - b), lambda x: escape(x["text"])).alias("texts"),
    )
    df = df.withColumn("blocks", F.transform("first", block))
    shown = lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(ROLE), F.array_join(b["texts"], NEXT), F.lit(CLOSE))
    # Pieces: for every text, characters before it (marks) and its own.
    piece = lambda b: F.transform(
        b["texts"],
        lambda x, i: F.struct(
            F.when(i == 0, F.length(b["role"]) + len(OPEN + ROLE)).otherwise(len(NEXT)).cast("long").alias("gap"),
            F.length(x).cast("long").alias("n"),
            b["loss"].alias("loss"),
            F.when(i == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).cast("long").alias("tail"),
        ),
    )
    df = df.select("conv_id", F.array_join(F.transform("blocks", shown), "").alias("formatted"), F.flatten(F.transform("blocks", piece)).alias("pieces"))
    df = with_starts(df, "pieces", "starts", lambda x: x["gap"] + x["n"] + x["tail"])
    begin = lambda z: z["starts"] + z["pieces"]["gap"]
    span = lambda z: F.struct(begin(z).alias("start"), (begin(z) + z["pieces"]["n"]).alias("end"), z["pieces"]["loss"].alias("loss"))
    spans = F.filter(F.transform(F.arrays_zip("pieces", "starts"), span), lambda x: x["loss"])
    return df.select("conv_id", "formatted", F.transform(spans, lambda x: F.struct(x["start"], x["end"])).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of struct(role, text) of a formatted conversation."""
    blocks = F.slice(F.split(formatted, r"\Q</s>\E", -1), 1, F.size(F.split(formatted, r"\Q</s>\E", -1)) - 1)
    parsed = lambda b: F.split(F.substring(b, len(OPEN) + 1, 2147483647), r"\Q[/INST]\E", 2)
    of = lambda b: F.transform(
        F.split(F.get(parsed(b), F.lit(1)), r"\Q[NEXT]\E", -1),
        lambda x: F.struct(unescape(F.get(parsed(b), F.lit(0))).alias("role"), unescape(x).alias("text")),
    )
    return F.flatten(F.transform(blocks, of))


def read_loss(formatted: Column, loss: Column) -> Column:
    """Array of the unescaped texts under the loss mask."""
    cut = lambda x: unescape(F.substring(formatted, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
    return F.transform(loss, cut)


def digests(chats: DataFrame) -> DataFrame:
    """What the contract asks for, all read back from ``formatted`` and ``loss``."""
    df = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("under", read_loss(F.col("formatted"), F.col("loss")))
    line = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    lost = F.array_join("under", "")
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
