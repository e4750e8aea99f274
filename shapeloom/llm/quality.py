"""Line-first quality rules with Spark expressions only.

Each line is judged by itself: punctuation (it must end like a sentence, or be long and hold the
end of one, and must not be full of repeated marks), navigation (many separators between short
items) and boilerplate (stock phrases of web pages).  Failed lines are removed, all else stays as it
is, blank lines included; a document that loses more than ``MAX_LOST`` of its words, or fails a base
rule, is rejected.  Documents are never joined or shuffled: all rules are expressions over one row.

Repeated windows are found by their hashes and compared by their words.

Defined results: a null text has no words; a text without words fails the base rule; lines
without a word are neither kept nor lost; repeated rows are judged alike; an empty table gives
no rows.  Other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.llm.common import WORD_CLASS, text_of, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document may lose up to this share of its words with its failed lines.
MAX_LOST = 0.5
#: Rules of a line.
ENDS = r"""[.!?…:;"'”’»)\]।॥؟۔。．！？｡][ \t-\r]*\z"""
#: The end of a sentence within a line, which is enough for lines of so many words.
INSIDE = r"""[.!?…।॥؟۔。．！？｡]["'”’»)\]]*(?:[ \t]|\z)"""
LONG_LINE = 30
MARKS = r"[!?#$%&*]{2,}"
MAX_MARKS = 0.3
SEPARATORS = r"(?:^|[ \t])[|»›•·>](?:[ \t]|$)"
MAX_SEPARATORS = 0.2
PHRASES = r"(?i)\b(?:javascript|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|sign in|log in|subscribe now|click here|lorem ipsum)\b"
#: A stock phrase damns a line only up to this number of words.
PHRASE_WORDS = 30
#: Columns that judge() adds; columns of these names in the input are replaced.
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words", "kept_text", "kept"]


def line_ok(line: Column) -> Column:
    """Whether a line with a word passes the rules of its own."""
    n = F.regexp_count(line, F.lit(WORD_CLASS + "+"))
    marks = F.regexp_count(line, F.lit(MARKS)) <= MAX_MARKS * n
    separators = F.regexp_count(line, F.lit(SEPARATORS)) <= MAX_SEPARATORS * n
    stock = ~(F.rlike(line, F.lit(PHRASES)) & (n <= PHRASE_WORDS))
    ends = F.rlike(line, F.lit(ENDS)) | ((n >= LONG_LINE) & F.rlike(line, F.lit(INSIDE)))
    return ends & marks & separators & stock


def judge(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_words, kept_text, kept."""
    own = [c for c in docs.columns if c not in ADDED]
    q = lambda c: F.col(f"`{c}`")
    df = docs.select(*[q(c) for c in own], text_of().alias("_t"))
    worded = lambda x: F.rlike(x, F.lit(WORD_CLASS))
    df = df.select("*", words_of(F.col("_t")).alias("_w"), F.split("_t", "\n", -1).alias("_all"))
    df = df.select("*", F.filter("_all", worded).alias("_lines"))
    windows = F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_w") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))))
    none = F.array().cast("array<bigint>")
    df = df.select(
        *[q(c) for c in own],
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(windows, none).alias("_h"),
        F.array_join(F.filter("_all", lambda x: ~worded(x) | line_ok(x)), "\n").alias("kept_text"),
    )
    # Only texts with a repeated window go on: their windows are sorted, equal neighbours are repeats.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda c, e, k: F.coalesce(F.get(c, k)["h"] == e["h"], F.lit(False))
    alike = lambda c: F.filter(c, lambda e, k: same(c, e, k - 1) | same(c, e, k + 1))
    df = df.withColumn("_c", alike("_s"))
    text = lambda e: F.struct(F.array_join(F.slice("_w", e["i"] + 1, WINDOW), " ").alias("h"), e["i"].alias("i"))
    df = df.withColumn("_s", F.array_sort(F.transform("_c", text)))
    df = df.withColumn("_p", F.array_sort(F.transform(alike("_s"), lambda e: e["i"])))
    covered = F.transform("_p", lambda p, k: F.least(F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    df = df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    df = df.withColumn("kept_words", F.regexp_count("kept_text", F.lit(WORD_CLASS + "+")).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # A filter on a verdict stays above it: pushed down, it would repeat every expression that it rests on.
    here = F.monotonically_increasing_id() >= 0
    df = df.withColumn("base_failed", here & failed)
    df = df.withColumn("kept", here & ~F.col("base_failed") & (F.col("kept_words") >= (1 - MAX_LOST) * F.col("n_words")))
    return df.select(*[q(c) for c in own], *ADDED)
