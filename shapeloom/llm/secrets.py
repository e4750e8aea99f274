"""Secret scans over a ledger of content-addressed blobs, with Spark expressions only.

Every version of every path is addressed by the SHA-256 of its text.  A ledger, a Parquet folder,
keeps for each blob the rule versions that have scanned it and the spans that they found.  A commit
takes each distinct blob of its versions once, runs only the rules whose version the ledger
lacks for that blob, and appends what they find.  Findings are joined back to all paths and versions
that hold a blob; spans of rule versions that are not asked for stay in the ledger, unread.

Spans are code points, end exclusive.  A rule takes leftmost non-overlapping matches of its
pattern; a match whose measured group is shorter than the rule's least length is dropped.

Defined results: a null text is the empty blob; empty tables give no rows; repeated rows and
equal texts get the same findings, each row its own result; versions that were never committed have
null spans.  Other columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.common import text_of, with_starts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1
    version: int = 1

    @property
    def tag(self) -> str:
        return f"{self.kind}@{self.version}"


#: Kinds and patterns fixed by the contract, in its order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: What this method adds: key blocks and tokens with a public, fixed shape.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE_RULES + MORE_RULES
_FOUND = "array<struct<start:bigint,end:bigint,tag:string>>"
_PIECES = "array<struct<gap:bigint,n:bigint,counted:int>>"


def _quick(rule: Rule) -> str:
    """A cheaper pattern that every counted match contains; runs of hex digits are maximal, so that it may stand for the rule's."""
    return rule.pattern if rule.kind != "hex" else f"[0-9a-f]{{{rule.least},}}"


def pieces_of(text: Column, rule: Rule) -> Column:
    """Array of (gap, n, counted) of the rule's matches: characters before each match, its own, and those that count.

    Only texts that can match are cut.  What stands behind the last match has no n.
    """
    pattern = _quick(rule)
    cut = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)).alias("counted"),
    )
    length = lambda x: F.coalesce(F.length(x), F.lit(0)).cast("long")
    pieces = F.transform(cut, lambda x: F.struct(length(x["gap"]).alias("gap"), length(x["found"]).alias("n"), F.length(x["counted"]).alias("counted")))
    return F.when(F.rlike(text, F.lit(pattern)), pieces).otherwise(F.array().cast(_PIECES))


def _counted(pieces: str, starts: str, rule: Rule) -> Column:
    """Spans of the pieces that count, from their columns."""
    begin = lambda z: z[starts] + z[pieces]["gap"]
    span = lambda z: F.struct(begin(z).alias("start"), (begin(z) + z[pieces]["n"]).alias("end"), F.lit(rule.tag).alias("tag"))
    long = lambda z: F.coalesce(z[pieces]["counted"] >= rule.least, F.lit(False))
    return F.transform(F.filter(F.arrays_zip(pieces, starts), long), span)


def with_spans(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``df`` (text, tags) without text and with the spans of the rules that its tags name."""
    none, own = F.array().cast(_PIECES), [c for c in df.columns if c != "text"]
    df = df.select(*own, *[F.when(F.array_contains("tags", r.tag), pieces_of(F.col("text"), r)).otherwise(none).alias(f"_p{k}") for k, r in enumerate(rules)])
    for k in range(len(rules)):
        df = with_starts(df, f"_p{k}", f"_s{k}", lambda x: x["gap"] + x["n"])
    spans = F.concat(*[_counted(f"_p{k}", f"_s{k}", r) for k, r in enumerate(rules)])
    return df.select(*own, spans.cast(_FOUND).alias("spans"))


def address(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, tags, spans) for the blobs of ``versions`` (column text) that lack a rule version."""
    blobs = versions.select(text_of().alias("text")).withColumn("blob", address(F.col("text"))).dropDuplicates(["blob"])
    tags = F.array(*[F.lit(r.tag) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("tags", tags)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("tags")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("tags", F.array_except(tags, F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.where(F.size("tags") > 0)
    return with_spans(todo.select("blob", "tags", "text"), rules)


class Ledger:
    """Blobs, the rule versions that have scanned them, and their spans, in a folder that jobs share and append to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.columns = spark, path, f"blob binary, tags array<string>, spans {_FOUND}"

    def rows(self) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(self.columns).parquet(self.path) if there else None

    def commit(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Scan what the ledger lacks of ``versions`` (column text) and append it."""
        scan_blobs(versions, self.rows(), rules).write.mode("append").parquet(self.path)

    def findings(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``versions`` without text, with blob and the spans of ``rules``: by start, then in the rules' order."""
        tags = F.array(*[F.lit(r.tag) for r in rules])
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        found = self.rows()
        if found is None:
            found = self.spark.createDataFrame([], self.columns)
        number = lambda s: F.array_position(tags, s["tag"]).cast("int") - 1
        shown = lambda s: F.struct(s["start"], number(s).alias("kind_no"), F.get(kinds, number(s)).alias("kind"), s["end"])
        asked = F.filter(F.flatten(F.collect_list("spans")), lambda s: number(s) >= 0)
        found = found.groupBy("blob").agg(F.array_sort(F.transform(asked, shown)).alias("spans"))
        keep = [F.col(c) for c in versions.columns if c not in ("text", "blob", "spans")]
        return versions.select(*keep, address(text_of()).alias("blob")).join(found, "blob", "left")


def show(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(show(base).cast("binary"), 256).alias("base_sha256"),
        show(F.col("spans")).alias("spans"),
    )
