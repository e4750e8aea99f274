"""Where triples come from: a triple table, or relational tables that are mapped to triples on the fly.

Both give ``scan(p)``, the distinct (s, o) pairs of a predicate, as a lazy DataFrame.  Mapped tables are
scanned column by column, so that a shape over two columns reads two columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.sources.terms import XSD, Graph

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$'


def _matching(df: DataFrame, s: str | None, p: str | None, o: str | None) -> DataFrame:
    for name, term in (("s", s), ("p", p), ("o", o)):
        df = df.where(F.col(name) == term) if term is not None else df
    return df


class TripleTable:
    """A DataFrame of (s, p, o) terms; rows are a set."""

    def __init__(self, df: DataFrame):
        self.df = df.select("s", "p", "o")
        self.spark = df.sparkSession

    @classmethod
    def of(cls, spark: SparkSession, graph: Graph) -> TripleTable:
        return cls(spark.createDataFrame(list(graph.triples), "s string, p string, o string"))

    def scan(self, p: str) -> DataFrame:
        return self.df.where(F.col("p") == p).select("s", "o")

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """(s, p, o) of the triples with these members; all eight patterns are filters of the scan."""
        return _matching(self.df, s, p, o)

    def all(self) -> DataFrame:
        return self.df

    def out_predicates(self) -> DataFrame:
        """(s, p): the predicates that leave each node."""
        return self.df.select("s", "p").distinct()

    def nodes(self) -> DataFrame:
        return self.df.select(F.col("s").alias("v")).union(self.df.select(F.col("o").alias("v"))).distinct()

    def union(self, other: TripleTable) -> TripleTable:
        return TripleTable(self.df.unionByName(other.all()).distinct())

    def minus(self, other: TripleTable) -> TripleTable:
        return TripleTable(self.df.join(other.all(), ["s", "p", "o"], "left_anti"))

    def statistics(self) -> DataFrame:
        """p, n, subjects, objects (the last two approximate)."""
        return self.df.groupBy("p").agg(F.count("*").alias("n"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects"))


def read_ntriples(spark: SparkSession, path: str) -> TripleTable:
    """N-Triples files, one line at a time on the executors; comments and blank lines are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    term = F.regexp_replace(part(3), r"\^\^<http://www\.w3\.org/2001/XMLSchema#string>$", "")
    checked = F.when(part(1) == "", F.raise_error(F.concat(F.lit("not an N-Triples line: "), F.col("value")))).otherwise(part(1))
    return TripleTable(lines.select(checked.alias("s"), part(2).alias("p"), term.alias("o")).distinct())


class StoredTriples(TripleTable):
    """Triples in a Parquet folder, partitioned by predicate, so that a scan reads one predicate; frozen until appended to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, triples: TripleTable, folder: str, files: int = 8) -> StoredTriples:
        """Write the distinct triples; within a predicate they are sorted by subject, dealt to about ``files`` files by its hash."""
        cls._write(triples.all().distinct(), folder, files, "errorifexists")
        return cls(triples.spark, folder)

    @staticmethod
    def _write(df: DataFrame, folder: str, files: int, mode: str) -> None:
        dealt = df.withColumn("predicate", F.col("p")).repartition("predicate", F.pmod(F.xxhash64("s"), F.lit(files))).sortWithinPartitions("predicate", "s")
        dealt.write.mode(mode).partitionBy("predicate").parquet(folder)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.folder).select("s", "p", "o")

    def scan(self, p: str) -> DataFrame:
        return self.spark.read.parquet(self.folder).where(F.col("predicate") == p).select("s", "o")

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.folder)
        rows = rows.where(F.col("predicate") == p) if p is not None else rows
        return _matching(rows, s, None, o).select("s", "p", "o")

    def append(self, more: TripleTable, files: int = 8) -> int:
        """Add the triples that are not there yet; returns their number."""
        from shapeloom.sources.storage import materialize

        new = materialize(more.all().distinct().join(self.df, ["s", "p", "o"], "left_anti"))
        self._write(new, self.folder, files, "append")
        vars(self).pop("_closures", None)
        return new.count()


class QuadTable:
    """A DataFrame of (g, s, p, o): named graphs; a null name is the default graph."""

    def __init__(self, df: DataFrame):
        self.df, self.spark = df.select("g", "s", "p", "o"), df.sparkSession

    def graph(self, name: str | None) -> TripleTable:
        return TripleTable(self.df.where(F.col("g").eqNullSafe(F.lit(name))).select("s", "p", "o"))

    def named(self) -> TripleTable:
        """All named graphs as one."""
        return TripleTable(self.df.where("g is not null").select("s", "p", "o").distinct())

    def names(self) -> DataFrame:
        return self.df.where("g is not null").select("g").distinct()

    def graphs(self, most: int = 10_000) -> dict[str, TripleTable]:
        """Graphs by name, for GRAPH patterns; more than ``most`` names are an error."""
        names = sorted(r.g for r in self.names().limit(most + 1).collect())
        if len(names) > most:
            raise ValueError(f"more than {most} named graphs")
        return {n: self.graph(n) for n in names}


def read_nquads(spark: SparkSession, path: str) -> QuadTable:
    """N-Quads files, one line at a time on the executors."""
    line = _LINE.replace(r")\s*\.\s*(?:#.*)?$", r")\s*(<[^>]*>|_:[^\s.]+)?\s*\.\s*(?:#.*)?$")
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract("value", line, k)
    term = F.regexp_replace(part(3), r"\^\^<http://www\.w3\.org/2001/XMLSchema#string>$", "")
    checked = F.when(part(1) == "", F.raise_error(F.concat(F.lit("not an N-Quads line: "), F.col("value")))).otherwise(part(1))
    return QuadTable(lines.select(F.nullif(part(4), F.lit("")).alias("g"), checked.alias("s"), part(2).alias("p"), term.alias("o")).distinct())


def write_ntriples(triples: TripleTable, path: str) -> None:
    triples.all().select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.text(path)


# ---------------------------------------------------------------- tables as graphs


@dataclass(frozen=True)
class Mapping:
    """A predicate of a table: subject and object are functions of its columns to term columns."""

    table: str
    subject: Column
    object: Column
    unique: bool = False  # subjects of the table are distinct


def node(base: str, *keys: str) -> Column:
    """An IRI made of a fixed start and key columns."""
    out = F.concat(F.lit(f"<{base}"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.lit(">"))
    out.template = (base, keys)  # lets a constant be turned into conditions on the keys
    return out


def keyed(rows: DataFrame, column: Column, term: str) -> DataFrame:
    """The rows whose IRI is the term: a condition on the key columns, which reaches the Parquet scan."""
    base, keys = vars(column).get("template", (None, ()))
    if base is None:
        return rows
    parts = term[len(base) + 1 : -1].split("/") if term.startswith(f"<{base}") else []
    if len(parts) != len(keys):
        return rows.where(F.lit(False))
    for k, x in zip(keys, parts, strict=True):
        rows = rows.where(F.col(k) == F.lit(x).try_cast(rows.schema[k].dataType))
    return rows


def value(column: str, datatype: str | None = None, lang: str | None = None) -> Column:
    """A literal of a column; ``lang`` names the column of its language tag."""
    text = F.col(column).cast("string")
    if datatype in (None, "string"):
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    if datatype == "dateTime":
        text = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    if lang:
        return F.concat(quoted, F.lit("@"), F.col(lang))
    return quoted if datatype in (None, "string") else F.concat(quoted, F.lit(f"^^<{XSD}{datatype}>"))


class MappedTables:
    """Predicates mapped to Parquet tables of a folder; a null subject or object is no triple."""

    def __init__(self, spark: SparkSession, folder: str, mappings: dict[str, list[Mapping]]):
        self.spark, self.folder, self.mappings = spark, folder, mappings

    def scan(self, p: str) -> DataFrame:
        return self._scan(p)

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """(s, p, o); constants become conditions on key columns where the mapping has them."""
        out = None
        for q in self.mappings if p is None else [p]:
            rows = _matching(self._scan(q, s, o).select("s", F.lit(q).alias("p"), "o"), s, None, o)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _scan(self, p: str, s: str | None = None, o: str | None = None) -> DataFrame:
        out = None
        for m in self.mappings.get(p, []):
            table = self.spark.read.parquet(f"{self.folder}/{m.table}.parquet")
            for column, term in ((m.subject, s), (m.object, o)):
                table = keyed(table, column, term) if term is not None else table
            rows = table.select(m.subject.alias("s"), m.object.alias("o")).where("s is not null and o is not null")
            rows = rows if m.unique else rows.distinct()
            out = rows if out is None else out.unionByName(rows).distinct()
        return out if out is not None else self.spark.createDataFrame([], "s string, o string")

    def all(self) -> DataFrame:
        out = None
        for p in self.mappings:
            rows = self.scan(p).select("s", F.lit(p).alias("p"), "o")
            out = rows if out is None else out.unionByName(rows)
        return out

    nodes, out_predicates = TripleTable.nodes, TripleTable.out_predicates

    @property
    def df(self) -> DataFrame:
        return self.all()
