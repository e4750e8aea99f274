"""Shared pieces of the training-data operators.

* materialised intermediates in the folder that the cluster names in ``spark.checkpoint.dir``;
* numpy views of Arrow text columns: word boundaries and rolling hashes for whole batches.

Words are maximal runs of characters other than space and U+0009..U+000D everywhere here.
A null text counts as an empty text.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy block holds (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20
#: Rows in an Arrow batch; with documents of a few KB a batch is a few MB.
ARROW_ROWS = 1000
#: Used only where the session names no folder (tests, notebooks).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

WS_CLASS = r"[ \t-\r]"
WORD_CLASS = r"[^ \t-\r]"


# ---------------------------------------------------------------- session and storage


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that Python workers stay within a few hundred MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set to a local one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_CHECKPOINTS
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/shapeloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a task that rereads files, not the whole job.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shapeloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_shapeloom_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no live DataFrame needs; it does so when the driver collects garbage.

    Plans are held by objects with finalizers, so that it takes two collections.
    """
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        spark.sparkContext._jvm.System.runFinalization()
        time.sleep(0.1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- column expressions


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a text without words."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_CLASS + "+"))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds (null id: the empty string's)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


#: Length of the stretches of a running sum: Spark copies what an aggregate has gathered at every step.
SUM_CHUNK = 256


def running_sums(values: Column) -> Column:
    """(out: sums before each value, all: sum of all) of a short array of longs."""
    zero = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("all"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["all"])).alias("out"), (acc["all"] + x).alias("all"))
    return F.aggregate(values, zero, step)


def with_starts(df: DataFrame, pieces: str, out: str, length) -> DataFrame:
    """``df`` with the sum of ``length(piece)`` over all pieces before each piece of the array column ``pieces``.

    Stretch by stretch, so that the cost is the number of pieces times a constant.  Arrays are read
    inside a lambda only where they are columns of more than one use, or zipped: Spark would
    otherwise compute them again for every element.
    """
    last = F.greatest(F.floor((F.size(pieces) - 1) / SUM_CHUNK).cast("int"), F.lit(0))
    chunk = lambda c: running_sums(F.transform(F.slice(pieces, c * SUM_CHUNK + 1, SUM_CHUNK), length))
    df = df.withColumn("_chunks", F.transform(F.sequence(F.lit(0), last), chunk))
    df = df.withColumn("_bases", running_sums(F.transform("_chunks", lambda c: c["all"]))["out"])
    both = F.arrays_zip("_chunks", "_bases")
    sums = F.flatten(F.transform(both, lambda z: F.transform(z["_chunks"]["out"], lambda x: x + z["_bases"])))
    return df.withColumn(out, sums).drop("_chunks", "_bases")


# ---------------------------------------------------------------- numpy views of text

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
#: White space and all other ASCII characters that are neither letters nor digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multiplier of the rolling hash and a table that spreads byte values over 64 bits.
_P = np.uint64(0x9E3779B97F4A7C15)
_IP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPREAD = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "ip": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n; kept by the worker and grown when needed."""
    if len(_powers["p"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for key, base in (("p", _P), ("ip", _IP)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[key] = np.cumprod(x, dtype=np.uint64)
    return _powers["p"], _powers["ip"]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Block:
    """Consecutive texts of a batch as one byte buffer.

    ``first``: row of the batch that the block starts with; ``off``: start of each text in
    ``buf``, and the end of the last.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, first: int):
        self.buf, self.off, self.first, self.n = buf, off, first, len(off) - 1

    def words(self, gaps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the index of its first word (n + 1 values).

        ``gaps``: for each byte value, whether it separates words; white space by default.
        """
        buf, off = self.buf, self.off
        if not len(buf):
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(self.n + 1, np.int64)
        word = ~(_WS if gaps is None else gaps)[buf]
        inside = off[(off > 0) & (off < len(buf))]
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        before[inside] = False
        after = np.empty_like(word)
        after[-1] = False
        after[:-1] = word[1:]
        after[inside - 1] = False
        starts = np.flatnonzero(word & ~before)
        ends = np.flatnonzero(word & ~after) + 1
        return starts, ends, np.searchsorted(starts, off)

    def lowered(self) -> np.ndarray:
        """The bytes with A-Z lower-cased."""
        return _LOWER[self.buf]


def prefix_hash(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers from which :func:`range_hash` gets the hash of any byte range."""
    p, ip = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_SPREAD[buf] * p[: len(buf)], out=sums[1:])
    return sums, ip


def range_hash(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) of each range: equal bytes, equal hash, wherever they stand."""
    sums, ip = prefix
    return mix((sums[ends] - sums[starts]) * ip[starts])


def blocks(column: pa.Array, limit: int = 0) -> Iterator[Block]:
    """Cut a string column into blocks of about ``limit`` bytes; null texts are empty."""
    limit = limit or BLOCK_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield Block(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for each i; 0 for an empty segment."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
