"""Exact substring de-duplication by longest-previous-factor arrays in suffix order.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier (in a
document of smaller doc_id, or earlier in its own).  The longest previous factor of a suffix is
the longest prefix that it shares with any suffix of smaller position; it is shared with the
nearest suffix of smaller position before or behind it in suffix order.  A string of LENGTH bytes
starts earlier if and only if the longest previous factor at its start is LENGTH or more.

A corpus has too many suffixes for one order, so they are sorted in buckets, in three steps:

1. Anchors.  The window of LENGTH bytes at every position has an anchor, its GRAM-byte gram of
   the least hash (leftmost of equals).  Equal windows have equal grams at equal places, so
   that matching windows meet in the bucket of their gram.  Neighbouring windows with the same
   anchor form a run, of about thirty windows.  A bucket of one run has no match and is dropped.
2. Runs.  The bytes of the other runs are cut.  A run whose bytes equal those of a run of smaller
   position in its bucket is removed whole, first in the task that cuts it, then in its bucket.
3. Suffixes.  Where a bucket has runs of several kinds, the suffixes at their windows are put
   in suffix order with the lengths of common prefixes of neighbours, the previous and next smaller
   positions give the longest previous factors, and windows of LENGTH or more are removed.

Hashes only bring together what may be equal; equality is always that of bytes.  Buckets of over
``HOT`` runs are dealt window by window, so that a gram that a third of all texts hold is spread; a
task sends each kind of run, or window, once.

Defined results: a null text has no bytes; texts shorter than LENGTH stay whole; a null doc_id
comes first; rows of equal doc_id are ordered by the SHA-256 of their text; rows of equal doc_id and
text are one document and all get its result; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.llm.common import blocks, discard, materialize, mix, prefix_hash, range_hash, release, tune

LENGTH = 100
GRAM = 40
#: Bytes of runs that a task holds before it settles copies among them and sends the rest on.
HELD_BYTES = 24 << 20
#: Grams that a counting task holds before it sends them on.
HELD_GRAMS = 1_000_000
#: Text bytes whose runs are found at a time: their hashes take a hundred times as much.
RUN_BYTES = 1 << 18
#: Rows that a task sends at a time: the JVM holds a batch beside its heap.
SENT_ROWS = 1 << 14
HOT = 1 << 11


def sent(batch: pa.RecordBatch):
    """A batch in pieces of SENT_ROWS rows."""
    for k in range(0, batch.num_rows, SENT_ROWS):
        yield batch.slice(k, SENT_ROWS)


# ---------------------------------------------------------------- runs


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i + w] for each i (len(x) - w + 1 values)."""
    n = len(x) - w + 1
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, x.dtype.type(np.iinfo(x.dtype).max))]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def runs_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts in a buffer: (text, start in it, windows, gram hash) of every run."""
    size = np.diff(off)
    empty = np.zeros(0, np.int64)
    if len(buf) < LENGTH or not (size >= LENGTH).any():
        return empty, empty, empty, empty.view(np.uint64)
    sums, ip = prefix_hash(buf)
    grams = len(buf) - GRAM + 1
    h = mix((sums[GRAM:] - sums[:-GRAM]) * ip[:grams])
    # The position makes the leftmost of equal grams the least; a block is far smaller than 2^26.
    low = np.uint64((1 << 26) - 1) if len(buf) < 1 << 26 else np.uint64((1 << 32) - 1)
    least = sliding_min((h & ~low) | np.arange(grams, dtype=np.uint64), LENGTH - GRAM + 1)
    anchor = (least & low).astype(np.int64)
    valid = np.zeros(len(anchor), bool)
    for a, n in zip(off[:-1], size, strict=True):
        if n >= LENGTH:
            valid[a : a + n - LENGTH + 1] = True
    at = np.flatnonzero(valid)
    anchor = anchor[at]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    start, n = at[first], np.diff(np.append(first, len(at)))
    text = np.searchsorted(off, start, "right") - 1
    return text, start - off[text], n, h[anchor[first]]


def _grams(batches):
    """Rows (text) -> (gram, n): how many runs have each gram, once for each time that the task's list is full."""
    held, size = [], 0

    def fold():
        gram, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    for batch in batches:
        for block in blocks(batch.column(0), RUN_BYTES):
            held.append(runs_of(block.buf, block.off)[3])
            size += len(held[-1])
        if size > HELD_GRAMS:
            yield from sent(fold())
            size = 0
    if held:
        yield from sent(fold())


def _runs(batches):
    """Rows (doc_id, text) -> (gram, doc_id, at) of every run; at is start << 8 | windows."""
    for batch in batches:
        docs = np.asarray(batch.column(0))
        for block in blocks(batch.column(1), RUN_BYTES):
            text, start, n, gram = runs_of(block.buf, block.off)
            yield from sent(pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(docs[block.first + text]), pa.array(start << 8 | n)], ["gram", "doc_id", "at"]))


# ---------------------------------------------------------------- equal runs

_CUT = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])


class Firsts:
    """The run of the least position of each kind (bucket, bytes); all others are copies."""

    def __init__(self):
        self.kinds: dict[tuple[int, bytes], tuple[int, int]] = {}
        self.copies: list[tuple[int, int]] = []
        self.size = 0

    def add(self, gram: int, data: bytes, position: tuple[int, int]) -> None:
        old = self.kinds.get((gram, data))
        if old is None:
            self.kinds[gram, data] = position
            self.size += len(data)
        elif old <= position:
            self.copies.append(position)
        else:
            self.copies.append(old)
            self.kinds[gram, data] = position


def _cut(batches):
    """Rows (doc_id, text, gram, at, hot), each document's text (at: null) before its runs -> (gram, doc_id, at, data).

    Runs of hot buckets become windows in buckets of their own.  Rows without data are known to be copies.
    """
    firsts = Firsts()

    def flush():
        kinds, copies = firsts.kinds, firsts.copies
        where = [*kinds.values(), *copies]
        doc, at = (np.array([w[k] for w in where], np.int64) for k in (0, 1))
        spread = mix(doc.view(np.uint64) ^ at.view(np.uint64) << np.uint64(20)).view(np.int64)
        gram = np.concatenate([np.array([k[0] for k in kinds], np.int64), spread[len(kinds) :]])
        data = pa.array([*(k[1] for k in kinds), *[None] * len(copies)], pa.binary())
        firsts.__init__()
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(doc), pa.array(at), data], schema=_CUT)

    text = b""
    for batch in batches:
        columns = [c.cast(pa.binary()) if k == 1 else c for k, c in enumerate(batch.columns)]
        for doc, own_text, gram, a, hot in zip(*(c.to_pylist() for c in columns), strict=True):
            if a is None:
                text = own_text
                if firsts.size > HELD_BYTES or len(firsts.copies) > 500_000:
                    yield from sent(flush())
                continue
            start, n = a >> 8, a & 255
            if not hot:
                firsts.add(gram, text[start : start + n - 1 + LENGTH], (doc, a))
                continue
            for s in range(start, start + n):
                data = text[s : s + LENGTH]
                own = gram ^ xxhash.xxh64_intdigest(data)
                firsts.add((own + (1 << 63)) % (1 << 64) - (1 << 63), data, (doc, s << 8 | 1))
    if firsts.kinds:
        yield from sent(flush())


# ---------------------------------------------------------------- suffixes of buckets with several kinds of runs


def word_columns(windows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of 64-bit words, whose order is that of the bytes."""
    width = -(-windows.shape[1] // 8) * 8
    rows = np.zeros((len(windows), width), np.uint8)
    rows[:, : windows.shape[1]] = windows
    return list(np.ascontiguousarray(rows.view(">u8").astype(np.uint64).T))


def suffix_order(columns: list[np.ndarray], bucket: np.ndarray, position: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes by bucket, then bytes, then position; bytes that each shares with the one before it (of its bucket)."""
    order = np.lexsort((position, *columns[::-1], bucket))
    lcp, same = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    same &= bucket[order[1:]] == bucket[order[:-1]]
    for c in columns:
        x = c[order[1:]] ^ c[order[:-1]]
        agree = sum((x < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 9))  # leading bytes of the word
        lcp[1:] += np.where(same, agree, 0)
        same &= x == 0
    return order, np.minimum(lcp, depth)


def nearest_smaller(position: np.ndarray, lcp: np.ndarray, floor: int, back: bool) -> np.ndarray:
    """For each place in suffix order, the bytes shared with the nearest suffix of smaller position before it (or behind it).

    ``lcp[k]``: bytes shared by k - 1 and k.  A place points past places of greater positions; pointers of
    pointers double their reach.  Search ends where fewer than ``floor`` bytes are shared; such values are 0.
    """
    n, floor = len(position), max(floor, 1)
    place = np.arange(n)
    if back:
        to, shared = place - 1, lcp.copy()
    else:
        to, shared = place + 1, np.append(lcp[1:], 0) if n else lcp.copy()
    end = (to < 0) | (to >= n) | (shared < floor)
    shared[end] = 0
    todo = np.flatnonzero(~end)
    todo = todo[position[to[todo]] > position[todo]]
    while len(todo):
        over = to[todo]
        shared[todo] = np.minimum(shared[todo], shared[over])
        to[todo] = to[over]
        gone = (shared[todo] < floor) | (to[todo] < 0) | (to[todo] >= n)
        shared[todo[gone]] = 0
        todo = todo[~gone]
        todo = todo[position[to[todo]] > position[todo]]
    return shared


def longest_previous_factors(windows: np.ndarray, bucket: np.ndarray, position: np.ndarray, floor: int = 1) -> np.ndarray:
    """Longest prefix (at most the width of ``windows``, rows of bytes) that each shares with one of smaller position in its bucket.

    Values below ``floor`` are 0.
    """
    order, lcp = suffix_order(word_columns(windows), bucket, position, windows.shape[1])
    at = position[order]
    out = np.zeros(len(order), np.int64)
    out[order] = np.maximum(nearest_smaller(at, lcp, floor, True), nearest_smaller(at, lcp, floor, False))
    return out


def _settle_buckets(gram, doc, at, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, at) of the windows with a previous factor of LENGTH bytes, of runs of different bytes in buckets of several."""
    start, n = at >> 8, at & 255
    flat = np.frombuffer(b"".join(data), np.uint8)
    base = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = base[row] + step
    # A window whose hash is alone in its bucket has no equal, and so no factor of LENGTH bytes.
    h = range_hash(prefix_hash(flat), place, place + LENGTH) ^ gram[row].view(np.uint64)
    order = np.argsort(h, kind="stable")
    twin = np.zeros(len(h) + 1, bool)
    twin[1:-1] = h[order[1:]] == h[order[:-1]]
    todo = order[twin[1:] | twin[:-1]]
    gone = np.zeros(len(h), bool)
    if len(todo):
        r = row[todo]
        rank = np.empty(len(todo), np.int64)
        rank[np.lexsort((start[r] + step[todo], doc[r]))] = np.arange(len(todo))
        windows = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[place[todo]]
        gone[todo] = longest_previous_factors(windows, gram[r], rank, LENGTH) >= LENGTH
    # consecutive windows of a run as one piece
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gone[1:] != gone[:-1])]))
    long = np.diff(np.append(first, len(row)))
    take = gone[first]
    first, long = first[take], long[take]
    return doc[row[first]], (start[row[first]] + step[first]) << 8 | long


def _suffixes(batches):
    """Rows (gram, doc_id, at, data) sorted by gram -> (doc_id, at) of windows that occur earlier; rows without data are copies."""
    firsts = Firsts()

    def flush():
        gram = np.array([k[0] for k in firsts.kinds], np.int64)
        order = np.argsort(gram, kind="stable")
        same = gram[order[1:]] == gram[order[:-1]]
        several = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(gram) else order
        copies = np.array(firsts.copies, np.int64).reshape(-1, 2)
        doc, at = copies[:, 0], copies[:, 1]
        if len(several):
            where = np.array(list(firsts.kinds.values()), np.int64)[several]
            kinds = list(firsts.kinds)
            more = _settle_buckets(gram[several], where[:, 0], where[:, 1], [kinds[k][1] for k in several.tolist()])
            doc, at = np.concatenate([doc, more[0]]), np.concatenate([at, more[1]])
        firsts.__init__()
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(doc)), pa.array(np.ascontiguousarray(at))], ["doc_id", "at"])

    last = None
    for batch in batches:
        for gram, doc, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if gram != last and (firsts.size > HELD_BYTES // 16 or len(firsts.copies) > 100_000):
                yield flush()
            last = gram
            if data is None:
                firsts.copies.append((doc, at))
            else:
                firsts.add(gram, data, (doc, at))
    yield flush()


# ---------------------------------------------------------------- the operator


def removed_ranges(ats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte ranges of a document from its pieces."""
    a = np.sort(ats)
    start = a >> 8
    end = start + (a & 255) - 1 + LENGTH
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]


def _clean(batches):
    for batch in batches:
        rows = []
        for d, text, ats in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
            text = text or b""
            if not ats.is_valid:
                rows.append((d, text, len(text), []))
                continue
            a, b = removed_ranges(np.asarray(ats.values))
            cuts = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
            kept = b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
            rows.append((d, kept, len(text), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], spans)],
            ["doc_id", "kept", "n_bytes", "removed"],
        )


def with_order(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` with uid, distinct documents (uid, text)): uid orders by doc_id, then by text digest.

    Where doc_ids are unique, which is checked, uid is doc_id.  Otherwise rows of equal doc_id and
    text are one document, and uids are numbered in order.
    """
    counts = docs.groupBy("doc_id").count().agg(F.max("count"), F.max(F.col("doc_id").isNull().cast("int"))).first()
    if (counts[0] or 0) <= 1 and not counts[1]:
        rows = docs.select("doc_id", F.col("doc_id").alias("uid"), "text")
        return rows, rows.select("uid", "text")
    keyed = docs.withColumn("tie", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ids = keyed.select("doc_id", "tie").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    ids = materialize(ids.select("doc_id", "tie", F.monotonically_increasing_id().alias("uid")), "uids")
    right = ids.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "uid")
    rows = keyed.join(right, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("doc_id", "uid", "text")
    return rows, rows.dropDuplicates(["uid"]).select("uid", "text")


def removable(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, at) pieces of runs whose windows all occur earlier, of ``docs`` (doc_id: unique longs, text)."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = materialize(counts.select("gram", (F.col("n") > hot).alias("hot")), "grams")
    del counts
    release(spark)
    rows = docs.mapInArrow(_runs, "gram long, doc_id long, at long")
    shared = materialize(rows.join(repeated, "gram").select("gram", "doc_id", "at", "hot"), "runs")  # a skewed gram is split by Spark
    del rows
    release(spark)
    # Plain rows, each document's text first: lists of runs, and a join with them, take the executors' heap.
    wanted = docs.select("doc_id", "text").unionByName(shared, allowMissingColumns=True).repartition("doc_id").sortWithinPartitions("doc_id", F.col("at").asc_nulls_first())
    cut = wanted.select("doc_id", "text", "gram", "at", "hot").mapInArrow(_cut, "gram long, doc_id long, at long, data binary")
    dealt = cut.repartition("gram").sortWithinPartitions("gram")
    pieces = materialize(dealt.mapInArrow(_suffixes, "doc_id long, at long"), "pieces")
    discard(repeated, shared)
    del cut, dealt, wanted
    release(spark)
    return pieces


def deduplicate(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, kept (binary: the remaining bytes), n_bytes, removed (array of struct(start, end): byte ranges)."""
    tune(docs.sparkSession)
    rows, distinct = with_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    pieces = removable(distinct.withColumnRenamed("uid", "doc_id"), hot)
    by_doc = pieces.groupBy(F.col("doc_id").alias("uid")).agg(F.collect_list("at").alias("ats"))  # of one document
    joined = rows.join(by_doc, "uid", "left").select("doc_id", "text", "ats")
    spans = "array<struct<start:bigint,end:bigint>>"
    return joined.mapInArrow(_clean, f"doc_id long, kept binary, n_bytes long, removed {spans}")


def digests(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
