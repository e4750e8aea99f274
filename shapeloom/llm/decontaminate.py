"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

A text is contaminated by an item of n words if some window of n of its words is within
``floor(n * MAX_RATE)`` word edits of it (items under six words: equal).  Windows may reach over the
start or the end of the text by up to that many words, and then hold fewer words.  Words are A-Z
lower-cased and cut at ASCII characters that are no letters or digits.

1. Windows.  Every word offset starts a window of each item's size.  By the q-gram lemma a
   window within d edits of an item holds at least n - 2 - 3 d of its word triples; offsets without
   that many are skipped, and nothing is lost by it.
2. CGK.  A window walks through a random string: at step j it emits its current word and moves on
   if a random bit of (j, word) says so.  Windows that differ by few edits emit few different words.
3. Bit sampling.  ``SAMPLES`` emitted positions are compared; ``REPEATS`` independent walks
   bring the chance to miss a pair at the edit limit under one percent (measured in the tests).
4. Candidates are checked by exact edit distance (banded, many pairs at once), of words, not of hashes.

Texts are never shuffled; items are a small query set which is broadcast in blocks of at most
``ITEM_BYTES`` of text, every block against all rows; of several blocks, one is held at a time.  A
worker handles at most ``CHUNK`` windows at once, however repetitive texts and items are.

Defined results: null or empty texts and items match nothing; equal items are reported each;
repeated rows are reported each; an empty table gives no rows; extra columns stay as they are; ids of
items may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shapeloom.llm.common import PUNCTUATION, Block, blocks, materialize, mix, prefix_hash, range_hash, tune

MAX_RATE = 0.2
SAMPLES = 2
REPEATS = 24
ITEM_BYTES = 16 << 20
#: Windows that are compared at once, and shared triples that are listed at once.
CHUNK, HITS = 1 << 13, 1 << 21
_TRIPLE = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03))
#: Ids of what stands behind a window's end, and of words that no item has; items' words are numbered from 2.
_PAD, _OTHER = 0, 1


def limit_of(n: int) -> int:
    return int(n * MAX_RATE) if n >= 6 else 0


class Words:
    """The words of a block: their place in the lower-cased bytes, hashes, and the first word of each text."""

    def __init__(self, block: Block):
        starts, ends, self.first = block.words(PUNCTUATION)
        low = block.lowered()
        self.h = range_hash(prefix_hash(low), starts, ends)
        self.bytes, self.starts, self.ends = low.tobytes(), starts, ends

    def __getitem__(self, k: int) -> bytes:
        return self.bytes[self.starts[k] : self.ends[k]]


def triples(h: np.ndarray) -> np.ndarray:
    return mix(h[:-2] * _TRIPLE[0] + h[1:-1] * _TRIPLE[1] + h[2:]) if len(h) > 2 else np.zeros(0, np.uint64)


def walk(rows: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """The first ``steps`` words that the CGK embedding of each row emits; rows are padded with ``_PAD`` at the end."""
    m, width = rows.shape
    at, out = np.arange(m, dtype=np.int64) * width, np.empty((steps, m), np.uint64)
    last, flat = at + width - 1, np.ascontiguousarray(rows).ravel()
    for j in range(steps):
        word = flat[at]
        out[j] = word
        step = mix(word ^ np.uint64((seed * 0x9E3779B97F4A7C15 + j * 0xBF58476D1CE4E5B9) & (2**64 - 1))) >> np.uint64(63)
        at = np.minimum(at + step.astype(np.int64), last)
    return out


def picks(n: int, r: int) -> np.ndarray:
    """Positions of walk r that are sampled for items of n words; a walk has 3 n steps."""
    return np.random.default_rng((n, r)).integers(0, 3 * n, SAMPLES)


def padded(words: list[np.ndarray]) -> np.ndarray:
    """Arrays of words as rows of one array, with a pad at the end of each."""
    n = np.array([len(w) for w in words], np.int64)
    out = np.full((len(words), int(n.max(initial=0)) + 1), _PAD, np.uint64)
    if len(words):
        out[np.arange(out.shape[1]) < n[:, None]] = np.concatenate(words)
    return out


def edits(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, band: int) -> np.ndarray:
    """Edit distances of the first m words of the rows of ``a`` and the first n of ``b``, exact up to ``band`` (beyond: band + 1)."""
    big, width = band + 1, 2 * band + 1
    result = np.full(len(a), big, np.int32)
    diagonal = n - m + band + 1
    fits = (diagonal >= 1) & (diagonal <= width)
    prev = np.full((width + 2, len(a)), big, np.int32)  # row k + 1: cell (i, i + k - band)
    for k in range(band, width):
        prev[k + 1] = k - band
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for i in range(1, int(m.max(initial=0)) + 1):
        now = np.full((width + 2, a.shape[1]), big, np.int32)
        for k in range(width):
            j = i + k - band
            if j == 0:
                now[k + 1] = i
            elif 0 < j < len(b):
                best = prev[k + 1] + (a[i - 1] != b[j - 1])
                np.minimum(best, prev[k + 2] + 1, out=best)
                np.minimum(best, now[k] + 1, out=best)
                now[k + 1] = best
        prev = np.minimum(now, big)
        done = np.flatnonzero((m == i) & fits)
        result[done] = prev[diagonal[done], done]
    return result


class Items:
    """The items' words, the index of their distinct triples, and the sampled keys of their walks."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.vocabulary, rows, hashes = [], {}, [], []
        for block in blocks(pa.array(texts, pa.string())):
            words = Words(block)
            for k in range(block.n):
                a, b = int(words.first[k]), int(words.first[k + 1])
                if b > a:
                    self.ids.append(ids[block.first + k])
                    rows.append(np.array([self.vocabulary.setdefault(words[x], len(self.vocabulary) + 2) for x in range(a, b)], np.uint64))
                    hashes.append(words.h[a:b])
        self.rows = padded(rows)
        self.n = np.array([len(w) for w in rows], np.int64)
        self.limit = np.array([limit_of(len(w)) for w in rows], np.int64)
        #: Words to a gram: items of one or two words are found by their first.
        self.gram = np.where(self.n > 2, 3, 1)
        self.need = np.where(self.n > 2, np.maximum(1, self.n - 2 - 3 * self.limit), 1)
        self.index = {}
        for name, key_of, has in (("triples", lambda h: np.unique(triples(h)), lambda h: len(h) > 2), ("short", lambda h: mix(h[:1]), lambda h: len(h) <= 2)):
            found = [(key_of(h), k) for k, h in enumerate(hashes) if has(h)]
            key = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
            item = np.repeat(np.array([k for _, k in found], np.int64), [len(x) for x, _ in found])
            order = np.argsort(key, kind="stable")
            table = np.zeros(1 << 20, bool)
            table[(key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.index[name] = (key[order], item[order], table)
        self.picks, self.keys = [], []
        for r in range(REPEATS):
            at = np.array([picks(int(n), r) for n in self.n]).reshape(-1, SAMPLES)
            walked = walk(self.rows, int(at.max(initial=0)) + 1, r + 1)
            self.picks.append(at)
            self.keys.append(walked[at.T, np.arange(len(at))].T)

    def ranges(self, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``keys``, first and end in the index) of the keys that some item has."""
        key, _, table = self.index[name]
        at = np.flatnonzero(table[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(key, keys[at], "left"), np.searchsorted(key, keys[at], "right")
        some = hi > lo
        return at[some], lo[some], hi[some]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each, ``count`` values."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def stretches(items: Items, found: dict, first: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, item, first offset, end) of all windows that the q-gram lemma leaves, each once, of offsets in [lo, hi).

    Offsets before a text's first word belong to the range of that word.  Where too many triples are
    shared, halves of the range are looked at one after the other.
    """
    reach, parts = hi + int(items.n.max(initial=0)), []
    for name, (at, a, b) in found.items():
        x, y = np.searchsorted(at, [lo, reach])
        parts.append((name, at[x:y], a[x:y], b[x:y]))
    if sum(int((b - a).sum()) for _, _, a, b in parts) > HITS and hi - lo > 1024:
        mid = (lo + hi) // 2
        yield from stretches(items, found, first, lo, mid)
        yield from stretches(items, found, first, mid, hi)
        return
    for name, at, a, b in parts:
        if not len(at):
            continue
        item = items.index[name][1][spread(a, b - a)]
        at = np.repeat(at, b - a)
        text = np.searchsorted(first, at, "right") - 1
        order = np.lexsort((at, item, text))
        text, item, at = text[order], item[order], at[order]
        need, room = items.need[item], items.n[item] - items.gram[item]
        # From every shared triple to the one that completes the number: a window holds both if it starts between.
        other = np.minimum(np.arange(len(at)) + need - 1, len(at) - 1)
        fits = (np.arange(len(at)) + need <= len(at)) & (text[other] == text) & (item[other] == item) & (at[other] - at <= room)
        begin, end = at[other] - room, at + 1
        text, item, begin, end = text[fits], item[fits], begin[fits], end[fits]
        begin[1:] = np.where((text[1:] == text[:-1]) & (item[1:] == item[:-1]), np.maximum(begin[1:], end[:-1]), begin[1:])
        head, tail = first[text], first[text + 1]
        begin = np.maximum(begin, np.where(head >= lo, head - items.limit[item], lo))
        end = np.minimum(end, np.minimum(tail - items.n[item] + items.limit[item] + 1, hi))
        some = begin < end
        yield text[some], item[some], begin[some], end[some]


def rows_of(items: Items, words: Words, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The windows of words [begin, end) as rows of the items' word ids."""
    wide = np.arange(items.rows.shape[1])
    inside = wide < (end - begin)[:, None]
    at, place = np.unique((begin[:, None] + wide)[inside], return_inverse=True)
    of = items.vocabulary
    own = np.fromiter((of.get(words[k], _OTHER) for k in at.tolist()), np.uint64, len(at))
    rows = np.full(inside.shape, _PAD, np.uint64)
    rows[inside] = own[place]
    return rows


def candidates(items: Items, rows: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Which windows share all sampled positions with their item in at least one walk."""
    hit, left = np.zeros(len(rows), bool), np.arange(len(rows))
    for r in range(REPEATS):
        if not len(left):
            break
        at = items.picks[r][item[left]]
        walked = walk(rows[left], int(at.max()) + 1, r + 1)
        same = (walked[at.T, np.arange(len(left))].T == items.keys[r][item[left]]).all(axis=1)
        hit[left[same]] = True
        left = left[~same]
    return hit


def match(items: Items, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row of ``texts``, item, word offset, edits) of the best window of each contaminated pair: least edits, then first."""
    if not items.ids:
        return
    for block in blocks(texts):
        words = Words(block)
        if not len(words.h):
            continue
        found = {"triples": items.ranges("triples", triples(words.h)), "short": items.ranges("short", mix(words.h))}
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for text, item, begin, end in stretches(items, found, words.first, 0, len(words.h)):
            count = end - begin
            sums = np.cumsum(count)
            for x in range(0, int(sums[-1]) if len(sums) else 0, CHUNK):
                # windows x to x + CHUNK of those in the stretches
                p, q = np.searchsorted(sums, x, "right"), np.searchsorted(sums, min(x + CHUNK, int(sums[-1])) - 1, "right") + 1
                a, b = begin[p:q].copy(), end[p:q].copy()
                a[0] += x - (sums[p] - count[p])
                b[-1] -= max(0, int(sums[q - 1]) - (x + CHUNK))
                size = b - a
                _best(items, words, np.repeat(text[p:q], size), np.repeat(item[p:q], size), spread(a, size), best)
        for (doc, item), (e, offset) in sorted(best.items()):
            yield doc + block.first, item, offset, e


def _best(items: Items, words: Words, text: np.ndarray, item: np.ndarray, offset: np.ndarray, best: dict) -> None:
    """Enter the best windows into ``best``: (text, item) -> (edits, offset)."""
    pair = text * len(items.n) + item
    open_ = np.array([best.get((p // len(items.n), p % len(items.n)), (1, 0))[0] > 0 for p in np.unique(pair).tolist()], bool)
    use = open_[np.unique(pair, return_inverse=True)[1]]  # a pair with an equal window is done
    text, item, offset, pair = text[use], item[use], offset[use], pair[use]
    if not len(pair):
        return
    begin, end = np.maximum(offset, words.first[text]), np.minimum(offset + items.n[item], words.first[text + 1])
    rows, m = rows_of(items, words, item, begin, end), end - begin
    exact = (rows == items.rows[item]).all(axis=1)
    todo = np.flatnonzero(~np.isin(pair, pair[exact]))
    todo = todo[candidates(items, rows[todo], item[todo])]
    e = np.where(exact, 0, np.iinfo(np.int32).max)
    e[todo] = edits(rows[todo], items.rows[item[todo]], m[todo], items.n[item[todo]], int(items.limit[item[todo]].max(initial=0)))
    for x in np.flatnonzero(e <= items.limit[item]).tolist():
        key, now = (int(text[x]), int(item[x])), (int(e[x]), int(begin[x] - words.first[text[x]]))
        best[key] = min(best.get(key, now), now)


def item_blocks(benchmark: DataFrame, limit: int = ITEM_BYTES) -> Iterator[Items]:
    """The items in blocks of about ``limit`` bytes of text, so that each broadcast is bounded."""
    ids, texts, size = [], [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if texts and size + 4 * len(r["text"]) > limit:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += 4 * len(r["text"])
    if texts:
        yield Items(ids, texts)


def _in_turn(benchmark: DataFrame, step) -> Iterator[DataFrame]:
    """``step(broadcast)`` for each block of items; of several blocks, each is written before the next is made."""
    spark, parts = benchmark.sparkSession, item_blocks(benchmark)
    now = next(parts, None)
    while now is not None:
        held, after = spark.sparkContext.broadcast(now), next(parts, None)
        if after is None:
            yield step(held)
        else:
            yield materialize(step(held), "contaminated")
            held.destroy()
        now = after


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (in words), n_words, edits: one row for each contaminated pair."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    tune(spark)
    of_item = benchmark.schema["item_id"].dataType
    kinds = {"doc_id": LongType(), "item_id": of_item, "start": LongType(), "n_words": LongType(), "edits": LongType()}
    columns = StructType([StructField(c, t) for c, t in kinds.items()])
    kind = to_arrow_type(of_item)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def step(held):
        def run(batches):
            items = held.value
            for batch in batches:
                got = list(match(items, batch.column(1)))
                doc = batch.column(0).take(pa.array([g[0] for g in got], pa.int64()))
                rest = [[g[2] for g in got], [int(items.n[g[1]]) for g in got], [g[3] for g in got]]
                yield pa.RecordBatch.from_arrays([doc, pa.array([items.ids[g[1]] for g in got], kind), *[pa.array(x, pa.int64()) for x in rest]], list(kinds))

        return rows.mapInArrow(run, columns)

    out = spark.createDataFrame([], columns)
    for part in _in_turn(benchmark, step):
        out = out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns; no shuffle."""
    tune(docs.sparkSession)
    at, now = docs.columns.index("text"), [docs]

    def step(held):
        def run(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[g[0] for g in match(held.value, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        return now[0].mapInArrow(run, docs.schema)

    for part in _in_turn(benchmark, step):
        now[0] = part
    return now[0]
