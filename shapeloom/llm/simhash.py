"""SimHash near-duplicates by a binary trie self-join.

A text's fingerprint has the bits that are set in over half of the XXH64 values (seed 42) of its
word shingles, repeats included.  Texts of equal fingerprints are one class; classes link when
their fingerprints differ in at most ``MAX_BITS`` bits; the connected components of classes are
the groups.

Links are found in a binary trie over the fingerprints: a pair of nodes is expanded into pairs
of children, differing bits add up along the way, and a pair is dropped once it has more than
the budget.  To spread the trie over tasks, its bits are also read in two rotated orders: of
three blocks of bits, one at least must agree between fingerprints that differ in two bits, so
that each rotation starts below the nodes of its first block, and a task gets whole subtrees.
A subtree with over ``HOT`` fingerprints is cut into tasks for pairs of nodes eight levels down.
A task returns a spanning forest of its links, fewer than the fingerprints that it read.

``near_groups`` links texts by the similarity of their shingle sets instead (five words, 0.8 or
more): fingerprints of such texts differ in too many bits for one trie, so that tries over random
samples of a longer sketch find candidates, whose shingle sets are then compared.  First only a forest
of candidates is compared; where that leaves what candidates connect in several groups, all sets
of these are compared with each other.

Defined results: a null text is an empty one; texts without words have the fingerprint zero,
which links like any other; a text of fewer words than a shingle is one shingle; a component's
id is the smallest doc_id that is not null (null if there is none); repeated rows get their row
each; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeloom.llm.common import discard, materialize, mix, tune
from shapeloom.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: (left rotation, bits of the block that it puts first)
ROTATIONS = ((0, 21), (21, 21), (42, 22))
HOT = 1 << 20
_SUB_BITS = 8
#: Node pairs that are expanded at once; bounds a task's memory.
_FRONTIER = 1 << 15
#: A pair of nodes with so few pairs of leaves is compared leaf by leaf.
_DIRECT = 16
#: Pairs of leaves that are compared at once.
_PAIRS = 1 << 18


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, k: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six white-space characters
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0] + [e + 1 for e in ends[:-k]]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)]


def fingerprints(texts: list[bytes], k: int = SHINGLE) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    held, rows = [], []

    def flush():
        if not held:
            return
        n = np.array([len(h) for h in held])
        flat = np.fromiter((x for h in held for x in h), np.uint64, int(n.sum()))
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
        out[rows] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        held.clear()
        rows.clear()

    size = 0
    for i, text in enumerate(texts):
        if h := shingle_hashes(text, k):
            held.append(h)
            rows.append(i)
            size += len(h)
            if size > 100_000:
                flush()
                size = 0
    flush()
    return out


def fingerprint_rows(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(texts, k).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- the trie


def trie_links(v: np.ndarray, cuts: np.ndarray, depth: int, budget: int, found) -> None:
    """Call ``found(i, j)`` with arrays of linked positions of sorted ``v``, within segments [cuts[k], cuts[k+1]).

    Values of a segment share their first ``depth`` bits.
    """
    lo, hi = cuts[:-1], cuts[1:]
    many = hi - lo > 1
    stack = [(depth, np.stack([lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int64)]))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        d, f = stack.pop()
        if f.shape[1] > _FRONTIER:
            stack += [(d, f[:, i : i + _FRONTIER]) for i in range(0, f.shape[1], _FRONTIER)]
            continue
        a, b, c, e, err = f
        direct = (b - a) * (e - c) <= _DIRECT if d < 64 else np.ones(len(a), bool)
        if direct.any():
            _leaves(v, f[:, direct], budget, found)
            f = f[:, ~direct]
            a, b, c, e, err = f
        if not len(a):
            continue
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((v >> np.uint64(63 - d)) & np.uint64(1)).astype(np.int64)])
        s = ones[d]
        m, k = b - (s[b] - s[a]), e - (s[e] - s[c])
        same = a == c
        other = ~same
        kids = np.concatenate(
            [
                np.stack([a, m, c, k, err]),
                np.stack([m, b, k, e, err]),
                np.stack([a, m, k, e, err + 1]),
                np.stack([m, b, c, k, err + 1])[:, other],
            ],
            axis=1,
        )
        a, b, c, e, err = kids
        stack.append((d + 1, kids[:, (err <= budget) & (b > a) & (e > c) & ((a != c) | (b - a > 1))]))


def _leaves(v, f, budget, found) -> None:
    """Compare all leaves of node pairs, at most about _PAIRS pairs at a time."""
    a, b, c, e, _ = f
    n = (b - a) * (e - c)
    for k in np.flatnonzero(n > _PAIRS):  # many leaves of equal values
        step = max(1, _PAIRS // int(e[k] - c[k]))
        for x in range(int(a[k]), int(b[k]), step):
            _compare(v, np.array([x]), np.array([min(x + step, b[k])]), c[k : k + 1], e[k : k + 1], budget, found)
    rest = np.flatnonzero(n <= _PAIRS)
    cuts = np.searchsorted(np.cumsum(n[rest]), np.arange(_PAIRS, int(n[rest].sum()) + _PAIRS, _PAIRS), "right")
    for x, y in zip([0, *cuts[:-1]], cuts, strict=True) if len(rest) else ():
        take = rest[x:y]
        _compare(v, a[take], b[take], c[take], e[take], budget, found)


def _compare(v, a, b, c, e, budget, found) -> None:
    n, w = (b - a) * (e - c), e - c
    t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = np.repeat(a, n) + t // np.repeat(w, n), np.repeat(c, n) + t % np.repeat(w, n)
    good = (i < j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
    if good.any():
        found(i[good], j[good])


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def labels(self) -> np.ndarray:
        """Root of every position; paths become one step long."""
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def add(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that joined two trees."""
        r = self.labels()
        apart = r[i] != r[j]
        i, j = i[apart], j[apart]
        used = []
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            x, y = self.root(p), self.root(q)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                used.append((p, q))
        return used


def _spanning(v: np.ndarray, group: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, root) of a spanning forest of the links within equal consecutive ``group`` values."""
    cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(v)]])
    forest = Forest(len(v))
    trie_links(v, cuts, min(bits for _, bits in ROTATIONS), budget, forest.add)
    at = np.flatnonzero(forest.parent != np.arange(len(v)))
    return at, np.array([forest.root(x) for x in at.tolist()], np.int64)


def _join(budget: int):
    def run(batches):
        """Rows (task, rot, fp) sorted by task and rotated fingerprint -> links (a, b) of fingerprints."""
        held: list[np.ndarray] = []

        def links(task, rot, v):
            if not len(v):
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
            at, root = _spanning(v, task, budget)
            turn = np.array([r for r, _ in ROTATIONS], np.uint64)[rot]
            back = (v >> turn) | np.where(turn > 0, v << ((np.uint64(64) - turn) & np.uint64(63)), np.uint64(0))
            fp = back.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root])], ["a", "b"])

        for batch in batches:
            now = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)).view(np.uint64)]
            held.append(now)
            task = now[0]
            if not len(task) or task[-1] == held[0][0][0]:
                continue  # the task that is open goes on
            last = int(np.searchsorted(task, task[-1], "left")) if task[0] != task[-1] else 0
            done = [np.concatenate([*(h[k] for h in held[:-1]), now[k][:last]]) for k in range(3)]
            yield links(*done)
            held = [[x[last:] for x in now]]
        if held:
            yield links(*[np.concatenate([h[k] for h in held]) for k in range(3)])

    return run


def links(classes: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough of them to connect what the budget connects."""
    if max_bits >= len(ROTATIONS):
        raise ValueError("the budget must be less than the number of rotations")
    turned = F.array(
        *[
            F.struct(
                F.lit(k).alias("rot"),
                (F.shiftleft("fp", r).bitwiseOR(F.shiftrightunsigned("fp", 64 - r)) if r else F.col("fp")).alias("v"),
            )
            for k, (r, _) in enumerate(ROTATIONS)
        ]
    )
    rows = classes.select(F.explode(turned).alias("x")).select("x.rot", "x.v")
    bits = F.element_at(F.array(*[F.lit(b) for _, b in ROTATIONS]), F.col("rot") + 1)
    rows = rows.withColumn("key", F.col("rot").cast("long") * (1 << 23) + F.call_function("shiftrightunsigned", F.col("v"), 64 - bits))
    big = [r["key"] for r in rows.groupBy("key").count().where(F.col("count") > hot).select("key").collect()]  # fewer than 3 rows / hot
    task = F.shiftleft("key", 2 * _SUB_BITS)
    if big:
        masks = [m for m in range(1 << _SUB_BITS) if bin(m).count("1") <= max_bits]
        sub = F.call_function("shiftrightunsigned", F.col("v"), 64 - bits - _SUB_BITS).bitwiseAND(F.lit((1 << _SUB_BITS) - 1))
        pair = lambda m: F.shiftleft(F.least(sub, sub.bitwiseXOR(m)), _SUB_BITS).bitwiseOR(F.greatest(sub, sub.bitwiseXOR(m)))
        tasks = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.shiftleft("key", 2 * _SUB_BITS).bitwiseOR(pair(m)))
        rows = rows.select("rot", "v", F.explode(F.when(F.col("key").isin(big), tasks).otherwise(F.array(task))).alias("task"))
    else:
        rows = rows.select("rot", "v", task.alias("task"))
    # Unsigned order of v: its sign bit is flipped for sorting.
    dealt = rows.repartition("task").sortWithinPartitions("task", F.col("v").bitwiseXOR(F.lit(-(1 << 63)))).select("task", "rot", "v")
    return dealt.mapInArrow(_join(max_bits), "a long, b long")


# ---------------------------------------------------------------- similar texts: tries over samples of a longer sketch

#: Five-word shingles, and the bits of a sketch that candidates may differ in, of SKETCH_WORDS * 64: two sets of similarity
#: s have cosine 2 s / (1 + s), and a bit differs with probability arccos(cosine) / pi, 58 +- 7 of 384 at 0.8.
NEAR_SHINGLE = 5
#: Numerator and denominator of the least similarity of a link.
NEAR = (4, 5)
#: Sets of a group that a task compares with each other.
BLOCK = 4096
SKETCH_WORDS = 6
NEAR_BITS = 85
#: Every table reads SAMPLED random bits of the sketch into a trie; pairs agree in the first EXACT of them, which name the
#: task, and differ in BUDGET of the rest.  A pair that differs in 58 bits is in one table with probability 0.19, so in one
#: of TABLES with 0.999; one that differs in 72 bits with 0.97.
TABLES, SAMPLED, EXACT, BUDGET = 32, 32, 8, 4
_SKETCH = [f"s{j}" for j in range(SKETCH_WORDS)]


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.array(shingle_hashes(text, k), np.uint64))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH_WORDS fingerprints of each shingle set, from independent hashes of its shingles."""
    out = np.zeros((len(sets), SKETCH_WORDS), np.uint64)
    at = 0
    while at < len(sets):
        held, size, first = [], 0, at
        while at < len(sets) and size < 100_000:
            held.append(sets[at])
            size += len(held[-1])
            at += 1
        n = np.array([len(h) for h in held])
        rows = np.flatnonzero(n) + first
        n = n[n > 0]
        flat = np.concatenate(held)
        for j in range(SKETCH_WORDS if len(n) else 0):
            h = mix(flat + np.uint64(j * 0x9E3779B97F4A7C15 & (2**64 - 1))) if j else flat
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64)
            out[rows, j] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _sketch_rows(k: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(b or b"", k) for b in batch.column(1).cast(pa.binary()).to_pylist()]
            fp = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            found = sketches(sets).view(np.int64)
            words = (pa.array(np.ascontiguousarray(found[:, j])) for j in range(SKETCH_WORDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:4], pa.array(fp), *words], ["doc_id", "h1", "h2", "fp", *_SKETCH])

    return run


def _tables(batches):
    """Rows (fp, sketch) -> a row for each table: (task, v, fp, sketch); v has the sampled bits below its sign."""
    picks = [np.random.default_rng((17, t)).permutation(64 * SKETCH_WORDS)[:SAMPLED] for t in range(TABLES)]
    for batch in batches:
        words = np.stack([np.asarray(c).view(np.uint64) for c in batch.columns[1:]], axis=1)
        for t, pick in enumerate(picks):
            v = np.zeros(len(words), np.uint64)
            for x in pick:
                v = v << np.uint64(1) | (words[:, x // 64] >> np.uint64(x % 64)) & np.uint64(1)
            task = (t << EXACT) + (v >> np.uint64(SAMPLED - EXACT)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array((v << np.uint64(63 - SAMPLED)).view(np.int64)), *batch.columns], ["task", "v", *batch.schema.names])


def _near_join(most: int):
    """Rows sorted by (task, v) -> a forest of pairs (a, b) of fps whose sketches differ in ``most`` bits at most, for each stretch of tasks."""

    def pairs_of(parts):
        task, v, fp = (np.concatenate([np.asarray(p[k]) for p in parts]) for k in range(3))
        words = np.stack([np.concatenate([np.asarray(p[3 + j]) for p in parts]) for j in range(SKETCH_WORDS)], axis=1).view(np.uint64)
        forest, used = Forest(len(v)), []

        def check(i, j):
            r = forest.labels()
            apart = r[i] != r[j]
            i, j = i[apart], j[apart]
            for x in range(0, len(i), 1 << 17):
                p, q = i[x : x + (1 << 17)], j[x : x + (1 << 17)]
                bits = np.bitwise_count(words[p] ^ words[q]).sum(axis=1)
                near = np.flatnonzero(bits <= most)
                near = near[np.argsort(bits[near], kind="stable")]  # the most similar first
                used.extend(forest.add(p[near], q[near]))

        cuts = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1, [len(v)]])
        trie_links(v.view(np.uint64), cuts, 1 + EXACT, BUDGET, check)
        return _pairs(fp, used)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            now, task = batch.columns, np.asarray(batch.column(0))
            held.append(now)
            size += len(task)
            if size < 20_000 or not len(task) or task[-1] == np.asarray(held[0][0])[0]:
                continue
            last = int(np.searchsorted(task, task[-1], "left"))
            if last == 0 and len(held) == 1:
                continue
            yield pairs_of([*held[:-1], [c.slice(0, last) for c in now]])
            held, size = [[c.slice(last) for c in now]], len(task) - last
        if held:
            yield pairs_of(held)

    return run


def _pairs(fp: np.ndarray, used: list[tuple[int, int]]) -> pa.RecordBatch:
    """Rows (a, b), a < b, of pairs of positions in ``fp``."""
    found = np.sort(fp[np.array(used, np.int64).reshape(-1, 2)], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])


def _all_pairs(batches):
    """Rows (root, lo, hi, block, fp, set) sorted by the first three -> a forest of pairs (a, b) of similar sets within each group.

    If lo and hi differ, only pairs of both blocks are compared.
    """

    def pairs_of(lo, hi, rows):
        block, fp = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64)
        order = np.argsort(block, kind="stable")
        sets = [np.frombuffer(rows[x][2], np.uint64) for x in order]
        block, fp = block[order], fp[order]
        size = np.array([len(x) for x in sets])
        ends = np.cumsum(size)
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
        has, forest, used = np.zeros(int(ids.max(initial=-1)) + 1, bool), Forest(len(sets)), []
        second = int(np.searchsorted(block, hi))
        for i in range(len(sets) - 1 if lo == hi else second):
            j = max(i + 1, second) if lo != hi else i + 1
            if j == len(sets):
                break
            mine = ids[ends[i] - size[i] : ends[i]]
            has[mine] = True
            both = np.add.reduceat(has[ids[ends[j - 1] :]], ends[j:] - size[j:] - ends[j - 1], dtype=np.int64)
            has[mine] = False
            for x in (np.flatnonzero(NEAR[1] * both >= NEAR[0] * (size[i] + size[j:] - both)) + j).tolist():
                p, q = forest.root(i), forest.root(x)
                if p != q:
                    forest.parent[max(p, q)] = min(p, q)
                    used.append((i, x))
        return _pairs(fp, used)

    key, rows = None, []
    for batch in batches:
        for root, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (root, lo, hi) != key:
                if rows:
                    yield pairs_of(*key[1:], rows)
                key, rows = (root, lo, hi), []
            rows.append(row)
    if rows:
        yield pairs_of(*key[1:], rows)


def _candidates(classes: DataFrame, most: int) -> DataFrame:
    """Distinct pairs (a, b) of rows (fp, sketch) that connect all candidates which the tables find."""
    columns = ", ".join(f"{c} long" for c in classes.columns)
    tasks = classes.mapInArrow(_tables, f"task long, v long, {columns}")
    found = tasks.repartition("task").sortWithinPartitions("task", "v").mapInArrow(_near_join(most), "a long, b long")
    return materialize(found.distinct(), "candidates")


def _set_rows(k: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(b or b"", k).tobytes() for b in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["fp", "set"])

    return run


def _similar(batches):
    """Rows (a, b, shingle set of a, of b) -> pairs of similarity NEAR or more."""
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for x, (p, q) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            good[x] = similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64))
        yield batch.select([0, 1]).filter(pa.array(good))


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets, sorted, have a Jaccard similarity of NEAR or more."""
    (above, below), least = NEAR, min(len(p), len(q))
    if below * least < above * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return below * both >= above * (len(p) + len(q) - both)


def _sets(pairs: DataFrame, rows: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """fp, set of the fps in pairs (a, b); one text of each is read again."""
    fps = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    reps = rows.join(fps, "fp", "left_semi").groupBy("fp").agg(F.min("key").alias("key")).select("fp", "key.doc_id", "key.h1", "key.h2")
    texts = docs.join(reps, docs.doc_id.eqNullSafe(reps.doc_id) & (docs.h1 == reps.h1) & (docs.h2 == reps.h2)).select("fp", "text")
    return materialize(texts.mapInArrow(_set_rows(k), "fp long, set binary").dropDuplicates(["fp"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of fps whose shingle sets are similar."""
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return materialize(both.mapInArrow(_similar, "a long, b long"), "verified")


def _closed(groups: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links (a, b) enough to connect all similar sets within each group (fp, root); tasks compare at most two blocks of a group."""
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / block).alias("n"))
    rows = groups.join(sizes, "root").join(sets, "fp").withColumn("block", F.pmod(F.xxhash64("fp"), "n"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = rows.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp", "set")
    dealt = rows.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    return materialize(dealt.mapInArrow(_all_pairs, "a long, b long"), "closed")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"))


def _near_classes(docs: DataFrame, k: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows: fp, key; edges: a, b) of texts; rows of equal keys are equal texts of one doc_id."""
    tune(docs.sparkSession)
    docs = _keyed(docs)
    columns = ", ".join(f"{c} long" for c in _SKETCH)
    found = docs.mapInArrow(_sketch_rows(k), f"doc_id long, h1 long, h2 long, fp long, {columns}")
    key = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h1", "h2").alias("key")
    rows = materialize(found.select("fp", key, *_SKETCH), "sketches")
    classes = rows.groupBy("fp").agg(*[F.min(c).alias(c) for c in _SKETCH])
    pairs = _candidates(classes, most)
    sets = _sets(pairs, rows, docs, k)
    edges = _verified(pairs, sets)
    # Where the forest's pairs connect more than the verified ones do, pairs beside the forest may link as well.
    loose, tight = materialize(connected_components(pairs), "loose"), materialize(connected_components(edges), "tight")
    at = loose.join(tight.withColumnRenamed("root", "own"), "node", "left").select("node", "root", F.coalesce("own", "node").alias("own"))
    split = at.groupBy("root").agg(F.min("own").alias("x"), F.max("own").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2").select("root")
    more = _closed(at.join(split, "root", "left_semi").select(F.col("node").alias("fp"), "root"), sets, BLOCK)
    discard(pairs, sets, loose, tight)
    return rows.select("fp", "key"), edges.unionByName(more)


def near_groups(docs: DataFrame, k: int = NEAR_SHINGLE, most: int = NEAR_BITS) -> DataFrame:
    """doc_id, fp (of the shingle set), component_id: texts whose shingle sets have a similarity of 0.8 or more are linked."""
    rows, edges = _near_classes(docs, k, most)
    labelled = _labels(rows.select("fp", F.col("key.doc_id").alias("doc_id")), edges, "doc_id")
    return rows.join(labelled, "fp").select("key.doc_id", "fp", "component_id")


def groups(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id of each row of ``docs`` (doc_id, text)."""
    rows = materialize(fingerprint_rows(docs, k), "fingerprints")
    classes = materialize(rows.select("fp").distinct(), "distinct")
    out = _label(rows, links(classes, max_bits))
    discard(classes)
    return out


def _label(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Component ids of rows (doc_id, fp) whose fps are linked by ``edges``."""
    return rows.join(_labels(rows, edges, "doc_id"), "fp").select("doc_id", "fp", "component_id")


def _labels(rows: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """fp, component_id: the least ``key`` of the rows whose fps are linked by ``edges``."""
    classes = materialize(rows.groupBy("fp").agg(F.min(key).alias("rep")), "classes")
    found = materialize(connected_components(edges), "components")
    joined = found.join(classes, found.node == classes.fp).select("node", "root", "rep")
    lowest = joined.groupBy("root").agg(F.min("rep").alias("low"))
    linked = found.join(lowest, "root").select(F.col("node").alias("fp"), "low")
    labelled = materialize(classes.join(linked, "fp", "left").select("fp", F.least("rep", "low").alias("component_id")), "labels")
    discard(classes, found)
    return labelled


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each group of similar texts: that of the least doc_id (nulls last), then text hash."""
    rows, edges = _near_classes(docs.select("doc_id", "text"), NEAR_SHINGLE, NEAR_BITS)
    kept = _labels(rows, edges, "key").select("component_id.*").distinct().select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "h1", "h2")])
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.withColumn("_k1", F.xxhash64(text)).withColumn("_k2", F.xxhash64(text, F.lit(1)))
    same = own.doc_id.cast("long").eqNullSafe(kept._doc_id) & (own._k1 == kept._h1) & (own._k2 == kept._h2)
    return own.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_k1", "_k2"]).drop("_k1", "_k2")


def hex_of(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
