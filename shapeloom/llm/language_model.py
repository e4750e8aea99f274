"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

The probability of a token given the words before it is p(class) p(slot | class) p(token | slot).
The first two factors are softmaxes over CLASSES and SLOTS outcomes; their weights are rows of
hashed features.  For the class: the pair of words before, and skip features that the last
three words share, wherever they stand; for the slot: the word before and the one before that,
each together with the class.  The most frequent OWN tokens have slots of their own, all others share slots by
their last bytes, and share a slot's probability by add-one counts, as in the base score.

1. Counts of all tokens of the training rows: summed in every task, then by a grouped sum.  Tokens
   are counted, looked up and joined by their bytes; only features are hashed.
2. Weights: ROUNDS synchronous gradient updates.  Each takes the training rows of one hash class of
   (doc_id, text): tasks get the weights, return the gradients of the rows that they touched, which are
   summed in two levels, and the driver moves the weights (row-wise AdaGrad).  Gradients
   are rounded to multiples of a power of two, so that sums do not depend on their order: one
   input gives one model, however it is partitioned.
3. Scores: a pass over all texts in sparse numpy batches.  The FREQUENT most frequent tokens
   (bounded by that number) are broadcast with their counts; all others are looked up by a join.

The counts, which grow with the corpus, are complete.  The number of feature rows grows in proportion to the
training tokens, one for ROW_TOKENS of them, up to MAX_ROWS, which bounds the broadcast weights.

Defined results: a null or empty text has one token, its end; without training rows all counts
are 0; repeated rows and equal doc_ids are scored row by row; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapeloom.llm.common import Block, blocks, discard, materialize, prefix_hash, range_hash, release, tune

CLASSES = SLOTS = 32
OWN = 512
SHARED = CLASSES * SLOTS - OWN
FREQUENT = 1 << 18
ROW_TOKENS = 1024
MIN_ROWS, MAX_ROWS = 1 << 10, 1 << 17
BACK = 3
ROUNDS = 6
STEP = 0.35
#: Added to a row's squared gradients, in tokens: rows that few tokens touch move little.
PRIOR = 16.0
#: Gradients are multiples of 1 / GRAIN; sums of a batch are exact in 32-bit floats.
GRAIN = 512
# A round moves a weight by STEP times the root of a row's length at most: products of e to the weights stay within 32-bit floats.
assert ROUNDS * STEP * max(CLASSES, SLOTS) ** 0.5 * (BACK + 2) < 80
BATCH = 8192
#: Training tokens to a task and round, about; the number of tasks follows the input.
SHARD_TOKENS = 4_000_000
BLOCK_ROWS = 1024
SALTS = 16
#: Words of blocks that a counting task holds before it adds them up, and distinct ones before it sends them on.
HELD_TOKENS = 500_000
#: The end of a text as a token; no word holds a space.
END = " "
BEGIN = np.uint64(0x14057B7EF767814F)
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_CLASS = np.uint64(0xE7037ED1A0B428DB)


class Tokens:
    """The tokens of a block: ``code`` numbers each in ``words`` (an Arrow array; END is the last), ``first``: first token of each text.

    ``hash`` and ``tail``: of each word, a hash and the number of a shared slot by its last bytes.
    """

    def __init__(self, block: Block):
        starts, ends, first = block.words()
        inside = np.zeros(len(block.buf) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        data = block.lowered()[np.cumsum(inside[:-1], dtype=np.int8) > 0] if len(starts) else block.buf[:0]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        distinct = found.dictionary.cast(pa.string())
        at = first[1:]
        self.code = np.insert(np.asarray(found.indices).astype(np.int64), at, len(distinct))
        self.words = pa.concat_arrays([distinct, pa.array([END], pa.string())])
        self.first = first + np.arange(len(first))
        buf = np.frombuffer(self.words.buffers()[2], np.uint8)
        cuts = np.frombuffer(self.words.buffers()[1], np.int32)[: len(self.words) + 1].astype(np.int64)
        prefix = prefix_hash(buf[: cuts[-1]])
        self.hash = range_hash(prefix, cuts[:-1], cuts[1:])
        self.tail = (range_hash(prefix, np.maximum(cuts[:-1], cuts[1:] - 3), cuts[1:]) % np.uint64(SHARED)).astype(np.int64)


# ---------------------------------------------------------------- counts


def _count(batches):
    """Rows (text) -> (token, tail, n), every distinct token once for each time that a task's table is full."""
    held, size = [], 0

    def fold() -> pa.Table:
        # One thread has one hash table; a token has one tail.
        return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("tail", "min"), ("n", "sum")]).rename_columns(["token", "tail", "n"])

    for batch in batches:
        for block in blocks(batch.column(0)):
            t = Tokens(block)
            n = np.bincount(t.code, minlength=len(t.words))
            held.append(pa.table([t.words, pa.array(t.tail.astype(np.int32)), pa.array(n.astype(np.int64))], ["token", "tail", "n"]))
            size += len(t.words)
        if size > 2 * HELD_TOKENS:
            held = [fold()]
            size = len(held[0])
            pa.default_memory_pool().release_unused()  # workers are used again, by stages that need the room
            if size > HELD_TOKENS:
                yield from held[0].combine_chunks().to_batches(max_chunksize=50_000)
                held, size = [], 0
    if held:
        yield from fold().combine_chunks().to_batches(max_chunksize=50_000)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, tail, n): how often each token occurs in ``docs`` (text)."""
    rows = docs.select("text").mapInArrow(_count, "token string, tail int, n long")
    return rows.groupBy("token", "tail").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What all tasks need of the counts; its size is bounded by FREQUENT and the number of slots."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("n"), F.count("*")).first()
        self.tokens, self.types = int(total[0] or 0), int(total[1])
        # The least count with at most FREQUENT tokens at or above it, from a histogram of counts in steps of an eighth of an octave.
        step = F.floor(F.log2("n") * 8).cast("int")
        histogram = sorted(((r["k"], r["m"]) for r in counts.groupBy(step.alias("k")).agg(F.count("*").alias("m")).collect()), reverse=True)
        least, seen = None, 0
        for k, m in histogram:
            if seen + m > FREQUENT:
                break
            least, seen = k, seen + m
        rows = counts.where(step >= least).select("token", "tail", "n").collect() if least is not None else []  # FREQUENT at most
        rows.sort(key=lambda r: (-r["n"], r["token"]))
        self.learn(pa.array([r["token"] for r in rows], pa.string()), np.array([r["n"] for r in rows], np.int64), np.array([r["tail"] for r in rows], np.int64))
        sums, types = np.zeros(SHARED), np.zeros(SHARED)
        for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect():  # SHARED rows
            sums[r["tail"]], types[r["tail"]] = r["n"], r["m"]
        for r in rows[:OWN]:
            sums[r["tail"]] -= r["n"]
            types[r["tail"]] -= 1
        self.log_slot = np.concatenate([np.zeros(OWN), np.log10(sums + types + 1)])
        self.log_all = float(np.log10(self.tokens + self.types + 1))

    def learn(self, known: pa.Array, count: np.ndarray, tail: np.ndarray) -> None:
        """Keep the frequent tokens, given in descending order of their counts, in ascending order of their hashes."""
        h = np.concatenate([np.zeros(0, np.uint64), *(range_hash(prefix_hash(b.buf), b.off[:-1], b.off[1:]) for b in blocks(known))])
        order = np.argsort(h, kind="stable")
        leaf = np.where(np.arange(len(h)) < OWN, np.arange(len(h)), OWN + tail)
        self.known, self.hash = known.take(pa.array(order)), h[order]
        self.count, self.leaf = np.append(count[order], -1), np.append(leaf[order], 0)

    def look_up(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1 where not among the frequent, leaf) of each of the block's words.

        Hashes name the only place where a word may stand, its bytes decide.  Arrow's own look-up would hash all
        known words again for every block; it is asked only for words whose hash is another word's.
        """
        at = np.full(len(t.words), -1, np.int64)
        if len(self.hash):
            place = np.minimum(np.searchsorted(self.hash, t.hash), len(self.hash) - 1)
            maybe = np.flatnonzero(self.hash[place] == t.hash)
            words = t.words.take(pa.array(maybe))
            equal = np.asarray(pc.equal(words, self.known.take(pa.array(place[maybe]))), bool)
            at[maybe[equal]] = place[maybe[equal]]
            if not equal.all():
                others = pc.index_in(words.filter(pa.array(~equal)), value_set=self.known)
                at[maybe[~equal]] = np.asarray(pc.fill_null(others, -1))
        return self.count[at], np.where(at >= 0, self.leaf[at], OWN + t.tail)


# ---------------------------------------------------------------- model


def contexts(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first, second and third word before each token; BEGIN before the first of a text."""
    before = []
    for k in range(1, BACK + 1):
        x = np.empty_like(h)
        x[k:] = h[:-k]
        x[:k] = BEGIN
        for j in range(k):
            at = first[:-1] + j
            x[at[at < first[1:]]] = BEGIN
        before.append(x)
    return tuple(before)


def rows_for(tokens: int) -> int:
    """Rows of each kind of feature for so many training tokens."""
    return int(min(MAX_ROWS, max(MIN_ROWS, tokens // ROW_TOKENS)))


def hashed(x: np.ndarray, rows: int) -> np.ndarray:
    """Row numbers; 16 bits wide where that is enough, so that they are sorted by radix."""
    return (((x * _MULT[0]) >> np.uint64(32)) * np.uint64(rows) >> np.uint64(32)).astype(np.uint16 if rows <= 1 << 16 else np.uint32)


class Model:
    """``skip`` and ``pair`` hold rows of CLASSES weights, ``near`` and ``far`` rows of SLOTS weights; b1, b2 are biases."""

    def __init__(self, rows: int = MIN_ROWS, kind=np.float32):
        self.n_rows = rows
        self.skip, self.pair = (np.zeros((rows, CLASSES), kind) for _ in range(2))
        self.near, self.far = (np.zeros((rows, SLOTS), kind) for _ in range(2))
        self.b1, self.b2 = np.zeros((1, CLASSES), kind), np.zeros((CLASSES, SLOTS), kind)

    def parts(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in ("skip", "pair", "near", "far", "b1", "b2")}

    def log_prob(self, words: tuple[np.ndarray, ...], leaf: np.ndarray) -> np.ndarray:
        return Factors(self).log_prob(words, leaf)


class Factors:
    """e to the weights of a model: probabilities are products of rows, so that no token takes an exponential."""

    def __init__(self, model: Model):
        self.n_rows = model.n_rows
        for k, w in model.parts().items():
            setattr(self, k, np.exp(w))

    def rows(self, words: tuple[np.ndarray, ...], cls: np.ndarray) -> dict:
        """Row numbers of a stretch of tokens.

        ``skip`` is of the word before each.  The same row is that of the second word before the next token, and so on;
        ``odd`` lists for each further word the tokens for which it is not, and their rows.
        """
        one, two, _ = words
        c, n = cls.astype(np.uint64) * _CLASS, self.n_rows
        odd = []
        for k, w in enumerate(words[1:], 1):
            at = np.concatenate([np.arange(min(k, len(w))), k + np.flatnonzero(w[k:] != one[:-k])])
            odd.append((at, hashed(w[at], n)))
        return {"skip": hashed(one, n), "odd": odd, "pair": hashed(one * _MULT[2] + two * _MULT[3], n), "near": hashed(one ^ c, n), "far": hashed((two ^ c) * _MULT[1], n)}

    def odds(self, rows: dict, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: the classes, and the slots of its class, in proportion to their probabilities."""
        z1 = np.take(self.pair, rows["pair"], axis=0)
        z1 *= self.b1
        skip = np.take(self.skip, rows["skip"], axis=0)
        z1 *= skip
        for k, (at, r) in enumerate(rows["odd"], 1):
            shifted = np.empty_like(skip)
            shifted[k:] = skip[:-k]
            shifted[at] = np.take(self.skip, r, axis=0)
            z1 *= shifted
        z2 = np.take(self.b2, cls, axis=0)
        z2 *= np.take(self.near, rows["near"], axis=0)
        z2 *= np.take(self.far, rows["far"], axis=0)
        return z1, z2

    def log_prob(self, words: tuple[np.ndarray, ...], leaf: np.ndarray) -> np.ndarray:
        """log10 p(class) p(slot | class) of each token."""
        cls, slot = leaf // SLOTS, leaf % SLOTS
        total = 0.0
        for z, outcome in zip(self.odds(self.rows(words, cls), cls), (cls, slot), strict=True):
            own = z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + outcome]
            total = total + np.log10(own.astype(np.float64)) - np.log10(sums_of(z).astype(np.float64))
        return total

    def errors(self, words: tuple[np.ndarray, ...], leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        """Gradients of the tokens' class and slot logits, rounded to the grain, and the rows that they are for."""
        cls, slot = leaf // SLOTS, leaf % SLOTS
        rows = self.rows(words, cls)
        e1, e2 = self.odds(rows, cls)
        for e, outcome in ((e1, cls), (e2, slot)):
            e *= (GRAIN / sums_of(e))[:, None]
            e.reshape(-1)[np.arange(0, e.size, e.shape[1]) + outcome] -= GRAIN
            np.rint(e, out=e)
        return e1, e2, rows


def sums_of(z: np.ndarray) -> np.ndarray:
    """Sum of each row, whatever rows stand beside it."""
    return np.vecdot(z, np.ones(z.shape[1], z.dtype))


class Gradient:
    """Sums of the gradients of tokens in units of the grain; all sums are whole numbers."""

    def __init__(self, model: Model | Factors):
        self.factors = model if isinstance(model, Factors) else Factors(model)
        self.sums = Model(model.n_rows, np.float64)

    def add(self, words: tuple[np.ndarray, ...], leaf: np.ndarray) -> None:
        e1, e2, rows = self.factors.errors(words, leaf)
        # A word is among the BACK before each of the next tokens: where rows agree, its gradients are summed first.
        follow = e1.copy()
        for k, (at, r) in enumerate(rows["odd"], 1):
            follow[:-k] += e1[k:]
            inside = at[at >= k]
            follow[inside - k] -= e1[inside]
            self._rows("skip", r, e1[at])
        self._rows("skip", rows["skip"], follow)
        self._rows("pair", rows["pair"], e1)
        wide = e2.astype(np.float64)
        self._rows("near", rows["near"], wide)
        self._rows("far", rows["far"], wide)
        self._rows("b2", leaf // SLOTS, wide)
        self.sums.b1[0] += e1.sum(axis=0)

    def _rows(self, part: str, rows: np.ndarray, e: np.ndarray) -> None:
        """Add each of ``e`` to its row; two sums at a time, as a complex number."""
        sums, e = getattr(self.sums, part).view(np.complex128), np.ascontiguousarray(e, np.float64).view(np.complex128)
        at = np.add.outer(rows.astype(np.intp) * sums.shape[1], np.arange(sums.shape[1]))
        np.add.at(sums.reshape(-1), at.reshape(-1), e.reshape(-1))


class Descent:
    """Row-wise AdaGrad over summed gradients."""

    def __init__(self, rows: int):
        self.model = Model(rows)
        self.squares = {k: np.full(len(v), float(PRIOR)) for k, v in self.model.parts().items()}

    def step(self, part: str, at: np.ndarray, gradient: np.ndarray) -> None:
        """Move the rows ``at`` against their gradients, whole numbers of grains."""
        g = gradient / GRAIN
        self.squares[part][at] += np.square(g).mean(axis=1)
        getattr(self.model, part)[at] -= (STEP * g / np.sqrt(self.squares[part][at])[:, None]).astype(np.float32)


_PIECE = "part string, block long, rows binary, sums binary"


def _gradients(vocabulary, model):
    """Rows (text) -> the sums of the task's gradients, block by block of the rows that it touched."""

    def run(batches):
        vocab, gradient, some = vocabulary.value, Gradient(model.value), False
        for batch in batches:
            for block in blocks(batch.column(0)):
                some = True
                t = Tokens(block)
                leaf = vocab.look_up(t)[1][t.code]
                words = contexts(t.hash[t.code], t.first)
                for a in range(0, len(leaf), BATCH):
                    gradient.add(tuple(w[a : a + BATCH] for w in words), leaf[a : a + BATCH])
        if some:
            yield from _pieces({(part, a // BLOCK_ROWS): w[a : a + BLOCK_ROWS] for part, w in gradient.sums.parts().items() for a in range(0, len(w), BLOCK_ROWS)})

    return run


def _pieces(sums: dict):
    for (part, block), w in sums.items():
        at = np.flatnonzero(w.any(axis=1)).astype("<i4")
        if len(at):
            yield pa.RecordBatch.from_pydict({"part": [part], "block": [block], "rows": [at.tobytes()], "sums": [np.ascontiguousarray(w[at]).astype("<i8").tobytes()]})


def _add(batches):
    """Sum the blocks of a task; it holds one model at most."""
    sums: dict = {}
    for batch in batches:
        for part, block, at, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = np.frombuffer(at, "<i4")
            w = np.frombuffer(w, "<i8").reshape(len(at), -1)
            if (part, block) not in sums:
                sums[part, block] = np.zeros((BLOCK_ROWS, w.shape[1]), np.int64)
            sums[part, block][at] += w
    yield from _pieces(sums)


def train(docs: DataFrame, vocabulary, tokens: int) -> Model:
    """Fit over all rows of ``docs`` (doc_id, text), each in one round; ``vocabulary`` is a broadcast Vocabulary."""
    spark, fit = docs.sparkSession, Descent(rows_for(tokens))
    for k in range(ROUNDS if tokens else 0):
        model = spark.sparkContext.broadcast(Factors(fit.model))
        mine = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS)) == k).select("text")
        partial = mine.coalesce(max(6, tokens // ROUNDS // SHARD_TOKENS)).mapInArrow(_gradients(vocabulary, model), _PIECE)
        salted = partial.repartition("part", "block", F.pmod(F.xxhash64("sums"), F.lit(SALTS))).mapInArrow(_add, _PIECE) if tokens // ROUNDS // SHARD_TOKENS > SALTS else partial
        for r in salted.repartition("part", "block").mapInArrow(_add, _PIECE).toLocalIterator():  # one model
            at = np.frombuffer(r["rows"], "<i4")
            fit.step(r["part"], at + r["block"] * BLOCK_ROWS, np.frombuffer(r["sums"], "<i8").reshape(len(at), -1))
        model.destroy()
        del mine, partial, salted
        release(spark)
    return fit.model


# ---------------------------------------------------------------- scores

_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, score double, rare array<struct<token:string,n:int>>"


def _score(vocabulary, model):
    def run(batches):
        from pyspark import TaskContext

        vocab, lm = vocabulary.value, model.value
        row = TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int32())]))
        for batch in batches:
            got: dict[str, list] = {k: [] for k in ("n_tokens", "n_frequent", "base", "score", "lengths", "n")}
            rare = [pa.array([], pa.string())]
            for block in blocks(batch.column(2)):
                t = Tokens(block)
                first, per_word, leaf_of = t.first, *vocab.look_up(t)
                leaf = leaf_of[t.code]
                words = contexts(t.hash[t.code], first)
                p = np.concatenate([lm.log_prob(tuple(w[a : a + BATCH] for w in words), leaf[a : a + BATCH]) for a in range(0, len(leaf), BATCH)])
                known = (per_word >= 0)[t.code]
                log_count = np.log10(np.maximum(per_word, 0) + 1.0)[t.code]
                of_text = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731, B023  every text has a token
                got["n_tokens"].append(np.diff(first))
                got["n_frequent"].append(of_text(known.astype(np.int64)))
                got["base"].append(of_text(log_count))
                got["score"].append(of_text(p + np.where(leaf >= OWN, log_count, 0) - vocab.log_slot[leaf]))
                text = np.repeat(np.arange(block.n), np.diff(first))[~known]
                pair, n = np.unique(text * len(t.words) + t.code[~known], return_counts=True)
                got["lengths"].append(np.bincount(pair // len(t.words), minlength=block.n))
                got["n"].append(n.astype(np.int32))
                rare.append(t.words.take(pa.array(pair % len(t.words))))
            cat = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in got.items()}
            offsets = pa.array(np.concatenate([[0], np.cumsum(cat["lengths"])]).astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.concat_arrays(rare), pa.array(cat["n"].astype(np.int32))], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), batch.column(1), *[pa.array(cat[k]) for k in ("n_tokens", "n_frequent", "base", "score")], pa.ListArray.from_arrays(offsets, pairs, type=kind)],
                ["row", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "score", "rare"],
            )
            row += batch.num_rows

    return run


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text"))
    training = docs.where("not held_out")
    counts = materialize(count_tokens(training), "counts")
    release(spark)
    vocab = Vocabulary(counts)
    vocabulary = spark.sparkContext.broadcast(vocab)
    model = spark.sparkContext.broadcast(Factors(train(training, vocabulary, vocab.tokens)))
    release(spark)
    scored = materialize(docs.mapInArrow(_score(vocabulary, model), _SCORED), "scored")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.token", "x.n")
    found = rare.join(counts.select("token", F.col("n").alias("c")), "token")
    sums = found.groupBy("row").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"))
    sums = materialize(sums, "rare-sums")
    discard(counts)
    release(spark)
    joined = scored.drop("rare").join(sums, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * vocab.log_all).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
