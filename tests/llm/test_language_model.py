from collections import Counter, defaultdict
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from brute import unigram_scores
from pyspark.sql import functions as F

from shapeloom.llm import language_model as lm
from shapeloom.llm import queries
from shapeloom.llm.common import blocks, fold_of

SF = "/root/testdata/sf0.001"
HELD = lambda: fold_of(F.col("doc_id"), 7) == 2


def check(got, docs):
    want = unigram_scores(docs)
    assert len(got) == len(docs)
    for r in got:
        held, n, known, train, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train), r.doc_id
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op8_language_model(spark, SF).collect(), docs)


def test_few_frequent_tokens(spark, monkeypatch):
    """Counts that are looked up by the join give the same sums as broadcast ones."""
    monkeypatch.setattr(lm, "FREQUENT", 40)
    monkeypatch.setattr(lm, "HELD_TOKENS", 50)
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    check(lm.score(df, HELD()).collect(), [tuple(r) for r in df.collect()])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A a b"), (5, "a B a"), (6, "É é"), (7, "w " * 50000), (10, "a")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row int")
    check(lm.score(df, HELD()).collect(), rows)
    assert len(lm.score(df.union(df), HELD()).collect()) == 16
    none = lm.score(df, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in none)
    assert lm.score(df.limit(0), HELD()).count() == 0


def test_better_than_the_base_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    got = [r for r in queries.op8_language_model(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.97 * sum(r.base_score for r in got)
    assert sum(r.score > r.base_score for r in got) > 0.9 * len(got)


def test_words_of_equal_hashes_are_counted_apart(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, f"{word} x"), (3, other), (4, f"{other} {other}"), (7, f"{word} {other}"), (10, "zzz " + other + "c")]
    check(lm.score(spark.createDataFrame(rows, "doc_id long, text string"), HELD()).collect(), rows)


def test_one_model_for_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    monkeypatch.setattr(lm, "SALTS", 1)
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 80").select("doc_id", "text")
    one, two = (sorted((r.doc_id, r.score) for r in lm.score(x, HELD()).collect()) for x in (df.coalesce(1), df.repartition(11)))
    assert one == two


class Brute:
    """The model from its description, token by token with plain loops."""

    def __init__(self, docs, fold):
        low = lambda t: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t).split(), lm.END]
        self.low, self.hash, self.tail = low, {}, {}
        for _, t in docs:
            for block in blocks(pa.array([t])):
                found = lm.Tokens(block)
                self.hash |= dict(zip(found.words.to_pylist(), found.hash.tolist()))
                self.tail |= dict(zip(found.words.to_pylist(), found.tail.tolist()))
        self.c = Counter(w for d, t in docs if not fold(d) for w in low(t))
        ranked = sorted(self.c, key=lambda w: (-self.c[w], w))
        self.own = {w: k for k, w in enumerate(ranked[: lm.OWN])}
        self.mass, self.types = Counter(), Counter()
        for w in ranked[lm.OWN :]:
            self.mass[self.tail[w]] += self.c[w]
            self.types[self.tail[w]] += 1
        self.n_rows = lm.rows_for(sum(self.c.values()))
        self.w = defaultdict(lambda: np.zeros(32))
        self.squares = defaultdict(lambda: float(lm.PRIOR))

    def leaf(self, w):
        return self.own.get(w, lm.OWN + self.tail[w])

    def features(self, words, k, cls):
        one, two, three = (self.hash[words[k - j]] if k >= j else int(lm.BEGIN) for j in (1, 2, 3))
        m = [int(x) for x in lm._MULT]
        row = lambda x: ((x * m[0] % 2**64) >> 32) * self.n_rows >> 32
        c = cls * int(lm._CLASS) % 2**64
        first = [("b1", 0), ("pair", row((one * m[2] + two * m[3]) % 2**64)), *(("skip", row(x)) for x in (one, two, three))]
        return first, [("b2", cls), ("near", row(one ^ c)), ("far", row((two ^ c) * m[1] % 2**64))]

    def predict(self, words, k):
        leaf = self.leaf(words[k])
        for rows, outcome in zip(self.features(words, k, leaf // 32), (leaf // 32, leaf % 32)):
            z = sum(self.w[r] for r in rows)
            p = np.exp(z - z.max())
            yield rows, outcome, p / p.sum()

    def learn(self, texts):
        sums = defaultdict(lambda: np.zeros(32))
        for t in texts:
            words = self.low(t)
            for k in range(len(words)):
                for rows, outcome, p in self.predict(words, k):
                    e = p * lm.GRAIN - lm.GRAIN * (np.arange(32) == outcome)
                    for r in rows:
                        sums[r] = sums[r] + np.rint(e) / lm.GRAIN
        for r, g in sums.items():
            self.squares[r] += (g * g).mean()
            self.w[r] = self.w[r] - lm.STEP * g / np.sqrt(self.squares[r])

    def score(self, t):
        words, total = self.low(t), 0.0
        for k, w in enumerate(words):
            total += sum(log10(p[outcome]) for _, outcome, p in self.predict(words, k))
            if w not in self.own:
                total += log10((self.c[w] + 1) / (self.mass[self.tail[w]] + self.types[self.tail[w]] + 1))
        return total


def test_scores_against_plain_loops(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40 and length(text) < 3000").select("doc_id", "text")
    fold = lambda d: crc32(str(d).encode()) % 7 == 2
    rounds = {r.doc_id: r.k for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(lm.ROUNDS)).alias("k")).collect()}
    docs = [tuple(r) for r in df.collect()]
    model = Brute(docs, fold)
    for k in range(lm.ROUNDS):
        model.learn([t for d, t in docs if not fold(d) and rounds[d] == k])
    got = {r.doc_id: r.score for r in lm.score(df, HELD()).collect()}
    for d, t in docs:
        assert got[d] == pytest.approx(model.score(t), rel=2e-3), d


def test_probabilities_sum_to_one():
    (block,) = blocks(pa.array(["one two three two one", "two three"] * 30))
    t = lm.Tokens(block)
    words, fit = lm.contexts(t.hash[t.code], t.first), lm.Descent(1 << 10)
    leaf = t.code * 100
    before = fit.model.log_prob(words, leaf).sum()
    for _ in range(5):
        g = lm.Gradient(fit.model)
        g.add(words, leaf)
        for part, w in g.sums.parts().items():
            at = np.flatnonzero(w.any(axis=1))
            fit.step(part, at, w[at])
    assert fit.model.log_prob(words, leaf).sum() > before / 2
    one = tuple(w[5:6] for w in words)
    total = sum(10 ** fit.model.log_prob(one, np.array([k]))[0] for k in range(lm.CLASSES * lm.SLOTS))
    assert total == pytest.approx(1, abs=1e-4)
    assert words[0][0] == lm.BEGIN and (words[1][:2] == lm.BEGIN).all() and words[0][6] == lm.BEGIN and words[2][3] == t.hash[t.code[0]]
    assert t.words.to_pylist() == ["one", "two", "three", lm.END] and t.code[:7].tolist() == [0, 1, 2, 1, 0, 3, 1]


def test_more_text_gives_more_rows():
    assert [lm.rows_for(n) for n in (0, 10, 10**6, 10**7, 5 * 10**7, 10**12)] == [lm.MIN_ROWS, lm.MIN_ROWS, lm.MIN_ROWS, 9765, 48828, lm.MAX_ROWS]


def vocabulary(words):
    (t,) = (lm.Tokens(b) for b in blocks(pa.array([" ".join(words)])))
    tail = dict(zip(t.words.to_pylist(), t.tail.tolist()))
    v = object.__new__(lm.Vocabulary)
    v.learn(pa.array(words, pa.string()), np.arange(len(words), 0, -1), np.array([tail[w] for w in words], np.int64))
    return v, tail


def test_looking_up_costs_the_words_of_the_block():
    from time import process_time

    words = [f"w{k}" for k in range(100_000)]
    v, tail = vocabulary(words)
    t = lm.Tokens(next(blocks(pa.array(["w7 w99999 new w600"]))))
    count, leaf = v.look_up(t)
    assert count.tolist() == [99_993, 1, -1, 99_400, -1]
    assert leaf.tolist()[:2] == [7, lm.OWN + tail["w99999"]] and leaf[3] == lm.OWN + tail["w600"]
    began = process_time()
    for _ in range(3):
        pa.compute.index_in(t.words, value_set=pa.array(words))  # hashes all known words
    three = process_time() - began
    began = process_time()
    for _ in range(30):
        v.look_up(t)
    assert process_time() - began < three


def test_looking_up_compares_bytes():
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for known in ([word, "x"], ["x", other], [word, other], [other, word, "x"]):
        v, _ = vocabulary(known)
        t = lm.Tokens(next(blocks(pa.array([f"{word} {other} x y"]))))
        assert t.hash[0] == t.hash[1]
        assert v.look_up(t)[0].tolist() == [len(known) - known.index(w) if w in known else -1 for w in (word, other, "x", "y", lm.END)]


def test_gradients_do_not_depend_on_the_stretches():
    (block,) = blocks(pa.array(["a b a a c " * 40, "", "b", "c a", "d e f g " * 30]))
    t, rng = lm.Tokens(block), np.random.default_rng(5)
    words, leaf = lm.contexts(t.hash[t.code], t.first), rng.integers(0, lm.CLASSES * lm.SLOTS, len(t.code))
    model = lm.Model(1 << 10)
    for w in model.parts().values():
        w[:] = rng.normal(0, 3, w.shape)
    want = None
    for size in (len(leaf), 1, 2, 7):
        g = lm.Gradient(model)
        for a in range(0, len(leaf), size):
            g.add(tuple(w[a : a + size] for w in words), leaf[a : a + size])
        got = np.concatenate([w.ravel() for w in g.sums.parts().values()])
        assert want is None or (got == want).all()
        want = got
