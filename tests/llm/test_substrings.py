import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from brute import repeats, sha

from shapeloom.llm import queries
from shapeloom.llm import substrings as op
from shapeloom.llm.common import powers

SF = "/root/testdata/sf0.001"


def result(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for w in (1, 7, 61, 200):
        assert op.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.op5_substrings(spark, SF).collect()) == repeats(docs)


def brute_factors(windows, bucket, position):
    share = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return [max([share(windows[i], windows[j]) for j in range(len(windows)) if bucket[j] == bucket[i] and position[j] < position[i]], default=0) for i in range(len(windows))]


@pytest.mark.parametrize("width", [1, 7, 8, 20, 100])
def test_longest_previous_factors(width):
    rng = np.random.default_rng(width)
    for letters in (1, 2, 3, 200):
        n = 150
        windows = rng.integers(0, letters, (n, width)).astype(np.uint8)
        copy = rng.integers(0, n, n // 2)
        windows[rng.integers(0, n, n // 2)] = windows[copy]
        bucket, position = rng.integers(0, 3, n), rng.permutation(n)
        want = brute_factors(windows.tolist(), bucket, position)
        assert op.longest_previous_factors(windows, bucket, position).tolist() == want
        floor = width // 2 + 1
        assert op.longest_previous_factors(windows, bucket, position, floor).tolist() == [w if w >= floor else 0 for w in want]


def test_texts_whose_rolling_hashes_are_equal(spark):
    """Two strings that differ but have the same polynomial hash modulo 2^64 are no copies."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = [(1, "x" * 150 + word), (2, "y" * 150 + other), (3, word[:700] + other[:700])]
    assert result(op.digests(op.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"))).collect()) == repeats(docs)


def test_a_passage_that_all_documents_hold(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, phrase = text(400), text(60)
    docs = [(k, text(rng.randrange(200)) + passage[rng.randrange(50) :] + text(40) + phrase + text(150)) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(12)
    for hot in (op.HOT, 20):
        assert result(op.digests(op.deduplicate(df, hot)).collect()) == repeats(docs)


def crossed():
    """Texts cut from few passages at random places, so that runs of many kinds share grams."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abé\0 ") for _ in range(rng.randrange(1, 9)))
    pool = ["".join(word() for _ in range(90)) for _ in range(5)] + ["ab" * 300, "x" * 400]
    docs = []
    for k in range(160):
        parts = []
        for _ in range(rng.randrange(4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randrange(40, 300)], word() * rng.randrange(4)]
        docs.append((k * 3 - 100, "".join(parts).replace("\0", chr(rng.randrange(1, 3)))))
    return docs + [(900, None), (901, ""), (902, "y" * 99), (903, "z" * 100), (904, "z" * 101), (905, "q" * 5000)]


@pytest.mark.parametrize("hot", [op.HOT, 3])
def test_crossed_passages(spark, hot):
    docs = crossed()
    random.Random(1).shuffle(docs)
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, gram string").repartition(7)
    got = op.deduplicate(df, hot)
    assert result(op.digests(got).collect()) == repeats(docs)


def test_repeated_rows_and_empty_tables(spark):
    docs = crossed()[:40]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    twice = op.digests(op.deduplicate(df.union(df))).collect()
    assert len(twice) == 80 and result(twice) == repeats(docs)
    text = "".join(map(str, range(200)))
    null = spark.createDataFrame([(None, text), (5, text), (5, text + "!")], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r for r in op.digests(op.deduplicate(null)).collect()}
    assert got[None, len(text)].n_removed == 0 and got[5, len(text)].n_removed == len(text) and got[5, len(text) + 1].kept_sha256 in (sha("!"), sha(""))
    assert op.deduplicate(df.limit(0)).count() == 0


def test_what_a_worker_holds_and_sends_is_bounded():
    """Memory grows neither with the texts of a batch nor with the rows that a task has gathered."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 100_000, np.uint8).tobytes().decode() for _ in range(40)]
    docs = pa.record_batch([pa.array(range(40), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    powers(1 << 20)  # kept by the worker, whatever it reads
    for task, batch in ((op._grams, docs.select(["text"])), (op._runs, docs)):
        tracemalloc.start()
        sent = [b.num_rows for b in task(iter([batch]))]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(sent) > 100_000 and max(sent) <= 1 << 14
        assert most < 40 << 20
