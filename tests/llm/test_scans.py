import random
import zlib

import numpy as np
import pyarrow as pa
from brute import words

from shapeloom.llm import decontaminate as dc
from shapeloom.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(docs, items):
    out = {}
    norm = lambda t: "".join((c.lower() if "A" <= c <= "Z" else c) if ord(c) > 127 or c.isalnum() else " " for c in t or "").split(" ")
    norm_ = lambda t: [w for w in norm(t) if w]
    for d, text in docs:
        w = norm_(text)
        for i, item in items:
            m = norm_(item)
            most = dc.limit_of(len(m))
            for o in range(-most, len(w) - len(m) + most + 1) if m else ():
                if (e := distance(w[max(o, 0) : max(o + len(m), 0)], m)) <= most:
                    out[d, i] = min(e, out.get((d, i), 99))
    return out


def test_edits():
    rng = random.Random(3)
    rows = [[rng.randint(1, 3) for _ in range(12)] for _ in range(80)]
    m, n = (np.array([rng.randint(1, 12) for _ in range(40)]) for _ in range(2))
    m[:20] = n[:20]
    a, b = dc.padded([np.array(r[:k], np.uint64) for r, k in zip(rows[:40], m)]), dc.padded([np.array(r[:k], np.uint64) for r, k in zip(rows[40:], n)])
    got = dc.edits(a, b, m, n, 4)
    for x, y, k, j, e in zip(rows[:40], rows[40:], m, n, got):
        assert e == min(distance(x[:k], y[:j]), 5)


def edited(rng, item, count):
    w = list(item)
    for _ in range(count):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            w.insert(at, f"more{rng.randrange(10**6)}")
        elif len(w) > 2:
            del w[at]
    return w


def test_recall_at_the_limit(spark):
    """Windows at the very edit limit are found, and nothing beyond it is."""
    rng = random.Random(5)
    items = [[f"w{rng.randrange(500)}" for _ in range(rng.choice((3, 6, 12, 30, 60)))] for _ in range(60)]
    docs = []
    for k in range(600):
        item = items[k % 60]
        around = lambda: [f"x{rng.randrange(5000)}" for _ in range(rng.randrange(30))]
        docs.append((k, " ".join(around() + edited(rng, item, rng.randrange(dc.limit_of(len(item)) + 2)) + around())))
    index = dc.Items(list(range(60)), [" ".join(i) for i in items])
    got = {(docs[d][0], i): e for d, i, _, e in dc.match(index, pa.array([t for _, t in docs]))}
    want = {}
    for k, text in docs:
        want |= brute([(k, text)], [(k % 60, " ".join(items[k % 60]))])
    assert all(want[p] == e for p, e in got.items() if p in want)
    assert len(set(want) & set(got)) >= 0.99 * len(want) and len(want) > 300


def test_passages_at_the_ends_of_a_text():
    rng = random.Random(8)
    items = [[f"w{rng.randrange(300)}" for _ in range(50)] for _ in range(20)]
    index = dc.Items(list(range(20)), [" ".join(i) for i in items])
    docs = []
    for item in items:
        for cut in (1, 5, 10, 11):
            at = rng.randrange(len(item) - cut)
            less = item[:at] + item[at + cut :]
            more = [f"x{rng.randrange(10**5)}" for _ in range(30)]
            docs += [" ".join(less), " ".join(less + more), " ".join(more + less)]
    got = {(d, i): e for d, i, _, e in dc.match(index, pa.array(docs))}
    want = {k: e for d, text in enumerate(docs) for k, e in brute([(d, text)], [(d // 12, " ".join(items[d // 12]))]).items()}
    assert got.items() <= want.items() and len(got) >= 0.99 * len(want)
    assert all(want[d, d // 12] == (1, 5, 10)[d // 3 % 4] for d in range(240) if d // 3 % 4 < 3)


def test_repetitive_text_in_bounded_memory():
    import tracemalloc

    index = dc.Items(["a", "b"], ["same " * 100, "same other " * 30])
    text = "same " * 210_000
    tracemalloc.start()
    got = list(dc.match(index, pa.array([text, "other same " * 20_000])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(d, i, o, e) for d, i, o, e in got] == [(0, 0, 0, 0), (1, 1, 1, 0)] and peak < 400e6


def test_words_of_equal_hashes_differ():
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    index = dc.Items([1], [f"one {word} three four five"])
    got = list(dc.match(index, pa.array([f"one {other} three four five", f"one {word} three four five"])))
    assert got == [(1, 0, 0, 0)]


def test_items_in_blocks_and_other_ids(spark, monkeypatch):
    monkeypatch.setattr(dc, "ITEM_BYTES", 40)
    monkeypatch.setattr(dc.item_blocks, "__defaults__", (40,))
    docs = spark.createDataFrame([(k, f"x{k} alpha beta gamma delta x") for k in range(6)] + [(9, "else")], "doc_id int, text string")
    bench = spark.createDataFrame([(f"i{k}", f"x{k} alpha beta gamma") for k in range(4)] + [(None, "gamma delta")], "item_id string, text string")
    got = {(r.doc_id, r.item_id) for r in dc.find(docs, bench).collect()}
    assert got == {(k, f"i{k}") for k in range(4)} | {(k, None) for k in range(6)}
    assert [r.doc_id for r in dc.clean(docs, bench).collect()] == [9]


def test_decontamination_query(spark):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op7_decontaminate(spark, SF).collect()}
    # brute force over the documents that share a run of three words with an item
    runs = {tuple(w[k : k + 3]) for _, t in bench for w in [words(t.lower())] for k in range(len(w) - 2)}
    near = [d for d in docs if any(tuple(w[k : k + 3]) in runs for w in [words(d[1].lower())] for k in range(len(w) - 2)) and len(d[1]) < 6000]
    want = brute(near, bench)
    assert want and want == {k: v for k, v in got.items() if k[0] in {d for d, _ in near}}


def test_decontamination_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "one two three four five six seven", 5), (3, "one two three four five six seven", 5), (None, "ONE, two three; four five SIX", 5), (4, "solo " * 20000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, " "), (4, "seven"), (5, "one two three four five six")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in dc.find(docs, bench).collect()), key=str)
    assert got == sorted([(3, 1, 0), (3, 5, 0), (3, 4, 0)] * 2 + [(None, 1, 0), (None, 5, 0)], key=str)
    kept = dc.clean(docs, bench).collect()
    assert [r.doc_id for r in kept] == [1, 2, 4] and kept[0].item_id == 5
    assert dc.find(docs, bench.limit(0)).count() == 0 and dc.find(docs.limit(0), bench).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op10_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(p for p, y in held if y) >= 0.7 * sum(y for _, y in held)
    assert sum(p for p, y in held if not y) <= 0.01 * sum(not y for _, y in held)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "you idiot " * 3), (4, "fine day"), (4, "fine day"), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    some = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, some)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.limit(0), None).count() == 0


def test_a_feature_counts_once():
    from shapeloom.llm.common import blocks

    (block,) = blocks(pa.array(["a b a b a b", "", "b"]))
    doc, ids = toxicity.features(block)
    assert set(doc.tolist()) == {0, 2} and len(set(ids[doc == 0].tolist())) == 6


def brute_ftrl(texts, labels):
    """FTRL-proximal by plain loops over dictionaries: bucket -> weight (the bias at BUCKETS)."""
    from math import exp, log, sqrt

    from shapeloom.llm.common import blocks

    sets = []
    for t in texts:
        (block,) = blocks(pa.array([t]))
        sets.append([*sorted(set(toxicity.features(block)[1].tolist())), toxicity.BUCKETS])
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        if i < toxicity.BUCKETS:
            if abs(a) <= toxicity.L1:
                return 0.0
            a -= toxicity.L1 if a > 0 else -toxicity.L1
        return -a / ((toxicity.BETA + sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    rate = sum(labels) / len(labels)
    z[toxicity.BUCKETS] = -log(rate / (1 - rate)) * toxicity.BETA / toxicity.ALPHA
    rng = np.random.default_rng(1)
    for _ in range(toxicity.EPOCHS):
        for k in rng.permutation(len(sets)):
            w = {i: weight(i) for i in sets[k]}
            g = 1 / (1 + exp(-sum(w.values()))) - labels[k]
            for i in sets[k]:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (sqrt(old + g * g) - sqrt(old)) / toxicity.ALPHA * w[i]
                n[i] = old + g * g
    return {i: w for i in z if (w := weight(i))}


def labelled(count):
    rng = random.Random(9)
    word = lambda k: f"v{rng.randrange(k)}"
    rows = [(k, " ".join([word(60) for _ in range(rng.randrange(5, 20))] + [f"vile scum{k % 8} {word(3)}"] * (k % 4 == 0)), int(k % 4 == 0) ^ (k % 23 == 0)) for k in range(count)]
    return rows


def test_weights_against_plain_loops(spark):
    from pyspark.sql import functions as F

    rows = labelled(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = toxicity.fit(docs, labels)
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    rows.sort(key=lambda r: order[r[0]])
    want = brute_ftrl([r[1] for r in rows], [r[2] for r in rows])
    assert len(want) > 10 and set(np.flatnonzero(got).tolist()) == set(want)
    assert np.allclose([got[i] for i in want], list(want.values()), rtol=1e-4)


def test_one_id_of_very_many_rows(spark):
    rows = labelled(60)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(0, f"{rows[0][1]} w{k}") for k in range(500)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    few = toxicity.fit(docs, labels, 40)
    assert few is not None and few.any()
    assert np.array_equal(few, toxicity.fit(docs.repartition(7), labels, 40))
