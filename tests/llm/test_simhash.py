import random

import numpy as np
import pyarrow as pa
from brute import components, simhash

from shapeloom.llm import queries
from shapeloom.llm import simhash as op
from shapeloom.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def expected(docs, bits=2):
    """docs: (doc_id, text) -> {doc_id: (fingerprint, component)}."""
    fp = {d: simhash(t) for d, t in docs}
    distinct = sorted(set(fp.values()))
    rep = {f: min(d for d in fp if fp[d] == f) for f in distinct}
    pairs = [(rep[a], rep[b]) for i, a in enumerate(distinct) for b in distinct[:i] if bin(a ^ b).count("1") <= bits]
    root = components(pairs, rep.values())
    return {d: (f"{f:016x}", root[rep[f]]) for d, f in fp.items()}


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == expected(docs)


def test_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(9, None), (8, ""), (7, " \n"), (6, "one"), (5, "ONE"), (4, "one two"), (3, "É é"), (2, "é É"), (20, base), (21, base + " x"), (22, base + " y"), (30, "long " * 30000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fp string")
    got = op.groups(df.select("doc_id", "text")).collect()
    assert {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in got} == expected(rows)
    more = op.groups(df.union(df).unionByName(df.selectExpr("cast(null as long) doc_id", "text", "fp")).select("doc_id", "text")).collect()
    assert len(more) == 36 and {r.component_id for r in more} == {r.component_id for r in got}
    assert op.groups(df.limit(0)).count() == 0
    kept = op.keep_one(df.union(df)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.component_id for r in got}) and kept[0].fp == "z"


def near(rng, n):
    out = []
    for _ in range(n // 4):
        x = rng.getrandbits(64)
        out += [x, x ^ 1 << rng.randrange(64), x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), x ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64))]
    return sorted(set(out))


def test_trie_finds_all_pairs():
    rng = random.Random(2)
    v = np.array([x >> 21 for x in near(rng, 400)] + [x >> 52 for x in near(rng, 400)], np.uint64)
    v = np.unique(v)
    got = []
    op.trie_links(v, np.array([0, len(v)]), 0, 2, lambda i, j: got.extend(zip(i.tolist(), j.tolist())))
    want = [(i, j) for j in range(len(v)) for i in range(j) if int(v[i] ^ v[j]).bit_count() <= 2]
    assert sorted(got) == sorted(want)


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(4)
    fps = near(rng, 800) + [(7 << 61) + (x >> 30) for x in near(rng, 200)]
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2]
    want = components(pairs, fps)
    for hot in (op.HOT, 30):
        got = [((r.a % 2**64), (r.b % 2**64)) for r in op.links(df, hot=hot).collect()]
        assert all((a ^ b).bit_count() <= 64 for a, b in got) and components(got, fps) == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, -7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {n: r for n, r in components(edges, nodes | {5}).items() if n in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_arrow_stream_keeps_tasks_whole():
    rng = random.Random(8)
    rows = sorted({(t, x >> 21) for t in range(40) for x in near(rng, 12)})
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([0] * len(part)), pa.array(np.array([r[1] for r in part], np.uint64).view(np.int64))], ["task", "rot", "v"]) for part in (rows[i : i + 7] for i in range(0, len(rows), 7))]
    got = {(a % 2**64, b % 2**64) for out in op._join(2)(iter(batches)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    nodes = {x for _, x in rows}
    pairs = [(a, b) for t, a in rows for u, b in rows if t == u and a < b and (a ^ b).bit_count() <= 2]
    assert components(got, nodes) == components(pairs, nodes)


def jaccard_groups(docs, k=5):
    """(pairs of texts with similarity >= 0.8, {pair: similarity}) by an index of shingles."""
    sets, index, sim = {}, {}, {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
        for s in sets[d]:
            index.setdefault(s, []).append(d)
    seen = {(a, b) for ds in index.values() if len(ds) < 300 for i, b in enumerate(ds) for a in ds[:i]}
    for a, b in seen:
        sim[a, b] = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    return sim


def edited_copies():
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(60, 400)))) for k in range(300)]
    for k in range(900):
        w = docs[k % 300][1].split()
        for _ in range(max(1, int(len(w) * rng.choice((0.004, 0.01, 0.015))))):
            w[rng.randrange(len(w))] = word()
        docs.append((1000 + k, " ".join(w)))
    return docs


def test_similar_texts_are_found(spark):
    docs = edited_copies()
    got = {r.doc_id: r.component_id for r in op.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sim = jaccard_groups(docs)
    near = [p for p, s in sim.items() if s >= 0.8]
    assert len(near) > 300 and sum(got[a] == got[b] for a, b in near) >= 0.97 * len(near)
    linked = components([p for p, s in sim.items() if s >= 0.65], [d for d, _ in docs])
    assert all(linked[d] == linked[c] for d, c in got.items())


def linked_docs(similarities, seed):
    """Pairs of texts (2 k, 2 k + 1) of about the similarities asked for."""
    rng, docs = random.Random(seed), []
    word = lambda: f"w{rng.randrange(10**6)}"
    for k, s in enumerate(similarities):
        w = [word() for _ in range(400)]
        lost = round(396 * (1 - s) / (1 + s))  # shingles of each that the other lacks
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[: 400 - lost], *(word() for _ in range(lost))]))]
    return docs


def test_links_are_exact_about_the_threshold(spark):
    docs = linked_docs([0.74 + 0.001 * (k % 101) for k in range(606)], 21)
    got = {r.doc_id: r.component_id for r in op.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sim = jaccard_groups(docs)
    near = {p for p, s in sim.items() if s >= 0.8}
    found = {(d - 1, d) for d in got if d % 2 and got[d] == got[d - 1]}
    assert found <= near and len([p for p in near if sim[p] < 0.84]) > 150
    assert len(found) >= 0.98 * len(near) and all(got[d] == d for d in got if d % 2 == 0)


def test_all_pairs_of_a_group_in_blocks(spark):
    docs = edited_copies()[:600]
    sets = {d: op.shingle_set(t.encode(), 5) for d, t in docs}
    want = components([p for p, s in jaccard_groups(docs).items() if s >= 0.8], sets)
    groups = spark.createDataFrame([(d, 1) for d in sets], "fp long, root long")
    rows = spark.createDataFrame([(d, bytearray(s.tobytes())) for d, s in sets.items()], "fp long, set binary")
    for block in (op.BLOCK, 150):
        assert components([tuple(r) for r in op._closed(groups, rows, block).collect()], sets) == want


def test_repeats_count_once(spark):
    rng = random.Random(22)
    docs = []
    for k in range(40):
        w = [f"v{k}x{x}" for x in range(270)]
        at = rng.randrange(270)
        docs.append((k, " ".join(w[:at] + ["filler"] * 30 + w[at:])))
    got = op.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len({r.component_id for r in got}) == 40


def test_null_and_repeated_ids_keep_their_texts(spark):
    text = lambda k: " ".join(f"t{k}w{x}" for x in range(50))
    rows = [(None, text(k)) for k in range(6)] + [(None, text(0)), (None, text(1) + " end")] + [(7, text(k)) for k in range(10, 13)] + [(7, text(10)), (8, text(11)), (9, text(2))]
    kept = op.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 9
    assert sorted(((r.doc_id, r.text.split()[0]) for r in kept), key=str) == sorted([(None, f"t{k}w0") for k in (0, 1, 3, 4, 5)] + [(9, "t2w0")] + [(7, f"t{k}w0") for k in (10, 11, 12)], key=str)
