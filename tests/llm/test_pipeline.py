from collections import Counter

import corpus_pipeline as cp
from brute import components, words
from test_simhash import jaccard_groups
from test_tokens import expected as expected_tokens

from shapeloom.llm import mixing, quality, queries
from shapeloom.llm.common import documents, materialize

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = documents(spark, SF)
    out = []
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = materialize(stage(spark, docs, SF), f"test-{k}")
        out.append(docs)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == cp.COLUMNS
    rows = [[r.asDict() for r in x.collect()] for x in out]
    kept = {r.doc_id for r in quality.judge(documents(spark, SF)).where("kept").collect()}
    assert {r["doc_id"] for r in rows[0]} == kept and len(rows[0]) == len(kept)
    sim = jaccard_groups([(r["doc_id"], r["text"]) for r in rows[0]])
    one = {r["doc_id"] for r in rows[1]}
    assert len(one) == len(rows[1]) and one <= kept
    assert not [p for p, s in sim.items() if s >= 0.85 and p[0] in one and p[1] in one]
    loose = components([p for p, s in sim.items() if s >= 0.65], kept)
    assert {loose[d] for d in kept} == {loose[d] for d in one}
    leaks = {r.doc_id for r in queries.op7_decontaminate(spark, SF).collect()}
    assert {r["doc_id"] for r in rows[2]} == {r["doc_id"] for r in rows[1]} - leaks
    times = Counter(r["doc_id"] for r in rows[3])
    copies = mixing.assign_copies(out[2], mixing.text_size()).collect()
    assert times == Counter({r.doc_id: r.copies for r in copies if r.copies})
    text = {r["doc_id"]: r["text"] for r in rows[2]}
    assert all(text[r["doc_id"]] == r["text"] and r["n_chars"] == len(r["text"]) for r in rows[3])
    assert abs(sum(len(words(r["text"])) for r in rows[3]) - 1.5 * sum(len(words(t)) for t in text.values())) < 0.1 * sum(len(words(t)) for t in text.values())
    want = expected_tokens(sorted((r["doc_id"], r["text"]) for r in rows[3]))
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows[4]) == want


def test_run_gives_the_last_stage(spark):
    got = cp.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
    ends = sorted((r.start, r.n_tokens) for r in got.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_stages_with_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, None, "a", None)] + [(3, "Some words stand here, and more follow. " * 3, "en", None, 117)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        x = table
        for name, stage in cp.STAGES:
            own = stage(spark, table, SF)
            assert own.count() <= 2 * len(rows), name
            x = materialize(stage(spark, x, SF), "odd")
        assert x.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
