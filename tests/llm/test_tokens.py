from zlib import crc32

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shapeloom.llm import queries, tokens

PATH = public_tokenizers.path(queries.TOKENIZER)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_coding_round_trip(values):
    v = np.array(values, np.uint32)
    control, data = tokens.pack(v)
    assert len(control) == -(-len(v) // 4)
    assert (tokens.unpack(control, data, len(v)) == v).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=9), max_size=6))
def test_many_at_once(stretches):
    n = np.array([len(s) for s in stretches], np.int64)
    flat = np.array([x for s in stretches for x in s], np.uint32)
    control, data = tokens.pack_many(flat, n)
    assert [tokens.pack(np.array(s, np.uint32)) for s in stretches] == list(zip(control, data))
    assert (tokens.unpack_many(control, data, n) == flat).all()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("aAÉéß×÷!.$'<2 \u030c\u0338J=…\n", max_size=40) | st.text("aé́ \n\t  'stré1²<|endoftext|>ΣςſK", max_size=60), min_size=1, max_size=8))
def test_words_alone_give_the_ids_of_the_text(texts):
    import pyarrow as pa

    enc = tokens.encoder(PATH)
    assert enc.by_word
    ids, n = enc.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [x for y in want for x in y]


def expected(rows):
    t, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(tuple(r) for r in queries.op9_tokens(spark, sf).collect()) == expected(rows)


def test_odd_rows(spark):
    texts = [None, "", " \n", "a", "<|endoftext|> x<|startoftext|>y", "Été́   x y", "w " * 70000]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, shard int, row string")
    assert sorted(tuple(r) for r in tokens.encoded(df, PATH).collect()) == expected(rows)
    assert tokens.encoded(df.limit(0), PATH).count() == 0
    twice = tokens.encoded(df.union(df).unionByName(df.selectExpr("cast(null as long) doc_id", "text", "shard", "row")), PATH).collect()
    assert len(twice) == 3 * len(rows)
    at = sorted((r.start, r.n_tokens) for r in twice)
    assert all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and at[0][0] == 0


def test_files_are_in_ascending_order(spark, tmp_path, monkeypatch):
    import re

    import pyarrow.parquet as pq

    monkeypatch.setattr(tokens, "BASE_SHARDS", 3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(9)
    path = str(tmp_path / "files")
    tokens.write(docs, path, PATH, shard_bytes=100_000)
    files = sorted((int(re.search(r"part-(\d+)", p.name)[1]), p) for p in (tmp_path / "files" / "data").glob("*.parquet"))
    ids, start = [], 0
    for _, file in files:
        table = pq.read_table(file).to_pydict()
        ids += table["doc_id"]
        assert table["start"] == [sum(table["n_tokens"][:k]) for k in range(len(table["start"]))] and len(set(table["shard"])) == 1
    assert len(files) > 8 and ids == sorted(ids) and len(ids) == docs.count()
    for r in sorted(tokens.read(spark, path).collect(), key=lambda r: (r.shard, r.row)):
        assert r.start == start and len(r.ids) == r.n_tokens
        start += r.n_tokens


def test_new_words_are_tokenized_together():
    import pyarrow as pa

    texts = ["a | b || c| <|endoftext|> x|y é| don't ̸ q̸ the=1", "|", "", *(f"w{k} zq{k * 7919}" for k in range(3000))]
    enc = tokens.Encoder(PATH)
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]

    class Counting:
        given = 0

        def encode_batch_fast(self, batch, **options):
            self.given += len(batch)
            return inner.encode_batch_fast(batch, **options)

    inner, enc.tokenizer = enc.tokenizer, Counting()
    for separator in (enc.separator, want[3][0], -1):  # the second is an id that words have
        alone, enc.separator, enc.tokenizer.given = enc.separator, separator, 0
        enc.forget()
        ids, n = enc.encode(pa.array(texts, pa.string()))
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [x for y in want for x in y]
        assert enc.tokenizer.given < 100 or separator != alone
