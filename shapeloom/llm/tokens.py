"""Token ids in files: frequency-ranked, byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the corpus (most frequent first, ties by id), so that frequent
ids take one byte.  Ranks are coded four to a control byte; its two-bit fields hold the number
of data bytes less one.  Control bytes and data bytes are kept apart, and both directions are
numpy table look-ups over whole documents.

Files: a Parquet folder ``data`` (a file for each shard, files and their rows in ascending doc_id
order: shard, row, doc_id, start in the shard, n_tokens, control, data) and a folder ``vocab`` (rank, id,
count).  Parquet is only the container; it is what lets executors write to any store with Spark's
commit protocol.

Texts are tokenized word by word: the normalizer and the splitter of the tokenizer never look
across white space, so the ids of a text are those of its words in order, and each worker asks
the tokenizer for a word once.  ``split_is_safe``
checks that the loaded tokenizer is of that kind; others get whole texts.

Defined results: a null or empty text has the end id only; rows of equal doc_id are ordered by
text; a null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapeloom.llm.common import Block, blocks, discard, materialize, new_path, release, tune

END_ID = 2
#: Text bytes that are tokenized at once; the more, the fewer look-ups of frequent words.
PIECE_BYTES = 2 << 20
#: Distinct words whose ids a Python worker keeps; when it is full, words that came in one block only go.
CACHE_WORDS = 750_000
#: New words that the tokenizer gets as one text, and what stands between them.
JOINED_WORDS = 1000
SEPARATOR = "|"
#: Text bytes in a shard, about; a shard is a range of doc_id, a task and a file.
SHARD_BYTES = 128 << 20
#: Shards whose sums are added up by one task when documents are read.
BASE_SHARDS = 1024

# ---------------------------------------------------------------- tokenizing

_worker: dict = {}


def split_is_safe(spec: dict) -> bool:
    """Whether ASCII white space always separates: NFC, lower case and a white-space-free split, nothing else."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = norm.get("normalizers", [norm])
    fine = all(s.get("type") in ("NFC", "Lowercase") or (s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " ") for s in steps)
    cuts = pre.get("pretokenizers", [pre])
    first = cuts[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s" in (first.get("pattern") or {}).get("Regex", "")
    rest = all(c.get("type") == "ByteLevel" and not c.get("add_prefix_space") and not c.get("use_regex") for c in cuts[1:])
    added = all(not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return bool(fine and drops and rest and added and not spec.get("post_processor"))


#: Splitter for which ``units`` cuts words further; a fixed value.
_LETTERS_DIGITS_REST = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_letters(spec: dict) -> bool:
    """Whether the tokenizer lowers all letters and always separates letters or digits from the rest."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return any(s.get("type") == "Lowercase" for s in steps) and (cuts[0].get("pattern") or {}).get("Regex") == _LETTERS_DIGITS_REST


_GAP, _ALNUM, _WILD = (np.zeros(256, bool) for _ in range(3))
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM[[b for b in range(256) if b >= 0x80 or chr(b).isalnum()]] = True
_WILD[[0x27, 0x3C, *(b for b in range(0xC0, 0x100) if b != 0xC3)]] = True


def units(block: Block) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased pieces of the block's words, cut between letters or digits and other characters; pieces per text.

    Only words of ASCII and the letters U+00C0 to U+00FF are cut and lowered.  Words with an
    apostrophe (contractions), with ``<`` (special tokens) or with other characters (which may
    combine) stay as they are.
    """
    buf, off = block.buf, block.off
    starts, ends, _ = block.words()
    after_c3 = np.zeros(len(buf), bool)
    after_c3[1:] = buf[:-1] == 0xC3
    wild = _WILD[buf] | (after_c3 & ((buf == 0x97) | (buf == 0xB7)))
    sums = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(wild, out=sums[1:])
    odd = sums[ends] > sums[starts]
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts[odd]] += 1
    edge[ends[odd]] -= 1
    as_is = np.cumsum(edge[:-1], dtype=np.int8) > 0
    lowered = block.lowered()
    lowered = np.where(after_c3 & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97), lowered + np.uint8(0x20), lowered)
    lowered = np.where(as_is, buf, lowered)
    gap, letter = _GAP[buf], _ALNUM[buf]
    begins = np.zeros(len(buf), bool)
    begins[1:] = (letter[1:] != letter[:-1]) & ~gap[1:] & ~gap[:-1] & ~as_is[1:]
    begins[starts] = True
    first = np.flatnonzero(begins)
    solid = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(~gap, out=solid[1:])
    offsets = np.append(solid[first], solid[-1]).astype(np.int32)
    data = lowered[~gap]
    pieces_ = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
    return pieces_, np.diff(np.searchsorted(first, off))


class Encoder:
    """Ids of texts as one flat array and the number of ids of each text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core; threads of the library's own would only get in each other's way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = split_is_safe(spec)
        self.by_unit = self.by_word and cuts_letters(spec)
        self.tokenizer = Tokenizer.from_file(path)
        alone = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.separator = alone[0] if self.by_word and len(alone) == 1 else -1
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts, self.lengths, self.blocks = (np.zeros(1 << 12, np.int64) for _ in range(3))

    def _purge(self) -> None:
        """Keep the words of two blocks or more; forget all if these are most of the cache."""
        n = len(self.index)
        keep = np.flatnonzero(self.blocks[:n] > 1)
        if len(keep) > CACHE_WORDS // 2:
            return self.forget()
        words = list(self.index)
        take, long = self.starts[keep], self.lengths[keep]
        ends = np.cumsum(long)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(take - (ends - long), long)]
        self.index = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.flat, self.used = np.concatenate([flat, np.zeros(1 << 16, np.uint32)]), len(flat)
        grow = lambda x: np.concatenate([x, np.zeros(1 << 12, np.int64)])
        self.starts, self.lengths, self.blocks = grow(ends - long), grow(long), grow(np.zeros(len(keep), np.int64))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words without SEPARATOR, and how many each has; None if one of them has the separator's id."""
        joined = [f" {SEPARATOR} ".join(words[k : k + JOINED_WORDS]) for k in range(0, len(words), JOINED_WORDS)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array([*x, self.separator], np.uint32) for x in self._ids(joined))])
        mark = ids == self.separator
        cuts = np.flatnonzero(mark)
        if len(cuts) != len(words):
            return None
        return ids[~mark], np.diff(cuts, prepend=-1) - 1

    def _add(self, new: list[str]) -> None:
        apart = np.array([self.separator < 0 or SEPARATOR in x for x in new], bool)
        found = self._together([x for x, a in zip(new, apart.tolist(), strict=True) if not a])
        if found is None:
            apart[:], found = True, (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        others = self._ids([x for x, a in zip(new, apart.tolist(), strict=True) if a])
        n, base = np.concatenate([found[1], np.array([len(x) for x in others], np.int64)]), len(self.index)
        place = base + np.argsort(apart, kind="stable")
        total = int(n.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while base + len(new) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.blocks = np.concatenate([self.blocks, np.zeros_like(self.blocks)])
        self.flat[self.used : self.used + total] = np.concatenate([found[0], np.fromiter(chain.from_iterable(others), np.uint32)])
        self.starts[place] = self.used + np.cumsum(n) - n
        self.lengths[place] = n
        self.used += total
        self.index.update(zip(new, range(base, base + len(new)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([x for y in ids for x in y], np.uint32), np.array([len(x) for x in ids], np.int64)
        if self.by_unit:
            both = [units(block) for block in blocks(texts, PIECE_BYTES)]
            flat = pa.concat_arrays([x[0] for x in both]) if both else pa.array([], pa.string())
            per_text = np.concatenate([x[1] for x in both]) if both else np.zeros(0, np.int64)
        else:
            lists = pc.ascii_split_whitespace(texts)
            flat, per_text = lists.flatten(), np.diff(np.asarray(lists.offsets))
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        if len(self.index) + len(words) > CACHE_WORDS:
            self._purge()
        own = np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))
        unseen = np.flatnonzero(own < 0)
        if len(unseen):
            own[unseen] = np.arange(len(self.index), len(self.index) + len(unseen))
            self._add([words[k] for k in unseen.tolist()])
        self.blocks[own] += 1
        starts, lengths, index = self.starts[own].astype(np.int32), self.lengths[own].astype(np.int32), np.asarray(coded.indices)
        n = np.take(lengths, index)
        sums = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=sums[1:])
        take = np.repeat(np.take(starts, index) - sums[:-1], n)
        take += np.arange(len(take), dtype=np.int32)
        first = np.concatenate([[0], np.cumsum(per_text)])
        return np.take(self.flat, take), (sums[first[1:]] - sums[first[:-1]]).astype(np.int64)


def encoder(path: str) -> Encoder:
    if path not in _worker:
        _worker[path] = Encoder(path)
    return _worker[path]


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of about PIECE_BYTES of text."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    ends, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to every text."""
    ends = np.cumsum(n)
    return np.insert(ids, ends, end).astype(np.uint32), n + 1


# ---------------------------------------------------------------- the coding

_LENGTHS = np.stack([np.arange(256) >> (2 * k) & 3 for k in range(4)], axis=1) + 1  # of 4 values, by control byte


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values; 1 to 4 data bytes each."""
    control, data = pack_many(values, np.array([len(values)]))
    return control[0], data[0]


def pack_many(values: np.ndarray, n: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """``pack`` of consecutive stretches of n values each: (control bytes, data bytes) of every stretch."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF) + (values > 0xFFFF).astype(np.int64) + (values > 0xFFFFFF)
    groups = -(-n // 4)
    control_ends, ends = np.cumsum(groups), np.cumsum(n)
    place = np.arange(len(values)) + np.repeat(4 * (control_ends - groups) - (ends - n), n)
    fields = np.zeros(4 * int(control_ends[-1]) if len(n) else 0, np.uint8)
    fields[place] = size - 1
    f = fields.reshape(-1, 4)
    control = (f[:, 0] | f[:, 1] << 2 | f[:, 2] << 4 | f[:, 3] << 6).astype(np.uint8).tobytes()
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()
    sums = np.concatenate([[0], np.cumsum(size)])
    cuts, data_cuts = [0, *control_ends.tolist()], sums[np.concatenate([[0], ends])].tolist()
    return [control[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], [data[x:y] for x, y in zip(data_cuts[:-1], data_cuts[1:], strict=True)]


def unpack_many(control: list[bytes], data: list[bytes], n: np.ndarray) -> np.ndarray:
    """The values of all stretches that ``pack_many`` coded, by table look-up."""
    groups, ends = -(-n // 4), np.cumsum(n)
    size = _LENGTHS[np.frombuffer(b"".join(control), np.uint8)].ravel()
    size = size[np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(4 * (np.cumsum(groups) - groups) - (ends - n), n)]
    starts = np.cumsum(size) - size
    b = np.frombuffer(b"".join(data) + b"\0\0\0", np.uint8)
    out = b[starts].astype(np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        out[has] |= b[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    return unpack_many([control], [data], np.array([count]))


# ---------------------------------------------------------------- the operator

_FILE_COLUMNS = "shard long, row long, doc_id long, start long, n_tokens long, control binary, data binary"


_STAGED = "shard long, row long, doc_id long, start long, n_tokens long, ids binary, counts binary"


def _tokenize(tokenizer: str, end_id: int):
    """Rows (doc_id, text) in order -> a row for each with its ids, and one with the counts of all ids of the task."""

    def run(batches):
        from pyspark import TaskContext

        enc, row, start, sums = encoder(tokenizer), 0, 0, np.zeros(1 << 16, np.int64)
        shard = TaskContext.get().partitionId()
        kinds = {"ids": pa.binary(), "counts": pa.binary()}
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids, n = with_end(*enc.encode(piece.column(1).fill_null("")), end_id)
                ends = np.cumsum(n)
                if ids.max() >= len(sums):
                    sums = np.concatenate([sums, np.zeros(int(ids.max()) + 1 - len(sums), np.int64)])
                sums += np.bincount(ids, minlength=len(sums))
                raw = ids.astype("<u2" if ids.max() < 1 << 16 else "<u4")
                columns = {
                    "shard": np.full(len(n), shard, np.int64),
                    "row": np.arange(row, row + len(n)),
                    "doc_id": piece.column(0),
                    "start": start + ends - n,
                    "n_tokens": n,
                    "ids": pa.array([raw[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], kinds["ids"]),
                    "counts": pa.nulls(len(n), kinds["counts"]),
                }
                yield pa.RecordBatch.from_pydict(columns)
                row, start = row + len(n), start + int(ends[-1])
        if row:
            last = {c: pa.nulls(1, pa.int64()) for c in ("shard", "row", "doc_id", "start", "n_tokens")}
            yield pa.RecordBatch.from_pydict(last | {"ids": pa.nulls(1, kinds["ids"]), "counts": pa.array([sums.astype("<i8").tobytes()])})

    return run


def _sum_counts(batches):
    sums = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            n = np.frombuffer(raw, "<i8")
            if len(n) > len(sums):
                sums = np.concatenate([sums, np.zeros(len(n) - len(sums), np.int64)])
            sums[: len(n)] += n
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(sums[at])], ["id", "n"])


def _pack_rows(ranks):
    def run(batches):
        of = ranks.value
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            raw, n = c["ids"].to_pylist(), np.asarray(c["n_tokens"])
            narrow = all(len(x) == 2 * k for x, k in zip(raw, n.tolist(), strict=True))
            ids = np.frombuffer(b"".join(raw), "<u2") if narrow else np.concatenate([np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4") for x, k in zip(raw, n, strict=True)])
            coded = [pa.array(x, pa.binary()) for x in pack_many(of[ids], n)]
            yield pa.RecordBatch.from_arrays([*(c[k] for k in ("shard", "row", "doc_id", "start", "n_tokens")), *coded], ["shard", "row", "doc_id", "start", "n_tokens", "control", "data"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``docs`` (doc_id, text) into the folder ``path``.

    Texts are tokenized once, in order; their ids wait in the shared folder until all are counted.
    The coded rows are dealt by shard number, so that the files are in the order of the shards.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // shard_bytes)
    tie = F.xxhash64("text")
    dealt = docs.repartitionByRange(shards, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    staged = materialize(dealt.mapInArrow(_tokenize(tokenizer, end_id), _STAGED), "ids", compression="zstd")
    del dealt
    release(spark)
    found = staged.where("counts is not null").select("counts").mapInArrow(_sum_counts, "id long, n long")
    counts = sorted(((r["id"], r["n"]) for r in found.groupBy("id").agg(F.sum("n").alias("n")).collect()), key=lambda x: (-x[1], x[0]))  # the vocabulary at most
    spark.createDataFrame([(k, i, n) for k, (i, n) in enumerate(counts)], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/vocab")
    ranks = np.zeros(max((i for i, _ in counts), default=0) + 1, np.uint32)
    ranks[[i for i, _ in counts]] = np.arange(len(counts))
    packed = staged.where("ids is not null").mapInArrow(_pack_rows(spark.sparkContext.broadcast(ranks)), _FILE_COLUMNS)
    ordered = packed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "row")
    ordered.write.option("compression", "none").parquet(f"{path}/data")
    discard(staged)


def read(spark: SparkSession, path: str, reduce=None, schema: str = "ids array<int>") -> DataFrame:
    """Documents of a folder: shard, row, doc_id, start (ids of all documents before it), n_tokens and ``reduce`` of the ids.

    ``reduce`` maps the uint32 ids of a document to the value of the one further column that ``schema`` names.
    """
    data, reduce = spark.read.parquet(f"{path}/data"), reduce or (lambda ids: ids.astype(np.int32))
    ids_of = np.array([r["id"] for r in spark.read.parquet(f"{path}/vocab").orderBy("rank").collect()], np.uint32)  # bounded by the vocabulary
    table = spark.sparkContext.broadcast(ids_of)
    kind = spark.createDataFrame([], schema).schema

    def decode(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        out = to_arrow_type(kind[0].dataType)
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            n = np.asarray(c["n_tokens"])
            ids, ends = table.value[unpack_many(c["control"].to_pylist(), c["data"].to_pylist(), n)], np.cumsum(n)
            got = [reduce(ids[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c["shard"], c["row"], c["doc_id"], c["start"], c["n_tokens"], pa.array(got, out)], ["shard", "row", "doc_id", "start", "n_tokens", kind[0].name])

    # Ids before each shard: sums within groups of shards, and of the groups.
    sums = data.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("group", F.floor(F.col("shard") / BASE_SHARDS))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("group").agg(F.sum("n").alias("n")).select("group", before(Window.orderBy("group")).alias("all"))
    base = sums.withColumn("own", before(Window.partitionBy("group").orderBy("shard"))).join(groups, "group").select("shard", (F.col("own") + F.col("all")).alias("base"))
    found = data.mapInArrow(decode, f"shard long, row long, doc_id long, start long, n_tokens long, {schema}")
    return found.join(base, "shard").withColumn("start", F.col("start") + F.col("base")).drop("base")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs``, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, tokenizer, end_id)
    return read(spark, path, crc, "ids_crc32 long").select("doc_id", "start", "n_tokens", "ids_crc32")

