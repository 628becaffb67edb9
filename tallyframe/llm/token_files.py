"""Token ids in files: frequency-ranked ids in a byte-aligned variable-length code.

Every id of the corpus is replaced by its rank by frequency (ties by id), so that common ids are
small numbers. A rank takes one to four bytes, least first; two bits in a separate control stream say
how many. Files hold one row per document in ascending ``doc_id`` order: ``doc_id, shard, start`` (within
the shard)``, n_tokens, control, data``, in the folder ``ids``; ``ids_by_rank`` has the id of each rank.
Reading looks control bytes up in a table and gathers the data with numpy. Spark's own committer writes
the files, so tasks that are lost or run twice leave no partial output.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import ChunkTable, by_batch, doc_ends, documents, shared, word_lists, written

#: How many data bytes each of the four numbers of a control byte has.
BYTES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
#: So many rows of two numbers are broadcast at most.
BROADCAST_SHARDS = 200_000
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint64)


def word_encoder(path: str):
    """Ids of texts without white space. The vocabulary drops white space before it merges anything,
    so a text is encoded word by word, each distinct one once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda words: [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]


def fewer_words(texts: pa.Array) -> pa.Array:
    """Texts with the same ids and fewer distinct words: small ASCII letters, and a space before
    punctuation that follows a letter or digit, where the tokenizer cuts anyway. Texts that may hold a
    special token, or marks that a letter can be composed with, stay as they are."""
    cut = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z0-9])([!-&(-/:-@\[-`{-~])", r"\1 \2")
    keep = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, r"\p{M}"))
    return pc.if_else(keep, texts, cut)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, tie, ids``: all ids of every text and the end id, as little-endian numbers of two bytes
    (four if the vocabulary needs them); ``tie`` is a hash of the text that orders equal ``doc_id``s."""
    kind = id_type(path, end_id)

    def build():
        table = shared(("words", path), lambda: ChunkTable(word_encoder(path)))

        def run(batch):
            words, per_doc = word_lists(fewer_words(batch.column("text").fill_null("")))
            ids, ends = table.join(table.of(words))
            ends = doc_ends(ends, per_doc)
            data = np.insert(ids, ends, end_id).astype(kind)
            ends = (ends + np.arange(1, len(ends) + 1)) * data.itemsize
            return pa.record_batch([batch.column("doc_id"), batch.column("tie"), ragged(data, ends)],
                                   ["doc_id", "tie", "ids"])
        return run
    rows = documents(docs).withColumn("tie", F.xxhash64("text"))
    return by_batch(rows, build, "doc_id long, tie long, ids binary")


def id_type(path: str, end_id: int) -> str:
    return "<u2" if max(vocabulary_size(path), end_id + 1) <= 1 << 16 else "<u4"


def ragged(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``data`` as binary values; ``ends`` counts bytes."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def id_counts(ids: DataFrame, kind: str) -> DataFrame:
    """How often each id occurs: (id, n)."""
    def build():
        def run(batch):
            counts = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
            at = np.flatnonzero(counts)
            return pa.record_batch([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["id", "n"])
        return run
    return by_batch(ids.select("ids"), build, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def to_streams(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each rank, data stream)."""
    v = ranks.astype("<u4")
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    return size, v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]


def control_stream(size: np.ndarray) -> bytes:
    code = np.zeros(-(-len(size) // 4) * 4, np.uint8)
    code[:len(size)] = size - 1
    return (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()


def from_streams(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again, by table lookup."""
    size = BYTES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    value = np.zeros(n, np.uint64)
    for k in range(int(size.max(initial=0))):
        value |= raw[start + k].astype(np.uint64) << np.uint64(8 * k)
    return value & MASKS[size]


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 1) -> None:
    """Encode every whole text, end each document with ``end_id`` and write the files to ``out``.

    Null and empty texts are the end id alone; a null ``doc_id`` comes first; rows that share a
    ``doc_id`` keep a fixed order, by a hash of the text. An empty table gives empty files.
    The ranks are as many as the vocabulary has entries, so they pass through the driver.
    """
    spark, kind = docs.sparkSession, id_type(tokenizer_path, end_id)
    staged = written(encoded(docs, tokenizer_path, end_id), "token-ids")
    ids = [r.id for r in sorted(id_counts(staged, kind).collect(), key=lambda r: (-r.n, r.id))]
    spark.createDataFrame(list(enumerate(ids)), "rank int, id int").coalesce(1).write.parquet(f"{out}/ids_by_rank")
    rank = np.zeros(max([end_id, *ids]) + 1, np.uint32)
    rank[ids] = np.arange(len(ids))

    def build():
        used, shard = 0, TaskContext.get().partitionId()

        def run(batch):
            nonlocal used
            data = batch.column("ids").to_pylist()
            n = np.fromiter(map(len, data), np.int64, len(data)) // np.dtype(kind).itemsize
            size, stream = to_streams(rank[np.frombuffer(b"".join(data), kind)])
            ends = np.cumsum(n)
            starts, used = used + ends - n, used + int(ends[-1])
            return pa.record_batch(
                [batch.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(starts), pa.array(n),
                 pa.array([control_stream(size[e - k:e]) for e, k in zip(ends.tolist(), n.tolist())], pa.binary()),
                 ragged(stream, np.concatenate(([0], np.cumsum(size)))[ends])],
                ["doc_id", "shard", "start", "n_tokens", "control", "data"])
        return run
    ordered = staged.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tie")
    by_batch(ordered, build, FILE_SCHEMA).write.parquet(f"{out}/ids")


FILE_SCHEMA = "doc_id long, shard int, start long, n_tokens long, control binary, data binary"


def _files(spark: SparkSession, out: str):
    """The rows of the files and the ids by rank."""
    ids = spark.read.schema("rank int, id int").parquet(f"{out}/ids_by_rank").orderBy("rank").collect()
    return spark.read.schema(FILE_SCHEMA).parquet(f"{out}/ids"), np.array([r.id for r in ids], np.uint32)


def starts(files: DataFrame) -> DataFrame:
    """``start`` counted over all files: the tokens of all earlier shards are added. One row per shard
    is ordered in one place, never one per document."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = written(totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before")), "token-starts")
    small = F.broadcast(before) if before.count() <= BROADCAST_SHARDS else before
    return files.join(small, "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")


def _decode(files: DataFrame, ids_by_rank: np.ndarray, schema: str, values) -> DataFrame:
    names = [c for c in files.columns if c not in ("control", "data")]

    def build():
        def run(batch):
            n, c, d = (batch.column(x).to_pylist() for x in ("n_tokens", "control", "data"))
            ids = [ids_by_rank[from_streams(*x)] for x in zip(c, d, n)]
            return pa.record_batch([*(batch.column(x) for x in names), values(ids)],
                                   [x.split()[0] for x in schema.split(",")])
        return run
    return by_batch(files, build, schema)


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids array<int> of every document, decoded from the files."""
    files, ids = _files(spark, out)
    rows = starts(files).select("doc_id", "start", "n_tokens", "control", "data")
    return _decode(rows, ids, "doc_id long, start long, n_tokens long, ids array<int>",
                   lambda found: pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """As ``read_token_files`` with the CRC-32 of the ids, as little-endian 32-bit numbers, in their place."""
    files, ids = _files(spark, out)
    rows = starts(files).select("doc_id", "start", "n_tokens", "control", "data")
    return _decode(rows, ids, "doc_id long, start long, n_tokens long, ids_crc32 long",
                   lambda found: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()))
