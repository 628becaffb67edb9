"""Helpers of the language-model operators: typed inputs, Arrow maps, scratch tables, chunk tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_dir
from ..sources.store import delete_path
from ..sources.tables import load


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, each under its own name and of the given type; one that the table
    lacks is null. Names that differ in case or clash with others never meet afterwards."""
    have = {c.lower(): c for c in reversed(df.columns)}
    exact = set(df.columns)
    return df.select(*[
        (F.col(f"`{n if n in exact else have[n.lower()]}`") if n in exact or n.lower() in have else F.lit(None))
        .cast(t).alias(n) for n, t in wanted.items()])


def documents(df: DataFrame) -> DataFrame:
    """``doc_id`` and the whole ``text``; a null text is the empty one."""
    return columns(df, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))


def by_batch(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str,
             size: int = 12 << 20) -> DataFrame:
    """``mapInArrow`` whose per-task state is made by ``build`` once in each task; it gets about ``size`` bytes at a time.
    At a task's end its worker, which waits for the next one, gives back the memory that Arrow holds unused."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        part = out = None
        for batch in batches:
            for part in slices(batch, size):
                out = step(part)
                if out is not None:
                    yield out
        batch = part = out = None
        pa.default_memory_pool().release_unused()
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size: int, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    step = max(1, min(rows, int(batch.num_rows * size / max(batch.get_total_buffer_size(), 1))))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as bytes, without decoding; null is empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


#: Spark's own switch to remove the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, path: str) -> DataFrame:
    """The rows, written to ``path`` and read again. What the write shuffled is removed with its end."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, stored once in the shared scratch folder and read again: lineage ends there."""
    return store(df, scratch_dir(df.sparkSession, name))


class Scratch:
    """Stored steps of one computation, which ``clear`` deletes once its result is stored and nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As the function ``written``."""
        path = scratch_dir(self.spark, name)
        self.paths.append(path)
        return store(df, path)

    def clear(self, keep: int = 0) -> None:
        """Delete all but the last ``keep`` of them."""
        last = max(len(self.paths) - keep, 0)
        for path in self.paths[:last]:
            delete_path(self.spark, path)
        self.paths = self.paths[last:]


class ChunkTable:
    """Ids of distinct chunks of text: each new chunk is encoded once, then found by its slot.

    Bounded: when the chunks kept hold more than ``limit`` bytes the table starts anew, which costs
    time but changes no result.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[Sequence[int]]], limit: int = 48 << 20):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.bytes = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)

    def slots(self, chunks: list[bytes]) -> np.ndarray:
        """The slot of every chunk. All slots of one call stay valid until the next call."""
        if self.bytes > self.limit:
            self.clear()
        new = [c for c in set(chunks) if c not in self.slot]
        if new:
            self.add(new)
        return np.fromiter(map(self.slot.__getitem__, chunks), np.int64, len(chunks))

    def of(self, chunks: pa.Array) -> np.ndarray:
        """As ``slots`` for an Arrow array of chunks: only its distinct values are looked up."""
        coded = chunks.dictionary_encode()
        own = self.slots(coded.dictionary.cast(pa.binary()).to_pylist())
        return own[coded.indices.to_numpy(zero_copy_only=False)] if len(chunks) else own

    def add(self, new: list[bytes]) -> None:
        found = self.encode(new)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        n, total = len(self.slot), int(counts.sum())
        while n + len(new) > len(self.start):
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used:self.used + total] = [i for ids in found for i in ids]
        self.start[n:n + len(new)] = self.used + np.cumsum(counts) - counts
        self.count[n:n + len(new)] = counts
        self.used += total
        self.bytes += sum(map(len, new)) + 64 * len(new)
        self.slot.update(zip(new, range(n, n + len(new))))

    def join(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and where each chunk's ids end."""
        counts = self.count[slots]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[slots] - (ends - counts), counts) + np.arange(total)
        return self.flat[at], ends


_TABLES: dict = {}


def shared(key, build: Callable):
    """What ``build`` makes, kept while the Python worker lives: tasks that follow in it find it again."""
    if key not in _TABLES:
        _TABLES[key] = build()
    return _TABLES[key]


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts between ASCII white space, and how many each text has. Texts that start
    or end with white space have an empty word there."""
    lists = pc.ascii_split_whitespace(texts)
    return lists.flatten(), np.diff(lists.offsets.to_numpy())


def doc_ends(ends: np.ndarray, chunks_per_doc: np.ndarray) -> np.ndarray:
    """Where each document's ids end, from the ends of its chunks."""
    return np.concatenate(([0], ends))[np.cumsum(chunks_per_doc)]


def connected(edges: DataFrame, name: str, own: Scratch | None = None) -> DataFrame:
    """Components of a graph as (node, root): root is the smallest node that can be reached.

    ``edges`` has two comparable columns. Only nodes with an edge appear. Union-find by alternating
    stars: every node hangs its larger neighbours, then all its neighbours, under the smallest one
    it sees; a component ends as one star. Each round is written to the shared folder, where the last
    one stays, or goes with the steps of ``own``.
    """
    rounds = Scratch(edges.sparkSession)
    a, b = edges.columns
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = rounds.written(e, name)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _hang(both, F.col("v") > F.col("u"))
        e = _hang(e.unionByName(e.select(F.col("u"), F.col("u").alias("v"))), F.lit(True))
        e = rounds.written(e, name)
        rounds.clear(keep=1)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    if own is not None:
        own.paths += rounds.paths
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _hang(edges: DataFrame, which: Column) -> DataFrame:
    """Every ``v`` that ``which`` picks goes under the smallest of ``u`` and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("at"), F.least("u", "m").alias("m"))
    return (edges.join(least, F.col("u") == F.col("at")).where(which)
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())


__all__ = ["ChunkTable", "Scratch", "by_batch", "columns", "connected", "doc_ends", "documents", "load", "scratch_dir", "shared",
           "slices", "store", "utf8", "word_lists", "written", "SparkSession"]
