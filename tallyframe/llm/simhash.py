"""SimHash near-duplicates: an inverted index on byte positions with count filtering.

Two 64-bit fingerprints that differ in at most four bits agree in at least four of their eight
bytes. One posting list per (position, byte) would hold a 256th of all fingerprints and pairs would
grow with the square of the table, so the index holds the lists of position *triples*: a covering family
of triples, one of which lies in any four positions. Pairs that meet there tally their shared
positional bytes; those with the guaranteed four are verified bit by bit.

A posting list longer than ``dense`` is not paired up. Its fingerprints go to an exact way of linear
size: fingerprints within four bits of each other share a value within two bits of both, so each one
lists the values within two bits of it, and those that meet at a value are linked to its smallest.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_batch, columns, connected, documents, utf8, written

BITS = (np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1).astype(np.int64)
SHARED_AT_LEAST = 4


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any four positions contain one of them: positions lie in
    three groups round a circle; within a group, or two of a group and one of the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]

    def chosen(t):
        g = sorted(group[i] for i in t)
        return g[0] == g[2] or any(g.count(a) == 2 and g.count((a + 1) % 3) == 1 for a in range(3))
    return [t for t in combinations(range(8), 3) if chosen(t)]


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of one text over its ``width``-word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    hashed, digest = [], xxhash.xxh64_digest
    if len(words) <= width:
        hashed = [digest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-width].tolist()]
        hashed = [digest(joined[s:e], seed) for s, e in zip(starts, (ends[width - 1:] - 1).tolist())]
    raw = np.frombuffer(b"".join(hashed), np.uint8).reshape(-1, 8)
    if len(raw) < 256:
        ones = np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(raw[:, i], minlength=256) @ BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """``doc_id``, ``key`` and ``fp``, the fingerprint as a signed long. A text without words, null too, has 0."""
    def build():
        return lambda batch: pa.record_batch(
            [batch.column("doc_id"), batch.column("key"), pa.array(map(fingerprint, utf8(batch)), pa.int64())],
            ["doc_id", "key", "fp"])
    rows = documents(docs).withColumn("key", F.lit(0).cast("long") if key is None else key)
    return by_batch(rows, build, "doc_id long, key long, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * i).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally of equal positional bytes."""
    x = a.bitwiseXOR(b)
    tally = F.lit(0)
    for i in range(8):
        tally = tally + (_byte(x, i) == 0).cast("int")
    return tally


def close_pairs(fps: DataFrame, bits: int = 4, dense: int = 256) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``fps.fp`` that differ in at most ``bits`` (4 at
    most): all pairs of ordinary posting lists, and for dense lists enough of them to connect
    everything that is connected."""
    if not 0 <= bits <= 4:
        raise ValueError("the count filter guarantees four shared bytes up to four differing bits")
    keys = []
    for n, triple in enumerate(covering_triples()):
        key = F.lit(n).cast("long")
        for i in triple:
            key = key * 256 + _byte(F.col("fp"), i)
        keys.append(key)
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    postings = written(postings.join(sizes, "key"), "simhash-postings")
    sparse = postings.where(F.col("n") <= dense).select("key", "fp")
    a, b = F.col("a"), F.col("b")
    near = (sparse.withColumnRenamed("fp", "a").join(sparse.withColumnRenamed("fp", "b"), "key")
            .where((a < b) & (shared_bytes(a, b) >= SHARED_AT_LEAST) & (F.bit_count(a.bitwiseXOR(b)) <= bits))
            .select("a", "b"))
    crowded = postings.where(F.col("n") > dense).select("fp").distinct()
    half, rest = bits // 2, bits - bits // 2
    return near.unionByName(_through_values(crowded, half, rest)).distinct()


def _through_values(fps: DataFrame, half: int, rest: int) -> DataFrame:
    """Links of fingerprints within ``half + rest`` bits, through values within ``rest`` bits of each."""
    flips = [0]
    for k in range(1, rest + 1):
        flips += [sum(1 << i for i in c) for c in combinations(range(64), k)]
    masks = [m - (1 << 64) if m >> 63 else m for m in flips]
    around = fps.select("fp", F.explode(F.transform(
        F.lit(np.array(masks, np.int64)), lambda m: m.bitwiseXOR(F.col("fp")))).alias("value"))
    least = around.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most").drop("most")
    links = around.join(least, "value").where("a < fp").select("a", F.col("fp").alias("b"))
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= half + rest).distinct()


def _components(rows: DataFrame, bits: int, dense: int) -> DataFrame:
    """(own, root) of every distinct fingerprint of ``rows``."""
    distinct = written(rows.select("fp").distinct(), "simhash-distinct")
    roots = connected(close_pairs(distinct, bits, dense), "simhash-components")
    return distinct.join(roots, distinct.fp == roots.node, "left").select(
        F.col("fp").alias("own"), F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, bits: int = 4, dense: int = 256) -> DataFrame:
    """Per document: ``doc_id, fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest
    ``doc_id`` that links of at most ``bits`` differing bits reach, itself included.

    Texts without words have fingerprint 0 and link like any other. Rows with a null ``doc_id`` take
    part; a component of such rows only has a null id. Repeated rows are returned as often as they come.
    """
    rows = written(fingerprints(docs), "simhash-fingerprints")
    named = _components(rows, bits, dense)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    smallest = named.join(least, F.col("own") == F.col("fp")).groupBy("root").agg(F.min("least").alias("component_id"))
    # One row per distinct fingerprint; a third of all documents may share one.
    of = named.join(smallest, "root").select("own", "component_id")
    return rows.join(of, F.col("fp") == F.col("own")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, bits: int = 4, dense: int = 256) -> DataFrame:
    """The rows of ``documents``, one of each component: the smallest ``doc_id``, null last, and of equal
    ids the least by a hash of the row. Of repeated rows one stays."""
    df = columns(docs, doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    rows = written(fingerprints(df, key=key), "simhash-fingerprints")
    named = _components(rows, bits, dense)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    of_print = rows.groupBy("fp").agg(first)
    kept = named.join(of_print, F.col("own") == F.col("fp")).groupBy("root").agg(F.min("first").alias("first"))
    keys = kept.select(F.col("first.key").alias("of"))
    stay = df.withColumn("key", key).join(keys, F.col("key") == F.col("of"), "left_semi")
    return stay.dropDuplicates(["key"]).drop("key")
