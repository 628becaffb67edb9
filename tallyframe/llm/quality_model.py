"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document with features x is sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise
sum is half of (sum v_i x_i)**2 - sum (v_i x_i)**2 over the factors, so it takes time linear in the features.
Labels, language, source and id are no features; the metadata are the text's own lengths.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import ChunkTable, by_batch, columns, documents, shared, word_lists

#: Hashed words; factors; labelled documents that train at most (chosen by a hash of the id).
BUCKETS, FACTORS, TRAIN_ROWS = 1 << 15, 8, 6000
THRESHOLD = 0.3
HELD_OUT = 5

SYMBOLS, ENDS, UPPER = r"[#*$%&|<>]", r"[.,;:!?]", r"\p{Lu}"
STRUCTURE = ("few_words", "log_words", "log_chars", "word_length", "symbols", "ends", "upper", "digits", "lines",
             "distinct", "commonest", "dup_lines", "exclaims")


@dataclass
class Features:
    """Sparse features of a batch: document ``row[i]`` has ``value[i]`` at ``column[i]``."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int


def features(texts: pa.Array, table: ChunkTable) -> Features:
    """Word features (square root of a hashed word's share, so that they have length one) and structure
    statistics of each text; an empty text has the statistics of nothing."""
    words, per_doc = word_lists(pc.ascii_lower(texts))
    n = len(texts)
    doc = np.repeat(np.arange(n), per_doc)
    slots = table.of(words)
    bucket = table.flat[table.start[slots]].astype(np.int64) if len(slots) else np.empty(0, np.int64)
    filled = bucket >= 0  # not the empty words at white space round a text
    key, count = np.unique(doc[filled] * BUCKETS + bucket[filled], return_counts=True)
    row, column = key // BUCKETS, key % BUCKETS
    total = np.maximum(np.bincount(doc[filled], minlength=n), 1)
    value = np.sqrt(count / total[row])
    most = np.zeros(n)
    np.maximum.at(most, row, count)
    number = np.bincount(doc[filled], minlength=n)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
    length = np.maximum(chars, 1)

    def share(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False) / length
    lines = pc.split_pattern(texts, "\n")
    own = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    codes = lines.flatten().dictionary_encode()
    pair = own * (len(codes.dictionary) + 1) + codes.indices.to_numpy(zero_copy_only=False)
    line_count = np.bincount(own, minlength=n)
    kept = np.bincount(np.unique(pair) // (len(codes.dictionary) + 1), minlength=n)
    stats = np.stack([
        number < 50, np.log1p(number) / 8, np.log1p(chars) / 10, (chars / np.maximum(number, 1)).clip(0, 40) / 10,
        np.sqrt(share(SYMBOLS)) * 2, np.sqrt(share(ENDS)) * 2, np.sqrt(share(UPPER)), np.sqrt(share("[0-9]")),
        np.log1p(line_count) / 6, np.bincount(row, minlength=n) / np.sqrt(total) / 20, most / total,
        1 - kept / np.maximum(line_count, 1), np.sqrt(share("!")) * 2,
    ], axis=1).astype(float)
    stats = np.concatenate((stats, np.ones((n, 1))), 1)
    k = stats.shape[1]
    return Features(np.concatenate((row, np.repeat(np.arange(n), k))),
                    np.concatenate((column, np.tile(BUCKETS + np.arange(k), n))),
                    np.concatenate((value, stats.ravel())), n)


def word_table() -> ChunkTable:
    """The bucket of each word; -1 for the empty one."""
    return ChunkTable(lambda words: [[zlib.crc32(w) % BUCKETS] if w else [-1] for w in words])


class Machine:
    """w0 is the weight of the constant statistic."""

    def __init__(self, w: np.ndarray, v: np.ndarray):
        self.w, self.v = w, v

    @classmethod
    def empty(cls) -> "Machine":
        size = BUCKETS + len(STRUCTURE) + 1
        return cls(np.zeros(size), np.random.default_rng(7).normal(0, 0.02, (size, FACTORS)))

    def margins(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """The sums before the sigmoid, and each document's sums of factors."""
        linear = np.bincount(f.row, self.w[f.column] * f.value, f.rows)
        sums, squares = np.zeros((f.rows, FACTORS)), np.zeros(f.rows)
        for k in range(FACTORS):
            x = self.v[f.column, k] * f.value
            sums[:, k] = np.bincount(f.row, x, f.rows)
            squares += np.bincount(f.row, x * x, f.rows)
        return linear + ((sums ** 2).sum(1) - squares) / 2, sums

    def scores(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(f)[0].clip(-30, 30)))

    def fit(self, f: Features, labels: np.ndarray, steps: int = 120, rate: float = 0.05) -> "Machine":
        """Full gradients with per-weight step sizes (Adam); both labels weigh the same together."""
        if not len(labels):
            return self
        weight = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
        first = [np.zeros_like(self.w), np.zeros_like(self.v)]
        second = [np.zeros_like(self.w), np.zeros_like(self.v)]
        for t in range(1, steps + 1):
            z, sums = self.margins(f)
            slope = (1 / (1 + np.exp(-z.clip(-30, 30))) - labels) * weight
            s = slope[f.row] * f.value
            gw = np.bincount(f.column, s, len(self.w)) + 1e-5 * self.w
            own = np.bincount(f.column, s * f.value, len(self.w))
            gv = np.stack([np.bincount(f.column, s * sums[f.row, k], len(self.w)) - self.v[:, k] * own
                           for k in range(FACTORS)], 1) + 1e-5 * self.v
            for i, (p, g) in enumerate(((self.w, gw), (self.v, gv))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p -= rate * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no label is learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD_OUT)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Machine:
    """A machine learnt from at most ``most`` labelled documents outside the held-out fifth, those with the
    least hash of their id; the sample's features pass through the driver. Rows with a null id or label
    are left out; one label per id counts, the smaller where they differ."""
    known = columns(labels, doc_id="bigint", quality="int").where("doc_id is not null and quality in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` rows of two numbers, so they may go to every task; the texts stay where they are.
    chosen = documents(docs).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

    def build():
        table = word_table()

        def run(batch):
            f = features(batch.column("text"), table)
            order = np.argsort(f.row, kind="stable")
            ends = np.searchsorted(f.row[order], np.arange(f.rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[order], k))
                     for x, k in ((f.column, pa.int32()), (f.value, pa.float64()))]
            return pa.record_batch([batch.column("doc_id"), batch.column("quality"), *lists],
                                   ["doc_id", "quality", "at", "value"])
        return run
    rows = by_batch(chosen, build, "doc_id long, quality int, at array<int>, value array<double>").collect()
    rows.sort(key=lambda r: r.doc_id)
    if not rows:
        return Machine.empty()
    f = Features(np.repeat(np.arange(len(rows)), [len(r.at) for r in rows]), np.concatenate([r.at for r in rows]),
                 np.concatenate([r.value for r in rows]), len(rows))
    return Machine.empty().fit(f, np.array([r.quality for r in rows], float))


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score`` (0 to 1, higher for label 1) and ``predicted``.

    Null and empty texts are scored by the statistics of an empty text; repeated rows and null ids stay
    (a null id is in no fold and counts as not held out).
    """
    w, v = machine.w.astype(np.float32), machine.v.astype(np.float32)

    def build():
        table, own = shared("quality-words", word_table), Machine(w.astype(float), v.astype(float))

        def run(batch):
            p = own.scores(features(batch.column("text"), table))
            return pa.record_batch([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                   ["doc_id", "score", "predicted"])
        return run
    scored = by_batch(documents(docs), build, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
