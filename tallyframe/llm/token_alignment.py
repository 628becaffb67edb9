"""Alignment of two tokenizers, with corpus-wide counts of linked ids by external spill counting.

Tasks that encode write *runs*: the records (pair of ids, document, occurrences) of one batch of documents and one radix of the second
tokenizer's ids, sorted side-major (by the second id, then the first), compressed with zstd, in the shared folder. A run
has a head (its pairs and their sums) and a body (their documents). Heads are merged by a heap, a bounded number
at a time, level by level until each radix is one stream; there the pairs of one second id follow each other, so its highest
count is known when the id ends. The counts then stream past the bodies, and each run sends one number per
document of its batch back. A frequent id costs a task only its distinct pairs, never its occurrences.

Both tokenizers leave the border between a character and a following space alone, so texts are encoded by distinct
chunks between such borders; every border ends a token of both.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import by_batch, documents, shared, written
from .piece_codec import check_model, word_encoder

STEP = 1 << 13        # distinct chunks encoded at a time
RADIX = 16            # ids of the second tokenizer are dealt to this many radices
FAN_IN = 16           # runs one heap merges
BATCH = 4 << 20       # bytes of text behind one run of each radix
BLOCK = 1 << 16       # pairs of a block of counts
BORDER = re.compile(r"(?<=\S)(?= )")
RUNS = ("batch long, radix int, head binary, body binary, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, "
        "n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>")
OUT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def byte_level(vocab: dict[str, int]) -> dict[int, bytes]:
    """Bytes of every entry of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the other
    bytes, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    to = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    return {i: bytes(to[c] for c in t) for t, i in vocab.items() if all(c in to for c in t)}


def check_tokenizer(path: str) -> None:
    """Raise unless the tokenizer cuts texts before spaces that follow other characters and changes none."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("tokens of this tokenizer may cross a space after a character")


class Chunks:
    """Tokens, groups and links of the distinct chunks of one batch. Columns, not objects per chunk; the
    libraries' own objects live for ``STEP`` chunks."""

    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        names = byte_level(self.a.get_vocab(with_added_tokens=False))
        sp, self.encode_b = word_encoder(b_path)
        self.a_bytes = pa.array([names.get(i, b"") for i in range(self.a.get_vocab_size())], pa.binary())
        self.b_bytes = pa.array([self.piece(sp.id_to_piece(i), sp.is_byte(i)) for i in range(sp.get_piece_size())], pa.binary())
        self.decimal = pa.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))])

    @staticmethod
    def piece(piece: str, is_byte: bool) -> bytes:
        return bytes([int(piece[3:-1], 16)]) if is_byte else piece.replace("▁", " ").encode()

    def aligned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Per word its numbers of tokens, whether both give its bytes back and its number of links; the links of all
        words one after another; and the groups of each word as text."""
        found_a = [e.ids for e in self.a.encode_batch([" " + w for w in words], add_special_tokens=False)]
        found_b = self.encode_b([w.encode() for w in words])
        counts = np.array([list(map(len, found_a)), list(map(len, found_b))], np.int64).reshape(2, -1)
        a, b = (np.fromiter(chain.from_iterable(f), np.int64, n) for f, n in zip((found_a, found_b), counts.sum(1).tolist()))
        raw = pa.array([b" " + w.encode() for w in words], pa.binary())
        ok = (_same(self.a_bytes.take(pa.array(a)), counts[0], raw) & _same(self.b_bytes.take(pa.array(b)), counts[1], raw))
        a, b = a[np.repeat(ok, counts[0])], b[np.repeat(ok, counts[1])]
        # Words whose bytes agree are equally long on both sides, so places in all of them compare.
        a_end, b_end = (np.cumsum(pc.binary_length(t.take(pa.array(x))).to_numpy()) for t, x in ((self.a_bytes, a), (self.b_bytes, b)))
        place = np.searchsorted(b_end, a_end)
        i = np.flatnonzero(b_end[place] == a_end)
        j = place[i]
        size = np.bincount(np.repeat(np.arange(len(words)), np.where(ok, counts[0], 0))[i], minlength=len(words))
        sides = [pc.binary_join(_lists(self.decimal.take(pa.array(x)), at + 1), ",") for x, at in ((a, i), (b, j))]
        groups = pc.binary_join(_lists(pc.binary_join_element_wise(*sides, "|"), np.cumsum(size)), ";")
        return np.stack([*counts, ok, size], 1), b[j] << 32 | a[i], groups

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Slots of words among their distinct ones, and ``aligned`` of these."""
        coded = words.dictionary_encode()
        own = coded.dictionary.to_pylist()
        rows, links, groups = zip(*[self.aligned(own[i:i + STEP]) for i in range(0, max(len(own), 1), STEP)])
        return coded.indices.to_numpy(zero_copy_only=False), np.concatenate(rows), np.concatenate(links), pa.concat_arrays(groups)


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """Values cut at the given ends."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), values)


def _same(tokens: pa.Array, counts: np.ndarray, raw: pa.Array) -> np.ndarray:
    """Which words' bytes are those of their tokens."""
    return pc.equal(pc.binary_join(_lists(tokens, np.cumsum(counts)), b""), raw).to_numpy(zero_copy_only=False)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of every text, each without its first space, and the offsets of the texts among them."""
    lists = pc.split_pattern(texts, " ")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    empty = np.concatenate(([0], np.cumsum(pc.equal(flat, "").to_numpy(zero_copy_only=False))))[offsets]
    odd = np.flatnonzero(np.diff(empty))
    if not len(odd):
        return flat, offsets
    # Runs of spaces: cut only where the space follows another character than white space.
    parts, counts, last = [], np.diff(offsets), 0
    for i in odd.tolist():
        text = texts[i].as_py()
        own = [c[1:] for c in BORDER.split(" " + text)] if text else []
        parts += [flat.slice(offsets[last], offsets[i] - offsets[last]), pa.array(own, pa.string())]
        counts[i], last = len(own), i + 1
    parts.append(flat.slice(offsets[last]))
    return pa.concat_arrays([p.cast(pa.string()) for p in parts]), np.concatenate(([0], np.cumsum(counts)))


def pack(*arrays: np.ndarray) -> bytes:
    """Columns of equal or different lengths as one compressed run; each in the fewest bytes its numbers need."""
    data = []
    for x in arrays:
        top = int(x.max(initial=0))
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
        data += [np.array([len(x), np.dtype(kind).itemsize], "<u8").tobytes(), x.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(data))


def unpack(run: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(run), 0, []
    while at < len(raw):
        n, size = np.frombuffer(raw, "<u8", 2, at).tolist()
        out.append(np.frombuffer(raw, f"<u{size}", n, at + 16).astype(np.int64))
        at += 16 + n * size
    return out


def pack_pairs(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted pairs as differences, and further columns."""
    return pack(np.diff(keys, prepend=0), *more)


def unpack_pairs(run: bytes) -> list[np.ndarray]:
    step, *more = unpack(run)
    return [np.cumsum(step), *more]


def runs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The runs of all documents, and per batch one row (radix -1) of what its documents have by themselves."""
    check_tokenizer(a_path)
    check_model(b_path)

    def build():
        table, place = shared(("aligned", a_path, b_path), lambda: Chunks(a_path, b_path)), TaskContext.get().partitionId()
        made = 0

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal made
            number, made = place << 32 | made, made + 1
            return _batch_runs(table, batch, number)
        return run
    return by_batch(documents(docs), build, RUNS, BATCH)


def _batch_runs(table: Chunks, batch: pa.RecordBatch, number: int) -> pa.RecordBatch:
    flat, offsets = words_of(batch.column("text"))
    slots, rows, every, groups = table.of(flat)
    size = rows[:, 3]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = batch.num_rows
    bad = np.bincount(doc, weights=1 - rows[slots, 2], minlength=n) > 0
    per_doc = [np.where(bad, 0, np.bincount(doc, weights=w[slots], minlength=n)).astype(np.int64) for w in (rows[:, 0], rows[:, 1], size)]
    digests = []
    for i, (x, y) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        empty = bad[i] or x == y
        digests.append("" if empty else hashlib.sha256(b";".join(groups.take(pa.array(slots[x:y])).cast(pa.binary()).to_pylist())).hexdigest())
    # (chunk, document) pairs are counted before chunks unfold into pairs of ids
    good = ~bad[doc]
    chunk, times = np.unique(slots[good] * n + doc[good], return_counts=True)
    of, doc = chunk // max(n, 1), chunk % max(n, 1)
    first = np.cumsum(size) - size
    at = np.repeat(first[of] - (np.cumsum(size[of]) - size[of]), size[of]) + np.arange(int(size[of].sum()))
    keys, code = np.unique(every, return_inverse=True)
    record, where = np.unique(code[at] * n + np.repeat(doc, size[of]), return_inverse=True)
    count = np.bincount(where, weights=np.repeat(times, size[of]), minlength=len(record)).astype(np.int64)
    pair, doc = record // max(n, 1), record % max(n, 1)
    radix = (keys >> 32) % RADIX
    out = [(number, -1, None, None, batch.column("doc_id").to_pylist(), *[x.tolist() for x in (*per_doc, per_doc[2])], digests)]
    for r in range(RADIX):
        mine = radix[pair] == r
        if mine.any():
            own, starts, held = np.unique(pair[mine], return_index=True, return_counts=True)
            head = pack_pairs(keys[own], np.add.reduceat(count[mine], starts))
            out.append((number, r, head, pack(held, doc[mine], count[mine], np.array([n])), *[None] * 6))
    return pa.RecordBatch.from_pylist([dict(zip(NAMES, row)) for row in out], SCHEMA)


NAMES = [c.split()[0] for c in RUNS.split(", ")]
SCHEMA = pa.schema(list(zip(NAMES, [pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string())])))


def merged(streams: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """(pair, sum) in order, from sorted streams of blocks, by a heap of one entry per stream."""
    def entries(blocks: list[bytes]) -> Iterator[tuple[int, int]]:
        for block in blocks:
            keys, sums = unpack_pairs(block)
            yield from zip(keys.tolist(), sums.tolist())
    for key, same in groupby(heapq.merge(*map(entries, streams)), itemgetter(0)):
        yield key, sum(n for _, n in same)


def with_best(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(pair, sum, 1 if no pair of the same second id has more). Holds the pairs of one id at a time."""
    for _, same in groupby(pairs, lambda p: p[0] >> 32):
        own = list(same)
        top = max(n for _, n in own)
        yield from ((key, n, int(n == top)) for key, n in own)


def _blocks(rows: Iterator[tuple], radix: int, group: int) -> Iterator[pa.RecordBatch]:
    rows, seq = iter(rows), 0
    while part := [row for row, _ in zip(rows, range(BLOCK))]:
        yield pa.record_batch([pa.array([radix], pa.int32()), pa.array([group], pa.int64()), pa.array([seq], pa.int32()),
                               pa.array([pack_pairs(*np.array(part, np.int64).T)], pa.binary())], ["radix", "grp", "seq", "head"])
        seq += 1


HEADS = "radix int, grp long, seq int, head binary"


def merge_level(heads: DataFrame, last: bool) -> DataFrame:
    """Every ``FAN_IN`` neighbouring groups of a radix as one; the last level adds who is best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("radix", "to", "grp", "head"))))
        for (radix, to), same in groupby(rows, itemgetter(0, 1)):
            streams = [[r[3] for r in own] for _, own in groupby(same, itemgetter(2))]
            pairs = merged(streams)
            # zip() in _blocks asks for a row beyond a full block; rows come first there, so none is lost
            yield from _blocks(with_best(pairs) if last else pairs, radix, to)
    dealt = heads.withColumn("to", F.floor(F.col("grp") / FAN_IN))
    return dealt.repartition("radix", "to").sortWithinPartitions("radix", "to", "grp", "seq").mapInArrow(run, HEADS)


def pair_blocks(stored: DataFrame, numbers: DataFrame, batches: int) -> DataFrame:
    """Counts of all pairs by radix, in blocks of sorted pairs."""
    heads = (stored.where("radix >= 0").select("batch", "radix", "head").join(numbers, "batch")
             .select("radix", F.col("no").alias("grp"), F.lit(0).alias("seq"), "head"))
    while True:
        batches = -(-batches // FAN_IN)
        heads = merge_level(heads, batches <= 1)
        if batches <= 1:
            return written(heads, "alignment-counts")


def contributions(stored: DataFrame, numbers: DataFrame, counts: DataFrame, batches: int) -> DataFrame:
    """One row per run: for every document of its batch, links of best pairs and the sum of counts over links."""
    groups = -(-batches // FAN_IN)
    bodies = (stored.where("radix >= 0").select("batch", "radix", "head", "body").join(numbers, "batch")
              .select("radix", F.floor(F.col("no") / FAN_IN).alias("grp"), F.lit(1).alias("kind"), F.lit(0).alias("seq"), "batch", "head", "body"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(groups - 1, 0)).cast("long")))
    sent = counts.select("radix", each.alias("grp"), F.lit(0).alias("kind"), "seq", F.lit(-1).cast("long").alias("batch"), "head",
                         F.lit(None).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, table = None, [], None
        for b in batches:
            for radix, grp, kind, batch, head, body in zip(*(b.column(c).to_pylist() for c in ("radix", "grp", "kind", "batch", "head", "body"))):
                if at != (radix, grp):
                    at, blocks, table = (radix, grp), [], None
                if kind == 0:
                    blocks.append(unpack_pairs(head))
                    continue
                if table is None:
                    table, blocks = [np.concatenate(x) for x in zip(*blocks)], []
                keys, _ = unpack_pairs(head)
                held, doc, times, (n,) = unpack(body)
                place = np.repeat(np.searchsorted(table[0], keys), held)
                total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(total, doc, table[1][place] * times)
                np.add.at(best, doc, table[2][place] * times)
                yield pa.record_batch([pa.array([batch]), pa.array([radix], pa.int32()), pa.array([pack(best, total)], pa.binary())],
                                      ["batch", "radix", "body"])
    rows = bodies.unionByName(sent).repartition("radix", "grp").sortWithinPartitions("radix", "grp", "kind", "seq", "batch")
    return rows.mapInArrow(run, "batch long, radix int, body binary")


class Alignment:
    """Documents aligned by two tokenizers, the first of the ``tokenizers`` library and the second of ``sentencepiece``.

    ``pairs()`` counts linked ids over the corpus; ``documents()`` has one row per document. Null and empty texts, and texts whose
    tokens do not give their bytes back (the white-space mark as a character), have no tokens, links or groups. Repeated rows count and stay; a null
    id stays; an empty table gives empty tables.
    """

    def __init__(self, docs: DataFrame, a_path: str, b_path: str):
        self.stored = written(runs(docs, a_path, b_path), "alignment-runs")
        # Batches are numbered densely, one small row each, in the order of their tasks.
        ids = self.stored.where("radix = -1").select("batch")
        place = ids.groupBy(F.shiftright("batch", 32).alias("task")).agg(F.count("*").alias("n"))
        tasks = {r.task: r.n for r in place.collect()}
        starts, self.batches = [], 0
        for task in sorted(tasks):
            starts.append((task, self.batches))
            self.batches += tasks[task]
        first = docs.sparkSession.createDataFrame(starts, "task long, first long")
        self.numbers = (ids.withColumn("task", F.shiftright("batch", 32)).join(first, "task")
                        .select("batch", (F.col("first") + F.col("batch").bitwiseAND(F.lit((1 << 32) - 1))).alias("no")))
        self.counts = pair_blocks(self.stored, self.numbers, self.batches)

    def pairs(self) -> DataFrame:
        """``a_id, b_id, n, best``: links of each pair of ids, and whether no pair of that ``b_id`` has more."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for head in b.column("head").to_pylist():
                    keys, n, best = unpack_pairs(head)
                    yield pa.record_batch([pa.array(keys & 0xFFFFFFFF, pa.int32()), pa.array(keys >> 32, pa.int32()), pa.array(n), pa.array(best > 0)],
                                          ["a_id", "b_id", "n", "best"])
        return self.counts.mapInArrow(run, "a_id int, b_id int, n long, best boolean")

    def documents(self) -> DataFrame:
        own = self.stored.where("radix = -1").drop("head")
        back = contributions(self.stored, self.numbers, self.counts, self.batches)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for b in batches for r in b.to_pylist())
            for _, same in groupby(rows, itemgetter("batch")):
                meta = next(same)
                sums = np.zeros((2, len(meta["doc_id"])), np.int64)
                for r in same:
                    sums += unpack(r["body"])
                yield pa.record_batch([*(pa.array(meta[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
                                       pa.array(sums[0]), pa.array(sums[1]), pa.array(meta["groups_sha256"], pa.string())],
                                      [c.split()[0] for c in OUT.split(", ")])
        rows = own.unionByName(back, allowMissingColumns=True)
        return rows.repartition("batch").sortWithinPartitions("batch", "radix").mapInArrow(run, OUT)
