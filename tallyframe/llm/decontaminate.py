"""Benchmark decontamination by greedy string tiling.

A document is joined with the benchmark passages it shares a seed with, a run of ``width`` equal words found
by its Karp-Rabin hash. For each such pair the longest common runs are marked one after another, never
over words already marked on either side, until no run of ``width`` words is left. So passages whose
parts are moved about are still covered. A pair whose tiles cover enough of the passage is a leak.

The benchmark is the query set. It goes to the tasks in blocks of a bounded number of words, and every
block meets all documents; no document is ever compared with passages it shares no seed with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import by_batch, columns, word_lists

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of a seed, and the share of a passage's words that tiles must cover.
WIDTH, COVERAGE = 5, 0.6
#: Words of benchmark text that one block holds.
BLOCK_WORDS = 1_000_000


PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def bare(word: bytes) -> bytes:
    """A word without the punctuation round it."""
    return word.strip(PUNCTUATION)


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all runs of ``width`` ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * BASE + x[k:k + n]
    return h


def open_runs(marked: np.ndarray, width: int) -> np.ndarray:
    """Which runs of ``width`` words have no marked word."""
    total = np.concatenate(([0], np.cumsum(marked)))
    return total[width:] == total[:-width]


def tiles(text: np.ndarray, passage: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two id sequences: (place in text, place in passage, length), longest first, of
    at least ``width`` words and never overlapping on either side."""
    used_t, used_p = np.zeros(len(text), bool), np.zeros(len(passage), bool)
    found = []
    size = min(len(text), len(passage))
    while (size := _longest(text, passage, used_t, used_p, width, size)) >= width:
        ht, hp = rolling(text, size), rolling(passage, size)
        free_p = np.flatnonzero(open_runs(used_p, size))
        at: dict[int, list[int]] = {}
        for j in free_p.tolist():
            at.setdefault(int(hp[j]), []).append(j)
        hits = np.flatnonzero(open_runs(used_t, size) & np.isin(ht, hp[free_p]))
        for i in hits.tolist():
            if used_t[i:i + size].any():
                continue
            for j in at[int(ht[i])]:
                # The hash finds the run, the words prove it.
                if not used_p[j:j + size].any() and (text[i:i + size] == passage[j:j + size]).all():
                    used_t[i:i + size] = used_p[j:j + size] = True
                    found.append((i, j, size))
                    break
        size -= 1
    return found


def _longest(text, passage, used_t, used_p, low: int, high: int) -> int:
    """Length of the longest common unmarked run, if at least ``low``; a common run of some length
    has common runs of every smaller one, so it is found by halving."""
    best, least = 0, low
    while least <= high:
        middle = (least + high) // 2
        a = rolling(text, middle)[open_runs(used_t, middle)] if len(text) >= middle else []
        b = rolling(passage, middle)[open_runs(used_p, middle)] if len(passage) >= middle else []
        if len(a) and len(b) and np.isin(b, a).any():
            best, least = middle, middle + 1
        else:
            high = middle - 1
    return best


class Block:
    """Passages of one block: their words as ids, and the seeds that lead to them."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.items = [(i, [w for w in map(bare, t.encode().lower().split()) if w]) for i, t in items]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, words in self.items for w in words}))}
        self.passages = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in self.items]
        # A passage shorter than a seed is looked for as a whole.
        self.widths = sorted({min(width, len(p)) for p in self.passages if len(p)}, reverse=True)
        self.seeds, self.owners = {}, {}
        for w in self.widths:
            pairs = [(h, n) for n, p in enumerate(self.passages) if min(width, len(p)) == w for h in np.unique(rolling(p, w))]
            order = sorted(pairs)
            self.seeds[w] = np.array([h for h, _ in order], np.uint64)
            self.owners[w] = np.array([n for _, n in order], np.int64)


def leaks_of(ids: np.ndarray, block: Block, width: int, coverage: float) -> Iterator[tuple]:
    """(passage, tiles, words covered, longest tile) of the passages that leak into one document, whose
    words are ids of the block's vocabulary, -1 for words that no passage has."""
    for w in block.widths:
        h = rolling(ids, w)
        known = open_runs(ids < 0, w) if len(h) else np.empty(0, bool)
        starts = np.flatnonzero(known)
        if not len(starts):
            continue
        low = np.searchsorted(block.seeds[w], h[starts])
        hit = low < len(block.seeds[w])
        hit[hit] = block.seeds[w][low[hit]] == h[starts][hit]
        if not hit.any():
            continue
        seeds = h[starts[hit]]
        first, last = (np.searchsorted(block.seeds[w], np.unique(seeds), side) for side in ("left", "right"))
        for n in sorted({int(x) for a, b in zip(first, last) for x in block.owners[w][a:b]}):
            passage = block.passages[n]
            shared = starts[np.isin(h[starts], rolling(passage, w))]
            # Only words within a shared seed can be part of a tile.
            near = np.zeros(len(ids) + 1, np.int64)
            np.add.at(near, shared, 1)
            np.add.at(near, shared + w, -1)
            inside = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            breaks = np.flatnonzero(np.diff(inside) > 1) + 1
            text = np.insert(ids[inside], breaks, -1)
            found = tiles(text, passage, w)
            covered = sum(t[2] for t in found)
            if covered >= coverage * len(passage):
                yield n, len(found), covered, max(t[2] for t in found)


def blocks(benchmark: DataFrame, words: int) -> Iterator[list[tuple[int, str]]]:
    """The passages in blocks of about ``words`` words; a block is all that the driver holds."""
    items = columns(benchmark, item_id="bigint", text="string").where("item_id is not null and trim(text) != ''").distinct()
    size = F.size(F.split("text", r"\s+")).cast("long")
    count = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] // words + 1
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for part in range(count):
        found = [(r.item_id, r.text) for r in items.where(F.col("part") == part).collect()]
        if found:
            yield sorted(found)


LEAKS = "doc_id long, item_id long, n_tiles int, covered_words int, item_words int, longest_tile int, coverage double"


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and passage that leaks into it: ``doc_id, item_id, n_tiles, covered_words,
    item_words, longest_tile, coverage``.

    A-Z count as a-z, words lie between ASCII white space and lose the punctuation round them. Passages of fewer than ``width`` words must
    occur whole. Null and empty texts and passages, and passages with a null ``item_id``, match nothing;
    a repeated passage counts once, repeated documents are each reported, with null ids too.
    """
    found = None
    texts = columns(docs, doc_id="bigint", text="string").where("text is not null")
    for items in blocks(benchmark, block_words):
        part = by_batch(texts, lambda items=items: _step(items, width, coverage), LEAKS)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], LEAKS)


def _step(items, width, coverage):
    block = Block(items, width)
    unknown = -1

    def run(batch):
        words, per_doc = word_lists(pc.ascii_lower(batch.column("text").fill_null("")))
        coded = words.dictionary_encode()
        known = np.array([block.vocabulary.get(bare(w), unknown) for w in coded.dictionary.cast(pa.binary()).to_pylist()] or [unknown], np.int64)
        ids = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)
        ends = np.cumsum(per_doc)
        rows = []
        for doc, start, end in zip(batch.column("doc_id").to_pylist(), (ends - per_doc).tolist(), ends.tolist()):
            for n, count, covered, longest in leaks_of(ids[start:end], block, width, coverage):
                total = len(block.passages[n])
                rows.append((doc, block.items[n][0], count, covered, total, longest, covered / total))
        if rows:
            a, b, c, d, e, f, g = zip(*rows)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            return pa.record_batch([pa.array(x, k) for x, k in zip((a, b, c, d, e, f, g), kinds)],
                                   [x.split()[0] for x in LEAKS.split(",")])
    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``documents`` that no passage leaks into, as they came; null texts stay."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    df = columns(docs, doc_id="bigint", text="string", lang="string", source="string", n_chars="bigint")
    for items in blocks(benchmark, block_words):
        df = by_batch(df, lambda items=items: _filter(items, width, coverage), ", ".join(f"{n} {t}" for n, t in df.dtypes))
    return df.select(*names)


def _filter(items, width, coverage):
    find = _step(items, width, coverage)

    def run(batch):
        places = pa.record_batch([pa.array(range(batch.num_rows), pa.int64()), batch.column("text")], ["doc_id", "text"])
        leaking = find(places)
        if leaking is None:
            return batch
        keep = np.ones(batch.num_rows, bool)
        keep[leaking.column("doc_id").to_numpy()] = False
        return batch.filter(pa.array(keep))
    return run
