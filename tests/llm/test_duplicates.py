"""SimHash, fuzzy lines and string tiling against brute force."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from conftest import SF
from tallyframe.llm import decontaminate, line_dedup, simhash
from tallyframe.llm.common import connected


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, bits=4):
    u = Union()
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                u.join(i, j)
    return [u.find(i) for i in range(len(prints))]


def test_simhash(corpus):
    rows = sorted((r.doc_id, plain_print(r.text)) for r in corpus.collect())
    roots = plain_components([p for _, p in rows])
    want = [(d, f"{p:016x}", rows[r][0]) for (d, p), r in zip(rows, roots)]
    assert sorted(map(tuple, simhash.near_duplicates(corpus).collect())) == want


def test_simhash_on_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.fingerprint, r.component_id))
    assert by[1] == by[3] == by[2] == {("0" * 16, 1)}
    assert {c for _, c in by[4] | by[5]} == {4}
    assert simhash.near_duplicates(nothing).count() == 0
    stay = simhash.one_per_group(odd).collect()
    assert sorted(r.doc_id for r in stay if r.doc_id) == sorted({r.component_id for r in got if r.component_id})
    assert simhash.one_per_group(nothing).count() == 0


@pytest.mark.parametrize("dense", [0, 3, 256])
def test_close_prints_on_both_ways(spark, dense):
    rng = np.random.default_rng(5)
    prints = []
    for _ in range(40):
        p = int(rng.integers(0, 2**63))
        prints.append(p)
        for _ in range(6):
            p = prints[-1 - int(rng.integers(0, 2))]
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                p ^= 1 << int(b)
            prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    u = Union()
    for r in simhash.close_pairs(fps, 4, dense).collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4
        u.join(signed.index(r.a), signed.index(r.b))
    assert [u.find(i) for i in range(len(prints))] == plain_components(prints)


def test_connected(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100, 300: 300, 301: 300}


def shingles(line):
    return {line} if len(line) <= 5 else {line[i:i + 5] for i in range(len(line) - 4)}


def test_lines(spark, corpus):
    place, every = {}, []
    for r in sorted(corpus.collect(), key=lambda r: r.doc_id):
        for k, line in enumerate(r.text.split("\n")):
            line = line.strip(" ").lower()
            if line:
                place.setdefault(line, (r.doc_id, k))
                every.append((r.doc_id, k, line))
    distinct = sorted(place)
    sets = [shingles(x) for x in distinct]
    u = Union()
    for i, a in enumerate(sets):
        u.find(i)
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                both = len(a & b)
                if both >= 0.8 * (len(a) + len(b) - both):
                    u.join(i, j)
    first = {}
    for i, x in enumerate(distinct):
        first[u.find(i)] = min(first.get(u.find(i), (10**9, 0)), place[x])
    at = {x: i for i, x in enumerate(distinct)}
    want = {(d, k) for d, k, x in every if first[u.find(at[x])] != (d, k)}
    got = {(r.doc_id, k) for r in line_dedup.report(corpus).collect() for k in r.removed}
    # Every line that goes has a similar earlier one; banding may miss few.
    assert got <= want
    assert len(got) >= 0.97 * len(want)


def test_lines_on_odd_rows(odd, nothing):
    got = line_dedup.report(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[6].removed == [1] and by[6].n_lines == 4
    assert by[1].n_lines == 0 and by[2].removed == []
    assert by[5].n_removed == 1 and by[4].n_removed == 0
    rows = {r.doc_id: r for r in line_dedup.deduplicated(odd).collect()}
    assert rows[6].text == "same line\n\nother line" and rows[6].n_chars == 21
    assert rows[5].text == "" and rows[2].text is None
    assert line_dedup.deduplicated(odd).count() == odd.count()
    assert line_dedup.report(nothing).count() == line_dedup.deduplicated(nothing).count() == 0


def plain_tiles(text, passage, width):
    """Greedy string tiling by comparing everything."""
    used_t, used_p, out = [False] * len(text), [False] * len(passage), 0
    while True:
        best, where = 0, []
        for i in range(len(text)):
            for j in range(len(passage)):
                k = 0
                while i + k < len(text) and j + k < len(passage) and text[i + k] == passage[j + k] \
                        and not used_t[i + k] and not used_p[j + k]:
                    k += 1
                if k > best:
                    best, where = k, []
                if k == best:
                    where.append((i, j))
        if best < width:
            return out
        for i, j in where:
            if not any(used_t[i:i + best]) and not any(used_p[j:j + best]):
                used_t[i:i + best] = used_p[j:j + best] = [True] * best
                out += best


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), min_size=1, max_size=14), st.integers(2, 4))
def test_tiles(text, passage, width):
    found = decontaminate.tiles(np.array(text, np.int64), np.array(passage, np.int64), width)
    seen_t, seen_p = set(), set()
    for i, j, n in found:
        assert text[i:i + n] == passage[j:j + n] and n >= width
        assert not seen_t & set(range(i, i + n)) and not seen_p & set(range(j, j + n))
        seen_t |= set(range(i, i + n))
        seen_p |= set(range(j, j + n))
    assert sum(n for *_, n in found) == plain_tiles(text, passage, width)


def test_leaks(spark, corpus):
    sf = SF
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, [w.strip(".,") for w in r.text.lower().split()]) for r in benchmark.collect()]
    want = set()
    for r in corpus.collect():
        words = [w.strip(".,") for w in r.text.lower().split()]
        joined = " " + " ".join(words) + " "
        want |= {(r.doc_id, i) for i, w in items if f" {' '.join(w)} " in joined}
    for words in (1_000_000, 60):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(corpus, benchmark, block_words=words).collect()}
        assert want <= got
        assert all(r.coverage >= decontaminate.COVERAGE for r in decontaminate.leaks(corpus, benchmark).collect())
    left = {r.doc_id for r in decontaminate.without_leaks(corpus, benchmark).collect()}
    assert left == {r.doc_id for r in corpus.collect()} - {d for d, _ in got}


def test_reordered_passages_and_odd_rows(spark, odd, nothing):
    words = [f"w{i}" for i in range(30)]
    moved = words[20:] + ["and", "then"] + words[:20]
    docs = spark.createDataFrame([(1, " ".join(moved)), (2, " ".join(words[:8])), (None, "x " + " ".join(words).upper()), (3, None),
                                  (4, ""), (5, "two words")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, ""), (None, " ".join(words)), (4, "Two, words."), (5, "...")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_tiles) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1, 2), (None, 1, 1), (5, 4, 1)}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, items).collect()} == {2, 3, 4}
    assert decontaminate.leaks(odd, items).count() == 0
    assert decontaminate.without_leaks(odd, items).count() == odd.count()
    assert decontaminate.leaks(nothing, items).count() == decontaminate.leaks(docs, items.limit(0)).count() == 0


def near_copies_found(spark, texts, copies):
    """The part of ``copies`` that goes; nothing else may go."""
    docs = spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string").repartition(4)
    gone = {r.doc_id for r in line_dedup.report(docs).collect() if r.n_removed}
    assert gone <= set(range(len(texts), len(texts) + len(copies)))
    return len(gone) / len(copies)


def test_lines_with_a_long_shared_opening(spark):
    """Hundreds of lines in one band: similar ones meet, whatever the band's ends are."""
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 10)))) for _ in range(n))
    opening = words(42)
    texts = [f"{opening} {words(8)}" for _ in range(300)]
    copies = [t[:-2] + "#" + t[-1] for t in texts[:100]]
    assert near_copies_found(spark, texts, copies) >= 0.98


def test_lines_without_spaces(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x5A00, 80))) for _ in range(150)]
    edited = [t[:k] + "新" + t[k + 1:] for t, k in zip(texts, rng.integers(0, 80, 150))]
    assert near_copies_found(spark, texts, ["新" + t for t in texts] + edited) >= 0.98
    short = [t[:9] for t in texts]
    assert near_copies_found(spark, short, [t + "新" for t in short]) >= 0.98


def test_lines_of_a_small_vocabulary(spark):
    """Pairs of lines out of the same few numbers, whose five-character shingles agree and whose longer ones do not."""
    rng = np.random.default_rng(6)
    first, second = [], []
    for _ in range(60):
        few = rng.choice(np.arange(10, 100), 8, replace=False)
        for out in (first, second):
            out.append(",".join(map(str, rng.choice(few, 600))))
    sets = [(shingles(a), shingles(b)) for a, b in zip(first, second)]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in sets)
    assert near_copies_found(spark, first, second) >= 0.97


def test_lines_at_the_limit(spark):
    """Recall at similarities from 0.8 on, for lines short and long; groups beyond one band's pairs meet as well."""
    rng = np.random.default_rng(8)
    line = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9000, n)))
    texts, copies = [], []
    for n in (20, 40, 60, 100, 200, 400):
        for _ in range(50):
            t = line(n)
            cut = int(n / 10)
            copy = t[:-cut] + line(1)
            a, b = shingles(t), shingles(copy)
            assert 0.8 <= len(a & b) / len(a | b) < 0.97
            texts.append(t)
            copies.append(copy)
    assert near_copies_found(spark, texts, copies) >= 0.97
    base = line(120)
    group = [base[:k] + line(1) + base[k + 1:] for k in range(100)]
    assert near_copies_found(spark, [base], group) == 1
    odd = [line(60) + line(240)[:k % 7] for k in range(40)]
    assert near_copies_found(spark, odd, [odd[0] + "x"]) == 1


def test_lines_that_face_none_get_no_keys(spark):
    """In a large band, sizes that allow no link make no keys, and linked lines of two components at the limit of
    sizes and of similarity are still compared."""
    long, limit = "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrst"
    texts = {1: long, 2: long[:-2], 3: long[:12], 4: limit, 5: limit[:-3], 6: limit[:9]}
    frame = spark.createDataFrame([(i, t) for i, t in texts.items()], "digest long, line string")
    size = {i: len(t) - line_dedup.WIDTH + 1 for i, t in texts.items()}
    large = spark.createDataFrame([(7, i, size[i]) for i in (1, 2, 3)] + [(8, i, size[i]) for i in (4, 5, 6)], "band long, digest long, n int")
    roots = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
    made = {}

    class Counted(line_dedup.Scratch):
        def written(self, df, name):
            made[name] = super().written(df, name)
            return made[name]
    pairs = line_dedup.between(large, roots, frame, Counted(spark))
    assert [tuple(r) for r in pairs.collect()] == [(4, 5)]
    assert {r.digest for r in made["lines-postings"].collect()} == {4, 5}
