"""Quality rules against a plain version; the classifier by held-out accuracy."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from conftest import SF
from tallyframe.llm import quality_model, quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    words, seen, dup = re.findall(WORD, text), set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def histograms(text):
    words = re.findall(WORD, text)
    upper = sum(unicodedata.category(c) == 'Lu' for c in text)
    chars = [upper, len(re.findall(r"[\x20\x09-\x0D]", text)), len(re.findall(r"[-.,;:!?'\"()]", text)),
             len(re.findall(r"[#*$%&|<>]", text))]
    chars.append(len(text) - sum(chars))
    uses = [words.count(w) for w in quality_rules.WORDS]
    uses.append(len(words) - sum(uses))
    return [c / max(len(text), 1) for c in chars], [u / max(len(words), 1) for u in uses]


def distance(p, q):
    def part(x, m):
        return x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(p, q)) / 2))


def test_base_counts(corpus, odd):
    for docs in (corpus, odd):
        want = sorted(str((r.doc_id, *base(r.text or ""))) for r in docs.select("doc_id", "text").collect())
        got = quality_rules.quality_report(docs).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_distances(corpus):
    rows = corpus.collect()
    by = {}
    for r in rows:
        if not base(r.text)[-1]:
            by.setdefault(r.lang, []).append(histograms(r.text))
    references = {}
    for lang, found in by.items():
        if len(found) >= quality_rules.MIN_REFERENCE:
            middle = [sorted(c[i] for c, _ in found)[(len(found) + 1) // 2 - 1] for i in range(len(quality_rules.CLASSES))]
            mean = np.mean([w for _, w in found], 0)
            references[lang] = [m / sum(middle) for m in middle], mean.tolist()
    got = {r.doc_id: r for r in quality_rules.quality_report(corpus).collect()}
    for r in rows:
        g = got[r.doc_id]
        if r.lang not in references:
            assert g.char_distance is None and g.word_distance is None
            continue
        chars, words = histograms(r.text)
        if len(r.text) >= quality_rules.MIN_CHARS:
            assert abs(g.char_distance - distance(chars, references[r.lang][0])) < 1e-6
        else:
            assert g.char_distance is None
        if g.n_words >= quality_rules.MIN_WORDS:
            assert abs(g.word_distance - distance(words, references[r.lang][1])) < 1e-6
        odd_one = (g.char_distance or 0) > quality_rules.CHAR_LIMIT or (g.word_distance or 0) > quality_rules.WORD_LIMIT
        assert g.kept == (not g.base_failed and not odd_one)


def test_many_repeats_take_the_other_way(spark):
    few = " ".join(f"a{i % 30}" for i in range(300))
    many = " ".join(f"b{i % 90}" for i in range(400)) + " tail"
    docs = spark.createDataFrame([(1, few), (2, many), (3, few + " " + many)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.quality_report(docs).collect()}
    assert got == {1: base(few)[4], 2: base(many)[4], 3: base(few + " " + many)[4]}


def test_kept_rows_are_unchanged(corpus, odd, nothing):
    for docs in (corpus, odd, nothing):
        kept = {tuple(r) for r in quality_rules.keep_good(docs).collect()}
        assert kept <= {tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()}
    assert quality_rules.quality_report(nothing).count() == 0


def test_machine_scores_by_all_pairs():
    """The sum-of-squares identity against the plain double sum."""
    rng = np.random.default_rng(3)
    m = quality_model.Machine.empty()
    m.w, m.v = rng.normal(size=m.w.shape), rng.normal(size=m.v.shape)
    texts = pa.array(["the cat. THE dog", "", "a b c a\na b c a"])
    f = quality_model.features(texts, quality_model.word_table())
    got, _ = m.margins(f)
    for d in range(3):
        at, x = f.column[f.row == d], f.value[f.row == d]
        want = m.w[at] @ x + sum(m.v[at[i]] @ m.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert abs(want - got[d]) < 1e-9


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_classifier_on_odd_tables(spark, corpus, odd, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (10, 0, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    for docs in (odd, nothing):
        rows = quality_model.classify(docs, labels).collect()
        assert len(rows) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality_model.classify(odd, labels.limit(0)).count() == odd.count()
