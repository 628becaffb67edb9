"""Alignment, whitening and mixing against brute force."""

from __future__ import annotations

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import source_mix, token_alignment, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_alignment(texts, a_path, b_path):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    names = token_alignment.byte_level(a.get_vocab(with_added_tokens=False))
    rows, count = [], Counter()
    for doc, text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text or "")
        xb = [names[i] for i in x]
        yb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or not b"".join(xb) == b"".join(yb) == (" " + text).encode():
            rows.append((doc, [], [], [], []))
            continue
        xe, ye = np.cumsum([len(t) for t in xb]).tolist(), np.cumsum([len(t) for t in yb]).tolist()
        ya = {e: i for i, e in enumerate(ye)}
        links = [(y[ya[e]], x[i]) for i, e in enumerate(xe) if e in ya]
        groups, p, q = [], 0, 0
        for i, e in enumerate(xe):
            if e in ya:
                groups.append(",".join(map(str, x[p:i + 1])) + "|" + ",".join(map(str, y[q:ya[e] + 1])))
                p, q = i + 1, ya[e] + 1
        count.update(links)
        rows.append((doc, x, y, groups, links))
    top = {}
    for (second, _), n in count.items():
        top[second] = max(top.get(second, 0), n)
    return count, [(d, len(x), len(y), len(g), len(k), sum(count[t] == top[t[0]] for t in k), sum(count[t] for t in k),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, x, y, g, k in rows]


ODD_SPACES = [
    (20, "  lead and  double   triple \n\n  after lines \t tab "), (21, " "), (22, "   "), (23, "a\n  b\n c \r\n   d"), (24, "a  b　  c\x85 d\x1c  e"),
    (25, "▁ mark"), (26, "it's 'll we'VE 12 345 !!! ...\n\n\n"), (27, "<|endoftext|> <s> </s> <unk> <0x41>"), (28, "中文 字 ไทย  🙂🙂 ​ x"), (29, "end "), (30, "\n"), (31, "a \n b")]


@pytest.mark.parametrize("table", ["corpus", "odd", "spaces"])
def test_alignment(spark, request, tokenizer, table, monkeypatch):
    if table == "spaces":
        docs = spark.createDataFrame(ODD_SPACES, "doc_id long, text string").repartition(2)
    else:
        docs = request.getfixturevalue(table)
    # small batches and a narrow heap, so that several levels are merged
    monkeypatch.setattr(token_alignment, "FAN_IN", 2)
    paths = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    count, want = plain_alignment(texts, *paths)
    out = token_alignment.Alignment(docs.repartition(5), *paths)
    got = [tuple(r) for r in out.documents().collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(r.b_id, r.a_id): r.n for r in out.pairs().collect()} == dict(count)


def test_alignment_of_nothing(nothing, tokenizer):
    out = token_alignment.Alignment(nothing, tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    assert out.documents().count() == 0 and out.pairs().count() == 0


def test_alignment_keeps_no_chunks(tokenizer, monkeypatch):
    """What a worker holds does not grow with the distinct words it has met, and chunks encoded a few at a time
    give what they give at once."""
    table = token_alignment.Chunks(tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    texts = [" ".join(f"word{i}x{j}" for j in range(2000)) for i in range(20)] + [t for _, t in ODD_SPACES]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        token_alignment._batch_runs(table, batch, 0)
        assert tracemalloc.get_traced_memory()[0] < 4 << 20
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(token_alignment, "STEP", 7)
    few = token_alignment._batch_runs(table, batch.slice(19), 0).to_pylist()
    monkeypatch.setattr(token_alignment, "STEP", 1 << 20)
    assert few == token_alignment._batch_runs(table, batch.slice(19), 0).to_pylist()


def test_runs_round_trip():
    for x in (np.zeros(0, np.int64), np.array([0, 255, 256, 1 << 40]), np.arange(1000) << 32):
        assert [y.tolist() for y in token_alignment.unpack(token_alignment.pack(x, x[:1]))] == [x.tolist(), x[:1].tolist()]
        assert token_alignment.unpack_pairs(token_alignment.pack_pairs(np.sort(x)))[0].tolist() == sorted(x.tolist())


def held(rows):
    ids = sorted({(r.vec_id is None, r.vec_id) for r in rows})
    return ids


def plain_whitening(x, top=32):
    x = np.array(x, np.int64)
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    return y @ v[:, :top] / np.sqrt(e[:top]), e / e.sum(), ((n * x - s) ** 2).sum(1)


def test_whitening(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [r for r in table.collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    x = np.floor(64 * np.array([r.embedding for r in rows], np.float64)).astype(np.int64) + 1_000_000
    want, share, deviation = plain_whitening(x)
    got = whitening.whiten(table.repartition(4)).collect()
    assert len(got) == len(rows) * 32 and {r.n for r in got} == {len(rows)}
    place = {r.vec_id: i for i, r in enumerate(rows)}
    mine = np.zeros_like(want)
    for r in got:
        mine[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[place[r.vec_id]]
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
    assert np.abs(mine * np.sign((mine * want).sum(0)) - want).max() < 1e-6


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 3))
    # a constant dimension, a repeated one, one of huge and one of tiny variance
    x = np.column_stack([base, np.full(60, 3.0), base[:, 0], base[:, 1] * 1e6, base[:, 2] / 8 + base[:, 1]])
    rows = [(i if i else None, v.tolist(), "clash", 1.0) for i, v in enumerate(x)]
    rows += [(100, None, "", 1.0), (101, [1.0, None], "", 1.0), (102, [float("nan")] * 7, "", 1.0), (103, [], "", 1.0), (104, [float("inf")] * 7, "", 1.0),
             (105, [1.0, 2.0], "", 1.0), (7, x[7].tolist(), "", 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n double").repartition(3)
    got = whitening.whiten(df)
    kept = np.vstack([x, x[7:8]])
    rank = np.linalg.matrix_rank(np.floor(64 * kept) - np.floor(64 * kept).mean(0))
    assert got.count() == 61 * rank
    assert got.agg(F.max("identity_error")).first()[0] < 1e-4
    alike = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(alike).count() == 0
    assert whitening.whiten(alike.limit(0)).count() == 0
    huge = spark.createDataFrame([(i, [v, 1e30 * v]) for i, v in enumerate((1.0, -2.0, 5.0))], "vec_id long, embedding array<float>")
    assert whitening.whiten(huge).where("deviation IS NULL").count() == 3  # the small dimension is below the precision of the huge one


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * w[s] / sum(w[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return share | {s: float(most * sizes[s]) for s in full}
        full |= over


@pytest.mark.parametrize("table", ["corpus", "odd"])
def test_mix(request, table):
    docs = request.getfixturevalue(table)
    rows = docs.select("doc_id", "source", "text").collect()
    size = Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    want = filled(dict(size))
    mix = source_mix.Mix(docs, block=16)
    got = mix.taken().collect()
    no = {r.source_no: r for r in mix.sources.collect()}
    assert {r.source: r.target for r in no.values()} == pytest.approx(want)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r.doc_id), len(WORD.findall(r.text or ""))) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[(r.source_size, round(r.target, 6))] += r.taken
    for r in no.values():
        assert abs(taken[(r.source_size, round(r.target, 6))] - r.target) <= 48
    again = source_mix.Mix(docs.repartition(7), block=16).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_is_what_its_slots_hold(corpus):
    mix = source_mix.Mix(corpus, block=32, shard=256)
    quota = {r.source_no: r for r in mix.sources.collect()}
    slots = mix.slots.collect()
    times = Counter((r.source_no, r.block) for r in slots)
    for s, q in quota.items():
        mine = sorted(r.k for r in slots if r.source_no == s)
        assert mine == list(range(q.slots))
        own = [times[(s, b)] for b in range(q.blocks)]
        assert max(own) - min(own) <= 1 and sum(own) == q.slots
    shards = Counter(r.shard for r in slots)
    assert all(shards[s] == 256 for s in range(max(shards)))
    per = Counter((r.shard, r.source_no) for r in slots)
    for s, q in quota.items():  # every shard's share is near the quota's
        for shard in range(max(shards)):
            p = q.slots / len(slots)
            assert abs(per[(shard, s)] - 256 * p) < 6 * (256 * p * (1 - p)) ** 0.5 + 1


def test_mix_of_nothing(nothing):
    assert source_mix.Mix(nothing).taken().count() == 0


def test_permutations_are_one_to_one(spark):
    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(source_mix.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))
    x = [r.x for r in got]
    assert abs(np.corrcoef(x, range(1000))[0, 1]) < 0.15
