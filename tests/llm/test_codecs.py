"""Token files and the piece codec against the libraries, over whole tables and odd rows."""

from __future__ import annotations

import array
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tallyframe.llm import piece_codec, token_files
from tallyframe.llm.common import scratch_dir


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("table", ["corpus", "odd"])
def test_token_files(spark, request, tokenizer, table):
    from tokenizers import Tokenizer

    docs, path = request.getfixturevalue(table), tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = {}
    for doc, text in texts_of(docs):
        want.setdefault(doc, []).append([*library.encode(text, add_special_tokens=False).ids, 1])
    out = scratch_dir(spark, "test-files")
    token_files.write_token_files(docs, path, out)
    rows = token_files.read_token_files(spark, out).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(list(r.ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    sums = sorted(zlib.crc32(array.array("I", x).tobytes()) for v in want.values() for x in v)
    assert sorted(r.ids_crc32 for r in token_files.read_digests(spark, out).collect()) == sums


def test_ranks_follow_frequency(spark, corpus, tokenizer):
    out = scratch_dir(spark, "test-ranks")
    token_files.write_token_files(corpus, tokenizer("word_bpe_49k.json"), out)
    rows = token_files.read_token_files(spark, out).selectExpr("explode(ids) id").groupBy("id").count().collect()
    want = [r.id for r in sorted(rows, key=lambda r: (-r["count"], r.id))]
    ranks = spark.read.parquet(f"{out}/ids_by_rank").orderBy("rank").collect()
    assert [r.id for r in ranks] == want


def test_empty_table_has_empty_files(spark, nothing, tokenizer):
    out = scratch_dir(spark, "test-empty")
    token_files.write_token_files(nothing, tokenizer("word_bpe_49k.json"), out)
    assert token_files.read_token_files(spark, out).count() == 0


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_streams_round_trip(values):
    values = np.array(values, np.uint32)
    size, data = token_files.to_streams(values)
    back = token_files.from_streams(token_files.control_stream(size), data.tobytes(), len(values))
    assert back.tolist() == values.tolist()
    assert len(data) == sum(max(1, (int(v).bit_length() + 7) // 8) for v in values)


@pytest.mark.parametrize("table", ["corpus", "odd"])
def test_piece_codec(request, tokenizer, table):
    import sentencepiece

    docs, path = request.getfixturevalue(table), tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = []
    for doc, text in texts_of(docs):
        ids = sp.encode(text)
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, piece_codec.digests(docs, path).collect()), key=str) == sorted(want, key=str)
    both = piece_codec.encode_decode(docs, path).collect()
    assert sorted(len(r.ids) for r in both) == sorted(w[1] for w in want)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet="ab ▁\n\t.é", max_size=24), min_size=1, max_size=6))
def test_marked_words_encode_as_the_library(texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    step = piece_codec._Step(path)
    found = list(step(pa.record_batch([pa.array(texts)], ["text"])))
    assert [f[0] for f in found] == [sp.encode(t) for t in texts]
    assert [f[2]() for f in found] == [sp.decode(sp.encode(t)) for t in texts]


def test_empty_table(nothing, tokenizer):
    assert piece_codec.digests(nothing, tokenizer("piece_bpe_32k.model")).count() == 0
