"""SentencePiece encoding and decoding by a table of distinct marked words.

In a model whose pieces never hold the white-space mark behind another character, no merge crosses
the border between a character and the mark that follows it. So a text falls into marked words (a run
of marks and what follows up to the next mark), each distinct one is segmented once, and its ids are
joined back by position. The table is kept per Python worker and bounded (``ChunkTable``): one shuffled table
of the whole corpus would move every position of every text twice, several times the input.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ChunkTable, by_batch, documents, shared

MARK = "▁"
#: Bytes of text taken at a time: their ids are Python numbers for a while.
BATCH = 1 << 20
#: Bytes of distinct words that a worker keeps. Workers outlive their task and stand beside the heap of the next stages.
TABLE = 8 << 20
SPACED = re.compile(b" *[^ ]*")


def check_model(path: str) -> None:
    """Raise unless the model's pieces stay within marked words and it changes no text."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    crossing = [p.piece for p in model.pieces if MARK in p.piece.lstrip(MARK)]
    user = [p.piece for p in model.pieces if p.type == pb.ModelProto.SentencePiece.USER_DEFINED]
    if crossing or user or spec.precompiled_charsmap or spec.remove_extra_whitespaces \
            or not (spec.add_dummy_prefix and spec.escape_whitespaces) or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("pieces of this model may cross white-space marks")


def marked_words(text: bytes) -> list[bytes]:
    """The marked words of a text, each without its first mark; other marks are spaces."""
    if not text:
        return []
    if MARK.encode() in text:
        text = text.replace(MARK.encode(), b" ")
    words = text.split(b" ")
    if b"" not in words:
        return words
    # Runs of spaces: a word owns all the marks before it.
    return [w[1:] for w in SPACED.findall(b" " + text) if w]


def word_encoder(path: str):
    """A function from marked words to ids, by the library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    bare = sp.piece_to_id(MARK)

    def encode(words: list[bytes]) -> list[list[int]]:
        # The library adds the first mark itself, but not to an empty text.
        return [ids or [bare] for ids in sp.encode([w.decode() for w in words], num_threads=1)]
    return sp, encode


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: ``doc_id``, ``ids array<int>`` and ``decoded``, the text made of them again.

    Null and empty texts have no ids and decode to the empty text. Repeated rows stay repeated; a
    null ``doc_id`` is kept.
    """
    check_model(model_path)

    def build():
        step = shared(("pieces", model_path), lambda: _Step(model_path))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(step(batch))
            return pa.record_batch([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                                    pa.array([r[2]() for r in rows], pa.string())], ["doc_id", "ids", "decoded"])
        return run
    return by_batch(documents(docs), build, "doc_id long, ids array<int>, decoded string", BATCH)


def tokens(docs: DataFrame, model_path: str, ids: bool = True) -> DataFrame:
    """Per document: ``doc_id, n_tokens, ids, ids_sha256, decoded_sha256``; null and empty texts have no ids."""
    check_model(model_path)

    def build():
        step = shared(("pieces", model_path), lambda: _Step(model_path))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(len(own), own if ids else None, hashlib.sha256(text).hexdigest(), hashlib.sha256(decoded().encode()).hexdigest())
                    for own, text, decoded in step(batch)]
            n, lists, a, b = zip(*rows)
            return pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.int32())),
                                    pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])
        return run
    rows = by_batch(documents(docs), build,
                    "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string", BATCH)
    return rows if ids else rows.drop("ids")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """``tokens`` without the ids, which then never leave the tasks."""
    return tokens(docs, model_path, ids=False)


class _Step:
    """Documents of one batch as (ids, their decimal text, how to decode them)."""

    def __init__(self, path: str):
        self.sp, encode = word_encoder(path)
        self.table = ChunkTable(encode, limit=TABLE)
        self.decimal = [b"%d" % i for i in range(self.sp.get_piece_size())]

    def __call__(self, batch: pa.RecordBatch):
        texts = batch.column("text").fill_null("")
        lists = pc.split_pattern(texts, " ")
        # Runs of spaces, and marks that stand in the text itself, take the general way.
        flat, offsets = lists.flatten(), lists.offsets.to_numpy()
        empty = np.concatenate(([0], np.cumsum(pc.equal(flat, "").to_numpy(zero_copy_only=False))))[offsets]
        odd = (np.diff(empty) > 0) | pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)
        ids, ends = self.table.join(self.table.of(flat))
        ends = np.concatenate(([0], ends))[offsets].tolist()
        ids = ids.tolist()
        for start, end, row in zip(ends, ends[1:], np.where(odd, np.arange(len(odd)), -1).tolist()):
            own = ids[start:end]
            if row >= 0:
                words = marked_words(texts[row].as_py().encode())
                own = self.table.join(self.table.slots(words))[0].tolist()
            yield own, b",".join([self.decimal[i] for i in own]), lambda own=own: self.sp.decode(own) if own else ""
