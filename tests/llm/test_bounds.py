"""What workers keep between tasks."""

from __future__ import annotations

import pyarrow as pa

from tallyframe.llm import piece_codec
from tallyframe.llm.common import slices


def test_codec_workers_keep_few_words(tokenizer):
    """A worker that waits stands beside the heap of the next stage: 20 MB of distinct words leave less than half."""
    step = piece_codec._Step(tokenizer("piece_bpe_32k.model"))
    most = 0
    for start in range(0, 240_000, 20_000):
        texts = [" ".join(f"w{i}x{i * i}" for i in range(k, k + 200)) for k in range(start, start + 20_000, 200)]
        batch = pa.record_batch([pa.array(texts)], ["text"])
        for part in slices(batch, piece_codec.BATCH):
            for ids, _, decoded in step(part):
                assert ids and decoded() in texts
            most = max(most, step.table.bytes)
    assert most < 12 << 20
