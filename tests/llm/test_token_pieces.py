"""Pieces of texts are told apart by Arrow; ids are those of the library on whole texts."""

import random

import numpy as np
import pyarrow as pa

from songloom.llm import token_files


def test_arrow_texts_in_any_order_have_the_library_s_ids():
    encoder = token_files.Encoder(token_files.default_tokenizer(), cached=50)
    draw = random.Random(3)
    parts = ["a", "foo", ".", ",", " ", " ", "\n", "\t", "\x00", "\x85", "　", "é", "1", "'s", "漢", "<|endoftext|>"]
    texts = ["".join(draw.choice(parts[: 7 if k % 2 else None]) for _ in range(draw.randrange(12))) for k in range(3000)]
    texts[::100] = [None] * 30
    found = encoder.tokenizer.encode_batch_fast([text or "" for text in texts], add_special_tokens=False)
    expected = [np.array(e.ids, "<u4").tobytes() + encoder.end for e in found]
    # arrays that begin inside their buffers
    array = pa.array(texts, pa.string())
    assert encoder.encode(array.slice(0, 1001)) + encoder.encode(array.slice(1001)) == expected
    assert encoder.encode(texts) == expected and encoder.encode([]) == []


def test_texts_encoded_at_once_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "_SLICE_ROWS", 3)
    monkeypatch.setattr(token_files, "_SLICE_BYTES", 10)
    texts = ["x" * 30, "", None, "", "", "yyyyy", "yyyyyy", "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["key", "body"])
    assert [part.column(1).to_pylist() for part in token_files._slices(batch)] == [texts[:1], texts[1:4], texts[4:6], texts[6:]]
