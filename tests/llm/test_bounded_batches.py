"""What a worker holds at once while it encodes texts."""

import numpy as np

from songloom.llm import token_files

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Recorder:
    """The library's tokenizer, and how many pieces it got at once."""

    def __init__(self, tokenizer):
        self.tokenizer, self.sizes = tokenizer, []

    def encode_batch_fast(self, pieces, add_special_tokens):
        self.sizes.append(len(pieces))
        return self.tokenizer.encode_batch_fast(pieces, add_special_tokens=add_special_tokens)


def test_pieces_go_to_the_library_in_groups():
    encoder = token_files.Encoder(token_files.default_tokenizer())
    text = " ".join(f"word{n}x" for n in range(10_000))
    expected = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    encoder.tokenizer = recorder = Recorder(encoder.tokenizer)
    assert encoder.encode([text]) == [expected + encoder.end]
    assert len(recorder.sizes) > 1 and max(recorder.sizes) <= 4096


def test_files_are_written_from_small_batches(spark, tmp_path, monkeypatch):
    rows, store = [], token_files.cut_lineage

    def stored(df):
        rows.append(int(spark.conf.get(ROWS)))
        return store(df)

    monkeypatch.setattr(token_files, "cut_lineage", stored)
    before = spark.conf.get(ROWS)
    docs = spark.createDataFrame([(2, "b"), (1, None)], "doc_id long, text string")
    files = token_files.write_tokens(docs, f"file://{tmp_path}/tokens", token_files.default_tokenizer())
    assert [row.doc_id for row in token_files.read_tokens(files).orderBy("start").collect()] == [1, 2]
    assert rows == [1000] and spark.conf.get(ROWS) == before
