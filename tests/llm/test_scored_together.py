"""Texts are scored in groups, in which repeated words and bigrams are looked up once."""

import numpy as np

from songloom.llm import bloom_lm


def test_a_thousand_texts_are_scored_together(spark, monkeypatch):
    rows, mapped = [], bloom_lm.map_texts

    def recorded(*args, **named):
        rows.append(named.get("rows", 500))
        return mapped(*args, **named)

    monkeypatch.setattr(bloom_lm, "map_texts", recorded)
    docs = spark.createDataFrame([(n, f"a b c{n % 7} a b") for n in range(2100)], "doc_id long, text string")
    found = bloom_lm.score_corpus(docs, docs).collect()
    assert rows == [1000]
    # equal texts score alike whatever group they are in
    scores = {n: {round(row.score, 9) for row in found if row.doc_id % 7 == n} for n in range(7)}
    assert len(found) == 2100 and {len(x) for x in scores.values()} == {1}


def test_levels_are_those_of_one_probe_after_the_other():
    draw = np.random.default_rng(5)
    n_bits = 50_000
    bits = draw.integers(0, 256, n_bits // 8 + 1, np.uint8) | draw.integers(0, 256, n_bits // 8 + 1, np.uint8)
    known = bloom_lm.Filter(bits, n_bits)
    keys = draw.integers(0, 1 << 63, 3000).astype(np.uint64)

    def level_of(key):
        found = 0
        for level in bloom_lm.STORED:
            one, two = bloom_lm._hashes(key, level)
            for number in range(bloom_lm.HASHES):
                place = int(bloom_lm._place(one, two, number, n_bits)[0])
                if not bits[place >> 3] >> (place & 7) & 1:
                    return found
            found = level
        return found

    expected = [level_of(keys[n : n + 1]) for n in range(len(keys))]
    assert known.distinct_levels(keys).tolist() == expected and max(expected) > 1
    assert known.distinct_levels(keys[:0]).tolist() == []
