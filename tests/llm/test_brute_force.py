"""Operators without SQL against plain programs over small tables with hot groups."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from songloom.llm import bloom_lm, line_dedup, mixing, near_join, queries, token_files, toxicity, url_templates, weak_labels
from songloom.llm.common import table
from songloom.storage import scratch_path
from tests.llm.odd import prose

SMALL = "/root/testdata/sf0.001"


def _changed(text: str, seed: int, places: int) -> str:
    draw, words = random.Random(seed), text.split()
    for at in draw.sample(range(len(words)), places):
        words[at] = f"new{seed}x{at}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    """A group of 400 near copies of one text, exact copies, chains and single texts."""
    base = prose(11, 150)
    texts = [_changed(base, seed, seed % 4) for seed in range(400)]
    texts += [base] * 60 + [prose(100 + n, 80) for n in range(60)]
    chain = prose(12, 100).split()
    for step in range(6):
        texts.append(" ".join(chain))
        chain[15 * step : 15 * step + 3] = ["c", str(step), "d"]
    rows = list(enumerate(texts))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def _sets(text: str) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("block", [1024, 64])
def test_join_finds_every_link(spark, corpus, block):
    rows, docs = corpus
    members = defaultdict(list)
    for key, text in rows:
        members[_sets(text)].append(key)
    sets = list(members)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i, one in enumerate(sets):
        for j in range(i):
            shared = len(one & sets[j])
            if 5 * shared >= 4 * (len(one) + len(sets[j]) - shared):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, one in enumerate(sets):
        least[find(i)] = min(least.get(find(i), 1 << 60), *members[one])
    expected = {
        key: (least[find(i)], links[i], len(members[one])) for i, one in enumerate(sets) for key in members[one]
    }
    got = near_join.near_groups(docs, block=block).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in got} == expected


def test_every_long_repeated_run_goes(spark):
    passages = [prose(200 + n, 60) for n in range(5)]
    short = [prose(300 + n, 8) for n in range(5)]
    rows = []
    for n in range(300):
        draw = random.Random(n)
        own = [prose(1000 + 10 * n + k, draw.choice([5, 30, 70])) for k in range(3)]
        rows.append((n, "\n".join(draw.sample(own + [passages[n % 5], short[n % 5], ""], 6))))
    several = "\n".join(prose(400 + k, 12) for k in range(6))  # a run of short lines
    rows += [(1000, several), (1001, f"before it\n{several}\nafter it"), (1002, f"{several}\n{several}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cleaned = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    seen = set()
    for key, text in rows:
        kept = (cleaned[key].text or "").split("\n")
        for line in text.split("\n"):
            if key < 1000 and line in seen and len(line.split()) >= 50:
                assert line not in kept
            if line and line not in seen:  # short repeated lines go with the run beside them
                assert line in kept
        seen.update(text.split("\n"))
    assert cleaned[1000].n_removed == 0 and cleaned[1001].text == "before it\nafter it"
    assert cleaned[1002].n_removed == 12
    assert all(row.n_removed < row.n_lines for row in cleaned.values() if row.doc_id < 1000)


def test_run_that_only_later_places_share_goes(spark):
    rows, expected = [], {}
    for n in range(12):  # the first document shares no more than one long line with the others
        g, x, y = prose(5000 + n, 26), prose(5100 + n, 15), prose(5200 + n, 15)
        for k, text in enumerate([f"{g}\n{prose(5300 + n, 26)}", f"{x}\n{g}\n{y}", f"{x}\n{g}\n{y}\nend {n}"]):
            rows.append((100 * k + n, text))
        expected[200 + n] = f"end {n}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cleaned = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert {key: cleaned[key] for key in expected} == expected
    assert all(cleaned[key] == text for key, text in rows if key < 100)


def test_base_score_is_exact_and_model_helps(spark):
    docs = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = {key for key, _ in rows if zlib.crc32(str(key).encode()) % 7 == 2}
    counts = Counter(w for key, text in rows if key not in held for w in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    base, model = 0.0, 0.0
    for row in queries.QUERIES["op5_lm_scoring"](spark, SMALL).collect():
        words = tokens(dict(rows)[row.doc_id])
        expected = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        assert row.base_score == pytest.approx(expected, rel=1e-9)
        assert (row.n_tokens, row.train_tokens) == (len(words), total)
        assert row.n_known == sum(counts[w] > 0 for w in words)
        assert row.held_out == (row.doc_id in held)
        base, model = base + row.base_score * row.held_out, model + row.score * row.held_out
    assert model > base


def test_rows_that_fill_a_filter_follow_its_size_not_its_batches(spark, monkeypatch):
    counts = spark.range(0, 400_000, 1, 2).selectExpr("id * 7919 AS key", "3L AS c")
    sent, kind = [], type(counts)
    deal = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *keys: sent.append(df) or deal(df, *keys))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        bloom_lm.build_filter(counts)
        assert sent[0].count() < 10_000  # a batch, level and piece each had one before: more than 20,000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_filter_never_forgets(spark):
    rows = [(n * 7919, 1 + n % 300) for n in range(5000)]
    kept = bloom_lm.build_filter(spark.createDataFrame(rows, "key long, c long"))
    keys = np.array([key for key, _ in rows], np.int64).view(np.uint64)
    counts = np.array([c for _, c in rows])
    assert (kept.levels(keys) >= bloom_lm.level_of(counts)).all()
    assert (kept.levels(keys) == bloom_lm.level_of(counts)).mean() > 0.95
    assert (kept.levels(keys + np.uint64(1)) > 0).mean() < 0.05


def _labelled(sf_dir: str, column: str) -> dict:
    rows = duckdb.sql(f"SELECT doc_id, {column} FROM '{sf_dir}/labels.parquet'").fetchall()
    return dict(rows)


def test_toxicity_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    truth = _labelled(sf_dir, "toxic")
    rows = [r for r in toxicity.op6_toxicity(spark, sf_dir).collect() if r.held_out and r.doc_id in truth]
    toxic = [r.predicted for r in rows if truth[r.doc_id]]
    clean = [r.predicted for r in rows if not truth[r.doc_id]]
    # nine of the 144 texts labelled toxic there hold no word that marks any other toxic text
    assert sum(toxic) / len(toxic) > 0.93 and sum(clean) / len(clean) < 0.01


def test_toxicity_scores_by_plain_search(spark):
    """Counts, weights and scores again, with string search in place of the automaton."""
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # more partitions than labelled documents: some tasks of the learning see no row at all
    lexicon = toxicity.learn_lexicon(docs.repartition(64), toxicity._training(labels))
    texts = {row.doc_id: row.text for row in docs.collect()}
    marks = {row.doc_id: row.toxic for row in labels.collect() if zlib.crc32(str(row.doc_id).encode()) % 3 != 1}
    sizes = Counter(marks.values())
    assert lexicon.weights
    for pattern, weight in lexicon.weights.items():
        shown = Counter(marks[key] for key in marks if pattern in toxicity.fold(texts[key]))
        share = [(shown[label] + 0.5) / (sizes[label] + 1) for label in (0, 1)]
        assert math.isclose(weight, math.log(share[1] / share[0]), rel_tol=1e-9)
    found = {row.doc_id: row.score for row in toxicity.op6_toxicity(spark, sf_dir).collect()}
    assert found.keys() == texts.keys()
    for key, text in texts.items():
        folded, best = toxicity.fold(text), {}
        for pattern, weight in lexicon.weights.items():
            for hit in re.finditer(f"(?={re.escape(pattern)})", folded):
                best[hit.start()] = max(weight, best.get(hit.start(), 0.0))
        for phrase in lexicon.exceptions:
            for hit in re.finditer(f"(?={re.escape(phrase)})", folded):
                best = {at: w for at, w in best.items() if not hit.start() <= at < hit.start() + len(phrase) - 1}
        total, n_words = sum(best.values()), len(folded.split())
        bias, by_total, by_rate = lexicon.coefficients
        logit = bias + by_total * math.log1p(total) + by_rate * math.log1p(100 * total / (n_words + 50))
        assert math.isclose(found[key], 1 / (1 + math.exp(-logit)), rel_tol=1e-6)


def test_quality_agrees_with_unseen_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = _labelled(sf_dir, "quality")
    rows = [r for r in weak_labels.op1_quality_classifier(spark, sf_dir).collect() if r.doc_id in truth]
    good = [r.kept for r in rows if truth[r.doc_id]]
    bad = [r.kept for r in rows if not truth[r.doc_id]]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2


def test_lookalikes_phrases_and_length():
    lexicon = toxicity.Lexicon({" idiot": 5.0}, [" idiot savant "], (-4.0, 1.0, 1.0))
    machine = lexicon.automaton()
    weight = lambda text: sum(toxicity.hits(toxicity.fold(text), machine).values())
    assert weight("You 1D10T!") == weight("you іdіоt") == weight("IDIOTS") == 5.0
    assert weight("an idiot savant") == 0 and weight("the-idiot savants") == 5.0
    assert toxicity.score(5, 10, lexicon.coefficients) > toxicity.score(5, 5000, lexicon.coefficients)


def test_draws_are_hypergeometric(spark):
    from pyspark.sql import functions as F

    u = (F.col("id") + 0.5) / 5000
    for marked, all_, drawn in ((3, 10, 5), (200, 1000, 400), (0, 5, 2), (5, 5, 2)):
        whole = [F.lit(x).cast("long") for x in (marked, all_, drawn)]
        found = spark.range(5000).select(mixing.hypergeometric(*whole, u).alias("x")).groupBy("x").count()
        for row in found.collect():
            chance = math.comb(marked, row.x) * math.comb(all_ - marked, drawn - row.x) / math.comb(all_, drawn)
            assert row["count"] / 5000 == pytest.approx(chance, abs=1e-3)


def test_shards_get_equal_blocks_and_no_block_twice(spark):
    rows = [(n, prose(n, 40), "abcd"[n % 3]) for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mix_sources(docs, block_words=32, shard_blocks=20)
    blocks = {(r.shard, r.slot, r.block, r.row, r.round, r.first_word) for r in mix.segments.collect()}
    assert len(blocks) == mix.segments.count()
    slots = defaultdict(set)
    for shard, slot, *_ in blocks:
        slots[shard].add(slot)
    sizes = {len(x) for x in slots.values()}
    assert len(slots) > 10 and max(sizes) - min(sizes) <= 1
    again = mixing.mix_sources(docs.repartition(7), block_words=32, shard_blocks=20)
    same = lambda m: sorted((r.shard, r.slot, r.first_word, r.n_words) for r in m.segments.collect())
    assert same(mix) == same(again)


def test_tokens_equal_the_library_and_damage_is_found(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = token_files.default_tokenizer()
    library = Tokenizer.from_file(tokenizer)
    texts = [
        "Plain words, and more.", "two  blanks \n\n three\t tabs ", " leading", "trailing ", "\n", "it's we'll 12.5%",
        "é   x y", "don't, stop... now.,", "a\x00b c", "naïve, Größe. 中文 text", "", "x" * 5000,
    ]
    expected = {n: library.encode(t, add_special_tokens=False).ids + [2] for n, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = token_files.write_tokens(docs, str(tmp_path), tokenizer, frame_ids=8)
    assert {r.doc_id: r.ids for r in token_files.read_tokens(files).collect()} == expected
    path = next(p for p in tmp_path.iterdir() if p.suffix == ".tok")
    with path.open("rb") as source:
        reader = token_files.FileReader(source)
        first = next(iter(reader.documents({reader.keys[0]})))
        assert first[0] == reader.keys[0] and reader.unpacked == 2 <= len(reader.entries)
    data = bytearray(path.read_bytes())
    data[len(data) // 8] ^= 0xFF
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="."):
        token_files.read_tokens(files).collect()


def _plain_templates(paths: list[tuple], most: int) -> dict:
    """The template of every path, level by level, by a plain program."""
    template = {path: "" for path in paths}
    wild = lambda x: "*" + (re.search(r"(\.[A-Za-z]+)$", x) or [""])[0]
    for level in range(max(map(len, paths))):
        nodes = defaultdict(Counter)
        longer = [path for path in paths if len(path) > level]
        for path in longer:
            nodes[template[path]][path[level]] += 1
        grown = {}
        for path in set(longer):
            node, own = nodes[template[path]], path[level]
            fixed = [x for x in node if not re.match(url_templates.VARIABLE, x)]
            stays = own in fixed and (len(fixed) <= most or node[own] * most >= sum(node.values()))
            grown[path] = f"{template[path]}/{own if stays else wild(own)}"
        template |= grown
    return template


def test_paths_are_judged_at_every_level(spark):
    rows = [(n, f"http://h.org/a/b/c/d/{'spam' if n % 2 else 'docs'}/{n}") for n in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(n, 1 - n % 2, 0) for n in range(80)], "doc_id long, quality int, toxic int")
    verdicts = {r.page_id: r.verdict for r in url_templates.judge_urls(pages, labels, rules={}).collect()}
    assert verdicts == {n: "block" if n % 2 else "allow" for n in range(80)}
    draw = random.Random(3)
    paths = [tuple(draw.choices(["a", "b", "c.html", "7", "8.html"], [6, 2, 1, 1, 1], k=draw.randint(0, 7))) for _ in range(300)]
    paths += [("a",) * 40 + (x,) for x in ("b", "9", "c")] + [("trap", "1") * 30] * 2
    parted = spark.createDataFrame(
        [(n, "h", "/" + "/".join(p), list(p)) for n, p in enumerate(paths)],
        "page long, host string, path string, segments array<string>",
    )
    found = {r.page: r.template for r in url_templates._templates(parted, None, 2).collect()}
    expected = _plain_templates(paths, 2)
    assert found == {n: expected[p] for n, p in enumerate(paths)}


def test_added_tokens_in_texts_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = token_files.default_tokenizer()
    library = Tokenizer.from_file(tokenizer)
    mark = "<|endoftext|>"
    texts = [
        f"some {mark} more", mark, f"{mark}{mark}", f"a word,{mark}. b\n{mark}\n c", f"two  blanks {mark}", "a word, b",
        f" {mark} ", "<|endoftext |>", "<|endoftext", f"<{mark}>", f"{mark} " * 300, "|> c",
    ]
    expected = {n: library.encode(t, add_special_tokens=False).ids + [2] for n, t in enumerate(texts)}
    assert 50256 in expected[0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = token_files.write_tokens(docs, str(tmp_path), tokenizer)
    assert {r.doc_id: r.ids for r in token_files.read_tokens(files).collect()} == expected


def test_pipeline_keeps_what_its_stages_say(spark):
    docs = table(spark, SMALL, "documents")
    lexicon = toxicity.learn_lexicon(docs, toxicity._training(table(spark, SMALL, "labels")))
    machine = lexicon.automaton()

    def toxic(text):
        folded = toxicity.fold(text)
        weight = sum(toxicity.hits(folded, machine).values())
        return toxicity.score(weight, folded.count(" ") - 1, lexicon.coefficients) >= 0.7

    rows = sorted((r.doc_id, r.text) for r in docs.collect() if not toxic(r.text))
    kept, sets = [], []
    for key, text in rows:  # links join groups, of which the least id stays
        mine = _sets(text)
        groups = [g for g in sets if any(5 * len(mine & s) >= 4 * len(mine | s) for s in g)]
        if not groups:
            kept.append((key, text))
        sets = [g for g in sets if g not in groups] + [[mine, *[s for g in groups for s in g]]]
    items = [(str(r.item_id), r.text) for r in table(spark, SMALL, "benchmark").collect()]
    from songloom.llm.decontaminate import words_of

    grams = {tuple(w[i : i + 10]) for w in (words_of(t) for _, t in items) for i in range(max(1, len(w) - 9))}
    clean = {k for k, t in kept if not any(tuple(words_of(t)[i : i + 10]) in grams for i in range(len(words_of(t))))}
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} <= clean and len({r.doc_id for r in out}) > 0.6 * len(clean)
    assert sorted(r.start for r in out)[0] == 0
    assert sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)
    staged = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        path = scratch_path(spark, name)
        stage(spark, staged, SMALL).write.parquet(path)
        staged = spark.read.parquet(path)
        assert staged.columns == docs.columns
    assert {r.doc_id for r in staged.collect()} == clean
