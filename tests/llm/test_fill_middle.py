"""Fill-in-the-middle against a plain program."""

from __future__ import annotations

import hashlib
import re

import pytest

from songloom.llm import fill_middle
from tests.llm.odd import no_docs, odd_docs, odd_rows, prose

TEXTS = [
    None, "", "x", "\n", "a\U0001f600b\r\n\x85c ", "é‍", "has <S> inside", "<P", "<<M", "S>M>",
    "$1 \\ $2", "\x00\x01", prose(1, 9_000), "\U0001f600" * 3_000, "line\n" * 2_000,
]


def _numbers(key: str, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def _expected(key: str, units: list[str], text: str, seed: int = 1, cut: int = 90, turned: int = 20) -> tuple:
    h1, h2, h3, h4 = _numbers(key, seed)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if text == "" or re.search("<[PSM]>", text) or h3 % 100 >= cut:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < turned:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("seed", [1, 2])
def test_every_text_is_cut_and_rebuilt(spark, seed):
    rows = [(100 * k + n, text) for k in range(6) for n, text in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = fill_middle.fill_in_middle(docs, seed=seed)
    back = made.withColumn("back", fill_middle.restore(made["output"], made["form"])).collect()
    assert sorted(row.doc_id for row in back) == [key for key, _ in rows]
    forms = set()
    for row in back:
        text = row.text or ""
        wanted = _expected(str(row.doc_id), list(text), text, seed)
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == wanted
        assert row.back == text
        forms.add(row.form)
    assert forms == {"plain", "psm", "spm"}


def test_other_units(spark):
    words = r"\S++\s*+"
    rows = [(1, "one two  three\n"), (2, " leading"), (3, prose(2, 5_000)), (4, ""), (5, "\U0001f600 a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fill_middle.fill_in_middle(docs, unit=words, cut_percent=100, suffix_first_percent=50)
    for row in made.collect():
        units = re.findall(r"\S+\s*", row.text)
        if row.doc_id == 2:
            assert (row.form, row.output, row.prefix_chars) == ("plain", " leading", None)
        else:
            wanted = _expected(str(row.doc_id), units, row.text, 1, 100, 50)
            assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == wanted


def test_odd_rows(spark):
    clash = odd_docs(spark).withColumnsRenamed({"node": "_text", "spans": "output", "score": "_n"})
    made = fill_middle.fill_in_middle(clash)
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "_n", "_text", "n_words", "n", "form", "output", "prefix_chars", "middle_chars"]
    rows = made.collect()
    assert len(rows) == len(odd_rows()) and {row._text for row in rows} == {"n"}
    for row in rows:
        text = row.text or ""
        key = "" if row.doc_id is None else str(row.doc_id)
        assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output) == _expected(key, list(text), text)
    assert fill_middle.fill_in_middle(no_docs(spark)).count() == 0


def test_no_python_and_no_shuffle(spark, sf_dir):
    plan = fill_middle.op11_fill_in_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
