"""Tokens of whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word is a run of letters, in any script.
NON_LETTERS = r"[^\p{L}]+"


def words(text: Column | str) -> Column:
    """Lower-case words of a text, in order; blank edges of the split are kept out."""
    value = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(value), NON_LETTERS), lambda word: word != "")
