"""What the operators on training text share: words, table access, small-column hygiene."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
GAP = r"[\x20\x09-\x0D]+"
#: ASCII capitals to small letters; other scripts keep their case.
LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}
UPPER_ASCII = "".join(map(chr, LOWER))
_BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """``text`` with A-Z in lower case and every other character as it was."""
    return text.lower() if text.isascii() else text.translate(LOWER)


def lower_ascii_column(text: Column) -> Column:
    return F.translate(text, UPPER_ASCII, UPPER_ASCII.lower())


def words_column(text: Column) -> Column:
    """All words of ``text`` in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda word: word != "")


def id_remainder(key: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While rows are long arrays or texts, fewer of them go to Python at a time.

    The setting is read when a job begins, and put back as it was.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, _BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under positional column names, which clash with no operator's, and where each is."""
    names = [f"_column{n}" for n in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def map_texts(
    docs: DataFrame,
    text_col: str,
    keep: list[str],
    make: Callable[[], Callable[[list[str | None]], list]],
    fields: dict[str, tuple[str, pa.DataType]],
    rows: int = 500,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` as they are, and columns computed from each text.

    ``make`` runs once in a task and gives a function from some texts to one list per field.
    ``fields`` has the Spark and the Arrow type of each. Kept columns stay Arrow data, so ids keep
    their nulls and types; positional names let them be called anything. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        kinds = [kind for _, kind in fields.values()]
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                made = function(part.column(len(keep)).to_pylist())
                arrays = [pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *arrays], names)

    names = [*[f"_k{n}" for n in range(len(keep))], *fields]
    kept = [docs[name].alias(f"_k{n}") for n, name in enumerate(keep)]
    read = docs.select(*kept, docs[text_col].cast("string").alias("_body"))
    types = [docs.schema[name].dataType.simpleString() for name in keep]
    types += [kind for kind, _ in fields.values()]
    made = read.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in zip(names, types)))
    return made.select(*[F.col(f"_k{n}").alias(name) for n, name in enumerate(keep)], *fields)
