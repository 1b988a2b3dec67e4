"""Mixing sources to target weights by a splitting tree of exact block quotas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songloom.llm.common import plain_names, WORD, table
from songloom.operators.skew import counted_lookup
from songloom.storage import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE, MOST_REPEATS = 1.5, 2
BLOCK_WORDS = 1024
#: Blocks of an output shard, on average.
SHARD_BLOCKS = 4096
_ROW_BITS = 33  # monotonically_increasing_id keeps the row within its partition in these bits
_LEVELS = 6  # tree levels after which the nodes are dealt out anew
#: Steps through a source's blocks; one that doesn't divide their number visits each once.
_STEPS = (1_000_003, 1_000_033, 1_000_037, 1_000_039)


@dataclass
class Mix:
    """``rows``: a row per document with its place in its source's stream and its target.
    ``segments``: what the mix takes, by output shard and place in the shard."""

    rows: DataFrame
    segments: DataFrame


def _running_totals(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with ``row`` (its place in ``order``) and for each name the sum of its value before it.

    Rows are range-sorted and stored; each partition sums its own, and one number per partition
    gives where it starts. No task sees more than one partition.
    """
    sorted_rows = df.orderBy(*order).withColumn("row", F.monotonically_increasing_id())
    placed = cut_lineage(sorted_rows).withColumn("_part", F.shiftright("row", _ROW_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = placed.groupBy("_part").agg(*[F.sum(x).alias(name) for name, x in values.items()])
    starts = cut_lineage(  # as many rows as the sort had partitions
        sums.select(
            "_part", *[F.coalesce(F.sum(x).over(earlier), zero).alias(f"_{x}") for x in values]
        )
    )
    within = Window.partitionBy("_part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    own = {name: F.coalesce(F.sum(x).over(within), zero) for name, x in values.items()}
    return (
        placed.withColumns(own)
        .join(F.broadcast(starts), "_part")
        .withColumns({name: F.col(name) + F.col(f"_{name}") for name in values})
        .drop("_part", *[f"_{name}" for name in values])
    )


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """``source``, ``source_size``, ``source_start`` (words of earlier sources), ``index``, ``target``.

    ``sizes`` has ``source`` and ``size``. Sources in code-point order, null last, take turns with
    ``weights`` and share ``share`` times all words; none gets more than ``most`` times its own,
    and what it can't take is shared by the others in the same proportions.
    """
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    totals = {"index": F.lit(1).cast("long"), "source_start": F.col("source_size")}
    numbered = _running_totals(summed, order, totals)
    turns = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(turns, (F.col("index") % len(weights) + 1).cast("int"))
    sources = cut_lineage(numbered.withColumn("weight", weight).drop("row"))
    most_of = F.col("source_size") * F.lit(float(most))
    level = 0.0
    while True:
        full = most_of <= F.col("weight") * F.lit(level)
        total, taken, open_weight = sources.agg(
            F.sum("source_size"), F.sum(F.when(full, most_of)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        budget = share * (total or 0)
        following = (budget - (taken or 0.0)) / open_weight if open_weight else level
        if following == level:
            break
        level = following
    full = most_of <= F.col("weight") * F.lit(level)
    target = F.when(full, most_of).otherwise(F.col("weight") * F.lit(level))
    chosen = sources.select("source", "source_size", "source_start", "index", target.alias("target"))
    return cut_lineage(chosen)


def hypergeometric(marked: Column, all_: Column, drawn: Column, u: Column) -> Column:
    """Marked ones among ``drawn`` of ``all_`` without replacement, where ``u`` in [0, 1) falls in
    the distribution. Chances follow from one another, so they are summed up from the lowest count
    with a weight of one, and then walked through to ``u`` of the sum. Counts over twelve deviations
    from the mean, with chances below 1e-30, are left out."""
    real = lambda x: x.cast("double")
    n = F.greatest(all_, F.lit(1)).cast("double")
    mean = drawn * marked / n
    spread = mean * (n - marked) / n * (n - drawn) / F.greatest(n - 1, F.lit(1.0))
    wide = 12 * F.sqrt(F.greatest(spread, F.lit(0.0))) + 12
    low = F.greatest(F.lit(0), drawn + marked - all_, F.floor(mean - wide)).cast("long")
    high = F.least(marked, drawn, F.ceil(mean + wide)).cast("long")
    counts = F.sequence(low, high)

    def following(weight: Column, x: Column) -> Column:
        down = real(x + 1) * real(all_ - marked - drawn + x + 1)
        return weight * real(marked - x) * real(drawn - x) / F.greatest(down, F.lit(1.0))

    def add(state: Column, x: Column) -> Column:
        return F.struct(
            (state["sum"] + state["w"]).alias("sum"), following(state["w"], x).alias("w")
        )

    def walk(state: Column, x: Column) -> Column:
        return F.struct(
            (state["left"] - state["w"]).alias("left"),
            following(state["w"], x).alias("w"),
            F.when(state["left"] >= state["w"], x + 1).otherwise(state["x"]).alias("x"),
        )

    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("w"))
    total = F.aggregate(counts, zero, add, lambda state: state["sum"])
    start = F.struct((u * total).alias("left"), F.lit(1.0).alias("w"), low.alias("x"))
    return F.least(F.aggregate(counts, start, walk, lambda state: state["x"]), high)


def _uniform(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def split_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard``, ``index`` and ``blocks``: each source's ``blocks`` dealt to ``shards`` shards.

    The counts are those of a random deal of all blocks: a node of the tree halves its shards, and
    the left half gets a multivariate hypergeometric draw of the node's blocks, source by source.
    Every source's blocks are all dealt, and shards have equal numbers of blocks (within one).
    A node holds one number per source.
    """
    quotas = F.transform(
        F.array_sort(F.collect_list(F.struct("index", "blocks"))), lambda x: x["blocks"]
    )
    nodes = sources.agg(quotas.alias("quotas")).select(
        F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("n"), "quotas"
    )
    levels = max(0, (shards - 1).bit_length())
    for level in range(levels):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        half = F.floor(F.col("n") / 2).cast("long")
        # the same rounding at every node keeps shards within one block of each other
        before = lambda at: F.floor(F.col("total") * at / F.col("n")).cast("long")
        state = F.struct(
            F.array().cast("array<long>").alias("left"),
            F.col("total").alias("all_"),
            before(F.col("half")).alias("drawn"),
        )

        def draw(acc: Column, quota: Column) -> Column:
            u = _uniform(F.lit(seed), F.col("first"), F.col("n"), F.size(acc["left"]))
            taken = hypergeometric(quota, acc["all_"], acc["drawn"], u)
            return F.struct(
                F.concat(acc["left"], F.array(taken)).alias("left"),
                (acc["all_"] - quota).alias("all_"),
                (acc["drawn"] - taken).alias("drawn"),
            )

        split = nodes.withColumn("total", total).withColumn("half", half)
        split = split.withColumn("left", F.aggregate("quotas", state, draw, lambda acc: acc["left"]))
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        children = F.array(
            F.struct(F.col("first"), F.col("half").alias("n"), F.col("left").alias("quotas")),
            F.struct(
                (F.col("first") + F.col("half")).alias("first"),
                (F.col("n") - F.col("half")).alias("n"),
                right.alias("quotas"),
            ),
        )
        nodes = split.select(F.explode(children).alias("child")).select("child.*").filter("n > 0")
        if level % _LEVELS == _LEVELS - 1:
            nodes = nodes.repartition("first")
    leaves = nodes.select(F.col("first").alias("shard"), F.posexplode("quotas").alias("index", "blocks"))
    return leaves.select("shard", F.col("index").cast("long"), "blocks")


def _drawn_blocks(dealt: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """``index``, ``block``, ``shard``, ``slot``: disjoint runs of each source's permuted blocks go
    to its shards, and each shard orders its blocks anew."""
    earlier = Window.partitionBy("index").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.withColumn("from", F.coalesce(F.sum("blocks").over(earlier), F.lit(0).cast("long")))
    runs = runs.filter("blocks > 0").join(
        quotas.select("index", F.col("blocks").alias("all_blocks")), "index"
    )
    step = F.coalesce(
        *[F.when(F.col("all_blocks") % p != 0, F.lit(p).cast("long")) for p in _STEPS],
        F.lit(1).cast("long"),
    )
    rank = F.explode(F.sequence(F.col("from"), F.col("from") + F.col("blocks") - 1))
    shift = F.pmod(F.xxhash64(F.lit(seed), F.col("index")), F.col("all_blocks"))
    block = ((F.col("rank") % F.col("all_blocks")) * step + shift) % F.col("all_blocks")
    blocks = runs.withColumn("rank", rank).select("shard", "index", block.alias("block"))
    within = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "index", "block"))
    return blocks.withColumn("slot", F.row_number().over(within))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    seed: int = 1,
) -> Mix:
    """Take words from every source to its target, in blocks dealt at random to output shards.

    A source's documents are put in an order fixed by ``seed`` and the hashes of their ids; their
    words form a stream that is read again from its start when the target is above its length.
    The stream is cut into blocks, the last one ending at the target, so every source gives its
    target rounded to whole words, and no document more than ``most`` times its own.

    ``rows``: ``row``, id, ``text_key``, ``source``, ``size``, ``source_size``, ``target``.
    ``segments``: ``shard``, ``slot``, ``block``, ``row``, ``round``, ``first_word``, ``n_words``.

    A null text has size 0, and documents without words are taken 0 words. Null sources are one
    source, the last. Null ids and repeated rows are rows like others. An empty table gives no
    rows. Other columns are not read.
    """
    text = F.col(text_col).cast("string")
    measured = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text).alias("text_key"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
    )
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    order = F.md5(F.concat(F.lit(f"{seed}:"), name))
    places = [F.col("source").asc_nulls_last(), order, F.col("id"), F.col("text_key")]
    stream = _running_totals(measured, places, {"at": F.col("size")})
    sources = source_targets(measured, weights, share, most)
    rows = cut_lineage(
        _lookup_source(stream, sources).select(
            "row",
            F.col("id").alias(id_col),
            "text_key",
            "source",
            "size",
            "source_size",
            "target",
            "index",
            (F.col("at") - F.col("source_start")).alias("at"),
            F.floor(F.col("target") + 0.5).cast("long").alias("words"),
        )
    )
    words = F.floor(F.col("target") + 0.5).cast("long")
    quotas = cut_lineage(
        sources.select("index", F.ceil(words / F.lit(block_words)).cast("long").alias("blocks"))
    )
    total = quotas.agg(F.sum("blocks")).first()[0] or 0
    shards = max(1, round(total / shard_blocks))
    blocks = _drawn_blocks(split_quotas(quotas, shards, seed), quotas, seed)

    turns = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    taken = rows.filter("size > 0").withColumn("round", turns)
    start = F.col("at") + F.col("round") * F.col("source_size")
    taken = taken.withColumn("start", start).withColumn(
        "stop", F.least(F.col("start") + F.col("size"), F.col("words"))
    )
    cut = F.lit(block_words)
    touched = F.explode(F.sequence(F.floor(F.col("start") / cut), F.floor((F.col("stop") - 1) / cut)))
    low = F.greatest(F.col("start"), F.col("block") * cut)
    high = F.least(F.col("stop"), (F.col("block") + 1) * cut)
    pieces = (
        taken.filter("stop > start")
        .withColumn("block", touched)
        .select("index", "block", "row", "round", (low - F.col("start")).alias("first_word"), (high - low).alias("n_words"))
    )
    # sizes of exploded tables are underestimated, so neither side may be taken for a small one
    segments = pieces.hint("merge").join(blocks.hint("merge"), ["index", "block"]).drop("index")
    return Mix(rows, segments)


def _lookup_source(stream: DataFrame, sources: DataFrame) -> DataFrame:
    """``stream`` with its source's figures. Sources with a large part of the rows are met by a
    small broadcast and their rows spread, the others by an ordinary join."""
    # a null source becomes a name of its own, so that it can be looked up
    name = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source"))
    left = stream.withColumn("_source", name)
    right = sources.select(name.alias("_source"), "source_size", "source_start", "index", "target")
    counts = left.groupBy("_source").agg(F.count(F.lit(1)).alias("_rows"))
    counted = cut_lineage(right.join(counts, "_source"))
    return counted_lookup(left, counted, "_source", "_rows", spread=["row"])


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """``docs`` mixed to the targets: each document as often as the mix takes it, to the nearest
    whole time, with its own columns. Rows with equal id and text are one row taken together, with
    the other columns of one of them. Columns may have any name."""
    plain, place = plain_names(docs)
    key, text = place[id_col], place[text_col]
    mix = mix_sources(plain, key, text, place[source_col], **options)
    times = (
        mix.segments.groupBy("row")
        .agg(F.sum("n_words").alias("taken"))
        .join(mix.rows.select("row", key, "text_key", "size"), "row")
        .groupBy(F.col(key).alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias("_times"))
    )
    keyed = plain.withColumn("_text_key", F.xxhash64(F.col(text).cast("string")))
    once = keyed.dropDuplicates([key, "_text_key"])
    match = F.col(key).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    found = once.join(times.filter("_times > 0"), match)
    turn = F.explode(F.sequence(F.lit(1), F.col("_times")))
    return found.withColumn("_turn", turn).select(*plain.columns).toDF(*docs.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Words the mix takes from every document."""
    mix = mix_sources(table(spark, sf_dir, "documents"))
    taken = mix.segments.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return mix.rows.join(taken, "row", "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS weight
  FROM d GROUP BY source),
ranked AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS most, 2 * source_size / CAST(weight AS DOUBLE) AS full_at FROM s),
levels AS (
  SELECT full_at,
         (1.5 * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(most) FROM ranked b WHERE b.full_at < a.full_at), 0))
         / CAST((SELECT sum(weight) FROM ranked b WHERE b.full_at >= a.full_at) AS DOUBLE) AS level
  FROM (SELECT DISTINCT full_at FROM ranked) a),
chosen AS (SELECT level FROM levels WHERE level <= full_at ORDER BY full_at LIMIT 1),
targets AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         least(most, CAST(weight AS DOUBLE) * (SELECT level FROM chosen)) AS target FROM ranked),
placed AS (
  SELECT d.doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS skipped
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, words - skipped)) + greatest(0, least(size, words - source_size - skipped)) AS taken
FROM placed
"""
