"""Similarity join of documents: a MinHash LSH forest, then exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import map_texts, plain_names, table
from songloom.operators.skew import counted_lookup
from songloom.storage import cut_lineage

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 20
LONGEST_PREFIX = 8
TARGET_RECALL = 0.9999
#: Members of a bucket that one task compares with each other, or with as many others.
BLOCK = 1024
_TILE = 256  # members compared by one matrix product
_COLUMNS = 8192  # shingles in one matrix product
_SEED = 20_240_501


def prefix_length(
    threshold: float = THRESHOLD,
    trees: int = TREES,
    longest: int = LONGEST_PREFIX,
    target: float = TARGET_RECALL,
) -> int:
    """Matched prefix of the tries: shortened from ``longest`` until pairs at the threshold share
    a prefix in some tree with probability ``target``. More similar pairs do so more surely."""
    for depth in range(longest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= target:
            return depth
    return 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit integer spread over all bits (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles of some texts, and how many each text has.

    Words stand between ASCII white space, with A-Z in lower case. A text of fewer words is one
    shingle; one without words has none.
    """
    words = [(text or "").encode("utf-8", "replace").lower().split() for text in texts]
    counts = np.array([len(x) for x in words], np.int64)
    flat = np.array([w for x in words for w in x], dtype=object)
    hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    padded = np.concatenate([hashed, np.zeros(size, np.uint64)])
    n = len(hashed)
    starts = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(texts)), counts)
    left = starts[owner + 1] - np.arange(n)  # words from here to the end of the text
    total = np.zeros(n, np.uint64)
    for k in range(size):
        inside = (left > k).astype(np.uint64)
        total = total * np.uint64(0x9E3779B97F4A7C15) + (_mixed(padded[k : n + k]) | np.uint64(1)) * inside
    first = np.arange(n) == starts[owner]
    keep = (left >= size) | first
    return _mixed(total[keep]), np.bincount(owner[keep], minlength=len(texts))


def _signer(size: int, trees: int, depth: int):
    """A function from texts to shingle counts, digests of shingle sets, and keys by tree."""
    random = np.random.default_rng(_SEED)
    salts = random.integers(1, 2**63, trees * depth, dtype=np.uint64)
    factors = random.integers(1, 2**63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(texts: list[str | None]) -> list:
        flat, counts = shingles(texts, size)
        full = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts[full])])
        digests: list[bytes | None] = [None] * len(texts)
        sizes = np.zeros(len(texts), np.int64)
        for place, doc in enumerate(full):
            distinct = np.unique(flat[starts[place] : starts[place + 1]])
            sizes[doc] = len(distinct)
            with np.errstate(over="ignore"):
                one = np.add.reduce(distinct) + np.uint64(len(distinct))
                two = np.add.reduce(_mixed(distinct ^ np.uint64(_SEED)))
            digests[doc] = one.tobytes() + two.tobytes()
        keys: list[list[int]] = [[] for _ in texts]
        if len(full):
            labels = np.zeros((trees, len(full)), np.uint64)
            for tree in range(trees):
                label = np.full(len(full), tree + 1, np.uint64)
                for at in range(tree * depth, (tree + 1) * depth):
                    least = np.minimum.reduceat((flat ^ salts[at]) * factors[at], starts[:-1])
                    label = _mixed(label * np.uint64(0x9E3779B97F4A7C15) + least)
                labels[tree] = label
            for place, doc in enumerate(full):
                keys[doc] = labels[:, place].view(np.int64).tolist()
        return [sizes, digests, keys]

    return sign


def _incidence(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``one`` shares with each set of ``two``."""
    both = np.concatenate([*one, *two])
    values, inverse, seen = np.unique(both, return_inverse=True, return_counts=True)
    place = np.cumsum(seen > 1) - 1  # a value of one set can't be shared
    row = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in (*one, *two)])
    useful = seen[inverse] > 1
    row, column = row[useful], place[inverse[useful]]
    shared = np.zeros((len(one), len(two)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    last = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, last, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        dense = np.zeros((len(one) + len(two), min(_COLUMNS, last - low)), np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        shared += dense[: len(one)] @ dense[len(one) :].T
    return shared


class _Unit:
    """Members of one bucket block, or of two blocks that are compared with each other."""

    def __init__(self, key: int, one: list[tuple], two: list[tuple] | None, ratio: Fraction):
        self.key, self.ratio = key, ratio
        self.members = one + (two or [])
        self.split = len(one) if two is not None else None
        self.root = list(range(len(self.members)))
        self.links = np.zeros(len(self.members), np.int64)

    def _find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def _link(self, x: int, y: int) -> None:
        a, b = self._find(x), self._find(y)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def _similar(self, shared, one, two):
        return shared * self.ratio.denominator >= self.ratio.numerator * (one + two - shared)

    def _pair(self, x: int, y: int) -> None:
        _, mine, a = self.members[x]
        _, other, b = self.members[y]
        if min(set(mine) & set(other)) != self.key:
            return  # compared in another bucket
        shared = len(np.intersect1d(a, b, assume_unique=True))
        if self._similar(shared, len(a), len(b)):
            self.links[[x, y]] += 1
            self._link(x, y)

    def _tile(self, xs: range, ys: range) -> None:
        sets = lambda at: [self.members[i][2] for i in at]
        smaller = lambda at: [
            np.array([k for k in self.members[i][1] if k < self.key], np.int64) for i in at
        ]
        owned = _incidence(smaller(xs), smaller(ys)) == 0
        if xs == ys:
            owned &= np.arange(len(xs))[:, None] < np.arange(len(ys))[None, :]
        if not owned.any():
            return
        shared = _incidence(sets(xs), sets(ys)).astype(np.int64)
        sizes = lambda at: np.array([len(x) for x in sets(at)], np.int64)
        linked = owned & self._similar(shared, sizes(xs)[:, None], sizes(ys)[None, :])
        self.links[xs.start : xs.stop] += linked.sum(1)
        self.links[ys.start : ys.stop] += linked.sum(0)
        for x, y in zip(*np.nonzero(linked)):
            self._link(xs.start + int(x), ys.start + int(y))

    def compare(self) -> list[tuple[int, int, int]]:
        """Member, links found here, and the least member that these links lead to."""
        n = len(self.members)
        if n <= 6:
            for x in range(n):
                for y in range(x + 1, n):
                    if self.split is None or x < self.split <= y:
                        self._pair(x, y)
        else:
            sides = [range(n)] * 2 if self.split is None else [range(self.split), range(self.split, n)]
            tiles = [[side[i : i + _TILE] for i in range(0, len(side), _TILE)] for side in sides]
            for xs in tiles[0]:
                for ys in tiles[1]:
                    if self.split is not None or xs.start <= ys.start:
                        self._tile(xs, ys)
        least: dict[int, int] = {}
        for x in range(n):
            at = self._find(x)
            least[at] = min(least.get(at, self.members[x][0]), self.members[x][0])
        return [
            (self.members[x][0], int(self.links[x]), least[self._find(x)])
            for x in range(n)
            if self.links[x]
        ]


def _compare(threshold: float):
    """Reads rows sorted by unit; a unit may go on in the next batch."""
    ratio = Fraction(str(threshold))

    def unit_of(key: int, low: int, high: int, rows: list[tuple]) -> list[tuple[int, int, int]]:
        if low == high:
            return _Unit(key, [r[1:] for r in rows], None, ratio).compare()
        one, two = ([r[1:] for r in rows if r[0] == side] for side in (low, high))
        return _Unit(key, one, two, ratio).compare() if one and two else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, out = None, [], []
        for batch in batches:
            keys, lows, highs, blocks, nodes, kept, hashed = batch.columns
            sets = hashed.values.to_numpy(zero_copy_only=False).view(np.uint64)
            ends = hashed.offsets.to_numpy()
            lists = kept.to_pylist()
            units = zip(keys.to_pylist(), lows.to_pylist(), highs.to_pylist())
            members = zip(blocks.to_pylist(), nodes.to_pylist())
            for at, (unit, (block, node)) in enumerate(zip(units, members)):
                if unit != held:
                    if rows:
                        out += unit_of(*held, rows)
                    held, rows = unit, []
                rows.append((block, node, lists[at], sets[ends[at] : ends[at + 1]].copy()))
            if len(out) > 10_000:
                yield _links(out)
                out = []
        if rows:
            out += unit_of(*held, rows)
        yield _links(out)

    return run


def _links(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = zip(*out) if out else ([], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(list(x), pa.int64()) for x in columns], ["node", "links", "least"]
    )


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (least node of its component) for every node in ``edges`` (node, least).

    Each round hangs the larger neighbours of every node on its least neighbour, then the smaller
    ones, until all edges lead straight to a root. Rounds grow with the logarithm of the longest
    chain; a node with very many edges is a skewed join key, which Spark splits.
    """
    edges = cut_lineage(edges.select(F.col("node").alias("a"), F.col("least").alias("b")))
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).filter("a <> b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        down = large.filter("a <> b")
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        fresh = (
            down.join(small, "a")
            .filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small)
            .distinct()
        )
        edges = cut_lineage(fresh)
        # done when no node hangs on two others, nor on one that hangs itself
        parents = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        tangled = parents.filter("n > 1").select("a")
        chained = edges.join(parents.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        if not tangled.union(chained).take(1):
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    size: int = SHINGLE_WORDS,
    trees: int = TREES,
    target: float = TARGET_RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """Join ``docs`` with itself on Jaccard similarity of word shingles of ``threshold`` or more.

    A row per row of ``docs``: its id, ``text_key`` (a hash of its text), ``class_id`` (least id
    of all rows that links join, directly or through others), ``n_links`` (number of different
    shingle sets linked to its own) and ``n_copies`` (rows with its shingle set).

    Rows with equal shingle sets are one node, so copies never meet pairwise. A node's signature
    is cut to prefixes, one for each tree, and nodes with an equal prefix form a bucket; of buckets
    with the same members one is kept. Large buckets are split into blocks which meet two by two.
    Every pair is verified once, on whole sets, in the least of its common buckets, and pairs
    never become rows: a task emits counts and one link for each member.

    Null, empty and blank texts have no shingles, no links and a class of their own (their id).
    Repeated rows are copies. Null ids come out as null and never name a class unless all its
    ids are null. An empty table gives no rows. Other columns are not read.
    """
    return _grouped(docs, id_col, text_col, threshold, size, trees, target, block).drop("class_key")


def _grouped(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float = THRESHOLD,
    size: int = SHINGLE_WORDS,
    trees: int = TREES,
    target: float = TARGET_RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """:func:`near_groups` with ``class_key``, which tells classes apart whatever ids they have; it is
    null for texts without words."""
    depth = prefix_length(threshold, trees, LONGEST_PREFIX, target)
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("body"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_key"),
    )
    fields = {
        "n_shingles": ("long", pa.int64()),
        "digest": ("binary", pa.binary()),
        "keys": ("array<long>", pa.list_(pa.int64())),
    }
    signed = cut_lineage(
        map_texts(keyed, "body", ["id", "text_key"], lambda: _signer(size, trees, depth), fields)
    )
    nodes = cut_lineage(
        signed.filter("digest is not null")
        .groupBy("digest")
        .agg(
            F.min(F.struct("text_key", "id", "keys")).alias("one"),
            F.min("id").alias("least_id"),
            F.count(F.lit(1)).alias("copies"),
        )
        .select(
            F.xxhash64("digest").alias("node"),
            "digest",
            "least_id",
            "copies",
            F.col("one.text_key").alias("text_key"),
            F.col("one.id").alias("id"),
            F.col("one.keys").alias("keys"),
        )
    )
    kept = _shared_buckets(nodes)
    found = cut_lineage(_verified(docs_of(keyed, nodes, kept, size), kept, threshold, block))
    roots = components(found.filter("node <> least").select("node", "least").distinct())
    counts = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    # names of classes: only nodes with links are in ``roots``
    named = roots.join(nodes.select("node", "least_id"), "node")
    classes = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    linked = roots.join(classes, "root").select("node", "root", "class_id").join(counts, "node", "left")
    described = cut_lineage(
        nodes.select("node", "digest", "least_id", "copies")
        .join(linked, "node", "left")
        .select(
            "digest",
            F.coalesce("root", "node").alias("class_key"),
            F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.col("copies").alias("n_copies"),
        )
    )
    rows = signed.select("id", "text_key", "digest")
    placed = counted_lookup(rows, described, "digest", "n_copies")
    none = F.col("digest").isNull()
    return placed.select(
        F.col("id").alias(id_col),
        "text_key",
        "class_key",
        F.when(none, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"),
    )


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    """``key``, ``node``, ``m`` (members): buckets of two or more, one for each set of members."""
    pairs = nodes.select("node", F.explode("keys").alias("key"))
    sizes = pairs.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"),
        F.bit_xor(F.xxhash64("node")).alias("mark"),
        F.sum(F.xxhash64("node", F.lit(1)).bitwiseAND(F.lit((1 << 40) - 1))).alias("total"),
    )
    chosen = (
        sizes.filter("m > 1").groupBy("m", "mark", "total").agg(F.min("key").alias("key")).select("key", "m")
    )
    return cut_lineage(pairs.join(chosen, "key"))


def docs_of(keyed: DataFrame, nodes: DataFrame, kept: DataFrame, size: int) -> DataFrame:
    """``node``, its bucket keys and its shingle set, for nodes in some bucket."""
    lists = kept.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("kept"))
    needed = nodes.select("node", "id", "text_key").join(lists, "node")
    wanted = needed.select("node", "kept", F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    read = keyed.join(
        wanted, (F.col("text_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))
    )

    def make():
        def run(texts: list[str | None]) -> list:
            flat, counts = shingles(texts, size)
            ends = np.cumsum(counts)
            return [[np.unique(x).view(np.int64) for x in np.split(flat, ends[:-1])]]

        return run

    field = {"hashes": ("array<long>", pa.list_(pa.int64()))}
    sets = map_texts(read, "body", ["node", "kept"], make, field, rows=200)
    return cut_lineage(sets.dropDuplicates(["node"]))


def _verified(sets: DataFrame, kept: DataFrame, threshold: float, block: int) -> DataFrame:
    """``node``, ``links`` and ``least`` from comparing all buckets."""
    n_blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(2)), n_blocks).cast("int")
    units = (
        kept.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        .select(
            "key",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "own",
            "node",
        )
    )
    filled = units.join(sets, "node").select("key", "low", "high", "own", "node", "kept", "hashes")
    spread = filled.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return spread.mapInArrow(_compare(threshold), "node long, links long, least long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the least id (of equal ids, least text hash; null
    ids last).

    Classes are told apart by their links, not by ids, so texts that share an id, or have none, are
    judged each by itself. Rows of documents without words all stay; rows with equal id and text
    are kept once. Columns may have any name.
    """
    plain, place = plain_names(docs)
    key, text = place[id_col], place[text_col]
    groups = _grouped(plain, key, text)
    first = F.min(F.struct(F.isnull(key).alias("none"), F.col(key).alias("id"), "text_key")).alias("first")
    worded = groups.filter("class_key IS NOT NULL").groupBy("class_key").agg(first).select("first.id", "first.text_key")
    blank = groups.filter("class_key IS NULL").select(F.col(key).alias("id"), "text_key").distinct()
    stays = worded.unionByName(blank)
    keyed = plain.withColumn("_key", F.xxhash64(F.col(text).cast("string")))
    once = keyed.dropDuplicates([key, "_key"])
    match = F.col(key).eqNullSafe(F.col("id")) & (F.col("_key") == F.col("text_key"))
    return once.join(stays, match, "left_semi").select(*plain.columns).toDF(*docs.columns)


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Class, links and copies of every document."""
    return near_groups(table(spark, sf_dir, "documents")).drop("text_key")
