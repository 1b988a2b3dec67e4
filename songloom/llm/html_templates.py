"""Main text of web pages by the template that pages of one host share.

Tokens of a page are its block elements opening and closing, told apart by their path, and its text
blocks at their path. Tokens that occur equally often on every page of a host have one occurrence
vector, and form an equivalence class. Classes that are large, frequent, ordered alike on all
pages and properly nested make up the host's template; what varies between their tokens are the
slots. The slot that holds most of the text is the article's place, and texts of the
template itself are boilerplate.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import plain_names, table
from songloom.llm.html_parts import CONTAINERS, Page, digest, parse, roles
from songloom.operators.skew import counted_lookup
from songloom.storage import cut_lineage

#: A host needs so many pages before they say anything about each other.
MIN_PAGES = 3
#: Classes of the template are on this share of a host's pages, and have so many tokens at least.
MIN_SUPPORT, MIN_TOKENS = 0.5, 3
#: The article's place holds this share of the text in all slots.
MAIN_SHARE = 0.6
#: Texts of the template that make up more of a page's article than this are a copied article.
MOST_BOILERPLATE = 0.3
#: Numbers of templates that go to every task; more of them are met by a shuffle.
MAX_BROADCAST = 500_000
_PIECES, _PIECE_BITS = 3, 24  # of a page's hash, so that their sums stay exact
_SUMMED = 200_000  # sums that a task holds before it emits them

HOST = r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#]*)"


def host_of(url: Column) -> Column:
    """Host in small letters; empty for a null url or one without ``://``."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1))


# --- occurrence vectors --------------------------------------------------------------------------

_STORED = (
    "site string, page long, chars long, tokens array<long>, counts array<int>, sizes array<int>, "
    "holders array<int>, events array<int>, paths array<long>, parents array<int>, single array<boolean>"
)


def _tokens_of(page: Page) -> tuple | None:
    """Distinct tokens with counts, text sizes and the container that holds a text (else -1); their
    order on the page; and the containers: paths, parents, whether the path occurs once."""
    dropped = roles(page).dropped
    containers: dict[int, int] = {}
    inside = [-1] * len(page.tags)
    occurs: dict[int, int] = defaultdict(int)
    parents: list[int] = []
    for element in range(1, len(page.tags)):
        outer = inside[page.parents[element]] if page.parents[element] >= 0 else -1
        inside[element] = outer
        if page.tags[element] in CONTAINERS and not dropped[element]:
            path = page.paths[element]
            if path not in containers:
                containers[path] = len(containers)
                parents.append(outer)
            occurs[path] += 1
            inside[element] = containers[path]
    place: dict[int, int] = {}
    counts, sizes, holders, events = [], [], [], []
    chars = 0
    for kind, number in page.events:
        if kind == 2:
            block = page.blocks[number]
            token = page.block_token(block)
            kept = not dropped[block.element]
            size = len(block.text) - block.linked if kept else 0
            holder = inside[block.element] if kept else -1
            chars += len(block.text)
        else:
            token = page.paths[number] if kind == 0 else digest(f"/{page.paths[number]}")
            size, holder = -1, -1
        at = place.setdefault(token, len(place))
        if at == len(counts):
            counts.append(0)
            sizes.append(size)
            holders.append(holder)
        counts[at] += 1
        events.append(at)
    single = [occurs[path] == 1 for path in containers]
    return chars, list(place), counts, sizes, holders, events, list(containers), parents, single


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), *[pa.list_(kind) for kind in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())]]
    names = ["site", "page", "chars", "tokens", "counts", "sizes", "holders", "events", "paths", "parents", "single"]
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            made = [_tokens_of(parse(source)) for source in part.column(2).to_pylist()]
            columns = [pa.array(column, kind) for column, kind in zip(zip(*made), kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names)


def _classes(stored: DataFrame, sites: DataFrame, min_support: float, min_tokens: int) -> DataFrame:
    """``site``, ``pages`` and its candidate classes: tokens with equal occurrence vectors.

    A vector is compared by sums over pages of the count times pieces of the page's hash, which
    are the same for equal vectors and can be summed before the shuffle.
    """
    each = stored.select(
        "site", "page", "chars", F.explode(F.arrays_zip("tokens", "counts", "sizes")).alias("x")
    ).select("site", "page", "chars", "x.tokens", "x.counts", "x.sizes")
    piece = lambda j: F.shiftright("page", j * _PIECE_BITS).bitwiseAND(F.lit((1 << _PIECE_BITS) - 1))
    sums = [F.sum(F.col("counts") * piece(j)).alias(f"sum{j}") for j in range(_PIECES)]
    vectors = each.groupBy("site", F.col("tokens").alias("token")).agg(
        F.count(F.lit(1)).alias("support"),
        F.sum("counts").alias("total"),
        F.max("sizes").alias("size"),
        F.max("chars").alias("chars"),
        *sums,
    )
    frequent = vectors.filter(F.col("support") >= MIN_PAGES).join(sites, "site")
    frequent = frequent.filter(F.col("support") >= min_support * F.col("pages"))
    # tokens on half of the pages: at most twice a page's mean number of tokens
    classes = frequent.groupBy("site", "pages", "support", "total", *[f"sum{j}" for j in range(_PIECES)]).agg(
        F.sort_array(F.collect_list(F.struct("token", "size"))).alias("members")
    )
    large = classes.filter(F.size("members") >= min_tokens).select(
        "site", "pages", F.get("members", F.lit(0))["token"].alias("class"), F.explode("members").alias("member")
    )
    return large.groupBy("site", "pages").agg(
        F.sort_array(F.collect_list(F.struct("class", "member.token", "member.size"))).alias("template")
    )


# --- order and nesting ---------------------------------------------------------------------------


def _class_orders(events: list[int], classes: dict[int, int], sizes: dict[int, int]) -> dict[int, int | None]:
    """For each class on a page a number for its order and its place in the template, the same on
    all pages where it is valid; None where it has no order or crosses another class.

    A class must occur as whole rounds of its tokens, each round in the same gap of the class
    around it, and everything inside it must end before its next token.
    """
    state: dict[int, list] = {}  # class: tokens of the first round, place in the round, enclosing gap
    bad: set[int] = set()
    nest: list[int] = []
    for token in events:
        own = classes.get(token)
        if own is None or own in bad:
            continue
        seen = state.setdefault(own, [[], 0, None])
        order, at, gap = seen
        size = sizes[own]
        if at == 0:
            outer = nest[-1] if nest else None
            here = (outer, state[outer][1]) if outer is not None else (None, 0)
            if gap is not None and gap != here:
                bad.add(own)
                continue
            seen[2] = here
            nest.append(own)
        else:
            while nest and nest[-1] != own:  # what began inside must have ended
                bad.add(nest.pop())
        if len(order) < size:
            if token in order:
                bad.add(own)
                if nest and nest[-1] == own:
                    nest.pop()
                continue
            order.append(token)
        elif order[at] != token:
            bad.add(own)
            if nest and nest[-1] == own:
                nest.pop()
            continue
        seen[1] = (at + 1) % size
        if seen[1] == 0 and nest and nest[-1] == own:
            nest.pop()
    bad.update(nest)
    return {own: None if own in bad else digest(repr((x[0], x[2]))) for own, x in state.items()}


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's pages: for each class its order numbers, for each container its text."""
    columns = ("site", "tokens", "sizes", "holders", "events", "paths", "parents", "single", "template")

    def emitted() -> Iterator[pa.RecordBatch]:
        if orders or texts:
            rows = [(s, 0, c, low, high, ok, 0, 0) for (s, c), (low, high, ok) in orders.items()]
            rows += [(s, 1, p, 0, 0, True, chars, pages) for (s, p), (chars, pages) in texts.items()]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["site", "kind", "key", "low", "high", "ok", "chars", "pages"])

    orders: dict[tuple, list] = {}
    texts: dict[tuple, list] = {}
    for batch in batches:
        for row in zip(*[batch.column(name).to_pylist() for name in columns]):
            site, tokens, sizes, holders, events, paths, parents, single, template = row
            classes = {entry["token"]: entry["class"] for entry in template}
            members: dict[int, int] = defaultdict(int)
            for own in classes.values():
                members[own] += 1
            found = _class_orders([tokens[e] for e in events], classes, members)
            for own, order in found.items():
                known = orders.setdefault((site, own), [order or 0, order or 0, True])
                known[0], known[1] = min(known[0], order or 0), max(known[1], order or 0)
                known[2] &= order is not None
            held = [0] * len(paths)
            whole = 0
            for token, size, holder in zip(tokens, sizes, holders):
                if size > 0 and token not in classes:
                    whole += size
                    while holder >= 0:
                        held[holder] += size
                        holder = parents[holder]
            for path, chars, once in [(0, whole, True), *zip(paths, held, single)]:
                known = texts.setdefault((site, path), [0, 0])
                known[0] += chars
                known[1] += 1 if once else -1_000
            if len(orders) + len(texts) > _SUMMED:
                yield from emitted()
                orders, texts = {}, {}
    yield from emitted()


def deduce_templates(
    docs: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    min_support: float = MIN_SUPPORT,
    min_tokens: int = MIN_TOKENS,
    main_share: float = MAIN_SHARE,
) -> DataFrame:
    """The template of every host with ``MIN_PAGES`` pages: ``site``, ``pages``, ``drop`` (numbers of texts that
    belong to the template) and ``main`` (the path of the article's place, or null).

    Pages without a host have no template. Repeated pages count each time. Equal pages say nothing new:
    texts of a class count as the template's only where they are a small part of the pages.
    """
    read = docs.select(
        host_of(docs[url_col]).alias("site"),
        F.xxhash64(docs[url_col].cast("string"), docs[html_col].cast("string")).alias("page"),
        docs[html_col].cast("string").alias("source"),
    ).filter("site <> '' AND source IS NOT NULL")
    stored = cut_lineage(read.mapInArrow(_tokens, _STORED))
    sites = cut_lineage(stored.groupBy("site").agg(F.count(F.lit(1)).alias("pages")))
    sites = sites.filter(F.col("pages") >= MIN_PAGES)
    templates = cut_lineage(_classes(stored, sites, min_support, min_tokens))
    met = counted_lookup(stored, templates, "site", "pages", spread=["page"]).filter("template IS NOT NULL")
    schema = "site string, kind int, key long, low long, high long, ok boolean, chars long, pages long"
    evidence = cut_lineage(
        met.mapInArrow(_evidence, schema)
        .groupBy("site", "kind", "key")
        .agg(
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.min("ok").alias("ok"),
            F.sum("chars").alias("chars"),
            F.sum("pages").alias("pages"),
        )
    )
    valid = evidence.filter("kind = 0 AND ok AND low = high").select("site", F.col("key").alias("class"))
    entries = templates.select("site", F.explode("template").alias("entry")).select("site", "entry.*")
    drop = (
        entries.filter("size > 0")
        .join(valid, ["site", "class"])
        .groupBy("site")
        .agg(F.sort_array(F.collect_list("token")).alias("drop"))
    )
    places = evidence.filter("kind = 1")
    whole = places.filter("key = 0").select("site", F.col("chars").alias("whole"))
    # of containers that occur once on a page, the one with the least text that still has most of it
    main = (
        places.filter("key <> 0 AND pages > 0")
        .join(whole, "site")
        .filter((F.col("chars") >= main_share * F.col("whole")) & (F.col("whole") > 0))
        .groupBy("site")
        .agg(F.min(F.struct("chars", "pages", "key"))["key"].alias("main"))
    )
    found = sites.join(drop, "site", "left").join(main, "site", "left")
    nothing = F.array().cast("array<long>")
    return cut_lineage(found.select("site", "pages", F.coalesce("drop", nothing).alias("drop"), "main"))


# --- extraction ----------------------------------------------------------------------------------


def _is_within(page: Page, element: int, top: int) -> bool:
    while element > top:
        element = page.parents[element]
    return element == top


def main_blocks(source: str | None, main: int | None = None, drop: frozenset[int] = frozenset()) -> list[str]:
    """The article's blocks in page order, given the host's template."""
    page = parse(source)
    role = roles(page)
    kept = [b for b in page.blocks if not role.dropped[b.element]]
    top, in_article = None, False
    if main is not None and main in page.paths:
        top = page.paths.index(main)
        if role.dropped[top]:
            top = None
        elif role.article[top] >= 0:
            top = role.article[top]
    inside = [b for b in kept if _is_within(page, b.element, top)] if top is not None else []
    if inside:
        in_article = role.article[top] >= 0
    else:
        inside = [b for b in kept if role.article[b.element] >= 0]
        in_article = bool(inside)
    if not in_article:
        inside = _without_menus(page, inside or kept)
    if drop:
        own = [b for b in inside if page.block_token(b) not in drop]
        chars = [sum(len(b.text) for b in blocks) for blocks in (own, inside)]
        if chars[1] - chars[0] <= MOST_BOILERPLATE * chars[1]:
            inside = own
    return [b.text for b in inside]


def _without_menus(page: Page, blocks: list) -> list:
    """Without lists of three or more entries that are nearly all links."""
    lists: dict[int, list] = defaultdict(list)
    for block in blocks:
        if page.tags[block.element] == "li":
            lists[page.parents[block.element]].append(block)
    menus = {
        id(block)
        for entries in lists.values()
        if len(entries) >= 3
        and sum(b.linked for b in entries) >= 0.8 * sum(len("".join(b.text.split())) for b in entries)
        for block in entries
    }
    return [block for block in blocks if id(block) not in menus]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            width = part.num_columns - 3
            made = [
                "\n".join(main_blocks(source, main, frozenset(drop or ())))
                for source, drop, main in zip(*[part.column(width + j).to_pylist() for j in range(3)])
            ]
            names = [*part.schema.names[:width], "_article"]
            yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(made, pa.string())], names)


def extract_main_text(
    docs: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    templates: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (default: all but the html) and ``text``, the article of each page, which takes the place of
    a column of that name.

    Blocks of text are joined by line breaks, white space inside a block is one blank, character
    references are decoded. The article is the slot of the host's template with most text, or without
    one the page's ``article`` or ``main`` parts, or what is left without menus, headers, footers,
    sidebars, notices, adverts, forms and comments, by their elements and names. Texts of the template go,
    unless they are a large part of the article: then pages are copies.

    One row per page; repeated rows stay. Null, empty and textless pages have the text "". Pages with a null
    or odd url are taken without a template. An empty table gives no rows. ``templates`` may be
    given, as from :func:`deduce_templates`.
    """
    if templates is None:
        templates = deduce_templates(docs, url_col, html_col)
    names = [name for name in keep or docs.columns if name != "text" and (keep or name != html_col)]
    plain, place = plain_names(docs)
    read = plain.select(
        *[F.col(place[name]) for name in names],
        host_of(F.col(place[url_col])).alias("_site"),
        F.col(place[html_col]).cast("string").alias("_source"),
    )
    known = templates.withColumnsRenamed({"site": "_site", "pages": "_pages", "drop": "_drop", "main": "_main"})
    numbers = known.agg(F.coalesce(F.sum(F.size("_drop") + 8), F.lit(0))).first()[0]
    if numbers <= MAX_BROADCAST:
        met = read.join(F.broadcast(known.drop("_pages")), "_site", "left")
    else:
        met = counted_lookup(read, known, "_site", "_pages", spread=["_source"])
    kept = [place[name] for name in names]
    types = [f"`{name}` {plain.schema[name].dataType.simpleString()}" for name in kept]
    made = met.select(*kept, "_source", "_drop", "_main").mapInArrow(_texts, ", ".join([*types, "_article string"]))
    return made.toDF(*names, "text")


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract_main_text(pages, keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))
