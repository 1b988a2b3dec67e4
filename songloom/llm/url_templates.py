"""URL filters: fixed rules first, then a path-template tree judged by labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songloom.llm.common import lower_ascii_column, table
from songloom.operators.skew import counted_lookup
from songloom.storage import cut_lineage

#: Host and path prefix, and what is done with pages under it; the longest rule that fits wins.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}
#: Levels that the SQL spells out, and that are met one by one; further ones are met by jumps.
DEPTH = 4
#: A node keeps this many children, or those that hold this part of its pages; others are variable.
MAX_CHILDREN = 16
#: Branches whose labelled purity differs from all siblings' by fewer deviations are merged.
SIMILAR = 2.0
#: Labels that the corpus's purity counts for beside a template's own, and the least purity.
PRIOR, MIN_PURITY = 5.0, 0.5
#: Numbers, dates and long hexadecimal names are variable wherever they stand.
VARIABLE = r"^([^0-9]{0,2}[0-9][0-9._-]*(\.[A-Za-z]+)?|[0-9A-Fa-f-]{16,})$"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii_column(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule for a host, its subdomains and paths with its prefix, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in sorted(rules, key=lambda x: (len(x), x)):
        own, slash, prefix = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + prefix)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(rules[name])).otherwise(verdict)
    return rule, verdict


def _wild(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z]+)$", 1))


def _jumped(pages: DataFrame) -> DataFrame:
    """``pages`` moved on to where the pages of their node part, or the first of them ends.

    A level that all pages of a node pass alike has one child, which is kept, or a wildcard, so
    long paths and traps of one page need no level each. The least and the greatest of a node's
    paths have in common what all have.
    """
    rest = F.slice("segments", F.col("at") + 1, F.size("segments"))
    steps = F.transform(rest, lambda x: F.when(x.rlike(VARIABLE), _wild(x)).otherwise(x))
    here = pages.withColumn("_node", F.concat_ws("\n", "host", "template"))
    ends = here.withColumn("_rest", steps).groupBy("_node").agg(
        F.min("_rest").alias("_low"), F.max("_rest").alias("_high"), F.count(F.lit(1)).alias("_n")
    )
    differs = F.array_position(
        F.zip_with("_low", "_high", lambda x, y: F.coalesce(x == y, F.lit(False))), False
    )
    length = F.when(differs > 0, differs - 1).otherwise(F.size("_low")).cast("int")
    shared = cut_lineage(ends.select("_node", "_n", F.slice("_low", F.lit(1), length).alias("_shared")))
    met = counted_lookup(here, shared, "_node", "_n", spread=["page", "path"])
    moved = F.concat("template", F.array_join(F.transform("_shared", lambda x: F.concat(F.lit("/"), x)), ""))
    return cut_lineage(
        met.withColumn("template", moved)
        .withColumn("at", F.col("at") + F.size("_shared"))
        .drop("_node", "_n", "_shared")
    )


def _templates(pages: DataFrame, depth: int | None, max_children: int) -> DataFrame:
    """``pages`` with ``template``: variable segments become wildcards, level by level.

    A level counts the children of every node and looks up which are kept: at most
    ``max_children`` for a node. Children with many pages are met by a small broadcast. Pages
    whose path has ended take no further part. With ``depth``, what follows so many segments is
    one wildcard.
    """
    going = pages.withColumn("template", F.lit("")).withColumn("at", F.lit(0))
    more = F.size("segments") > F.col("at")
    if depth is not None:
        more &= F.col("at") < depth
    ended, level = [], 0
    while True:
        ended.append(going.filter(~more))
        going = going.filter(more)
        if going.isEmpty():
            break
        if depth is None and level >= DEPTH:
            going = _jumped(going)
            ended.append(going.filter(~more))
            going = going.filter(more)
            if going.isEmpty():
                break
        segment = F.get("segments", F.col("at"))
        variable = segment.rlike(VARIABLE)
        parent = F.concat_ws("\n", "host", "template")
        key = F.when(~variable, F.concat_ws("\n", parent, segment))
        here = going.withColumn("node_key", key).withColumn("_parent", parent)
        counted = cut_lineage(here.groupBy("_parent", "node_key").agg(F.count(F.lit(1)).alias("_n")))
        nodes = counted.groupBy(F.col("_parent").alias("_node")).agg(
            F.sum("_n").alias("_all"), F.count("node_key").alias("_children")
        )
        enough = (F.col("_children") <= max_children) | (F.col("_n") * max_children >= F.col("_all"))
        kept = cut_lineage(
            counted.filter(F.col("node_key").isNotNull())
            .join(nodes, F.col("_parent") == F.col("_node"))
            .filter(enough)
            .select("node_key", "_n", F.lit(True).alias("_kept"))
        )
        met = counted_lookup(here, kept, "node_key", "_n", spread=["page", "path"])
        step = F.when(F.coalesce("_kept", F.lit(False)), segment).otherwise(_wild(segment))
        grown = met.withColumn("template", F.concat("template", F.lit("/"), step)).withColumn("at", F.col("at") + 1)
        going = cut_lineage(grown.drop("node_key", "_parent", "_n", "_kept"))
        level += 1
    placed = ended[0]
    for part in ended[1:]:
        placed = placed.unionByName(part)
    longer = F.size("segments") > F.col("at")
    whole = F.when(longer, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return placed.withColumn("template", whole).drop("at")


def _purity(templates: DataFrame) -> DataFrame:
    """``key`` and ``purity`` of every template, after similar branches have been merged.

    Siblings are templates of a host with wildcards in the same places. A branch is merged with
    the others unless its own labels differ from those of all siblings together.
    """
    skeleton = F.concat_ws("\n", "host", F.regexp_replace("template", r"/[^/*]+", "/+"))
    branches = templates.withColumn("skeleton", skeleton)
    groups = branches.groupBy(F.col("skeleton").alias("_group")).agg(
        F.sum("n_good").alias("g_good"), F.sum("n_labelled").alias("g_labelled")
    )
    met = branches.join(groups, F.col("skeleton") == F.col("_group"))
    rate = (F.col("g_good") + 1) / (F.col("g_labelled") + 2)
    apart = F.abs(F.col("n_good") - F.col("n_labelled") * rate)
    similar = apart <= F.lit(SIMILAR) * F.sqrt(F.col("n_labelled") * rate * (1 - rate))
    merged = cut_lineage(met.withColumn("merged", F.when(similar, F.col("skeleton")).otherwise(F.col("key"))))
    corpus = merged.agg((F.sum("n_good") + 1) / (F.sum("n_labelled") + 2)).first()[0] or 0.5
    judged = merged.groupBy(F.col("merged").alias("_merged")).agg(
        ((F.sum("n_good") + F.lit(PRIOR * corpus)) / (F.sum("n_labelled") + F.lit(PRIOR))).alias("purity")
    )
    return merged.join(judged, F.col("merged") == F.col("_merged")).select("key", "purity", "n_pages")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: dict[str, str] | None = None,
    depth: int | None = None,
    max_children: int = MAX_CHILDREN,
    min_purity: float = MIN_PURITY,
) -> DataFrame:
    """Host, path, rule and verdict of every page.

    ``labels`` has ``doc_id`` (the page's id), ``quality`` and ``toxic``; a page is good if its
    quality is 1 and it isn't toxic. Pages without a rule are blocked if the smoothed part of good
    pages under their template is below ``min_purity``. Templates have a level for every segment,
    unless ``depth`` says after how many the rest is one wildcard.

    A row per row, repeated rows included. A null url, or one without ``://``, has empty host and
    path and the template of such. Null labels count as absent, an id labelled twice is good only
    if all its labels say so. Without labels everything not ruled out is allowed. An empty table
    gives no rows. Other columns are not read.
    """
    host, path = url_parts(F.col(url_col).cast("string"))
    read = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    parted = read.select("*", rule.alias("rule"), verdict.alias("ruled"), segments.alias("segments"))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    marks = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.min(good.cast("int")).alias("good"))
    )
    marked = cut_lineage(parted.join(marks, F.col("page") == F.col("_doc"), "left").drop("_doc"))
    placed = cut_lineage(
        _templates(marked, depth, max_children).withColumn("key", F.concat_ws("\n", "host", "template"))
    )
    templates = placed.groupBy("key", "host", "template").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count("good").alias("n_labelled"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"),
    )
    purity = cut_lineage(_purity(cut_lineage(templates)))
    judged = counted_lookup(
        placed.select("page", "host", "path", "rule", "ruled", "key"),
        purity,
        "key",
        "n_pages",
        spread=["page", "path"],
    )
    own = F.when(F.col("purity") < min_purity, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("page").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict")
    )


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _level_sql(level: int) -> str:
    before = f"p{level}"
    return rf"""
c{level} AS (
  SELECT host, template, segments[{level + 1}] AS seg, count(*) AS n,
         regexp_matches(segments[{level + 1}], '{VARIABLE}') AS variable
  FROM {before} WHERE len(segments) > {level} GROUP BY ALL),
k{level} AS (
  SELECT host, template, seg FROM (
    SELECT *, sum(n) OVER (PARTITION BY host, template) AS total,
           count(CASE WHEN NOT variable THEN 1 END) OVER (PARTITION BY host, template) AS children
    FROM c{level})
  WHERE NOT variable AND (children <= {MAX_CHILDREN} OR n * {MAX_CHILDREN} >= total)),
p{level + 1} AS (
  SELECT p.* EXCLUDE (template),
         p.template || CASE WHEN len(segments) <= {level} THEN ''
           WHEN k.seg IS NOT NULL THEN '/' || k.seg
           ELSE '/*' || regexp_extract(segments[{level + 1}], '(\.[A-Za-z]+)$', 1) END AS template
  FROM {before} p LEFT JOIN k{level} k ON p.host = k.host AND p.template = k.template
       AND k.seg = p.segments[{level + 1}]),"""


_ORDERED = sorted(RULES, key=lambda x: (-len(x), x))
_FITS = {
    name: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*name.split("/", 1))
    for name in RULES
}
_RULE = "CASE " + " ".join(f"WHEN {_FITS[x]} THEN '{x}'" for x in _ORDERED) + " END"
_RULED = "CASE " + " ".join(f"WHEN {_FITS[x]} THEN '{RULES[x]}'" for x in _ORDERED) + " END"
OP3_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
marks AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
p0 AS (
  SELECT row_number() OVER () AS k, page_id, host, path, {_RULE} AS rule, {_RULED} AS ruled, good, '' AS template,
         list_filter(string_split(path, '/'), lambda x: x <> '') AS segments
  FROM h LEFT JOIN marks ON page_id = doc_id),
{"".join(_level_sql(level) for level in range(DEPTH))}
placed AS (SELECT * EXCLUDE (template), template || CASE WHEN len(segments) > {DEPTH} THEN '/**' ELSE '' END AS template FROM p{DEPTH}),
templates AS (
  SELECT host, template, host || chr(10) || regexp_replace(template, '/[^/*]+', '/+', 'g') AS skeleton,
         count(good) AS n_labelled, coalesce(sum(good), 0) AS n_good FROM placed GROUP BY host, template),
grouped AS (
  SELECT *, (sum(n_good) OVER (PARTITION BY skeleton) + 1) / CAST(sum(n_labelled) OVER (PARTITION BY skeleton) + 2 AS DOUBLE) AS rate
  FROM templates),
merged AS (
  SELECT *, CASE WHEN abs(n_good - n_labelled * rate) <= {SIMILAR} * sqrt(n_labelled * rate * (1 - rate))
                 THEN skeleton ELSE host || chr(10) || template END AS branch FROM grouped),
corpus AS (SELECT (sum(n_good) + 1) / CAST(sum(n_labelled) + 2 AS DOUBLE) AS rate FROM merged),
purity AS (
  SELECT branch, (sum(n_good) + {PRIOR} * any_value(corpus.rate)) / (sum(n_labelled) + {PRIOR}) AS purity
  FROM merged, corpus GROUP BY branch)
SELECT page_id, placed.host, path, rule,
       coalesce(ruled, CASE WHEN purity < {MIN_PURITY} THEN 'block' ELSE 'allow' END) AS verdict
FROM placed JOIN merged ON placed.host = merged.host AND placed.template = merged.template JOIN purity USING (branch)
"""
