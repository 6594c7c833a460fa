"""Packages of pages: which part of a page represents each line, the proof that all are represented once, and their order.

Figures win over tables, tables over body text; of several tables the first takes a line. Tables: lines (doc, page, line, text,
box), figures and tables (doc, page, place, box).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..registry import query
from ..sources.tables import REGIONS_SQL, regions, stored

_BOX = ("x0", "y0", "x1", "y1")
_PAGE = ["doc", "page"]
#: A line lies in a region if its centre does and more than this share of it.
INSIDE = f"{g.centre_inside('l', 'r')} AND {g.overlap('l', 'r')} > 0.4"
_HELD = f"{g.centre_inside('', 'r.')} AND {g.overlap('', 'r.')} > 0.4"


def claims(lines: DataFrame, figures: DataFrame, tables: DataFrame) -> DataFrame:
    """lines with owner (figure, table or body) and owner_place (of body lines null). A page's regions meet its lines as one array,
    the least of those that hold a line owns it."""
    part = lambda df, rank: df.select(*_PAGE, F.struct(F.lit(rank).alias("rank"), F.col("place").cast("bigint").alias("place"), *_BOX).alias("r"))
    parts = part(figures, 0).unionByName(part(tables, 1)).groupBy(*_PAGE).agg(F.collect_list("r").alias("__parts"))
    first = F.expr(f"array_min(transform(filter(__parts, r -> {_HELD}), r -> struct(r.rank, r.place)))")
    owner = F.when(F.col("__o.rank") == 0, "figure").when(F.col("__o.rank") == 1, "table").otherwise("body")
    return lines.join(parts, _PAGE, "left").withColumn("__o", first).withColumns({"owner": owner, "owner_place": F.col("__o.place")}).drop("__o", "__parts")


def coverage(lines: DataFrame, represented: DataFrame) -> DataFrame:
    """What is wrong by page: lines that nothing represents, lines that are represented twice, and characters (without white
    space) of which more or fewer are represented than there are. represented: doc, page, line, text. No row: all is proven."""
    side = lambda df, a, b: df.select(*_PAGE, "line", "text", F.lit(a).alias("a"), F.lit(b).alias("b"))
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("a", "b")]
    texts = side(lines, 1, 0).unionByName(side(represented, 0, 1)).groupBy(*_PAGE, "line", "text").agg(*sums)
    odd = texts.groupBy(*_PAGE, "line").agg(*sums).where("a <> b").select(*_PAGE, F.when(F.col("b") == 0, "line without a place").when(F.col("a") == 0, "unknown line").otherwise("line with several places").alias("violation"), F.col("line").cast("string").alias("what"))
    # a text that is represented as often as it is there loses no character and adds none: only the others are taken apart
    each = texts.where("a <> b").select(*_PAGE, F.explode(F.split(F.regexp_replace("text", r"\s", ""), "")).alias("what"), (F.col("a") - F.col("b")).alias("n")).where("what <> ''")
    chars = each.groupBy(*_PAGE, "what").agg(F.sum("n").alias("n")).where("n <> 0")
    return odd.unionByName(chars.select(*_PAGE, F.when(F.col("n") > 0, "characters lost").otherwise("characters added").alias("violation"), "what"))


def page_parts(claimed: DataFrame, figures: DataFrame, tables: DataFrame) -> DataFrame:
    """Parts of each page in reading order (doc, page, place, kind, text, lines): its marker, then images, tables (if they
    own a line) and body lines by y, images first, then x."""
    text = lambda order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda t: t["text"]), "\n")
    own = claimed.where("owner = 'table'").groupBy(*_PAGE, F.col("owner_place").alias("place")).agg(text(["y0", "x0", "line"]).alias("text"), F.count("*").alias("lines"))
    image = figures.select(*_PAGE, "y0", F.lit(0).alias("t"), "x0", F.lit("image").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("bigint").alias("lines"), F.col("place").cast("bigint").alias("id"))
    table = tables.withColumn("place", F.col("place").cast("bigint")).join(own, [*_PAGE, "place"]).select(*_PAGE, "y0", F.lit(1).alias("t"), "x0", F.lit("table").alias("kind"), "text", "lines", F.col("place").alias("id"))
    body = claimed.where("owner = 'body'").select(*_PAGE, "y0", F.lit(1).alias("t"), "x0", F.lit("text").alias("kind"), "text", F.lit(1).cast("bigint").alias("lines"), F.col("line").cast("bigint").alias("id"))
    events = image.unionByName(table).unionByName(body)
    none = lambda kind: F.lit(None).cast(kind)
    # every line is of a part and every figure is one, so pages need not wait for the parts
    pages = claimed.select(*_PAGE).unionByName(figures.select(*_PAGE)).distinct().select(*_PAGE, none("double").alias("y0"), F.lit(-1).alias("t"), none("double").alias("x0"), F.lit("page_marker").alias("kind"), F.concat(F.lit("page "), F.col("page").cast("string")).alias("text"), F.lit(0).cast("bigint").alias("lines"), F.lit(0).cast("bigint").alias("id"))
    order = Window.partitionBy(*_PAGE).orderBy(F.col("t") >= 0, "y0", "t", "x0", "kind", "id")
    return events.unionByName(pages).withColumn("place", F.row_number().over(order)).select(*_PAGE, "place", "kind", "id", "text", "lines")


_TAG = "role || ' ' || kind || ' ' || name || ' ' || CAST(CAST(len AS BIGINT) AS VARCHAR)"
_BUILD_SQL = f"""{REGIONS_SQL},
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY role, label, name, x0, y0, x1, y1, confidence, forced, size, len, rotation) AS place FROM kinds),
l AS (SELECT page, place AS line, {_TAG} AS text, x0 AS lx0, y0 AS ly0, x1 AS lx1, y1 AS ly1 FROM n WHERE role <> 'old'),
r AS (SELECT page, CASE WHEN kind = 'figure' THEN 0 ELSE 1 END AS rank, place, x0 AS rx0, y0 AS ry0, x1 AS rx1, y1 AS ry1 FROM n WHERE role = 'old'),
h AS (SELECT l.page, line, rank, place, row_number() OVER (PARTITION BY l.page, line ORDER BY rank, place) AS i FROM l JOIN r ON l.page = r.page AND {INSIDE}),
c AS (SELECT l.*, rank, place FROM l LEFT JOIN (SELECT * FROM h WHERE i = 1) h ON l.page = h.page AND l.line = h.line)"""


def given(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, figures and tables of pages made of line items; what is no region is a line."""
    every = stored(regions(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("role", "label", "name", *_BOX, "confidence", "forced", "size", "len", "rotation"))), "given_places").withColumn("doc", F.lit(0))
    tag = F.concat_ws(" ", "role", "kind", "name", F.col("len").cast("string"))
    old = every.where("role = 'old'")
    return every.where("role <> 'old'").select(*_PAGE, F.col("place").alias("line"), tag.alias("text"), *_BOX), old.where("kind = 'figure'"), old.where("kind = 'table'")


@query("line_claims", f"WITH {_BUILD_SQL} SELECT page, CASE rank WHEN 0 THEN 'figure' WHEN 1 THEN 'table' ELSE 'body' END AS owner, CAST(place AS BIGINT) AS owner_place, count(*) AS lines, CAST(sum(length(replace(text, ' ', ''))) AS BIGINT) AS chars FROM c GROUP BY ALL")
def line_claims(spark, d):
    """Which figure, table or body text represents the lines of each page."""
    claimed = claims(*given(spark, d))
    return claimed.groupBy("page", "owner", "owner_place").agg(F.count("*").alias("lines"), F.sum(F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("bigint")).alias("chars"))


@query(
    "page_parts",
    f"""WITH {_BUILD_SQL}, e AS (SELECT page, ry0 AS y, 0 AS t, rx0 AS x, 'image' AS kind, place AS id, '' AS text, 0 AS lines FROM r WHERE rank = 0
 UNION ALL SELECT r.page, ry0, 1, rx0, 'table', r.place, string_agg(text, chr(10) ORDER BY ly0, lx0, line), count(*) FROM r JOIN c ON r.page = c.page AND c.rank = 1 AND c.place = r.place WHERE r.rank = 1 GROUP BY r.page, ry0, rx0, r.place
 UNION ALL SELECT page, ly0, 1, lx0, 'text', line, text, 1 FROM c WHERE rank IS NULL)
 SELECT page, count(*) + 1 AS parts, CAST(sum(lines) AS BIGINT) AS lines, md5('page_marker 0 page ' || page || chr(10) || string_agg(kind || ' ' || id || ' ' || text, chr(10) ORDER BY y, t, x, kind, id)) AS digest FROM e GROUP BY page""",
)
def page_parts_query(spark, d):
    """The parts of every page in reading order; a marker begins it."""
    lines, figures, tables = given(spark, d)
    made = page_parts(claims(lines, figures, tables), figures, tables)
    shown = F.concat_ws(" ", "kind", F.col("id").cast("string"), F.coalesce("text", F.lit("")))
    return made.groupBy("page").agg(F.count("*").alias("parts"), F.sum("lines").alias("lines"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", shown.alias("t")))), lambda x: x["t"]), "\n")).alias("digest"))


@query("coverage_proof", f"WITH {_BUILD_SQL} SELECT page, count(*) AS lines, CAST(0 AS BIGINT) AS violations FROM l GROUP BY page")
def coverage_proof(spark, d):
    """Pages whose parts represent every line and every character once: all of them, or the query's violations say which not."""
    lines, figures, tables = given(spark, d)
    bad = coverage(lines, claims(lines, figures, tables)).groupBy("page").agg(F.count("*").alias("violations"))
    return lines.groupBy("page").agg(F.count("*").alias("lines")).join(bad, "page", "left").fillna(0, ["violations"])
