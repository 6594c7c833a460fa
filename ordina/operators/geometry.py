"""Joins and aggregates over boxes. Every join has the page as an equality key, so pairs are only made inside a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..registry import query
from ..sources.tables import BOXES_SQL, box_sides, boxes

_A = ["ax0", "ay0", "ax1", "ay1"]
_B = ["bx0", "by0", "bx1", "by1"]
_W = f"WITH {BOXES_SQL}"
_AS, _BS = ", ".join(_A), ", ".join(_B)


def paired(a: DataFrame, b: DataFrame, condition: str, how: str = "inner") -> DataFrame:
    """Pairs of boxes on one page that meet a condition."""
    left, right = a.withColumnRenamed("page", "__p"), b
    if how in ("left_anti", "left_semi"):
        return left.join(right, (F.col("__p") == F.col("page")) & F.expr(condition), how).withColumnRenamed("__p", "page")
    return left.join(right, (F.col("__p") == F.col("page")) & F.expr(condition), how).drop("page").withColumnRenamed("__p", "page")


_MATCH = f"({g.iou('a', 'b')} > 0.25 OR {g.overlap('a', 'b')} > 0.75)"


@query("iou_matches", f"{_W} SELECT a.page, {_AS}, {_BS}, round({g.iou('a', 'b')}, 6) AS iou, round({g.overlap('a', 'b')}, 6) AS overlap FROM a JOIN b ON a.page = b.page AND {_MATCH}")
def iou_matches(spark, d):
    out = paired(*box_sides(spark, d), _MATCH)
    return out.select("page", *_A, *_B, F.expr(f"round({g.iou('a', 'b')}, 6)").alias("iou"), F.expr(f"round({g.overlap('a', 'b')}, 6)").alias("overlap"))


@query(
    "nearest_caption",
    f"""{_W}, p AS (SELECT a.page, {_AS}, {_BS}, {g.distance('a', 'b')} AS dist FROM (SELECT DISTINCT page, {_AS} FROM a) a JOIN b ON a.page = b.page WHERE {g.distance('a', 'b')} < 160),
 r AS (SELECT *, row_number() OVER (PARTITION BY page, {_AS} ORDER BY dist, {_BS}) AS i FROM p) SELECT page, {_AS}, {_BS}, round(dist, 6) AS dist FROM r WHERE i = 1""",
)
def nearest_caption(spark, d):
    """The caption with the smallest distance, by min_by: partial aggregation instead of a sort of all pairs."""
    a, b = box_sides(spark, d)
    near = paired(a.select("page", *_A).distinct(), b, f"{g.distance('a', 'b')} < 160").withColumn("dist", F.expr(g.distance("a", "b")))
    best = near.groupBy("page", *_A).agg(F.min(F.struct("dist", *_B)).alias("m"))
    return best.select("page", *_A, *[F.col(f"m.{c}") for c in _B], F.round("m.dist", 6).alias("dist"))


@query(
    "argmax_correction",
    f"""{_W}, p AS (SELECT a.page, {_AS}, max({g.iou('a', 'b')}) AS best FROM (SELECT DISTINCT page, {_AS} FROM a) a JOIN b ON a.page = b.page GROUP BY a.page, {_AS})
 SELECT page, {_AS}, round(best, 6) AS best, CASE WHEN best >= 0.45 THEN 'matched' ELSE 'no region' END AS outcome FROM p""",
)
def argmax_correction(spark, d):
    a, b = box_sides(spark, d)
    best = paired(a.select("page", *_A).distinct(), b, "true").groupBy("page", *_A).agg(F.max(F.expr(g.iou("a", "b"))).alias("b"))
    return best.select("page", *_A, F.round("b", 6).alias("best"), F.when(F.col("b") >= 0.45, "matched").otherwise("no region").alias("outcome"))


@query("point_in_rect", f"{_W} SELECT a.page, count(*) AS n FROM a JOIN b ON a.page = b.page AND {g.centre_inside('a', 'b')} AND {g.overlap('a', 'b')} > 0.4 GROUP BY a.page")
def point_in_rect(spark, d):
    return paired(*box_sides(spark, d), f"{g.centre_inside('a', 'b')} AND {g.overlap('a', 'b')} > 0.4").groupBy("page").agg(F.count("*").alias("n"))


@query("mask_intersections", f"{_W} SELECT a.page, {_AS}, count(*) AS masks FROM a JOIN b ON a.page = b.page AND {g.intersects('a', 'b', 0.02)} GROUP BY a.page, {_AS}")
def mask_intersections(spark, d):
    return paired(*box_sides(spark, d), g.intersects("a", "b", 0.02)).groupBy("page", *_A).agg(F.count("*").alias("masks"))


@query("uncovered_anti", f"{_W} SELECT page, {_AS} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.page = b.page AND {g.overlap('a', 'b')} > 0.95)")
def uncovered_anti(spark, d):
    return paired(*box_sides(spark, d), f"{g.overlap('a', 'b')} > 0.95", "left_anti").select("page", *_A)


@query("union_bbox", f"{_W} SELECT page, source, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM boxes GROUP BY page, source")
def union_bbox(spark, d):
    return union_of(boxes(spark, d), ["page", "source"])


def union_of(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


@query("caption_group_merge", f"{_W} SELECT page, name, CAST(round_even(y0 / 4, 0) AS BIGINT) AS slot, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM boxes GROUP BY 1, 2, 3")
def caption_group_merge(spark, d):
    return union_of(boxes(spark, d).withColumn("slot", F.bround(F.col("y0") / 4, 0).cast("bigint")), ["page", "name", "slot"])


_NEAR = f"(aname = bname AND ({g.iou('a', 'b')} > 0.1 OR abs(ay0 - by0) < 30))"


@query("unmatched_captions", f"{_W} SELECT page, {_AS}, aname FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.page = b.page AND {_NEAR})")
def unmatched_captions(spark, d):
    return paired(*box_sides(spark, d), _NEAR, "left_anti").select("page", *_A, "aname")


@query(
    "caption_adoption",
    f"""{_W}, u AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.page = b.page AND {_NEAR})), p AS (SELECT u.page, {_AS}, min(abs(ay0 - by0) + abs(ax0 - bx0)) AS gap FROM u JOIN b ON u.page = b.page GROUP BY u.page, {_AS})
 SELECT page, {_AS}, gap, gap < 135 AS adopted FROM p""",
)
def caption_adoption(spark, d):
    a, b = box_sides(spark, d)
    gap = paired(paired(a, b, _NEAR, "left_anti"), b, "true").groupBy("page", *_A).agg(F.min(F.expr("abs(ay0 - by0) + abs(ax0 - bx0)")).alias("gap"))
    return gap.withColumn("adopted", F.col("gap") < 135)


_FLAGS = (("degenerate", "x1 - x0 < 10 OR y1 - y0 < 10"), ("out_of_page", "x1 > 601 OR y1 > 501 OR x0 < -1 OR y0 < -1"), ("large", "(x1 - x0) * (y1 - y0) > 0.3 * 600 * 500"))


@query("box_quality_flags", f"{_W} SELECT page, x0, y0, x1, y1, source, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, c in _FLAGS)}) AS flags FROM (SELECT DISTINCT page, x0, y0, x1, y1, source FROM boxes)")
def box_quality_flags(spark, d):
    flags = [F.when(F.expr(c), n) for n, c in _FLAGS]
    return boxes(spark, d).select("page", "x0", "y0", "x1", "y1", "source").distinct().withColumn("flags", F.concat_ws(",", *flags))


@query("confidence_threshold", f"{_W} SELECT source, name, count(*) AS n, CAST(count_if(confidence >= 0.05 OR name = 'F') AS BIGINT) AS usable FROM boxes GROUP BY source, name")
def confidence_threshold(spark, d):
    return boxes(spark, d).groupBy("source", "name").agg(F.count("*").alias("n"), F.count_if((F.col("confidence") >= 0.05) | (F.col("name") == "F")).alias("usable"))


@query("coordinate_scaling", f"{_W} SELECT page, round_even(least(greatest(x0 * 612 / 700, 0), 612), 4) AS x0, round_even(least(greatest(y1 * 792 / 600, 0), 792), 4) AS y1, count(*) AS n FROM boxes GROUP BY 1, 2, 3")
def coordinate_scaling(spark, d):
    """Pixels to points along each axis, clipped to the page."""
    scaled = lambda c, px, pt: F.bround(F.least(F.greatest(F.col(c) * pt / px, F.lit(0.0)), F.lit(float(pt))), 4)
    return boxes(spark, d).groupBy("page", scaled("x0", 700, 612).alias("x0"), scaled("y1", 600, 792).alias("y1")).agg(F.count("*").alias("n"))


_P = "p AS (SELECT a.page, {_AS}, b.bx0, b.by0, b.bx1, b.by1 FROM (SELECT DISTINCT page, {_AS} FROM a) a JOIN b ON a.page = b.page AND {_MATCH})".replace("{_AS}", _AS).replace("{_MATCH}", _MATCH)


@query(
    "region_fusion",
    f"""{_W}, {_P}, u AS (SELECT page, {_AS}, min(bx0) AS ux0, min(by0) AS uy0, max(bx1) AS ux1, max(by1) AS uy1, count(*) AS n FROM p GROUP BY page, {_AS})
 SELECT page, {_AS}, n, round({g.area('a')} / greatest(1, {g.area('u')}), 6) AS ratio,
 CASE WHEN {g.area('a')} / greatest(1, {g.area('u')}) BETWEEN 0.65 AND 1.5 THEN 'agreement' ELSE 'prefer_layout_bounds' END AS outcome FROM u""",
)
def region_fusion(spark, d):
    """Each old region against the union of the detections that match it: similar areas agree, others take the union."""
    a, b = box_sides(spark, d)
    u = paired(a.select("page", *_A).distinct(), b, _MATCH).groupBy("page", *_A).agg(F.min("bx0").alias("ux0"), F.min("by0").alias("uy0"), F.max("bx1").alias("ux1"), F.max("by1").alias("uy1"), F.count("*").alias("n"))
    ratio = F.expr(f"{g.area('a')} / greatest(1, {g.area('u')})")
    return u.select("page", *_A, "n", F.round(ratio, 6).alias("ratio"), F.when(ratio.between(0.65, 1.5), "agreement").otherwise("prefer_layout_bounds").alias("outcome"))
