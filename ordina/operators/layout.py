"""Regions, detections and captions on pages: kinds, thresholds, guards, matches and fusion.

Joins have the page (and mostly the kind) as equality keys. Thresholds are parameters; the defaults decide exactly as
written here: `>` and `>=` are not interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..registry import query
from ..sources.detector import FIGURE, one_based
from ..sources.tables import PAGE_HEIGHT, PAGE_WIDTH, REGIONS_SQL, region_sides, regions

_W = f"WITH {REGIONS_SQL}"
_A, _B, _C = (["{0}x0".format(p), "{0}y0".format(p), "{0}x1".format(p), "{0}y1".format(p)] for p in "abc")
_AS, _BS, _CS = ", ".join(_A), ", ".join(_B), ", ".join(_C)
_BOX = ["x0", "y0", "x1", "y1"]

CAPTION, VISUAL, PROSE, MODEL = 0.25, 0.25, 0.65, 0.15


def on(left: DataFrame, right: DataFrame, condition: str, keys: tuple[str, ...] = ("page", "kind"), how: str = "inner") -> DataFrame:
    """Pairs of rows with equal keys that meet a condition; the keys come from the left."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    equal = " AND ".join(f"{k} = __{k}" for k in keys)
    return left.join(other, F.expr(f"{equal} AND ({condition})"), how).drop(*[f"__{k}" for k in keys])


def visual(det: DataFrame, least: float = VISUAL) -> DataFrame:
    return det.where((F.col("confidence") >= least) | F.col("forced"))


_VISUAL = f"vis AS (SELECT * FROM det WHERE confidence >= {VISUAL} OR forced)"


@query("kind_partition", f"{_W} SELECT page, kind, label, count(*) AS n FROM kinds GROUP BY page, kind, label")
def kind_partition(spark, d):
    return regions(spark, d).groupBy("page", "kind", "label").agg(F.count("*").alias("n"))


@query(
    "confidence_rules",
    f"""{_W} SELECT role, kind, count(*) AS n, CAST(count_if(role = 'cap' AND confidence >= {CAPTION}) AS BIGINT) AS captions, CAST(count_if(role = 'det' AND (confidence >= {VISUAL} OR forced)) AS BIGINT) AS visuals,
 CAST(count_if(role = 'cap' AND confidence > {PROSE}) AS BIGINT) AS prose, CAST(count_if(confidence >= {MODEL}) AS BIGINT) AS model FROM kinds GROUP BY role, kind""",
)
def confidence_rules(spark, d):
    """Captions and visuals from .25 (or forced), prose above .65, the model's own limit .15."""
    c, role = F.col("confidence"), F.col("role")
    rules = {"captions": (role == "cap") & (c >= CAPTION), "visuals": (role == "det") & ((c >= VISUAL) | F.col("forced")), "prose": (role == "cap") & (c > PROSE), "model": c >= MODEL}
    return regions(spark, d).groupBy("role", "kind").agg(F.count("*").alias("n"), *[F.count_if(r).alias(n) for n, r in rules.items()])


@query(
    "long_text_flags",
    f"{_W} SELECT page, string_agg(DISTINCT CAST(len AS VARCHAR), ',' ORDER BY CAST(len AS VARCHAR)) AS lengths, count(*) AS n FROM kinds WHERE len > 100 AND size >= 9.5 AND role <> 'det' GROUP BY page",
)
def long_text_flags(spark, d):
    """Pages whose regions (but for rasters) hold text of more than 100 characters in 9.5 points or more."""
    long = regions(spark, d).where((F.col("len") > 100) & (F.col("size") >= 9.5) & (F.col("role") != "det"))
    return long.groupBy("page").agg(F.array_join(F.array_sort(F.collect_set(F.col("len").cast("string"))), ",").alias("lengths"), F.count("*").alias("n"))


_CLIPPED = f"least(greatest(x0, 0), {PAGE_WIDTH}) AS x0, least(greatest(y0, 0), {PAGE_HEIGHT}) AS y0, least(greatest(x1, 0), {PAGE_WIDTH}) AS x1, least(greatest(y1, 0), {PAGE_HEIGHT}) AS y1"


def clipped(df: DataFrame, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> DataFrame:
    inside = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(most))
    return df.withColumns({"x0": inside("x0", width), "y0": inside("y0", height), "x1": inside("x1", width), "y1": inside("y1", height)})


@query(
    "usable_boxes",
    f"{_W}, c AS (SELECT page, role, {_CLIPPED} FROM kinds) SELECT page, role, x0, y0, x1, y1, count(*) AS n FROM c WHERE CASE WHEN role = 'det' THEN x1 - x0 >= 35 AND y1 - y0 >= 30 ELSE x1 - x0 > 0 AND y1 - y0 > 0 END GROUP BY ALL",
)
def usable_boxes(spark, d):
    """Boxes clipped to their page; empty masks and tiny rasters go (the least sides of rasters are set for this table)."""
    return usable(clipped(regions(spark, d)), F.col("role") == "det", 35.0, 30.0).groupBy("page", "role", *_BOX).agg(F.count("*").alias("n"))


def usable(df: DataFrame, raster: Column, width: float = 1.0, height: float = 1.0) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return df.where(F.when(raster, (w >= width) & (h >= height)).otherwise((w > 0) & (h > 0)))


_RULES = {
    "invalid_bbox": f"x1 <= x0 OR y1 <= y0 OR x0 < -1 OR y0 < -1 OR x1 > {PAGE_WIDTH} + 1 OR y1 > {PAGE_HEIGHT} + 1",
    "large_area": f"(x1 - x0) * (y1 - y0) > 0.7 * {PAGE_WIDTH} * {PAGE_HEIGHT}",
    "rotated_page": "rotation <> 0",
}


@query("region_quality_flags", f"{_W} SELECT page, role, x0, y0, x1, y1, rotation, concat_ws(',', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, c in _RULES.items())}) AS flags FROM (SELECT DISTINCT page, role, x0, y0, x1, y1, rotation FROM kinds)")
def region_quality_flags(spark, d):
    flags = F.concat_ws(",", *[F.when(F.expr(c), n) for n, c in _RULES.items()])
    return regions(spark, d).select("page", "role", *_BOX, "rotation").distinct().withColumn("flags", flags)


_TRIM = "CASE WHEN top > ay0 + (ay1 - ay0) * 0.5 AND top < ay1 + 4 THEN least(ay1, top - 3) ELSE ay1 END"


@query(
    "caption_proximity",
    f"""{_W}, n AS (SELECT old.page, old.kind, aname, {_AS}, min(cy0) AS top, count(cy0) AS captions FROM old LEFT JOIN cap ON old.page = cap.page AND old.kind = cap.kind AND aname = cname AND abs(cy0 - ay1) < 18
 GROUP BY ALL) SELECT page, kind, aname, {_AS}, captions, {_TRIM} AS bottom FROM n""",
)
def caption_proximity(spark, d):
    """Captions with the region's label less than 18 points off its lower edge; the topmost one cuts the region."""
    return near_captions(*region_sides(spark, d)[::2]).select("page", "kind", "aname", *_A, "captions", F.expr(_TRIM).alias("bottom"))


def near_captions(old: DataFrame, cap: DataFrame, reach: float = 18.0) -> DataFrame:
    near = on(old, cap, f"aname = cname AND abs(cy0 - ay1) < {reach}", how="left")
    return near.groupBy("page", "kind", "aname", *_A).agg(F.min("cy0").alias("top"), F.count("cy0").alias("captions"))


@query("full_page_guard", f"{_W} SELECT page, x0, y0, x1, y1, count(*) AS n FROM (SELECT page, {_CLIPPED} FROM kinds WHERE kind = 'figure') WHERE (x1 - x0) * (y1 - y0) > 0.8 * {PAGE_WIDTH} * {PAGE_HEIGHT} GROUP BY ALL")
def full_page_guard(spark, d):
    """Figures that cover nearly a whole page (.8 of it on these tables, so that some do)."""
    return covering(clipped(regions(spark, d).where("kind = 'figure'")), 0.8).groupBy("page", *_BOX).agg(F.count("*").alias("n"))


def covering(df: DataFrame, share: float = 0.93, width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> DataFrame:
    return df.where(F.expr(f"(x1 - x0) * (y1 - y0) > {share} * {width} * {height}"))


_SAME = f"{g.iou('a', 'b')} > 0.25 OR {g.overlap('b', 'a')} > 0.75"


@query("region_matches_by_kind", f"{_W}, {_VISUAL} SELECT old.page, old.kind, {_AS}, {_BS}, round({g.iou('a', 'b')}, 6) AS iou FROM (SELECT DISTINCT page, kind, {_AS} FROM old) old JOIN (SELECT DISTINCT page, kind, {_BS} FROM vis) vis ON old.page = vis.page AND old.kind = vis.kind AND ({_SAME})")
def region_matches_by_kind(spark, d):
    old, det, _ = region_sides(spark, d)
    pairs = on(old.select("page", "kind", *_A).distinct(), visual(det).select("page", "kind", *_B).distinct(), _SAME)
    return pairs.select("page", "kind", *_A, *_B, F.round(F.expr(g.iou("a", "b")), 6).alias("iou"))


_COPY = f"{g.overlap('b', 'a')} > 0.9 AND {g.iou('a', 'b')} > 0.7"


@query("table_duplicates", f"{_W}, {_VISUAL} SELECT page, {_BS}, forced FROM vis WHERE kind = 'figure' AND (forced OR NOT EXISTS (SELECT 1 FROM old WHERE old.page = vis.page AND old.kind = 'table' AND {_COPY})) GROUP BY ALL")
def table_duplicates(spark, d):
    """Detected figures that are no copy of a known table; forced ones stay."""
    old, det, _ = region_sides(spark, d)
    return no_table_copies(visual(det).where("kind = 'figure'"), old).select("page", *_B, "forced").distinct()


def no_table_copies(figures: DataFrame, old: DataFrame) -> DataFrame:
    return on(figures, old.where("kind = 'table'").drop("kind"), f"NOT forced AND {_COPY}", ("page",), "left_anti")


_DIST = g.distance("b", "c", "kind")


@query(
    "nearest_caption_by_kind",
    f"""{_W}, {_VISUAL}, c AS (SELECT * FROM cap WHERE cconf >= {CAPTION}), p AS (SELECT vis.page, vis.kind, {_BS}, {_CS}, cname, {_DIST.replace('kind', 'vis.kind')} AS dist FROM vis JOIN c ON vis.page = c.page AND vis.kind = c.kind),
 r AS (SELECT *, row_number() OVER (PARTITION BY page, kind, {_BS} ORDER BY dist, {_CS}, cname) AS i FROM p WHERE dist < 160) SELECT page, kind, {_BS}, cname, round(dist, 6) AS dist FROM r WHERE i = 1""",
)
def nearest_caption_by_kind(spark, d):
    """The nearest caption of a visual: under a figure or above a table costs nothing, the other side 12."""
    _, det, cap = region_sides(spark, d)
    near = on(visual(det), cap.where(F.col("cconf") >= CAPTION), f"{_DIST} < 160").withColumn("dist", F.expr(_DIST))
    best = near.groupBy("page", "kind", *_B).agg(F.min(F.struct("dist", *_C, "cname")).alias("m"))
    return best.select("page", "kind", *_B, "m.cname", F.round("m.dist", 6).alias("dist"))


@query(
    "argmax_region",
    f"""{_W}, p AS (SELECT old.page, old.kind, {_AS}, {_BS}, {g.iou('a', 'b')} AS iou FROM (SELECT DISTINCT page, kind, {_AS} FROM old) old JOIN (SELECT DISTINCT page, kind, {_BS} FROM det) det ON old.page = det.page AND old.kind = det.kind),
 r AS (SELECT *, row_number() OVER (PARTITION BY page, kind, {_BS} ORDER BY iou DESC, {_AS}) AS i FROM p WHERE iou > 0) SELECT page, kind, {_BS}, {_AS}, round(iou, 6) AS iou, CASE WHEN iou >= 0.45 THEN 'matched' ELSE 'no region' END AS outcome FROM r WHERE i = 1""",
)
def argmax_region(spark, d):
    """The region that a correction (a detection here) is about: the one with the largest IoU, which must reach .45.
    Only boxes that meet are paired."""
    old, det, _ = region_sides(spark, d)
    pairs = on(det.select("page", "kind", *_B).distinct(), old.select("page", "kind", *_A).distinct(), g.intersects("a", "b")).withColumn("iou", F.expr(g.iou("a", "b")))
    best = pairs.groupBy("page", "kind", *_B).agg(F.min(F.struct((-F.col("iou")).alias("iou"), *_A)).alias("m"))
    return best.select("page", "kind", *_B, *[f"m.{c}" for c in _A], F.round(-F.col("m.iou"), 6).alias("iou"), F.when(F.col("m.iou") <= -0.45, "matched").otherwise("no region").alias("outcome"))


_TOLD = f"aname = cname AND ({g.iou('a', 'c')} > 0.1 OR abs(ay0 - cy0) < 30)"
_TO_CAP = g.distance("a", "c", "kind")


@query(
    "unnumbered_adoption",
    f"""{_W}, u AS (SELECT * FROM cap WHERE cname <> 'unnumbered' AND cconf >= {CAPTION} AND NOT EXISTS (SELECT 1 FROM old WHERE old.page = cap.page AND old.kind = cap.kind AND {_TOLD})),
 p AS (SELECT u.page, u.kind, cname, cconf, {_CS}, {_AS}, aname, {_TO_CAP.replace('kind', 'u.kind')} AS dist FROM u LEFT JOIN old ON u.page = old.page AND u.kind = old.kind),
 r AS (SELECT *, row_number() OVER (PARTITION BY page, kind, cname, cconf, {_CS} ORDER BY dist NULLS LAST, {_AS}, aname) AS i FROM p)
 SELECT page, kind, cname, cconf, {_CS}, CASE WHEN dist < 35 AND aname = 'unnumbered' THEN 'adopted' ELSE 'unmatched_layout_caption' END AS outcome FROM r WHERE i = 1""",
)
def unnumbered_adoption(spark, d):
    """Captions that no region carries: the nearest region adopts one if it is unnumbered and less than 35 away."""
    old, _, cap = region_sides(spark, d)
    alone = on(cap.where((F.col("cname") != "unnumbered") & (F.col("cconf") >= CAPTION)), old, _TOLD, how="left_anti")
    near = on(alone, old, f"{_TO_CAP} < 10000", how="left").withColumn("dist", F.expr(_TO_CAP))
    key = ["page", "kind", "cname", "cconf", *_C]
    best = near.groupBy(*key).agg(F.min(F.when(F.col("aname").isNotNull(), F.struct("dist", *_A, "aname"))).alias("m"))
    adopted = (F.col("m.dist") < 35) & (F.col("m.aname") == "unnumbered")
    return best.select(*key, F.when(adopted, "adopted").otherwise("unmatched_layout_caption").alias("outcome"))


@query(
    "caption_group_regions",
    f"""{_W} SELECT page, kind, aname, min(ax0) AS x0, min(ay0) AS y0, max(ax1) AS x1, max(ay1) AS y1, count(*) AS n FROM old
 GROUP BY page, kind, aname, CASE WHEN aname = 'unnumbered' THEN concat_ws('/', {_AS}) ELSE CAST(CAST(round_even(ay0 / 4, 0) AS BIGINT) AS VARCHAR) END""",
)
def caption_group_regions(spark, d):
    """Panels of one caption become one region; unnumbered ones are never merged."""
    slot = F.when(F.col("aname") == "unnumbered", F.concat_ws("/", *[F.col(c).cast("string") for c in _A])).otherwise(F.bround(F.col("ay0") / 4, 0).cast("bigint").cast("string"))
    merged = region_sides(spark, d)[0].groupBy("page", "kind", "aname", slot.alias("slot")).agg(F.min("ax0").alias("x0"), F.min("ay0").alias("y0"), F.max("ax1").alias("x1"), F.max("ay1").alias("y1"), F.count("*").alias("n"))
    return merged.drop("slot")


_U = {"x0": "min(bx0)", "y0": "min(by0)", "x1": "max(bx1)", "y1": "max(by1)"}
_UNION = ", ".join(f"{f} AS u{c}" for c, f in _U.items())
_RATIO = f"{g.area('a')} / greatest(1, {g.area('u')})"
_LEFT_OUT = f"{g.overlap('c', 'a')} > 0.6 AND {g.overlap('c', 'u')} < 0.3"


@query(
    "region_outcomes",
    f"""{_W}, {_VISUAL}, v AS (SELECT * FROM vis WHERE kind = 'table' OR forced OR NOT EXISTS (SELECT 1 FROM old WHERE old.page = vis.page AND old.kind = 'table' AND {_COPY})),
 o AS (SELECT DISTINCT page, kind, {_AS} FROM old), u AS (SELECT o.page, o.kind, {_AS}, {_UNION}, bool_or(size > 10) AS manual FROM o JOIN v ON o.page = v.page AND o.kind = v.kind AND ({_SAME}) GROUP BY o.page, o.kind, {_AS}),
 t AS (SELECT DISTINCT page, {_CS} FROM cap WHERE cconf > {PROSE}), p AS (SELECT u.page, u.kind, {_AS}, count(*) AS prose FROM u JOIN t ON u.page = t.page AND {_LEFT_OUT} GROUP BY u.page, u.kind, {_AS})
 SELECT o.page, o.kind, {', '.join(f'o.{c}' for c in _A)}, coalesce(prose, 0) AS prose, CASE WHEN u.page IS NULL THEN 'caption_detector_only' WHEN manual THEN 'manually_verified_layout_bounds'
 WHEN {_RATIO.replace('ax', 'o.ax').replace('ay', 'o.ay')} BETWEEN 0.65 AND 1.5 AND prose IS NULL THEN 'agreement' ELSE 'prefer_layout_bounds' END AS outcome
 FROM o LEFT JOIN u ON o.page = u.page AND o.kind = u.kind AND {' AND '.join(f'o.{c} = u.{c}' for c in _A)} LEFT JOIN p ON o.page = p.page AND o.kind = p.kind AND {' AND '.join(f'o.{c} = p.{c}' for c in _A)}""",
)
def region_outcomes(spark, d):
    """What becomes of each old region: none matches it, a verified box decides, both agree (and no prose of the old one
    would be left out), or the detections' bounds are preferred."""
    old, det, cap = region_sides(spark, d)
    seen = visual(det)
    seen = seen.where("kind = 'table'").unionByName(no_table_copies(seen.where("kind = 'figure'"), old))
    return outcomes(old.select("page", "kind", *_A).distinct(), seen.withColumn("manual", F.col("size") > 10), cap.where(F.col("cconf") > PROSE).select("page", *_C).distinct())


def outcomes(old: DataFrame, seen: DataFrame, prose: DataFrame) -> DataFrame:
    key = ["page", "kind", *_A]
    union = on(old, seen, _SAME).groupBy(*key).agg(*[F.expr(f).alias(f"u{c}") for c, f in _U.items()], F.bool_or("manual").alias("manual"))
    left_out = on(union, prose, _LEFT_OUT, ("page",)).groupBy(*key).agg(F.count("*").alias("prose"))
    every = old.join(union, key, "left").join(left_out, key, "left").withColumn("prose", F.coalesce("prose", F.lit(0)))
    agree = F.expr(_RATIO).between(0.65, 1.5) & (F.col("prose") == 0)
    outcome = F.when(F.col("manual").isNull(), "caption_detector_only").when(F.col("manual"), "manually_verified_layout_bounds").when(agree, "agreement").otherwise("prefer_layout_bounds")
    return every.select(*key, "prose", outcome.alias("outcome"))


_ORDERS = {
    "figure_order": "least(y0, y0 + 20 - size), x0, x1, y1, role, label",
    "detection_order": "y0, x0, x1, y1, role, label",
    "event_order": "y0, CASE WHEN role = 'det' THEN 0 ELSE 1 END, x0, x1, y1, role, label",
}


def _order_query(name: str, order: str, note: str) -> None:
    tag = "role || ':' || CAST(CAST(x0 AS INT) AS VARCHAR) || '/' || CAST(CAST(y0 AS INT) AS VARCHAR)"
    sql = f"{_W} SELECT page, string_agg(t, ' ' ORDER BY {order}) AS reading_order FROM (SELECT DISTINCT page, role, label, x0, y0, x1, y1, size, {tag} AS t FROM kinds) GROUP BY page"

    def run(spark, d):
        tagged = F.concat(F.col("role"), F.lit(":"), F.col("x0").cast("int").cast("string"), F.lit("/"), F.col("y0").cast("int").cast("string"))
        rows = regions(spark, d).select("page", "role", "label", *_BOX, "size").distinct()
        fields = [F.expr(f).alias(f"o{i}") for i, f in enumerate(_split(order))]
        packed = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(*fields, tagged.alias("t")))).alias("l"))
        return packed.select("page", F.array_join(F.transform("l", lambda i: i["t"]), " ").alias("reading_order"))

    run.__doc__ = note
    query(name, sql)(run)


def _split(order: str) -> list[str]:
    out, depth = [""], 0
    for c in order:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [o.strip() for o in out]


_order_query("figure_order", _ORDERS["figure_order"], "Figures of a page by the upper edge of box or caption (here: above the box by a size), then x.")
_order_query("detection_order", _ORDERS["detection_order"], "Detections of a page by y, then x.")
_order_query("event_order", _ORDERS["event_order"], "Events of a page by y, images before text, then x.")


@query("result_order", f"{_W}, n AS (SELECT page, count(*) AS n FROM kinds GROUP BY page) SELECT printf('paper_%03d', page) AS package_id, n, row_number() OVER (ORDER BY page) AS place FROM n")
def result_order(spark, d):
    """Results in the order of their packages, however they were finished."""
    from ..plans.ranking import ordinals

    done = regions(spark, d).groupBy("page").agg(F.count("*").alias("n"))
    return ordinals(done, "page", "place").select(F.format_string("paper_%03d", "page").alias("package_id"), "n", "place")


_JSON = """'{"figType":"' || label || '","name":"' || name || '","page":' || CAST(page AS VARCHAR) || ',"regionBoundary":{"x1":' || CAST(CAST(x0 AS INT) AS VARCHAR) || ',"y1":' || CAST(CAST(y0 AS INT) AS VARCHAR) || ',"x2":' || CAST(CAST(x1 AS INT) AS VARCHAR) || ',"y2":' || CAST(CAST(y1 AS INT) AS VARCHAR) || '}}'"""


@query("detector_boxes", f"{_W} SELECT page + 1 AS page, kind, name, CAST(CAST(x0 AS INT) AS DOUBLE) AS x0, CAST(CAST(y1 AS INT) AS DOUBLE) AS y1, count(*) AS n FROM kinds WHERE role = 'det' GROUP BY ALL")
def detector_boxes(spark, d):
    """Another program's records (pages from 0, boxes as objects), read by the same code as its files."""
    raw = regions(spark, d).where("role = 'det'").select(F.from_json(F.expr(_JSON.replace('VARCHAR', 'STRING')), FIGURE).alias("f"))
    return raw.select(*one_based(F.col("f"))).groupBy("page", "kind", "name", F.col("bbox")[0].alias("x0"), F.col("bbox")[3].alias("y1")).agg(F.count("*").alias("n"))


# Pixels of a rendering to points of the page, turned back to the unrotated page (w by h points, shown rotated by `rotation`).
_SHOWN = "CASE WHEN rotation % 180 = 90 THEN {0} ELSE {1} END"


def _turned(x: str, y: str, w: str, h: str) -> tuple[str, str]:
    return (f"CASE rotation WHEN 90 THEN {y} WHEN 180 THEN {w} - ({x}) WHEN 270 THEN {w} - ({y}) ELSE {x} END", f"CASE rotation WHEN 90 THEN {h} - ({x}) WHEN 180 THEN {h} - ({y}) WHEN 270 THEN {x} ELSE {y} END")


def unrotated(width: float, height: float, px: float, py: float) -> dict[str, str]:
    """x0, y0, x1, y1 in points, four places, half to even, clipped to the page: SQL for both engines (`bround` is the
    name of the rounding). px and py are the pixels of the shown page."""
    shown_w, shown_h = _SHOWN.format(height, width), _SHOWN.format(width, height)
    ends = [_turned(f"({x} * ({shown_w}) / {px})", f"({y} * ({shown_h}) / {py})", str(width), str(height)) for x, y in (("x0", "y0"), ("x1", "y1"))]
    out = {}
    for i, (axis, most) in enumerate((("x", width), ("y", height))):
        a, b = ends[0][i], ends[1][i]
        for end, pick in (("0", "least"), ("1", "greatest")):
            out[f"{axis}{end}"] = f"bround(least(greatest({pick}({a}, {b}), 0), {most}), 4)"
    return out


_POINTS = unrotated(612.0, 792.0, 437.0, 391.0)


@query("layout_scaling", f"{_W} SELECT page, rotation, {', '.join(f'{e.replace('bround', 'round_even')} AS {c}' for c, e in _POINTS.items())}, count(*) AS n FROM kinds WHERE role = 'det' GROUP BY ALL")
def layout_scaling(spark, d):
    det = regions(spark, d).where("role = 'det'")
    return det.groupBy("page", "rotation", *[F.expr(e).alias(c) for c, e in _POINTS.items()]).agg(F.count("*").alias("n"))
