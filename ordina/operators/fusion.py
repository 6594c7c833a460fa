"""Figures and tables of documents from two sources: regions that a caption detector found, and detections of a layout model.

`fuse` gives the figures, what is missing and the warnings of each page; `corrected` applies verified corrections in order;
`status` sums documents up. Tables: regions (doc, page, place, kind, name, box, caption box or nulls, caption), detections (doc,
page, det, class_name, confidence, box), lines (doc, page, place, text, box), decisions and later_decisions (doc, page, det, decision,
replacement as `doc:page:det`, box or nulls; where both have one, the later wins), required (key: replacements needed anyway).
Pairs are only made inside a page and kind; what depends on order (captions that take a region, corrections) folds over the
ordered array of one page's and kind's captions, or corrections, in built-in expressions. Tables between the steps are bucketed by
page and joined by page alone (`within`; kind and number are conditions), so rows go to their page once and stay there.
Keys `doc:page:det` are told apart from behind: page and det are numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..registry import query
from ..sources.tables import buckets_of, placed, region_rows
from .layout import CAPTION, PROSE, VISUAL
from .text import caption_name

_BOX = ("x0", "y0", "x1", "y1")
_PAGE = ["doc", "page"]
_KIND = ["doc", "page", "kind"]
# What a caption's text begins a line with (fixed value).
_LABEL = r"(?im)^\s*(Figure|Fig\.|Table)\s*([A-Za-z]?\.?\d+(?:[.][\d]+)?[A-Za-z]?)"
ADOPT, SAME_IOU, SAME_Y, CORRECTION = 35.0, 0.1, 30.0, 0.45
FIGURE = "struct<page:bigint,kind:string,name:string,x0:double,y0:double,x1:double,y1:double,cx0:double,cy0:double,cx1:double,cy1:double,caption:string,source:string>"


def _as(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    """Box columns with a prefix."""
    return df.select(*more, *[F.col(c).alias(f"{prefix}{c}") for c in _BOX])


def within(left: DataFrame, right: DataFrame, *same: str, how: str = "inner", condition: str | Column = "true") -> DataFrame:
    """Rows of one page that are equal in `same`, with the columns of both. Only the page is a key of the join: were the others keys too,
    rows would be shuffled by all of them. Two bounds say what an equality would make a key."""
    keys = [*_PAGE, *same]
    other = right.withColumnsRenamed({c: f"__{c}" for c in keys})
    met = F.expr(condition) if isinstance(condition, str) else condition
    for c in _PAGE:
        met = (F.col(c) == F.col(f"__{c}")) & met
    for c in same:
        met = (F.col(c) >= F.col(f"__{c}")) & (F.col(c) <= F.col(f"__{c}")) & met
    return left.join(other, met, how).drop(*[f"__{c}" for c in keys])


def decided(detections: DataFrame, decisions: DataFrame, later: DataFrame, required: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(detections after decisions with forced and manual, violations: dropped ones whose replacement is neither kept nor required)."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in (*_PAGE, "det")])
    boxed = lambda df: df.select(*_PAGE, "det", "decision", "replacement", F.when(F.col("x0").isNotNull(), F.struct(*_BOX)).alias("box"))
    every = within(boxed(decisions), later.select(*_PAGE, "det"), "det", how="left_anti").unionByName(boxed(later))
    said = within(detections, every, "det", how="left")
    dropped = F.coalesce(F.col("decision") == "drop", F.lit(False))
    kept = every.where("decision = 'keep'").select(key.alias("replacement")).unionByName(required.select(F.col("key").alias("replacement"))).distinct()
    lost = said.where(dropped & (F.coalesce("replacement", F.lit("")) != "")).join(kept, "replacement", "left_anti").select(*_PAGE, "det", F.concat(F.lit("missing replacement "), "replacement").alias("violation"))
    parts = {c: F.regexp_extract("key", "^(.*):([^:]*):([^:]*)$", i + 1).try_cast(detections.schema[c].dataType).alias(c) for i, c in enumerate((*_PAGE, "det"))}
    needed = required.select("key", *parts.values()).where(key == F.col("key")).select(*_PAGE, "det").distinct().withColumn("needed", F.lit(True))
    needed = needed.repartition(buckets_of(needed.sparkSession), *_PAGE)
    rows = within(said.where(~dropped), needed, "det", how="left")
    forced = F.coalesce(F.col("decision").isin("keep", "reclassify_table"), F.lit(False)) | F.col("needed").isNotNull()
    name = F.when(F.col("decision") == "reclassify_table", "table").otherwise(F.col("class_name"))
    out = rows.select(*_PAGE, "det", name.alias("class_name"), "confidence", *[F.coalesce(F.col(f"box.{c}"), F.col(c)).alias(c) for c in _BOX], forced.alias("forced"), F.col("box").isNotNull().alias("manual"))
    return out, lost


def captions(dets: DataFrame, lines: DataFrame) -> DataFrame:
    """Usable captions: detected ones whose lines (by their centres, the box a little wider) carry a label; with their text, kind and name."""
    found = _as(dets.where(F.col("class_name").isin("figure_caption", "table_caption") & (F.col("confidence") >= CAPTION)), "c", *_PAGE, "det")
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = x.between(F.col("cx0") - 5, F.col("cx1") + 5) & y.between(F.col("cy0") - 4, F.col("cy1") + 4)
    met = within(found, lines.select(*_PAGE, "place", "text", *_BOX), condition=inside)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda i: i["text"]), "\n")
    one = met.groupBy(*_PAGE, "det", "cx0", "cy0", "cx1", "cy1").agg(text.alias("caption"))
    label = F.regexp_extract("caption", _LABEL, 1)
    kind = F.when(F.lower(label) == "table", "table").otherwise("figure")
    return one.where(label != "").select(*_PAGE, kind.alias("kind"), F.col("det").alias("cdet"), "cx0", "cy0", "cx1", "cy1", "caption", F.regexp_extract("caption", _LABEL, 2).alias("cname"))


def fuse(regions: DataFrame, detections: DataFrame, lines: DataFrame, decisions: DataFrame, later: DataFrame, required: DataFrame) -> dict[str, DataFrame]:
    """figures, missing, warnings and violations."""
    dets, lost = decided(detections, decisions, later, required)
    dets = placed(dets, _PAGE, "decided")
    caps = placed(captions(dets, lines), _PAGE, "captions")
    olds = regions.withColumn("kind", F.when(F.lower("kind") == "table", "table").otherwise("figure"))
    old = _as(olds, "a", *_KIND, "place")
    seen = _as(dets.where(F.col("class_name").isin("figure", "table") & ((F.col("confidence") >= VISUAL) | F.col("forced"))), "b", *_PAGE, F.col("class_name").alias("kind"), "det", "confidence", "forced", "manual")
    tables = _as(olds.where("kind = 'table'"), "a", "doc", "page")
    copy = f"kind = 'figure' and not forced and {g.overlap('b', 'a')} > 0.9 and {g.iou('b', 'a')} > 0.7"
    seen = placed(within(seen, tables, how="left_anti", condition=copy), _PAGE, "visuals")
    # 1. old regions: what matches them, and what would be left out
    met = within(old, seen, "kind", condition=f"{g.iou('a', 'b')} > 0.25 or {g.overlap('b', 'a')} > 0.75")
    key = [*_KIND, "place"]
    union = met.groupBy(*key, "ax0", "ay0", "ax1", "ay1").agg(F.min("bx0").alias("ux0"), F.min("by0").alias("uy0"), F.max("bx1").alias("ux1"), F.max("by1").alias("uy1"), F.max("manual").alias("manual"), F.collect_set("det").alias("dets"))
    prose = _as(dets.where((F.col("class_name") == "plain text") & (F.col("confidence") > PROSE)), "p", *_PAGE)
    outside = within(union, prose, condition=f"{g.overlap('p', 'a')} > 0.6 and {g.overlap('p', 'u')} < 0.3").groupBy(*key).agg(F.count("*").alias("prose"))
    judged = within(within(olds, union.drop("ax0", "ay0", "ax1", "ay1"), "kind", "place", how="left"), outside, "kind", "place", how="left").withColumn("prose", F.coalesce("prose", F.lit(0)))
    ratio = (F.expr(g.area("")) / F.greatest(F.lit(1.0), F.expr(g.area("u")))).alias("ratio")
    outcome = F.when(F.col("dets").isNull(), "pdffigures2_only").when(F.col("manual"), "manually_verified_layout_bounds").when(F.col("ratio").between(0.65, 1.5) & (F.col("prose") == 0), "pdffigures2+layout_agreement").otherwise("prefer_layout_bounds")
    judged = placed(judged.withColumn("ratio", ratio).withColumn("source", outcome), _PAGE, "judged")
    reason = F.when(F.col("source") == "pdffigures2_only", "caption_only_detection").when(F.col("source") == "prefer_layout_bounds", "prefer_layout_bounds")
    warnings = judged.where(reason.isNotNull()).select(*_KIND, "name", reason.alias("reason"), F.when(reason == "prefer_layout_bounds", F.col("ratio")).alias("ratio"), F.when(reason == "prefer_layout_bounds", F.col("prose")).alias("outside_prose"))
    bounds = {c: F.when(F.col("source") == "manually_verified_layout_bounds", F.col(f"u{c}")).otherwise(F.col(c)).alias(c) for c in _BOX}
    cap_box = ["cx0", "cy0", "cx1", "cy1"]
    kept = judged.where("source <> 'prefer_layout_bounds'").select(*_KIND, F.lit(0).alias("turn"), F.col("place").cast("bigint").alias("place"), "name", *bounds.values(), *cap_box, "caption", "source")
    # 2. detections that no kept region used become regions of their own, with their nearest caption
    used = judged.where("source <> 'prefer_layout_bounds' and dets is not null").select(*_KIND, F.explode("dets").alias("det"))
    free = within(seen, used, "kind", "det", how="left_anti")
    near = within(free, caps, "kind", condition=f"{g.distance('b', 'c', 'kind')} < 160").withColumn("dist", F.expr(g.distance("b", "c", "kind")))
    best = near.groupBy(*_KIND, "det").agg(F.min(F.struct("dist", "cdet", *cap_box, "caption")).alias("c"))
    own = within(free, best, "kind", "det", how="left").withColumn("caption", F.coalesce("c.caption", F.lit("")))
    added = own.select(*_KIND, F.lit(1).alias("turn"), F.col("det").cast("bigint").alias("place"), caption_name(F.col("caption")).alias("name"), *[F.col(f"b{c}").alias(c) for c in _BOX], *[F.col(f"c.{c}").alias(c) for c in cap_box], "caption", F.lit("layout_detector").alias("source"))
    # 3. panels of one caption are one region
    every = kept.unionByName(added).repartition(buckets_of(kept.sparkSession), *_PAGE)
    alone = (F.col("name") == "unnumbered") | F.col("cy0").isNull()
    slot = F.when(alone, F.concat_ws("/", "turn", "place")).otherwise(F.concat(F.lit("#"), F.bround(F.col("cy0") / 4, 0).cast("bigint").cast("string")))
    first = F.min(F.struct("turn", "place", *cap_box, "caption")).alias("f")
    sources = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "place", "source"))), lambda s: s["source"]), "+")
    merged = every.groupBy(*_KIND, "name", slot.alias("slot")).agg(first, F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), sources.alias("source"))
    merged = placed(merged.select(*_KIND, "name", F.struct("f.turn", "f.place").alias("rank"), *_BOX, *[F.col(f"f.{c}").alias(c) for c in cap_box], "f.caption", "source"), _PAGE, "merged")
    # 4. captions without a region: each in turn takes the nearest region, if that is near and has no number yet
    adopted, missing = adoption(merged, caps)
    figures = within(merged, adopted, "kind", "rank", how="left")
    taken = F.col("n.cname").isNotNull()
    put = lambda c, new: F.when(taken, F.col(new)).otherwise(F.col(c)).alias(c)
    figures = figures.select(*_KIND, "rank", put("name", "n.cname"), *_BOX, *[put(c, f"n.{c}") for c in cap_box], put("caption", "n.caption"), "source")
    return {"figures": figures, "missing": missing, "warnings": warnings, "violations": lost}


def adoption(figures: DataFrame, caps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rank of each region that a caption takes, with the caption `n`; captions that stay without a region)."""
    fig = _as(figures, "a", *_KIND, "rank", F.col("name").alias("aname"), *[F.col(f"c{c}").alias(f"k{c}") for c in _BOX])
    same = f"aname = cname and kx0 is not null and ({g.iou('k', 'c')} > {SAME_IOU} or abs(ky0 - cy0) < {SAME_Y})"
    pairs = within(caps, fig, "kind", how="left").withColumn("dist", F.when(F.col("aname").isNotNull(), F.expr(g.distance("a", "c", "kind"))))
    one = pairs.groupBy(*_KIND, "cdet", "cname", "cx0", "cy0", "cx1", "cy1", "caption").agg(F.max(F.coalesce(F.expr(same), F.lit(False))).alias("has"), F.min(F.when(F.col("dist").isNotNull(), F.struct("dist", "rank", "aname"))).alias("near"))
    open_caps = one.where("not has").withColumn("can", F.coalesce((F.col("near.dist") < ADOPT) & (F.col("near.aname") == "unnumbered"), F.lit(False)))
    cap = F.struct("cdet", "cname", "cx0", "cy0", "cx1", "cy1", "caption", F.col("near.rank").alias("rank"), "can")
    listed = open_caps.groupBy(*_KIND).agg(F.array_sort(F.collect_list(cap)).alias("caps"))

    def alike(a: Column, b: Column) -> Column:
        inner = F.greatest(F.lit(0.0), F.least(a["cx1"], b["cx1"]) - F.greatest(a["cx0"], b["cx0"])) * F.greatest(F.lit(0.0), F.least(a["cy1"], b["cy1"]) - F.greatest(a["cy0"], b["cy0"]))
        area = lambda x: F.greatest(F.lit(0.0), x["cx1"] - x["cx0"]) * F.greatest(F.lit(0.0), x["cy1"] - x["cy0"])
        return (a["cname"] == b["cname"]) & ((inner / F.greatest(F.lit(0.01), area(a) + area(b) - inner) > SAME_IOU) | (F.abs(a["cy0"] - b["cy0"]) < SAME_Y))

    def step(state: Column, c: Column) -> Column:
        told = F.exists(state, lambda s: s["took"] & alike(s["c"], c))
        takes = c["can"] & ~F.exists(state, lambda s: s["took"] & (s["c"]["rank"] == c["rank"]))
        return F.concat(state, F.array(F.struct(c.alias("c"), (~told & takes).alias("took"), (~told & ~takes).alias("lost"))))

    kind = listed.schema["caps"].dataType.elementType.simpleString()
    done = listed.select(*_KIND, F.aggregate("caps", F.array().cast(f"array<struct<c:{kind},took:boolean,lost:boolean>>"), step).alias("s")).select(*_KIND, F.explode("s").alias("s"))
    done = placed(done.where("s.took or s.lost"), _PAGE, "adoption")
    adopted = done.where("s.took").select(*_KIND, F.col("s.c.rank").alias("rank"), F.col("s.c").alias("n"))
    return adopted, done.where("s.lost").select(*_KIND, F.col("s.c.cname").alias("name"), *[F.col(f"s.c.c{c}").alias(c) for c in _BOX], F.col("s.c.caption").alias("text"))


def _overlap_of(f: Column, c: Column) -> Column:
    inner = F.greatest(F.lit(0.0), F.least(f["x1"], c["ox1"]) - F.greatest(f["x0"], c["ox0"])) * F.greatest(F.lit(0.0), F.least(f["y1"], c["oy1"]) - F.greatest(f["y0"], c["oy0"]))
    area = F.greatest(F.lit(0.0), f["x1"] - f["x0"]) * F.greatest(F.lit(0.0), f["y1"] - f["y0"]) + F.greatest(F.lit(0.0), c["ox1"] - c["ox0"]) * F.greatest(F.lit(0.0), c["oy1"] - c["oy0"])
    return inner / F.greatest(F.lit(0.01), area - inner)


def corrected(figures: DataFrame, missing: DataFrame, corrections: DataFrame) -> dict[str, DataFrame]:
    """figures, missing and violations after corrections (doc, place, page, kind, name, decision, box, old box ox0 .., caption box,
    caption), applied to each document in the order of place: `relabel` replaces the region of its page and kind that overlaps
    the old box most (.45 of their union at least, else a violation and no change), `add` appends one, others do nothing.
    Both take the caption of their page, kind and name off the missing ones. A correction touches its page and kind alone, so these
    are folded one by one; `place` of the figures counts a document's figures in the order of pages, then what was added."""
    fields = [f.split(":")[0] for f in FIGURE.removeprefix("struct<").rstrip(">").split(",")]
    figure = F.struct(*[F.col(c).cast("bigint") if c == "page" else F.col(c) for c in fields]).cast(FIGURE).alias("f")
    change = F.struct("place", F.col("page").cast("bigint").alias("page"), "kind", "name", "decision", *_BOX, *[f"o{c}" for c in _BOX], *[f"c{c}" for c in _BOX], "caption")
    place = F.lit(None).cast(corrections.schema["place"].dataType).alias("at")
    rows = figures.select(*_KIND, F.struct(F.struct(F.col("page").cast("bigint").alias("page"), "y0", "x0", "kind", "rank").alias("o"), place, figure).alias("fig"))
    both = rows.unionByName(corrections.select(*_KIND, change.alias("change")), allowMissingColumns=True).repartition(buckets_of(figures.sparkSession), *_PAGE)
    lists = both.groupBy(*_KIND).agg(F.array_sort(F.collect_list("fig")).alias("figs"), F.array_sort(F.collect_list("change")).alias("changes"))
    entry = rows.schema["fig"].dataType
    none = F.lit(None).cast(entry["o"].dataType).alias("o")

    def step(state: Column, c: Column) -> Column:
        new = F.struct(c["page"].alias("page"), c["kind"].alias("kind"), c["name"].alias("name"), *[c[b].alias(b) for b in _BOX], *[c[f"c{b}"].alias(f"c{b}") for b in _BOX], c["caption"].alias("caption"), F.lit("visually_verified_caption_resolution").alias("source")).cast(FIGURE)
        score = lambda e, i: F.struct(F.when((e["f"]["page"] == c["page"]) & (e["f"]["kind"] == c["kind"]), _overlap_of(e["f"], c)).otherwise(-1.0).alias("iou"), (-i).alias("at"))
        best = F.when(c["decision"] == "relabel", F.array_max(F.transform(state["figs"], score)))

        def applied(b: Column) -> Column:
            found = F.coalesce(b["iou"] >= CORRECTION, F.lit(False))
            relabelled = F.transform(state["figs"], lambda e, i: F.when(i == -b["at"], F.struct(e["o"].alias("o"), e["at"].alias("at"), new.alias("f"))).otherwise(e))
            added = F.concat(state["figs"], F.array(F.struct(none, c["place"].alias("at"), new.alias("f"))))
            figs = F.when((c["decision"] == "relabel") & found, relabelled).when(c["decision"] == "add", added).otherwise(state["figs"])
            failed = F.when((c["decision"] == "relabel") & ~found, F.concat(state["failed"], F.array(c["place"].cast("bigint")))).otherwise(state["failed"])
            return F.struct(figs.alias("figs"), failed.alias("failed"))

        # an array of one: the best region is looked for once, not once for each region that it is compared with
        return F.element_at(F.transform(F.array(best), applied), 1)

    start = F.struct(F.col("figs"), F.array().cast("array<bigint>").alias("failed")).cast(f"struct<figs:array<{entry.simpleString()}>,failed:array<bigint>>")
    folded = lists.select(*_KIND, "changes", F.aggregate("changes", start, step).alias("s"))
    good = F.filter("changes", lambda c: c["decision"].isin("relabel", "add") & ~F.array_contains(F.col("s.failed"), c["place"].cast("bigint")))
    done = placed(folded.select(*_KIND, "s.figs", "s.failed", F.array_distinct(F.transform(good, lambda c: c["name"])).alias("good")), _PAGE, "corrected")
    failed = done.select("doc", F.explode("failed").alias("place"), F.lit("no region for a verified correction").alias("violation"))
    left = within(missing, done.select(*_KIND, F.explode("good").alias("name")), "kind", "name", how="left_anti")
    order = Window.partitionBy("doc").orderBy(F.asc_nulls_last("e.o"), "e.at", *[f"e.f.{c}" for c in fields])
    new = done.select("doc", F.explode("figs").alias("e")).select("doc", (F.row_number().over(order) - 1).alias("place"), "e.f.*")
    return {"figures": new, "missing": left, "violations": failed}


def status(docs: DataFrame, figures: DataFrame, missing: DataFrame) -> DataFrame:
    """Per document of docs: counts by kind, missing captions and whether it is `ok` or `partial`."""
    counts = figures.groupBy("doc").agg(F.count_if(F.col("kind") == "figure").alias("figures"), F.count_if(F.col("kind") == "table").alias("tables"))
    lost = missing.groupBy("doc").agg(F.count("*").alias("missing"))
    out = docs.select("doc").distinct().join(counts, "doc", "left").join(lost, "doc", "left").fillna(0, ["figures", "tables", "missing"])
    return out.withColumn("status", F.when(F.col("missing") > 0, "partial").otherwise("ok"))


def given(spark, d) -> dict[str, DataFrame]:
    """The tables of `fuse` and `corrected` from the boxes of line items: three pages a document; captions are lines of text too."""
    every = region_rows(spark, d).withColumn("doc", F.floor(F.col("page") / 3).cast("bigint")).repartition(buckets_of(spark), *_PAGE)
    # one sort of a page's rows numbers them and tells repeated ones: only the first of equal rows has its row number as rank
    order = Window.partitionBy(*_PAGE).orderBy("role", "label", "name", *_BOX, "confidence", "forced", "size", "len", "rotation")
    every = every.withColumns({"place": F.dense_rank().over(order) - 1, "__rank": F.rank().over(order), "__row": F.row_number().over(order)})
    every = placed(every.where("__rank = __row").drop("__rank", "__row"), _PAGE, "given_boxes")
    role, kind, text = F.col("role"), F.col("kind"), F.col("len") > 200
    old = every.where(role == "old").withColumn("cy0", F.when(F.col("len") % 3 != 0, F.col("y1") + 4))
    caption = {"cx0": F.when(F.col("cy0").isNotNull(), F.col("x0")), "cx1": F.when(F.col("cy0").isNotNull(), F.col("x1")), "cy1": F.col("cy0") + 10}
    regions = old.withColumns(caption).select(*_PAGE, "place", F.col("label").alias("kind"), "name", *_BOX, "cx0", "cy0", "cx1", "cy1", F.concat(F.lit("caption "), "name").alias("caption"))
    name = F.when(role == "det", kind).when(text, "plain text").otherwise(F.concat(kind, F.lit("_caption")))
    flat = {"y1": F.when((role == "cap") & ~text, F.col("y0") + 12).otherwise(F.col("y1"))}
    dets = every.where(role != "old").withColumns(flat)
    detections = dets.select(*_PAGE, F.col("place").alias("det"), name.alias("class_name"), F.round(F.col("confidence") * 1.5, 2).alias("confidence"), *_BOX)
    lines = dets.where((role == "cap") & ~text).select(*_PAGE, "place", F.concat(F.when(kind == "table", "Table ").otherwise("Figure "), F.when(F.col("name") == "unnumbered", "of all").otherwise(F.col("name")), F.lit(": text")).alias("text"), *_BOX)
    seen = dets.where(role == "det")
    say = lambda df, decision, replacement, box: df.select(*_PAGE, F.col("place").alias("det"), decision.alias("decision"), replacement.alias("replacement"), *[F.when(box, F.col(c) + s).alias(c) for c, s in zip(_BOX, (5, 5, 9, 9), strict=True)])
    other = F.concat_ws(":", F.col("doc").cast("string"), F.col("page").cast("string"), (F.col("place") + 1).cast("string"))
    decisions = say(seen.where("len % 7 < 3"), F.when(F.col("len") % 7 == 0, "drop").when(F.col("len") % 7 == 1, "keep").otherwise("reclassify_table"), F.when(F.col("len") % 2 == 0, other), F.col("len") % 4 == 0)
    later = say(seen.where("len % 9 = 1"), F.lit("keep"), F.lit(None).cast("string"), F.lit(False))
    required = seen.where("len % 8 = 3").select(other.alias("key"))
    corrections = every.where("(role = 'det' and len % 5 = 0 and rotation = 90) or (role = 'old' and rotation = 0 and len % 3 = 0)").select(
        "doc", F.struct(*_PAGE, "place").alias("place"), "page", "kind", F.when(F.col("name") == "unnumbered", "9").otherwise(F.col("name")).alias("name"), F.when(F.col("len") % 4 == 0, "add").when(F.col("len") % 11 == 0, "ignore").otherwise("relabel").alias("decision"),
        *[(F.col(c) + 2).alias(c) for c in _BOX], *[F.col(c).alias(f"o{c}") for c in _BOX], *[F.col(c).alias(f"c{c}") for c in _BOX], F.lit("verified").alias("caption"),
    )
    corrections = corrections.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("place")).cast("bigint"))
    return {"regions": regions, "detections": detections, "lines": lines, "decisions": decisions, "later": later, "required": required, "corrections": corrections}


@query("fused_figures")
def fused_figures(spark, d):
    """Figures and tables of every page, fused from both sources (tested against a plain loop)."""
    made = given(spark, d)
    made.pop("corrections")
    return fuse(**made)["figures"].drop("rank")


@query("fusion_report")
def fusion_report(spark, d):
    """What fusion warns of, misses and refuses, by document."""
    made = given(spark, d)
    made.pop("corrections")
    out = fuse(**made)
    parts = [out["warnings"].select("doc", F.col("reason").alias("what")), out["missing"].select("doc", F.lit("unmatched_layout_caption").alias("what")), out["violations"].select("doc", F.lit("missing replacement").alias("what"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("doc", "what").agg(F.count("*").alias("n"))


@query("corrected_status")
def corrected_status(spark, d):
    """Documents after verified corrections: counts, missing captions, status, corrections that met no region."""
    made = given(spark, d)
    corrections = made.pop("corrections")
    out = fuse(**made)
    new = corrected(out["figures"], out["missing"], corrections)
    failed = new["violations"].groupBy("doc").agg(F.count("*").alias("failed"))
    return status(made["detections"].unionByName(made["regions"], allowMissingColumns=True), new["figures"], new["missing"]).join(failed, "doc", "left").fillna(0, ["failed"])
