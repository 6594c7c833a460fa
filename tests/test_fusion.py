"""Fusion and corrections against a plain loop over the same boxes."""

import copy
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ordina.operators import fusion
from ordina.sources.tables import placed

SF = "/root/testdata/sf0.001"
NAME = r"(?i)\b(?:Figure|Fig\.|Table)\s*([A-Za-z]?\.?\d+(?:[.][\d]+)?[A-Za-z]?)\s*[:.]?"
LABEL = r"(?im)^\s*(Figure|Fig\.|Table)\s*([A-Za-z]?\.?\d+(?:[.][\d]+)?[A-Za-z]?)"


def area(a):
    return max(0, a[2] - a[0]) * max(0, a[3] - a[1])


def shared(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def iou(a, b):
    return shared(a, b) / max(0.01, area(a) + area(b) - shared(a, b))


def cover(a, b):
    return shared(a, b) / max(0.001, area(a))


def away(a, b, kind):
    if max(0, min(a[2], b[2]) - max(a[0], b[0])) / max(1, min(a[2] - a[0], b[2] - b[0])) < 0.15:
        return 10000
    gap = max(0, b[1] - a[3], a[1] - b[3])
    if gap > 160:
        return 10000
    return gap + 0.03 * abs(a[0] + a[2] - b[0] - b[2]) + 12 * (a[1] > b[3] if kind == "figure" else a[3] < b[1])


def union(boxes):
    return [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]


def box_of(r, p=""):
    return None if r[f"{p}x0"] is None or r[f"{p}y0"] is None else [r[f"{p}{c}"] for c in ("x0", "y0", "x1", "y1")]


def page_loop(olds, dets, lines):
    """figures, missing, warnings of one page; olds and dets in order."""
    figures, missing, warnings, caps = [], [], [], []
    for d in dets:
        if d["name"] in ("figure_caption", "table_caption") and d["confidence"] >= 0.25:
            b = d["box"]
            text = "\n".join(t for t, x in lines if b[0] - 5 <= (x[0] + x[2]) / 2 <= b[2] + 5 and b[1] - 4 <= (x[1] + x[3]) / 2 <= b[3] + 4)
            if m := re.search(LABEL, text):
                caps.append({"kind": "table" if m[1].lower() == "table" else "figure", "name": m[2], "text": text, "box": b})
    for kind in ("figure", "table"):
        seen = [d for d in dets if d["name"] == kind and (d["confidence"] >= 0.25 or d["forced"])]
        if kind == "figure":
            tables = [o["box"] for o in olds if o["kind"] == "table"]
            seen = [d for d in seen if d["forced"] or not any(cover(d["box"], t) > 0.9 and iou(d["box"], t) > 0.7 for t in tables)]
        used, own = set(), []
        for o in (o for o in olds if o["kind"] == kind):
            met = [i for i, d in enumerate(seen) if iou(o["box"], d["box"]) > 0.25 or cover(d["box"], o["box"]) > 0.75]
            if not met:
                own.append(o | {"source": "pdffigures2_only"})
                warnings.append("caption_only_detection")
                continue
            whole = union([seen[i]["box"] for i in met])
            prose = sum(d["name"] == "plain text" and d["confidence"] > 0.65 and cover(d["box"], o["box"]) > 0.6 and cover(d["box"], whole) < 0.3 for d in dets)
            if any(seen[i]["manual"] for i in met):
                own.append(o | {"box": whole, "source": "manually_verified_layout_bounds"})
                used |= set(met)
            elif 0.65 <= area(o["box"]) / max(1, area(whole)) <= 1.5 and not prose:
                own.append(o | {"source": "pdffigures2+layout_agreement"})
                used |= set(met)
            else:
                warnings.append("prefer_layout_bounds")
        mine = [c for c in caps if c["kind"] == kind]
        for i, d in enumerate(seen):
            if i not in used:
                best = min(mine, key=lambda c: away(d["box"], c["box"], kind), default=None)
                best = best if best and away(d["box"], best["box"], kind) < 160 else None
                text = best["text"] if best else ""
                m = re.search(NAME, text)
                own.append({"kind": kind, "name": m[1] if m else "unnumbered", "box": d["box"], "cap": best["box"] if best else None, "caption": text, "source": "layout_detector"})
        groups = {}
        for k, f in enumerate(own):
            key = (f["name"], k, 0) if f["cap"] is None or f["name"] == "unnumbered" else (f["name"], round(f["cap"][1] / 4), 1)
            if key in groups:
                g = groups[key]
                g["box"], g["source"] = union([g["box"], f["box"]]), g["source"] + "+" + f["source"]
            else:
                groups[key] = dict(f)
        own = list(groups.values())
        for c in mine:
            if not any(f["name"] == c["name"] and f["cap"] and (iou(f["cap"], c["box"]) > 0.1 or abs(f["cap"][1] - c["box"][1]) < 30) for f in own):
                near = min(own, key=lambda f: away(f["box"], c["box"], kind), default=None)
                if near and away(near["box"], c["box"], kind) < 35 and near["name"] == "unnumbered":
                    near.update(name=c["name"], caption=c["text"], cap=c["box"])
                else:
                    missing.append((kind, c["name"], *c["box"], c["text"]))
        figures += own
    return figures, missing, warnings


def shown(f, page):
    return (page, f["kind"], f["name"], *f["box"], *(f["cap"] or [None] * 4), f["caption"], f["source"])


@pytest.fixture(scope="module")
def made(spark):
    tables = {n: t.cache() for n, t in fusion.given(spark, SF).items()}
    rows = {n: [r.asDict(True) for r in t.collect()] for n, t in tables.items()}
    key = lambda r: f"{r['doc']}:{r['page']}:{r['det']}"
    said = {key(r): r for r in rows["decisions"]} | {key(r): r for r in rows["later"]}
    needed = {r["key"] for r in rows["required"]}
    dets, lost = defaultdict(list), set()
    for r in sorted(rows["detections"], key=lambda r: r["det"]):
        s = said.get(key(r), {})
        if s.get("decision") == "drop":
            other = s["replacement"]
            if other and other not in needed and said.get(other, {}).get("decision") != "keep":
                lost.add(key(r))
            continue
        new = box_of(s) if s else None
        dets[r["doc"], r["page"]].append({"name": "table" if s.get("decision") == "reclassify_table" else r["class_name"], "confidence": r["confidence"], "box": new or box_of(r), "manual": bool(new), "forced": s.get("decision") in ("keep", "reclassify_table") or key(r) in needed})
    olds, lines = defaultdict(list), defaultdict(list)
    for r in sorted(rows["regions"], key=lambda r: r["place"]):
        olds[r["doc"], r["page"]].append({"kind": "table" if r["kind"].lower() == "table" else "figure", "name": r["name"], "box": box_of(r), "cap": box_of(r, "c"), "caption": r["caption"]})
    for r in sorted(rows["lines"], key=lambda r: r["place"]):
        lines[r["doc"], r["page"]].append((r["text"], box_of(r)))
    pages = {p: page_loop(olds[p], dets[p], lines[p]) for p in {*dets, *olds}}
    corrections = tables.pop("corrections")
    yield fusion.fuse(**tables), corrections, pages, lost, rows["corrections"]
    spark.catalog.clearCache()


def test_fusion_equals_a_plain_loop(made):
    out, _, pages, lost, _ = made
    got, want = defaultdict(Counter), {p: Counter(shown(f, p[1]) for f in v[0]) for p, v in pages.items()}
    for r in out["figures"].collect():
        got[r.doc, r.page][(r.page, r.kind, r.name, r.x0, r.y0, r.x1, r.y1, r.cx0, r.cy0, r.cx1, r.cy1, r.caption, r.source)] += 1
    for p in pages:
        assert got[p] == want[p], p
    assert Counter((r.doc, r.page, r.kind, r.name, r.cx0 if "cx0" in r else r.x0, r.y0, r.x1, r.y1, r.text) for r in out["missing"].collect()) == Counter((*p, *m) for p, v in pages.items() for m in v[1])
    assert Counter((r.doc, r.page, r.reason) for r in out["warnings"].collect()) == Counter((*p, w) for p, v in pages.items() for w in v[2])
    assert {f"{r.doc}:{r.page}:{r.det}" for r in out["violations"].collect()} == lost
    sources = Counter(s for v in pages.values() for f in v[0] for s in f["source"].split("+"))
    assert len(sources) >= 4 and any(v[1] for v in pages.values())


def test_corrections_equal_a_plain_loop(made):
    out, corrections, pages, _, changes = made
    figures, missing, failed = defaultdict(list), defaultdict(list), set()
    for p in sorted(pages):
        figures[p[0]] += [dict(copy.deepcopy(f), page=p[1]) for f in pages[p][0]]
        missing[p[0]] += [(p[1], *m) for m in pages[p][1]]
    rank = {(r.doc, r.page, r.kind, r.x0, r.y0, r.x1, r.y1, r.name, r.source): r["rank"] for r in out["figures"].collect()}
    for d, own in figures.items():
        own.sort(key=lambda f: (f["page"], f["box"][1], f["box"][0], f["kind"], rank[d, f["page"], f["kind"], *f["box"], f["name"], f["source"]]))
    for c in sorted(changes, key=lambda c: (c["doc"], c["place"])):
        own = figures[c["doc"]]
        new = {"page": c["page"], "kind": c["kind"], "name": c["name"], "box": box_of(c), "cap": box_of(c, "c"), "caption": c["caption"], "source": "visually_verified_caption_resolution"}
        if c["decision"] == "relabel":
            near = max((f for f in own if f["page"] == c["page"] and f["kind"] == c["kind"]), key=lambda f: iou(f["box"], box_of(c, "o")), default=None)
            if not near or iou(near["box"], box_of(c, "o")) < 0.45:
                failed.add((c["doc"], c["place"]))
                continue
            near.update(new)
        elif c["decision"] == "add":
            own.append(new)
        else:
            continue
        missing[c["doc"]] = [m for m in missing[c["doc"]] if m[:3] != (c["page"], c["kind"], c["name"])]
    new = fusion.corrected(out["figures"], out["missing"], corrections)
    got = defaultdict(list)
    for r in new["figures"].orderBy("doc", "place").collect():
        got[r.doc].append((r.page, r.kind, r.name, r.x0, r.y0, r.x1, r.y1, r.cx0, r.cy0, r.cx1, r.cy1, r.caption, r.source))
    for d, own in figures.items():
        assert got[d] == [shown(f, f["page"]) for f in own], d
    assert {(r.doc, r.place) for r in new["violations"].collect()} == failed and failed
    assert Counter((r.doc, r.page, r.kind, r.name) for r in new["missing"].collect()) == Counter((d, *m[:3]) for d, v in missing.items() for m in v)
    state = {r.doc: r for r in fusion.status(out["figures"].select("doc"), new["figures"], new["missing"]).collect()}
    for d, r in state.items():
        assert (r.figures, r.tables, r.missing, r.status) == (sum(f["kind"] == "figure" for f in figures[d]), sum(f["kind"] == "table" for f in figures[d]), len(missing[d]), "partial" if missing[d] else "ok")


def test_a_region_is_taken_once(spark):
    fig = spark.createDataFrame([Row(doc=1, page=1, kind="figure", name="unnumbered", rank=(0, 0), x0=0.0, y0=0.0, x1=100.0, y1=50.0, cx0=None, cy0=None, cx1=None, cy1=None)], "doc bigint, page bigint, kind string, name string, rank struct<turn:int,place:bigint>, x0 double, y0 double, x1 double, y1 double, cx0 double, cy0 double, cx1 double, cy1 double")
    cap = lambda det, name, y: Row(doc=1, page=1, kind="figure", cdet=det, cname=name, cx0=0.0, cy0=y, cx1=100.0, cy1=y + 8, caption=f"Figure {name}: x")
    caps = spark.createDataFrame([cap(5, "1", 55.0), cap(6, "2", 52.0), cap(7, "1", 60.0)], "doc bigint, page bigint, kind string, cdet int, cname string, cx0 double, cy0 double, cx1 double, cy1 double, caption string")
    adopted, missing = fusion.adoption(fig, caps)
    assert [r.n.cname for r in adopted.collect()] == ["1"]  # the first in order, though the second is nearer
    assert [r.name for r in missing.collect()] == ["2"]  # the third is the same figure's caption


def test_rows_stay_at_their_page(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(200).selectExpr("id div 40 as doc", "id div 4 as page", "if(id % 3 = 0, 'table', 'figure') as kind", "id as det", "id % 7 as v")
        a, b = placed(rows, ["doc", "page"], "left"), placed(rows.withColumnRenamed("v", "w"), ["doc", "page"], "right")
        one = fusion.within(a, b, "kind", "det", how="left").groupBy("doc", "page", "kind").agg(F.sum(F.col("v") - F.col("w")).alias("d"), F.count("w").alias("n"))
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
        assert one.agg(F.sum("n"), F.max("d"), F.min("d")).first() == (200, 0, 0)
        assert fusion.within(a, b.where("kind = 'table'"), "kind", how="left_anti").where("kind = 'table'").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_a_correction_sees_those_before_it(spark):
    """Of one page: the first moves a region, so the second finds none where it was, and the third finds what the second page's did not touch."""
    at = lambda p, x: dict(zip([f"{p}{c}" for c in ("x0", "y0", "x1", "y1")], (x, 0.0, x + 10.0, 10.0), strict=True))
    box = lambda p: ", ".join(f"{p}{c} double" for c in ("x0", "y0", "x1", "y1"))
    fig = lambda page, x: Row(doc=1, page=page, kind="figure", name=f"{page}", rank=(0, 0), **at("", x), **at("c", x), caption="a", source="s")
    figures = spark.createDataFrame([fig(1, 0.0), fig(2, 0.0)], f"doc bigint, page bigint, kind string, name string, rank struct<turn:int,place:bigint>, {box('')}, {box('c')}, caption string, source string")
    change = lambda place, page, decision, old, new: Row(doc=1, place=place, page=page, kind="figure", name=f"n{place}", decision=decision, **at("", new), **at("o", old), **at("c", new), caption="c")
    changes = [change(1, 1, "relabel", 0.0, 100.0), change(2, 1, "relabel", 0.0, 200.0), change(3, 1, "add", 0.0, 300.0), change(4, 1, "relabel", 300.0, 400.0), change(5, 2, "relabel", 0.0, 500.0)]
    corrections = spark.createDataFrame(changes, f"doc bigint, place bigint, page bigint, kind string, name string, decision string, {box('')}, {box('o')}, {box('c')}, caption string")
    missing = spark.createDataFrame([(1, 1, "figure", "n2"), (1, 1, "figure", "n4")], "doc bigint, page bigint, kind string, name string")
    out = fusion.corrected(figures, missing, corrections)
    assert [(r.place, r.page, r.name, r.x0) for r in out["figures"].orderBy("place").collect()] == [(0, 1, "n1", 100.0), (1, 2, "n5", 500.0), (2, 1, "n4", 400.0)]
    assert [r.place for r in out["violations"].collect()] == [2]
    assert [r.name for r in out["missing"].collect()] == ["n2"]
