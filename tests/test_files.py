"""Sources and checks that read files, and functions against plain Python."""

import base64
import hashlib
import json
import posixpath
import random
import struct
import unicodedata

import pytest
from pyspark.sql import functions as F

from ordina.functions.json_schema import referred, schema_violations, violations
from ordina.operators import layout, packages, review, sequences, text
from ordina.operators.contracts import RESPONSE
from ordina.plans.ranking import ordinals
from ordina.sources import detector, papers
from ordina.streaming import sessions


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\x08\x02\x00\x00\x00"


@pytest.fixture
def package(tmp_path):
    """Two packages: one is right, the other has a fault of each kind."""

    def make(name, sequence, texts, images, schema=packages.SCHEMA_NAME):
        root = tmp_path / "packages" / name
        (root / "figures").mkdir(parents=True)
        for path, content in images.items():
            (root / path).write_bytes(content)
        (root / "text.json").write_text(json.dumps([{"id": i, "text": t} for i, t in enumerate(texts)]), encoding="utf-8")
        (root / "index.json").write_text(json.dumps({"schema": schema, "package_id": name, "pages": 1, "text_records_path": "text.json", "sequence": sequence}, indent=1))

    image = png(30, 20)
    sha = hashlib.sha256(image).hexdigest()
    part = lambda kind, **more: {"type": kind, "page": 1, **more}
    make("good", [part("text", record=0), part("text", record=1), part("image", path="figures/page_001_figure_01.png", sha256=sha), part("text", record=2)], ["first\nparagraph", "second paragraph", "third"], {"figures/page_001_figure_01.png": image})
    faults = [part("text", record=9), part("image", path="figures/a.png", sha256="0"), part("image", path="../good/text.json", sha256="0"), part("image", path="figures/none.png", sha256="0"), part("audio")]
    make("wrong", faults, ["x"], {"figures/a.png": image})
    make("old", [part("text", record=0)], ["x"], {}, "paper-text-figures/v1")
    return tmp_path / "packages", image


def test_packages_are_loaded(spark, package):
    root, image = package
    rows = packages.load_input(spark, str(root), base="jobs").orderBy("package_id", "item").collect()
    good = [(r["type"], r["text"], r["path"], r["violation"]) for r in rows if r["package_id"] == "good"]
    assert good == [("text", "first\nparagraph\n\nsecond paragraph", None, ""), ("localImage", None, "../good/figures/page_001_figure_01.png", ""), ("text", "third", None, "")]
    assert [r["violation"] for r in rows if r["package_id"] == "wrong"] == ["no record", "checksum", "unsafe path", "no image", "unknown item"]
    assert [r["violation"] for r in rows if r["package_id"] == "old"] == ["unsupported schema"]
    inline = packages.load_input(spark, str(root), "responses").where("package_id = 'good' and type = 'input_image'").first()
    assert inline["image_url"] == "data:image/png;base64," + base64.b64encode(image).decode()
    with pytest.raises(ValueError, match="unknown format"):
        packages.load_input(spark, str(root), "xml")
    assert {r["folder"] for r in rows} == {"good", "wrong", "old"} and {r["detail"] for r in rows if r["type"] == "localImage"} == {"high"}
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(str(root)).select(*packages.png_size(F.col("content"))).distinct().collect()
    assert [tuple(r) for r in sizes] == [(30, 20)]
    assert packages.file_bytes(spark, str(root)).agg(F.sum("files")).first()[0] == 8


def test_paths(spark):
    r = random.Random(1)
    steps = ["a", "b", "..", ".", "", "c.d", "..x"]
    pairs = [("/".join(r.choice(steps) for _ in range(r.randrange(1, 6))), "/".join(r.choice("abc") for _ in range(r.randrange(4)))) for _ in range(400)]
    df = spark.createDataFrame([(i, p, b) for i, (p, b) in enumerate(pairs)], "i int, p string, b string")
    own = packages.resolved(F.col("p"))
    got = df.select("i", own.alias("own"), packages.relative(own, F.col("b")).alias("rel")).orderBy("i").collect()
    for (p, b), row in zip(pairs, got, strict=True):
        up = down = 0
        for s in p.split("/"):
            down += s not in ("", ".", "..")
            if s == "..":
                down -= 1
            up = min(up, down)
        want = None if p.startswith("/") or up < 0 or posixpath.normpath(p) == "." else posixpath.normpath(p)
        assert row["own"] == want
        assert want is None or row["rel"] == posixpath.relpath("/" + want, "/" + b)


def test_uncovered_rasters(spark):
    box = "page int, x0 double, y0 double, x1 double, y1 double"
    rasters = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (1, 200.0, 0.0, 300.0, 100.0), (1, 5.0, 5.0, 5.5, 50.0), (2, 0.0, 0.0, 100.0, 100.0)], box)
    assets = spark.createDataFrame([(1, 1.0, 1.0, 99.0, 99.0), (1, 200.0, 0.0, 290.0, 100.0)], box)
    assert sorted((r["page"], r["ax0"]) for r in packages.uncovered(rasters, assets).collect()) == [(1, 200.0), (2, 0.0)]


def test_detector_files(spark, tmp_path):
    box = {"x1": 1.00005, "y1": 2, "x2": 3, "y2": 4}
    (tmp_path / "p 1.json").write_text(json.dumps([{"name": "2", "figType": "TABLE", "page": 0, "caption": "c", "regionBoundary": box}, {"figType": "Figure", "page": 4, "regionBoundary": box, "captionBoundary": box, "more": 1}]))
    (tmp_path / "none.json").write_text("[]")
    rows = detector.detections(spark, str(tmp_path / "*.json")).orderBy("page").collect()
    assert [(r["key"], r["page"], r["kind"], r["name"], r["bbox"], r["caption_bbox"]) for r in rows] == [("p 1", 1, "table", "2", [1.0, 2.0, 3.0, 4.0], None), ("p 1", 5, "figure", "unnumbered", [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0])]
    keys = spark.createDataFrame([("p 1",), ("none",), ("lost",)], "key string")
    out = detector.detections(spark, str(tmp_path / "*.json"), keys).collect()
    assert sorted((r["key"], r["page"], r["warning"]) for r in out if r["key"] != "p 1") == [("lost", None, "output_missing"), ("none", None, None)] and len(out) == 4


LINES = [
    {"method": "item/started", "params": {"item": {"id": "u", "type": "userMessage", "content": [{"type": "text", "text": "hi"}]}}},
    {"method": "item/reasoning/delta", "params": {}},
    {"method": "error", "params": {"error": {"message": "x"}, "willRetry": True}},
    {"method": "thread/tokenUsage/updated", "params": {"tokenUsage": {"total": 7}}},
    {"method": "item/completed", "params": {"item": {"id": "a", "type": "agentMessage", "phase": "final_answer", "text": "{}"}}},
    {"method": "turn/completed", "params": {"turn": {"status": "completed"}}},
]


def folded(spark, lines, **more):
    rows = [("s", i, line if isinstance(line, str) else json.dumps(line)) for i, line in enumerate(lines)]
    return review.folded(review.parsed(spark.createDataFrame(rows, "session string, seq bigint, line string")), **more).first()


@pytest.mark.parametrize(
    ("change", "status", "violations", "errors"),
    [
        ([], "completed", 0, 0), (["not json"], "completed", 0, 0), ([{"method": "error", "params": {}}], "failed", 0, 1), ([{"method": "error", "params": {"willRetry": "true"}}], "failed", 0, 1),
        ([{"method": "item/started", "params": {"item": {"id": "t", "type": "commandExecution"}}}, {"method": "item/completed", "params": {"item": {"id": "t", "type": "commandExecution"}}}], "quarantined", 1, 0),
        ([{"method": "item/webSearch/progress", "params": {"itemId": "w"}}], "quarantined", 1, 0), ([{"id": "9", "method": "item/tool/call", "params": {}}], "quarantined", 1, 1),
        ([{"method": "turn/completed", "params": {"turn": {"status": "completed", "error": {"message": "m"}}}}], "failed", 0, 1), ([{"method": "turn/completed", "params": {"turn": {"status": "interrupted"}}}], "failed", 0, 0),
    ],
)
def test_session_status(spark, change, status, violations, errors):
    row = folded(spark, [*LINES, *change])
    assert (row["status"], row["violations"], row["errors"], row["warnings"], row["usage"], row["final"]) == (status, violations, errors, 1, 7, "{}")


def test_echo_must_be_what_was_sent(spark):
    sent = f"text:2:{hashlib.sha256(b'hi').hexdigest()}"
    assert folded(spark, LINES, sent=F.lit(sent))["status"] == "completed"
    assert folded(spark, LINES, sent=F.lit("text:2:0"))["status"] == "failed" and folded(spark, LINES[1:])["status"] == "failed"


def test_event_files(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(LINES[0]), "panic!", '{"method": 5', json.dumps(LINES[5])]))
    rows = review.event_lines(spark, str(tmp_path / "log.jsonl")).orderBy("seq").collect()
    assert [r["method"] for r in rows] == ["item/started", review.NOT_JSON, review.NOT_JSON, "turn/completed"]


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    path, files, place = sessions.event_files(spark, sf), tmp_path / "seen", str(tmp_path / "state")
    files.mkdir()
    import shutil
    from pathlib import Path

    source = sorted(Path(path).glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    assert len(source) == sessions.FILES + 1
    run = lambda: sessions.drained(sessions.fold_stream(sessions.event_stream(spark, sf, str(files))), "update", "fold", place)
    for k, part in enumerate((source[:2], source[2:])):
        for f in part:
            shutil.copy(f, files / f"{k}-{f.name}")
        changes = run()
    assert changes.select("batch").distinct().count() > 2
    want = {tuple(r) for r in sessions.last_states(sessions.drained(sessions.fold_stream(sessions.event_stream(spark, sf)), "update", "whole")).collect()}
    assert {tuple(r) for r in sessions.last_states(changes).collect()} == want


def test_table_text():
    lines = [(0.0, 0.0, 20.0, 10.0, 10.0, "Name"), (84.0, 1.0, 99.0, 11.0, 10.0, "Value"), (0.0, 20.0, 30.0, 30.0, 10.0, "a very long cell indeed"), (84.0, 22.9, 99.0, 32.9, 10.0, "7"), (0.0, 40.0, 9.0, 50.0, 10.0, "b")]
    assert sequences.table_text(lines) == "Name                Value\na very long cell indeed  7\nb"


def test_laid_out(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 10.0, 10.0, "a"), (1, 42.0, 0.0, 60.0, 10.0, 10.0, "b")], "page int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    assert sequences.laid_out(rows, ["page"]).first()["layout"] == "a         b"


def test_laid_out_in_one_pass(spark):
    """Tables stream through batches smaller than they are: no call of Python for each table."""
    cells = [(p, c % 2 * 42.0, c // 2 * 20.0, c % 2 * 42.0 + 9, c // 2 * 20.0 + 10, 10.0, f"{p}.{c}") for p in (3, None, 1, 2) for c in range(6)]
    rows = spark.createDataFrame(cells[::-1], "page int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        out = sequences.laid_out(rows, ["page"])
        assert "MapInArrow" in out._jdf.queryExecution().toString() and "GroupMap" not in out._jdf.queryExecution().toString() and "InGroup" not in out._jdf.queryExecution().toString()
        got = {r["page"]: r["layout"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == {p: sequences.table_text([c[1:] for c in cells if c[0] == p]) for p in (1, 2, 3, None)}


def test_compiled_schemas_agree_with_the_plain_check(spark):
    r = random.Random(1)

    def value(depth=0):
        k = r.randrange(9) if depth < 3 else r.randrange(6)
        if k < 6:
            return [None, True, r.randrange(-2, 12), r.choice([1.0, 7.5, 0.5]), r.choice(["", "a", "xyz"]), False][k]
        return [value(depth + 1) for _ in range(r.randrange(5))] if k == 6 else {r.choice(["score", "b", "k", "summary"]): value(depth + 1) for _ in range(r.randrange(4))}

    def answer():
        own = {"score": r.choice([0, 1, 10, 11, 7.0, "7", True]), "confidence": r.randrange(7), "summary": "s", "strengths": ["a"] * r.randrange(5), "weaknesses": r.choice([["a"], ["a", 1], "x"]), "score_rationale": "r"}
        return {k: v for k, v in own.items() if r.random() < 0.95} | ({"extra": 1} if r.random() < 0.2 else {})

    texts = [json.dumps(v) for v in [*(value() for _ in range(200)), *(answer() for _ in range(150)), 10**30, 1e30]] + ["{", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    schemas = [
        RESPONSE, {"anyOf": [{"type": "integer"}, {"type": "string", "minLength": 2}]}, {"oneOf": [{"type": "integer"}, {"type": "number"}]}, {"allOf": [{"minimum": 1}, {"maximum": 3}]}, {"enum": [1, "a", None, True]}, {"const": 1},
        {"type": "object", "additionalProperties": {"type": "integer"}}, {"items": {"$ref": "#/definitions/a~1b"}, "definitions": {"a/b": {"type": ["boolean", "null"]}}}, {"exclusiveMinimum": 0, "exclusiveMaximum": 2}, {"const": [1]},
        {"$ref": "#/$defs/tree", "$defs": {"tree": {"type": ["object", "integer"], "additionalProperties": {"$ref": "#/$defs/tree"}}}},
    ]
    for schema in schemas:
        got = [r["v"] for r in df.select("i", schema_violations(F.col("t"), schema).alias("v")).orderBy("i").collect()]
        for t, found in zip(texts, got, strict=True):
            try:
                want = violations(json.loads(t), schema)
            except json.JSONDecodeError:
                want = ["$: json"]
            assert sorted(found) == sorted(want), (schema, t)


def test_references():
    root = {"$defs": {"a~b": 1, "x": [{"y": 2}]}}
    assert referred("#/$defs/a~0b", root) == 1 and referred("#/$defs/x/0/y", root) == 2 and referred("#", root) is root
    for bad in ("http://x", "#/$defs/none", "#/$defs/x/7"):
        with pytest.raises(ValueError, match="#|local"):
            referred(bad, root)


def test_normal_forms(spark):
    r = random.Random(2)
    alphabet = "aZéÉñßﬁ①Åﾊ한각‐–—’­́ǅİ゛½"
    values = ["".join(r.choice(alphabet) for _ in range(r.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    got = [r["n"] for r in df.select("i", text.normalized(F.col("t")).alias("n")).orderBy("i").collect()]
    for v, n in zip(values, got, strict=True):
        plain = v.translate(str.maketrans({"‐": "-", "‑": "-", "–": "-", "—": "-", "’": "'", "­": None}))
        want = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
        assert n.lower() == want.lower()


def test_ordinals_of_large_ids(spark):
    ids = [2**53 + i for i in range(200)]
    rows = ordinals(spark.createDataFrame([(i,) for i in random.Random(3).sample(ids, 200)], "k bigint"), "k", "n", 0).collect()
    assert all(r["n"] == r["k"] - 2**53 for r in rows)


def test_packages_fail_closed(spark, tmp_path):
    """Each fault gives a row that says so; no package vanishes."""
    image = png(3, 2)
    index = {"schema": packages.SCHEMA_NAME, "package_id": "x", "text_records_path": "text.json", "sequence": [{"type": "text", "record": 0}, {"type": "image", "path": "a.png", "sha256": hashlib.sha256(image).hexdigest()}]}
    without = lambda name: {k: v for k, v in index.items() if k != name}
    cases = {
        "whole": (json.dumps(index, indent=1), [{"text": "line one\nline two"}]), "no_index": (None, []), "broken": ("{oops", []), "twice": (json.dumps(index) + "{}", []), "no_schema": (json.dumps(without("schema")), []), "no_sequence": (json.dumps(without("sequence")), []),
        "odd_sequence": (json.dumps(index | {"sequence": "text"}), []), "no_sum": (json.dumps(index | {"sequence": [{"type": "image", "path": "a.png"}]}), []), "no_type": (json.dumps(index | {"sequence": [{"record": 0}]}), [{"text": "t"}]), "nothing": (json.dumps(index | {"sequence": []}), []),
    }
    for name, (value, texts) in cases.items():
        (tmp_path / "p" / name).mkdir(parents=True)
        (tmp_path / "p" / name / "a.png").write_bytes(image)
        (tmp_path / "p" / name / "text.json").write_text(json.dumps(texts, indent=1))
        if value is not None:
            (tmp_path / "p" / name / "index.json").write_text(value)
    found = {}
    for r in packages.load_input(spark, str(tmp_path / "p")).orderBy("folder", "item").collect():
        found.setdefault(r["folder"], []).append((r["text"], r["violation"]))
    want = {"no_index": "no index", "broken": "broken index", "twice": "broken index", "no_sequence": "no sequence", "odd_sequence": "broken index", "no_sum": "no checksum", "no_type": "unknown item", "nothing": ""}
    assert {k: {v[1] for v in found[k]} for k in want} == {k: {v} for k, v in want.items()} and set(found) == set(cases)
    assert {v for _, v in found["no_schema"]} == {"unsupported schema"}
    assert found["whole"] == [("line one\nline two", ""), (None, "")]


def test_canonical_json(spark):
    texts = ['{"b":{"y":[1,2],"x":null},"a":1}', '{ "a":1, "b":{"x":null,"y":[1,2]} }', '{"a":"1","b":{"x":null,"y":[1,2]}}', '{"a":1.0,"b":{"x":null,"y":[1,2]}}', '{"a":true}', "{oops", "NaN", None, "[" * 100_000, '"é\\n"', '{"k":1,"k":2}']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(packages.canonical("t")).collect()]
    assert got[0] == got[1] == '{"a":1,"b":{"x":null,"y":[1,2]}}' and len({*got[:5]}) == 4
    assert got[5:] == [None, None, None, None, '"é\\n"', '{"k":2}']


def test_manifest_faults(spark, tmp_path):
    def write(*rows):
        (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
        return str(tmp_path / "m.jsonl")

    with pytest.raises(ValueError, match="place"):
        papers.manifest(spark, write({"pdf_path": "a.pdf", "package_id": "paper_002"}))
    with pytest.raises(ValueError, match="pdf"):
        papers.manifest(spark, write({"pdf_path": "a.doc"}))
    with pytest.raises(ValueError, match="authors"):
        papers.manifest(spark, write({"pdf_path": "a.pdf"}), require_authors=True)
    for none in ([], ";"):  # said to have none, which is an answer
        assert papers.manifest(spark, write({"pdf_path": "a.pdf", "authors": none}), require_authors=True).first()["authors"] == []
    with pytest.raises(ValueError, match="repeats"):
        papers.manifest(spark, write({"pdf_path": "a.pdf"}, {"paper_id": "paper_001", "pdf_path": "b.pdf"}))
    (tmp_path / "broken.jsonl").write_text('{"pdf_path": "a.pdf"}\n{oops not json\n[1]\n{"pdf_path": "a.pdf"}}\n{"paper_id": "x"}\n{"pdf_path": 3, "authors": [" "]}\n')
    told = papers.checked_manifest(spark, str(tmp_path / "broken.jsonl")).orderBy("number").collect()
    assert [r["violation"] for r in told] == [None, "no JSON", "no object", "no JSON", "no pdf_path", "no .pdf"]
    rows = papers.manifest(spark, write(*({"paper_id": f"p{i}", "pdf_path": f"{i}.pdf"} for i in range(300))))
    assert all(r["package_id"] == f"paper_{int(r['paper_id'][1:]) + 1:03d}" for r in rows.collect())
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "0.pdf").write_bytes(b"x")
    assert papers.missing_files(rows, str(tmp_path / "pdf")).count() == 299


def test_merged_decisions(spark):
    schema = "paper string, page int, det int, decision string"
    first, later = spark.createDataFrame([("p", 1, 1, "drop"), ("p", 1, 2, "keep")], schema), spark.createDataFrame([("p", 1, 1, "keep")], schema)
    items = spark.createDataFrame([("p", 1, 1), ("p", 1, 2), ("q", 1, 1)], "paper string, page int, det int")
    rows = packages.merged_decisions(items, first, later, ["paper", "page", "det"]).collect()
    assert {(r["paper"], r["det"]): r["decision"] for r in rows} == {("p", 1): "keep", ("p", 2): "keep", ("q", 1): None}


def test_full_page_figures(spark):
    boxes = spark.createDataFrame([(0.0, 0.0, 100.0, 94.0), (0.0, 0.0, 100.0, 93.0)], "x0 double, y0 double, x1 double, y1 double")
    assert layout.covering(boxes, width=100.0, height=100.0).count() == 1


def test_surrogates(spark):
    raw = [b"a\xed\xa0\xbd\xed\xb8\x80b", b"\xed\xa0\xbdx", "é".encode(), None]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    assert [r["t"] for r in df.select("i", text.repaired("b").alias("t")).orderBy("i").collect()] == ["a😀b", "�x", "é", None]


def test_manifest_rows_are_made_once(spark, tmp_path):
    from ordina.sources import papers

    (tmp_path / "m.jsonl").write_text('{"paper_id":"a","pdf_path":"a.pdf","authors":["A"]}\n')
    rows = papers.manifest(spark, str(tmp_path / "m.jsonl"))
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.first()["paper_id"] == "a"


def test_batches_of_many_events_are_many_files(spark):
    """Every batch has the same number of files, so a trigger takes whole batches and no event comes after its time has passed."""
    sf = "/root/testdata/sf0.001"
    path, files = sessions.event_batches(spark, sf, rows=50)
    seen = spark.read.parquet(path).select("event_id", "user_id", "ts", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))
    order = [f.file for f in seen.groupBy("file").agg(F.first("at").alias("at")).orderBy("at").collect()]
    assert files > 1 and len(order) == sessions.FILES * files + 1
    span = {r.file: (r.low, r.high) for r in seen.groupBy("file").agg(F.min("ts").alias("low"), F.max("ts").alias("high")).collect()}
    for k in range(files, len(order), files):
        assert max(span[f][1] for f in order[:k]) < min(span[f][0] for f in order[k:])
    n = seen.where(F.col("user_id") != sessions.END).count()
    twice = sessions.event_stream(spark, sf, path, files).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withWatermark("ts", "1 day")
    out = sessions.drained(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "session"), "append", "many_files")
    assert out.where(F.col("session") != sessions.END).count() == n == spark.read.parquet(f"{sf}/events.parquet").count()
    assert out.select("batch").distinct().count() >= sessions.FILES
