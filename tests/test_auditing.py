"""The audit of packages over real files."""

import hashlib
import json
import struct

from ordina.operators import auditing


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\x08\x02\x00\x00\x00"


def test_audit_of_files(spark, tmp_path):
    image = png(30, 20)
    sha = hashlib.sha256(image).hexdigest()
    path = "figures/page_001_figure_01.png"

    def make(name, index=None, texts=None, assets=None, full="no one", files=None, drop=()):
        root = tmp_path / "p" / name
        (root / "figures").mkdir(parents=True)
        sequence = [{"type": "text", "record": 0, "page": 0}, {"type": "text", "record": 1, "page": 1}, {"type": "image", "path": path, "page": 1}, {"type": "text", "record": 2, "page": 1}]
        whole = {"package_id": name, "pages": 1, "sequence": sequence} | (index or {})
        for n, value in {"index.json": whole, "text.json": texts or [{"kind": "preamble", "text": "a\nb"}, {"kind": "page_marker", "text": "p"}, {"kind": "text", "text": "José\nthanks"}], "figures.json": assets if assets is not None else [{"path": path, "sha256": sha, "width": 30, "height": 20, "page": 1, "bbox": [10, 10, 60, 60]}]}.items():
            if n not in drop:
                (root / n).write_text(json.dumps(value, indent=1, ensure_ascii=False), encoding="utf-8")
        (root / "paper.txt").write_text(full, encoding="utf-8")
        for n, content in (files if files is not None else {path: image}).items():
            (root / n).write_bytes(content)

    make("good")
    make("no_index", drop=("index.json",))
    make("no_assets", drop=("figures.json",))
    make("named", full="thanks to josé\nNÚÑEZ of old")
    make("records", texts=[{"kind": "page_marker", "text": "by Jose Nunez"}])
    make("bytes", files={path: png(31, 20), "figures/old.png": image})
    make("gone", files={})
    make("told", index={"decision": "Reject", "pages": 2})
    make("order", index={"sequence": [{"type": "image", "path": path, "page": 2}, {"type": "text", "record": 1, "page": 1}, {"type": "text", "record": 0, "page": 1}, {"type": "text", "record": 2, "page": 1}]})
    jobs = spark.createDataFrame([(n, ["José Núñez"]) for n in ("good", "no_index", "no_assets", "named", "records", "bytes", "gone", "told", "order", "absent")], "folder string, authors array<string>")
    box = "folder string, page int, x0 double, y0 double, x1 double, y1 double"
    rasters = spark.createDataFrame([("good", 1, 9.0, 9.0, 61.0, 61.0), ("good", 1, 300.0, 300.0, 300.5, 400.0), ("told", 1, 100.0, 100.0, 160.0, 160.0), ("told", 2, 10.0, 10.0, 60.0, 60.0)], box)
    found = {}
    for r in auditing.audit_files(spark, str(tmp_path / "p"), jobs, rasters).collect():
        found.setdefault(r["folder"], set()).add(r["rule"])
    assert found == {
        "no_index": {"index"}, "absent": {"index"}, "no_assets": {"assets", "asset_paths", "unreferenced_file"}, "named": {"author_name"}, "records": {"author_name", "record_count"}, "bytes": {"checksum", "image_size", "unreferenced_file"},
        "gone": {"no_file"}, "told": {"forbidden_key", "page_markers", "uncovered_raster"}, "order": {"page_order", "record_order"},
    }
