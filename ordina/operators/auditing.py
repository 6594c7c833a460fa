"""Audit of packages as they stand in files: every rule that a package breaks is a row.

Tables: indexes (folder, value: index.json), texts (folder, name, value: text.json, figures.json and the full text), images
(folder, at, sha, width, height: of every image file), jobs (folder, authors), rasters (folder, page, box: placements in the source).
Each rule reads only what it needs; rules meet in one union, and packages without a row have passed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..registry import query
from ..sources.checked import fault, parsed
from ..sources.tables import stored, table
from .packages import png_size, resolved
from .redaction import patterns
from .text import normalized

INDEX = "package_id string, pages int, sequence array<struct<type:string,path:string,record:int,page:int>>"
RECORDS = "array<struct<kind:string,text:string>>"
ASSETS = "array<struct<path:string,sha256:string,width:int,height:int,page:int,bbox:array<double>>>"
# What an index must not tell (fixed values).
FORBIDDEN = ("ratings", "reviews", "decision", "authors_original", "pdf_path", "paper_id")
#: Points by which an asset is widened, and the share of a placement that it must cover.
PAD, SHARE = 2.0, 0.94


def audit(indexes: DataFrame, texts: DataFrame, images: DataFrame, jobs: DataFrame, rasters: DataFrame) -> DataFrame:
    """folder, rule, detail of everything that is wrong with the packages of jobs."""
    name = lambda n: texts.where(F.col("name") == n).select("folder", "value")
    rule = lambda df, what, detail: df.select("folder", F.lit(what).alias("rule"), detail.cast("string").alias("detail"))
    index = jobs.select("folder").distinct().join(indexes, "folder", "left").withColumn("r", parsed(F.col("value"), INDEX)).withColumn("broken", F.when(F.col("value").isNull(), "no index").otherwise(fault(F.col("r"), F.col("value"), ["sequence"])))
    index = stored(index, "audit_index")
    good = index.where("broken is null")
    own = good.select("folder")
    records = stored(own.join(name("text.json"), "folder", "left").select("folder", F.from_json("value", RECORDS).alias("t")), "audit_records")
    assets = own.join(name("figures.json"), "folder", "left").select("folder", F.from_json("value", ASSETS).alias("a"))
    seq = good.select("folder", F.posexplode("r.sequence").alias("place", "i")).select("folder", "place", "i.*")
    one = assets.select("folder", F.explode("a").alias("a")).select("folder", "a.*").withColumn("at", resolved(F.col("path")))
    found = [rule(index.where("broken is not null"), "index", F.col("broken"))]
    found.append(rule(good.select("folder", F.explode(F.json_object_keys("value")).alias("k")).where(F.col("k").isin(*FORBIDDEN)), "forbidden_key", F.col("k")))
    found.append(rule(records.where("t is null"), "records", F.lit("no list")))
    found.append(rule(assets.where("a is null"), "assets", F.lit("no list")))
    # text items name every record once, in order
    w = Window.partitionBy("folder").orderBy("place")
    order = seq.where("type = 'text'").withColumn("n", F.row_number().over(w) - 1)
    count = order.groupBy("folder").agg(F.count("*").alias("n"))
    found.append(rule(order.where("record is null or record <> n"), "record_order", F.col("record")))
    found.append(rule(records.where("t is not null").join(count, "folder", "left").where(F.size("t") != F.coalesce("n", F.lit(0))), "record_count", F.size("t")))
    found.append(rule(seq.withColumn("last", F.lag("page").over(w)).where("page is null or page < last"), "page_order", F.col("page")))
    markers = records.where("t is not null").select("folder", F.size(F.filter("t", lambda t: t["kind"] == "page_marker")).alias("n")).join(good.select("folder", F.col("r.pages").alias("pages")), "folder")
    found.append(rule(markers.where("not n <=> pages"), "page_markers", F.col("n")))
    # assets, sequence and files name the same images
    shown = seq.where("type = 'image'").select("folder", resolved(F.col("path")).alias("at")).distinct()
    listed = one.select("folder", "at").distinct()
    both = shown.withColumn("s", F.lit(True)).join(listed.withColumn("a", F.lit(True)), ["folder", "at"], "full").where("s is null or a is null")
    found.append(rule(both, "asset_paths", F.coalesce("at", F.lit("unsafe path"))))
    found.append(rule(images.join(own, "folder", "left_semi").join(listed, ["folder", "at"], "left_anti"), "unreferenced_file", F.col("at")))
    met = one.join(images.select("folder", "at", "sha", F.col("width").alias("w"), F.col("height").alias("h")), ["folder", "at"], "left")
    found.append(rule(met.where("sha is null"), "no_file", F.col("path")))
    found.append(rule(met.where("sha is not null and not sha <=> sha256"), "checksum", F.col("path")))
    found.append(rule(met.where("sha is not null and not (w <=> width and h <=> height)"), "image_size", F.concat_ws("x", "w", "h")))
    found.append(rule(one.where(~F.coalesce(F.substring_index("path", "/", -1).contains("figure_"), F.lit(False))), "asset_name", F.col("path")))
    # no author is named, in the full text or in the records, in their normal form
    said = name("paper.txt").unionByName(records.select("folder", F.array_join(F.transform("t", lambda t: t["text"]), "\n").alias("value"))).where("value is not null")
    named = said.join(patterns(jobs.withColumnRenamed("folder", "doc")).withColumnRenamed("doc", "folder"), "folder").withColumn("n", normalized(F.col("value")))
    found.append(rule(named.where(F.regexp_like("n", "pattern")), "author_name", F.element_at(F.regexp_extract_all("n", "pattern", F.lit(0)), 1)))
    # every raster placement of a point or more lies under an asset of its page
    boxes = one.where("bbox is not null").select("folder", "page", *[(F.col("bbox")[i] + s * PAD).alias(f"b{c}") for i, (c, s) in enumerate((("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1)))])
    places = rasters.join(own, "folder", "left_semi").where("x1 - x0 >= 1 and y1 - y0 >= 1").select("folder", "page", *[F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    bare = places.alias("p").join(boxes.withColumnsRenamed({"folder": "__f", "page": "__p"}), F.expr(f"folder = __f and page = __p and {g.overlap('a', 'b')} > {SHARE}"), "left_anti")
    found.append(rule(bare, "uncovered_raster", F.concat_ws(",", "page", "ax0", "ay0")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def audit_files(spark: SparkSession, root: str, jobs: DataFrame, rasters: DataFrame) -> DataFrame:
    """`audit` of the folders under root."""
    start = re.sub(r"^[a-z]+:(//[^/]*)?", "", root).rstrip("/") + "/"

    def parts(path: Column) -> list[Column]:
        two = F.split(F.substring(path, F.locate(start, path) + len(start), F.length(path)), "/", 2)
        return [two[0].alias("folder"), F.get(two, 1).alias("at")]

    lists = spark.read.text([f"{root}/*/*.json", f"{root}/*/paper.txt"], wholetext=True).select(*parts(F.url_decode(F.input_file_name())), "value").withColumnRenamed("at", "name")
    images = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root)
    images = images.select(*parts(F.url_decode("path")), F.sha2("content", 256).alias("sha"), *png_size(F.col("content")))
    return audit(lists.where("name = 'index.json'").select("folder", "value"), lists.where("name <> 'index.json'"), images, jobs, rasters)


@query(
    "package_file_audit",
    """WITH t AS (SELECT DISTINCT conv_id AS c FROM conversations) SELECT r.rule, count(*) AS n FROM t JOIN (VALUES (1, 'index'), (2, 'forbidden_key'), (3, 'record_order'), (3, 'record_count'), (4, 'page_order'), (5, 'page_markers'), (6, 'asset_paths'), (6, 'no_file'), (7, 'unreferenced_file'),
 (8, 'checksum'), (9, 'image_size'), (10, 'author_name'), (11, 'uncovered_raster'), (12, 'records')) r(k, rule) ON c % 14 = k GROUP BY r.rule""",
)
def package_file_audit(spark, d):
    """Packages made of conversations, a fault of one kind in most of them: the rules they break."""
    k = F.col("conv_id") % 14
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("texts")).withColumn("folder", F.col("conv_id").cast("string")).withColumn("k", k)
    sha = F.sha2(F.col("folder"), 256)
    # texts keep their words but for digits and letters that could be a name
    record = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    name = F.concat(F.lit("zyxw "), F.lit("vutsrq"))
    first = F.when(k == 10, F.concat(F.element_at("texts", 1), F.lit(" by ZYXW "), F.lit("Vutsrq."))).otherwise(F.element_at("texts", 1))
    records = F.array(record("page_marker", F.lit("page 1")), record("text", first))
    item = lambda kind, number, page, path=None: F.struct(F.lit(kind).alias("type"), F.lit(path).cast("string").alias("path"), F.lit(number).cast("int").alias("record"), page.cast("int").alias("page"))
    one, image = F.lit(1), "figures/page_001_figure_01.png"
    sequence = F.when(k == 3, F.array(item("text", 1, one), item("image", None, one, image))).when(k == 4, F.array(item("text", 0, one), item("text", 1, F.lit(3)), item("image", None, F.lit(2), image))).otherwise(F.array(item("text", 0, one), item("text", 1, one), item("image", None, one, image)))
    content = F.to_json(F.struct(F.col("folder").alias("package_id"), F.when(k == 5, 2).otherwise(1).alias("pages"), sequence.alias("sequence"), F.when(k == 2, "yes").alias("decision")))
    indexes = turns.select("folder", F.when(k == 1, F.concat(content, F.lit("{"))).otherwise(content).alias("value"))
    asset = F.struct(F.when(k == 6, "figures/other_figure_02.png").otherwise(image).alias("path"), F.when(k == 8, F.lit("0")).otherwise(sha).alias("sha256"), F.when(k == 9, 31).otherwise(30).alias("width"), F.lit(20).alias("height"), F.lit(1).alias("page"), F.array(*map(F.lit, (10.0, 10.0, 60.0, 60.0))).alias("bbox"))
    listed = [turns.select("folder", F.lit(n).alias("name"), v.alias("value")) for n, v in (("text.json", F.when(k != 12, F.to_json(records)).otherwise("{")), ("figures.json", F.to_json(F.array(asset))), ("paper.txt", F.element_at("texts", 1)))]
    files = F.when(k == 7, F.array(F.lit(image), F.lit("figures/old.png"))).when(k == 6, F.array().cast("array<string>")).otherwise(F.array(F.lit(image)))
    images = turns.select("folder", F.explode(files).alias("at"), sha.alias("sha"), F.lit(30).alias("width"), F.lit(20).alias("height"))
    rasters = turns.select("folder", F.lit(1).alias("page"), F.when(k == 11, 70.0).otherwise(11.0).alias("x0"), F.lit(11.0).alias("y0"), F.when(k == 11, 90.0).otherwise(61.0).alias("x1"), F.lit(61.0).alias("y1"))
    found = audit(indexes, listed[0].unionByName(listed[1]).unionByName(listed[2]), images, turns.select("folder", F.array(name).alias("authors")), rasters)
    return found.select("folder", "rule").distinct().groupBy("rule").agg(F.count("*").alias("n"))
