"""Ordered items: coalescing, joining, runs, digests, and folds that depend on order."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import upper
from ..registry import query
from ..sources.tables import BOXES_SQL, LINES_SQL, REGIONS_SQL, SEQUENCE_SQL, boxes, lines, regions, sequence, table


def ordered_text(items: Column, separator: str) -> Column:
    """Joins an array of (position, text) in order of position."""
    return F.array_join(F.transform(F.array_sort(items), lambda i: i["text"]), separator)


def coalesced(df: DataFrame, key: str, position: str, kind: str, text: str) -> DataFrame:
    """Neighbours of one kind become one item, texts joined by a blank line: islands by a running sum of changes."""
    w = Window.partitionBy(key).orderBy(position)
    new = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)) & F.lag(kind).over(w).isNotNull(), 0).otherwise(1)
    island = df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w))
    return island.groupBy(key, "island", kind).agg(F.count("*").alias("parts"), ordered_text(F.collect_list(F.struct(F.col(position).alias("at"), F.col(text).alias("text"))), "\n\n").alias("text"))


_ISLANDS = f"""WITH {SEQUENCE_SQL}, n AS (SELECT *, CASE WHEN type = lag(type) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM items),
 i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM n)"""


@query("coalesce_adjacent", f"{_ISLANDS} SELECT conv_id, CAST(island AS BIGINT) AS island, type, count(*) AS parts, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, island, type")
def coalesce_adjacent(spark, d):
    return coalesced(sequence(spark, d), "conv_id", "turn", "type", "text")


@query("package_text", f"WITH {SEQUENCE_SQL} SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha256, count(*) AS n FROM items GROUP BY conv_id")
def package_text(spark, d):
    """Pointers followed in order, and the digest of what they give."""
    whole = sequence(spark, d).groupBy("conv_id").agg(ordered_text(F.collect_list(F.struct(F.col("turn").alias("at"), "text")), "\n").alias("t"), F.count("*").alias("n"))
    return whole.select("conv_id", F.sha2("t", 256).alias("sha256"), "n")


@query("full_text_join", f"WITH {SEQUENCE_SQL} SELECT conv_id, string_agg('===== PDF PAGE ' || (turn + 1) || ' =====' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS full_text FROM items GROUP BY conv_id")
def full_text_join(spark, d):
    page = F.concat(F.lit("===== PDF PAGE "), (F.col("turn") + 1).cast("string"), F.lit(" =====\n"), F.col("text"))
    return sequence(spark, d).groupBy("conv_id").agg(ordered_text(F.collect_list(F.struct(F.col("turn").alias("at"), page.alias("text"))), "\n\n").alias("full_text"))


def escaped(c: Column) -> Column:
    """Markup characters as references; the ampersand first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escaped_sql(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query("html_preview", f"WITH {SEQUENCE_SQL} SELECT conv_id, string_agg('<pre>' || {escaped_sql('text')} || '</pre>', chr(10) ORDER BY turn) AS html FROM items GROUP BY conv_id")
def html_preview(spark, d):
    part = F.concat(F.lit("<pre>"), escaped(F.col("text")), F.lit("</pre>"))
    return sequence(spark, d).groupBy("conv_id").agg(ordered_text(F.collect_list(F.struct(F.col("turn").alias("at"), part.alias("text"))), "\n").alias("html"))


def sequential_runs(df: DataFrame, keys: list[str], number: str, order: str, distinct: bool, least: int = 8, share: float = 0.7) -> DataFrame:
    """Groups of at least `least` numbers of which most neighbours differ by one: margin line numbers. With
    `distinct`, sorted distinct numbers count; else all of them in reading order."""
    rows = df.select(*keys, number).distinct() if distinct else df
    step = F.col(number) - F.lag(number).over(Window.partitionBy(*keys).orderBy(*([number] if distinct else [order, number])))
    out = rows.withColumn("__step", step).groupBy(*keys).agg(F.count("*").alias("members"), F.count_if(F.col("__step") == 1).alias("steps"))
    return out.where((F.col("members") >= least) & (F.col("steps") >= share * (F.col("members") - 1)))


_NUMBERS = "numbers AS (SELECT l_partkey % 20 AS page, round_even((l_suppkey % 7) * 3.0 / {q}, 0)::BIGINT AS bucket, CAST(l_linenumber + 3 * (l_orderkey % 5) AS BIGINT) AS number, l_orderkey AS y FROM lineitem)"


def _numbers(spark, d, q: int) -> DataFrame:
    bucket = F.bround((F.col("l_suppkey") % 7) * 3.0 / q, 0).cast("bigint")
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("page"), bucket.alias("bucket"), (F.col("l_linenumber") + 3 * (F.col("l_orderkey") % 5)).cast("bigint").alias("number"), F.col("l_orderkey").alias("y"))


@query(
    "sequential_runs_x0",
    f"""WITH {_NUMBERS.format(q=8)}, s AS (SELECT page, bucket, number, number - lag(number) OVER (PARTITION BY page, bucket ORDER BY number) AS step FROM (SELECT DISTINCT page, bucket, number FROM numbers))
 SELECT page, bucket, count(*) AS members, CAST(count_if(step = 1) AS BIGINT) AS steps FROM s GROUP BY page, bucket HAVING count(*) >= 8 AND count_if(step = 1) >= 0.7 * (count(*) - 1)""",
)
def sequential_runs_x0(spark, d):
    return sequential_runs(_numbers(spark, d, 8), ["page", "bucket"], "number", "y", True)


@query(
    "sequential_runs_x1",
    """WITH numbers AS (SELECT CAST(floor(o_orderkey / 50) AS BIGINT) AS page, round_even((floor(o_orderkey / 50) % 9) / 4, 0)::BIGINT AS bucket, o_orderkey + CASE WHEN o_custkey % 10 < 2 THEN 3 ELSE 0 END AS number, o_orderkey AS y FROM orders),
 s AS (SELECT page, bucket, number, number - lag(number) OVER (PARTITION BY page, bucket ORDER BY y, number) AS step FROM numbers)
 SELECT page, bucket, count(*) AS members, CAST(count_if(step = 1) AS BIGINT) AS steps FROM s GROUP BY page, bucket HAVING count(*) >= 8 AND count_if(step = 1) >= 0.7 * (count(*) - 1)""",
)
def sequential_runs_x1(spark, d):
    page = F.floor(F.col("o_orderkey") / 50).cast("bigint")
    number = F.col("o_orderkey") + F.when(F.col("o_custkey") % 10 < 2, 3).otherwise(0)
    rows = table(spark, d, "orders").select(page.alias("page"), F.bround((page % 9) / 4, 0).cast("bigint").alias("bucket"), number.alias("number"), F.col("o_orderkey").alias("y"))
    return sequential_runs(rows, ["page", "bucket"], "number", "y", False)


@query(
    "char_multiset_equality",
    """WITH a AS (SELECT source, unnest(string_split(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g'), '')) AS ch, 1 AS n FROM documents),
 b AS (SELECT source, unnest(string_split(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]', '', 'g'), '')) AS ch, -1 AS n FROM documents)
 SELECT source, ch, CAST(sum(n) AS BIGINT) AS surplus FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE ch <> '' GROUP BY source, ch HAVING sum(n) <> 0""",
)
def char_multiset_equality(spark, d):
    """Characters (without white space) of the source against those represented (here: lower-cased). Each character of a
    source is counted once; what represents it follows from the count, so texts are read and exploded once."""
    docs = table(spark, d, "documents").select("source", F.explode(F.split(F.regexp_replace("text", r"[ \t\n\x0B\f\r]", ""), "")).alias("ch"))
    counts = docs.where("ch != ''").groupBy("source", "ch").agg(F.count("*").alias("n"))
    signed = F.concat(F.array(F.struct("ch", "n")), F.transform(F.split(F.lower("ch"), ""), lambda c: F.struct(c.alias("ch"), (-F.col("n")).alias("n"))))
    both = counts.select("source", F.explode(signed).alias("s")).select("source", "s.*").where("ch != ''")
    return both.groupBy("source", "ch").agg(F.sum("n").alias("surplus")).where("surplus != 0")


@query("ordered_digest", f"WITH {SEQUENCE_SQL} SELECT conv_id, sha256(string_agg(turn || ':' || type || ':' || sha256(text), '|' ORDER BY turn)) AS digest FROM items GROUP BY conv_id")
def ordered_digest(spark, d):
    part = F.concat_ws(":", F.col("turn").cast("string"), "type", F.sha2("text", 256))
    joined = sequence(spark, d).groupBy("conv_id").agg(ordered_text(F.collect_list(F.struct(F.col("turn").alias("at"), part.alias("text"))), "|").alias("j"))
    return joined.select("conv_id", F.sha2("j", 256).alias("digest"))


@query(
    "line_ordering",
    f"WITH {BOXES_SQL} SELECT page, string_agg(x0::INT || '/' || y0::INT, ' ' ORDER BY round_even(y0, 1), x0, x1, y1, source) AS reading_order FROM boxes GROUP BY page",
)
def line_ordering(spark, d):
    at = F.struct(F.bround("y0", 1), "x0", "x1", "y1", "source", F.concat_ws("/", F.col("x0").cast("int"), F.col("y0").cast("int")).alias("text"))
    return boxes(spark, d).groupBy("page").agg(ordered_text(F.collect_list(at), " ").alias("reading_order"))


@query("counters_by_name", "SELECT l_orderkey AS page, l_returnflag AS kind, printf('page_%03d_figure_%02d', l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS name FROM lineitem")
def counters_by_name(spark, d):
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("kind"), F.format_string("page_%03d_figure_%02d", "l_orderkey", i).alias("name"))


# Folds: what a row means depends on all rows before it, so each document's rows are folded in order.


def folded(df: DataFrame, key: str, order: list[str], arguments: list[str], start: Callable[[], Callable], name: str, kind: str) -> DataFrame:
    """Adds a column made by a fold over the rows of each key in order. `start()` gives the step function of a new
    key, which gets a row's `arguments`. Rows stream through in sorted partitions; only what the step keeps is held."""
    ordered = df.repartition(key).sortWithinPartitions(key, *order)
    arrow = {"bigint": pa.int64(), "boolean": pa.bool_()}[kind]

    def run(batches):
        last, step = None, None
        for batch in batches:
            out = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in (key, *arguments)), strict=True):
                if step is None or k != last:
                    last, step = k, start()
                out.append(step(*row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, name])

    return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]))


_F = f"WITH RECURSIVE {REGIONS_SQL}"
_READING_SQL = "round_even(y0, 1), x0, x1, y1, role, label, name, confidence, forced, size, len, rotation"
_READING = ["__y", "x0", "x1", "y1", "role", "label", "name", "confidence", "forced", "size", "len", "rotation"]


def in_reading_order(df: DataFrame) -> DataFrame:
    return df.withColumn("__y", F.bround("y0", 1))


class LineGroups:
    """Lines grow into one group until the block changes or a separator lies below the group's upper edge and not below
    the line's; the edge is that of all its lines."""

    def __init__(self) -> None:
        self.group, self.top, self.block = 0, None, None

    def __call__(self, block, y0: float, cuts: list[float] | None) -> int:
        if self.top is not None and (block != self.block or any(self.top < y <= y0 for y in cuts or ())):
            self.group, self.top = self.group + 1, None
        self.block, self.top = block, y0 if self.top is None else min(self.top, y0)
        return self.group


@query(
    "group_lines_fold",
    f"""{_F}, l AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {_READING_SQL}) AS i FROM kinds WHERE role <> 'old'), c AS (SELECT page, list(y0) AS cuts FROM kinds WHERE role = 'old' GROUP BY page),
 r AS (SELECT l.*, coalesce(cuts, []) AS cuts FROM l LEFT JOIN c ON l.page = c.page),
 f AS (SELECT page, i, 0::BIGINT AS g, y0 AS top, name AS block FROM r WHERE i = 1 UNION ALL
  SELECT n.page, n.i, n.g + CASE WHEN n.cut THEN 1 ELSE 0 END, CASE WHEN n.cut THEN n.y0 ELSE least(n.top, n.y0) END, n.name
  FROM (SELECT r.page, r.i, r.y0, r.name, f.g, f.top, r.name <> f.block OR len(list_filter(r.cuts, lambda y: y > f.top AND y <= r.y0)) > 0 AS cut FROM f JOIN r ON r.page = f.page AND r.i = f.i + 1) n)
 SELECT page, g AS line_group, count(*) AS n, min(r.y0) AS y0, max(r.y1) AS y1 FROM f JOIN r USING (page, i) GROUP BY page, g""",
)
def group_lines_fold(spark, d):
    """Lines of a page in groups, cut by the upper edges of its old regions."""
    every = regions(spark, d)
    cuts = every.where("role = 'old'").groupBy("page").agg(F.collect_list("y0").alias("cuts"))
    rows = in_reading_order(every.where("role != 'old'").join(cuts, "page", "left"))
    grouped = folded(rows, "page", _READING, ["name", "y0", "cuts"], LineGroups, "line_group", "bigint")
    return grouped.groupBy("page", "line_group").agg(F.count("*").alias("n"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


class TableRows:
    """A line joins the most recent of the last four rows whose anchor (the centre of its first line) is nearer than 2 points
    or .3 of the line's size, or opens a row. Only four anchors are held."""

    def __init__(self) -> None:
        self.recent: list[tuple[int, float]] = []
        self.rows = 0

    def __call__(self, y0: float, y1: float, size: float) -> int:
        centre, reach = (y0 + y1) / 2, max(2.0, 0.3 * size)
        for row, anchor in reversed(self.recent):
            if abs(anchor - centre) < reach:
                return row
        self.recent = [*self.recent, (self.rows, centre)][-4:]
        self.rows += 1
        return self.rows - 1


_NEAR_ROW = " ".join(f"WHEN len(f.a) > {k} AND abs(f.a[len(f.a) - {k}] - (r.y0 + r.y1) / 2) < greatest(2, 0.3 * r.size) THEN len(f.a) - {k + 1}" for k in range(4))


@query(
    "table_row_cluster",
    f"""{_F}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {_READING_SQL}) AS i FROM kinds),
 f AS (SELECT page, i, 0::BIGINT AS t, [(y0 + y1) / 2] AS a FROM r WHERE i = 1 UNION ALL
  SELECT n.page, n.i, coalesce(n.near, len(n.a)), CASE WHEN n.near IS NULL THEN list_append(n.a, n.mid) ELSE n.a END FROM (SELECT r.page, r.i, f.a, (r.y0 + r.y1) / 2 AS mid, CASE {_NEAR_ROW} END AS near FROM f JOIN r ON r.page = f.page AND r.i = f.i + 1) n)
 SELECT page, t AS table_row, count(*) AS n, min(r.y0) AS y0, max(r.y1) AS y1 FROM f JOIN r USING (page, i) GROUP BY page, t""",
)
def table_row_cluster(spark, d):
    rows = folded(in_reading_order(regions(spark, d)), "page", _READING, ["y0", "y1", "size"], TableRows, "table_row", "bigint")
    return rows.groupBy("page", "table_row").agg(F.count("*").alias("n"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


class Unlike:
    """A box is kept unless it and a kept one cover each other by more than `share`. Kept boxes are looked up by
    their area, as only boxes of nearly the same area can cover each other so far."""

    def __init__(self, share: float = 0.98) -> None:
        self.share = share
        self.kept: dict[int, list[tuple[float, ...]]] = {}

    def __call__(self, x0: float, y0: float, x1: float, y1: float) -> bool:
        size = max(0.0, x1 - x0) * max(0.0, y1 - y0)
        # areas of two such boxes differ by 1 / share at most: neighbours on a logarithmic scale
        slot = math.floor(math.log(max(size, 1e-9)) / -math.log(self.share))
        for s in (slot - 1, slot, slot + 1):
            for a, b, c, e in self.kept.get(s, ()):
                inner = max(0.0, min(x1, c) - max(x0, a)) * max(0.0, min(y1, e) - max(y0, b))
                if inner / max(0.001, size) > self.share and inner / max(0.001, (c - a) * (e - b)) > self.share:
                    return False
        self.kept.setdefault(slot, []).append((x0, y0, x1, y1))
        return True


_INNER = "greatest(0, least(r.x1, k.x1) - greatest(r.x0, k.x0)) * greatest(0, least(r.y1, k.y1) - greatest(r.y0, k.y0))"


@query(
    "greedy_dedup",
    f"""{_F}, r AS (SELECT page, x0, y0, x1, y1, role, row_number() OVER (PARTITION BY page ORDER BY {_READING_SQL}) AS i FROM kinds),
 f AS (SELECT page, i, TRUE AS kept, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS a FROM r WHERE i = 1 UNION ALL
  SELECT n.page, n.i, n.new, CASE WHEN n.new THEN list_append(n.a, {{'x0': n.x0, 'y0': n.y0, 'x1': n.x1, 'y1': n.y1}}) ELSE n.a END
  FROM (SELECT r.*, f.a, len(list_filter(f.a, lambda k: {_INNER} / greatest(0.001, (r.x1 - r.x0) * (r.y1 - r.y0)) > 0.98 AND {_INNER} / greatest(0.001, (k.x1 - k.x0) * (k.y1 - k.y0)) > 0.98)) = 0 AS new FROM f JOIN r ON r.page = f.page AND r.i = f.i + 1) n)
 SELECT page, role, count(*) AS n, CAST(count_if(kept) AS BIGINT) AS kept FROM f JOIN r USING (page, i) GROUP BY page, role""",
)
def greedy_dedup(spark, d):
    """A box is kept unless it and a kept one cover each other almost wholly; order decides."""
    marked = folded(in_reading_order(regions(spark, d)), "page", _READING, ["x0", "y0", "x1", "y1"], Unlike, "kept", "boolean")
    return marked.groupBy("page", "role").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


def table_text(lines: list[tuple[float, float, float, float, float, str]], pitch: float = 4.2) -> str:
    """Lines (x0, y0, x1, y1, size, text) of a table as text: rows by `TableRows`, cells at the column that their x0 gives, at
    least two spaces between cells."""
    cluster, rows = TableRows(), {}
    for line in sorted(lines, key=lambda v: (v[1], v[0])):
        rows.setdefault(cluster(line[1], line[3], line[4]), []).append(line)
    left = min(v[0] for v in lines)
    out = []
    for own in sorted(rows.values(), key=lambda r: (r[0][1] + r[0][3]) / 2):
        text = ""
        for x0, *_, cell in sorted(own, key=lambda v: v[0]):
            text = text.ljust(max(len(text) + (2 if text else 0), round((x0 - left) / pitch))) + cell
        out.append(text.rstrip())
    return "\n".join(out)


def laid_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """The text of each table (rows of one key: x0, y0, x1, y1, size, text). Rows stream through in partitions sorted by key, so a
    call meets many tables; one table is one page's, and fits in memory."""
    shown = ("x0", "y0", "x1", "y1", "size", "text")
    made = T.StructType([*[df.schema[k] for k in keys], T.StructField("layout", T.StringType())])
    ordered = df.select(*keys, *shown).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        last, held, schema = None, [], None
        for batch in batches:
            schema = pa.schema([*[batch.schema.field(k) for k in keys], pa.field("layout", pa.string())])
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, *shown)), strict=True):
                key = row[: len(keys)]
                if held and key != last:
                    out.append((*last, table_text(sorted(held))))
                    held = []
                last = key
                held.append(row[len(keys) :])
            if out:
                yield _batch(out, schema)
        if held:
            yield _batch([(*last, table_text(sorted(held)))], schema)

    return ordered.mapInArrow(run, made)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@query("table_layout")
def table_layout(spark, d):
    """Boxes of a page laid out as a table, their labels as cells."""
    return laid_out(regions(spark, d).withColumn("text", F.concat_ws("", "label", "name")).select("page", "x0", "y0", "x1", "y1", "size", "text"), ["page"])


_SHOWN_SQL = "CASE WHEN line_id % 11 = 3 THEN 'ACKNOWLEDGEMENTS' WHEN line_id % 5 = 4 THEN 'HEADING ' || line_id WHEN line_id % 13 = 6 THEN '42' ELSE line END"


@query(
    "section_mask_fold",
    f"""WITH {LINES_SQL}, t AS (SELECT doc_id, line_id, {_SHOWN_SQL} AS line FROM lines),
 k AS (SELECT *, line = 'ACKNOWLEDGEMENTS' AS s, regexp_matches(line, '^[0-9]+$') AS num, length(line) < 110 AND upper(line) = line AND length(regexp_replace(line, '[^A-Za-z]', '', 'g')) > 3 AS h FROM t),
 g AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_id) AS seg FROM k),
 n AS (SELECT *, sum(CASE WHEN NOT s AND NOT num THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, seg ORDER BY line_id) AS nth FROM g),
 e AS (SELECT *, sum(CASE WHEN h AND NOT s AND nth >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, seg ORDER BY line_id) AS ends FROM n)
 SELECT doc_id, count(*) AS n, CAST(count_if(seg > 0 AND NOT s AND NOT num AND ends = 0) AS BIGINT) AS masked, CAST(count_if(h) AS BIGINT) AS headings FROM e GROUP BY doc_id""",
)
def section_mask_fold(spark, d):
    n, line = F.col("line_id"), F.col("line")
    shown = F.when(n % 11 == 3, "ACKNOWLEDGEMENTS").when(n % 5 == 4, F.concat(F.lit("HEADING "), n.cast("string"))).when(n % 13 == 6, "42").otherwise(line)
    rows = lines(spark, d).withColumn("line", shown)
    heading = (F.length("line") < 110) & (upper(F.col("line")) == F.col("line")) & (F.length(F.regexp_replace("line", "[^A-Za-z]", "")) > 3)
    out = in_sections(rows, "doc_id", "line_id", F.col("line") == "ACKNOWLEDGEMENTS", heading, F.col("line").rlike("^[0-9]+$"))
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("masked").alias("masked"), F.count_if("heading").alias("headings"))


def in_sections(rows: DataFrame, key: str, order: str, start: Column, heading: Column, passed: Column) -> DataFrame:
    """Adds `masked` and `heading`: from a starting heading on, lines are masked, over pages, until the next heading; but one
    directly after the start belongs to it. `passed` lines (margin numbers) are neither masked nor do they count. The state
    follows from running counts, so no fold is needed."""
    rows = rows.withColumns({"__s": start, "heading": heading, "__p": passed & ~start})
    rows = rows.withColumn("__seg", F.sum(F.col("__s").cast("int")).over(Window.partitionBy(key).orderBy(order)))
    w = Window.partitionBy(key, "__seg").orderBy(order)
    rows = rows.withColumn("__nth", F.sum((~F.col("__s") & ~F.col("__p")).cast("int")).over(w))
    rows = rows.withColumn("__ends", F.sum((F.col("heading") & ~F.col("__s") & ~F.col("__p") & (F.col("__nth") >= 2)).cast("int")).over(w))
    return rows.withColumn("masked", (F.col("__seg") > 0) & ~F.col("__s") & ~F.col("__p") & (F.col("__ends") == 0)).drop("__s", "__p", "__seg", "__nth", "__ends")
