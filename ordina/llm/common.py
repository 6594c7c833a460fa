"""What several operators share: table reading, shared folders, Arrow stages and labelled samples."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from bisect import bisect_left
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names, else (tests) a folder under /tmp."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def mapped(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow, after this package has been shipped to the executors (once per application)."""
    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_ordina_shipped", False):
        package = Path(__file__).resolve().parent.parent
        if package.is_dir():
            archive = Path(tempfile.mkdtemp()) / "ordina_package.zip"
            with zipfile.ZipFile(archive, "w") as z:
                for p in sorted(package.rglob("*.py")):
                    z.write(p, p.relative_to(package.parent))
            sc.addPyFile(str(archive))
        sc._ordina_shipped = True
    return df.mapInArrow(run, schema)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here and a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def to_arrow(schema: T.StructType) -> pa.Schema:
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
        "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
        "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
    }
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def by_texts(df: DataFrame, keep: list[str], text: str, schema: str, work: Callable[[], Callable[[tb.Texts, int], dict]]) -> DataFrame:
    """Adds columns made from a text column. `work()` is called once per task and gives a function from
    a slice of texts to its new columns (arrays or lists). Rows keep their order; `keep` columns pass through
    (the text travels once, also if it is one of them), under their names with `_in` at the end if a new column has theirs."""
    new = T._parse_datatype_string(schema)
    named = {c: f"{c}_in" if c in new.names else c for c in keep}
    source = named[text] if text in keep else unused("__text", [*named.values(), *new.names])
    picked = df.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], *([] if text in keep else [F.col(f"`{text}`").cast("string").alias(source)]))
    full = T.StructType([f for f in picked.schema.fields if f.name != source or text in keep] + new.fields)
    arrow = to_arrow(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch in batches:
            pa.default_memory_pool().release_unused()  # workers live on: what the last batch took goes back
            at = batch.schema.get_field_index(source)
            others = [i for i in range(batch.num_columns) if i != at or text in keep]
            for i, j, texts in tb.slices(batch.column(at)):
                made = function(texts, j - i)
                cols = [batch.column(k).slice(i, j - i) for k in others]
                cols += [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(cols, names=[*(batch.schema.names[k] for k in others), *arrow.names])

    return mapped(picked, run, full)


def unused(name: str, others: list[str]) -> str:
    """The name, with as many underscores behind it as make it none of the others."""
    while name in others:
        name += "_"
    return name


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with names that clash with no result's, and the new name of each column."""
    named = {c: f"__column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*named.values()), named


def replaced(docs: DataFrame, out: DataFrame, named: dict[str, str], new: str) -> DataFrame:
    """The columns of docs from `out`, whose column `new` replaces the text where it is not null; n_chars follows."""
    text, changed = F.col(named["text"]), F.col(new)
    own = {c: F.col(n) for c, n in named.items()} | {"text": F.coalesce(changed, text)}
    if "n_chars" in named:
        own["n_chars"] = F.when(changed.isNull(), F.col(named["n_chars"])).otherwise(F.length(changed).cast(docs.schema["n_chars"].dataType))
    return out.select(*[c.alias(n) for n, c in own.items()])


class Taken:
    """A set of spans that are joined where they overlap; tests a new one in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]] | None = None) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans or ()):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def add(self, a: int, b: int) -> bool:
        """Takes the span unless it overlaps one."""
        if self.touches(a, b):
            return False
        i = bisect_left(self.starts, b)
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


#: Longer texts are not learnt from, so that a sample has a bound in characters too (every text is scored, whatever its length).
LONGEST_LEARNT = 200_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *, where: Callable | None = None) -> tuple[list[str], list[int]]:
    """Whole texts (of LONGEST_LEARNT characters at most) and 0/1 labels of at most `per_class` rows of each class, chosen by a hash of doc_id, so the
    sample is the same in every run. Labels other than 0 and 1, and documents with contradicting labels, are unused.
    The sample's ids are few by construction, so they are broadcast and `documents` is only scanned."""
    one = labels.select(F.col("doc_id").alias("__id"), F.col(f"`{label}`").cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    one = one.groupBy("__id").agg(F.min("__y").alias("__y"), F.max("__y").alias("__top")).where("__y = __top")
    if where is not None:
        one = one.where(where(F.col("__id")))
    order = F.xxhash64(F.col("__id"), F.lit(7))
    picks = [one.where(F.col("__y") == y).orderBy(order, "__id").limit(per_class) for y in (0, 1)]
    ids = picks[0].unionByName(picks[1]).select("__id", "__y")
    # a doc_id that repeats in docs has one text in the sample (the smallest), so the bound holds for rows too
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("__text")).where(F.coalesce(F.length("__text"), F.lit(0)) <= LONGEST_LEARNT)
    rows = texts.join(F.broadcast(ids), "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text")).orderBy(order, "__id").toArrow()
    return [t or "" for t in rows["__text"].to_pylist()], rows["__y"].to_pylist()
