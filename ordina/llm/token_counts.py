"""Operator 2: token counts in delta-maintained rollups.

Totals by source, language and tokenizer version are additive, so a batch of changes is folded into
signed sums before it touches them: an insert adds a document's counts, a delete takes them away, a
revision does both. `TokenLedger` keeps a log of numbered entries, each a small file that names a folder of sums. An
entry is written whole and then given the next number by an operation that fails if the number is taken, and a writer
looks for its batch id in all entries before its own. So committing the same batch id again, after a crash or by a
second writer, changes nothing, and of two writers of an id exactly one is told True. `compact` adds an entry that stands
for the sums and ids of all before it; no folder that a reader may use is moved or removed (`vacuum` does that when
asked), and batches committed while it runs are counted after it.

Changes have the columns op (insert, delete or revise), source, lang, tokenizer, n_tokens, n_chars and for
revisions old_source, old_lang, old_tokenizer, old_tokens, old_chars; other columns are not looked at. Null keys are keys of
their own; null counts are 0; rows with another op are an error (they would be lost). Repeated rows count as often as they
occur; an empty batch is committed with no rows. Totals whose documents, tokens and characters are all 0 are not shown.

Counts come from a public byte-level BPE vocabulary (its path is a parameter); null texts count as empty, texts of any
length are counted whole. Columns named by `keep` that clash with n_tokens are passed on as n_tokens_in.
"""

from __future__ import annotations

import base64
import json
import uuid

import regex
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import by_texts, fresh_path, stored, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: What splits a text before merges (fixed value of the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space from so many characters on is not left to the pattern.
LONG_SPACE = 10_000
_LONG_SPACE = regex.compile(rf"\p{{White_Space}}{{{LONG_SPACE},}}+")
KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")
_ENTRY = "number bigint, batch string, folder string, upto bigint"
_SCHEMA = ", ".join([f"{k} string" for k in KEYS] + [f"{s} bigint" for s in SUMS])


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", *, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """The `keep` columns with n_tokens of each whole text."""
    with open(ranks, "rb") as f:  # noqa: PTH123  on the driver; the table goes along with the function
        table_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def work():
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_of, special_tokens={})

        def of(texts: tb.Texts, n: int) -> dict:
            return {"n_tokens": [tokens_of(coder, texts.text(i)) for i in range(n)]}

        return of

    return by_texts(docs, keep, text, "n_tokens bigint", work)


def tokens_of(coder, text: str) -> int:
    """The number of tokens. The coder's pattern takes a run of white space before a word as one piece but for its last
    character, so a long run is handed over as that piece, and the texts around it by themselves."""
    n = at = 0
    if len(text) > LONG_SPACE:
        for m in _LONG_SPACE.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            n += len(coder.encode_ordinary(text[at : m.start()])) + len(coder._encode_single_piece(text[m.start() : end]))
            at = end
    return n + len(coder.encode_ordinary(text[at:]))


def signed(changes: DataFrame) -> DataFrame:
    """Sums of a batch by key. Partial sums are made before the shuffle, so a hot source is no burden."""
    ops = F.array(*[F.lit(o) for o in ("insert", "delete", "revise")])
    known = F.when(F.array_contains(ops, F.col("op")), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
    entry = lambda sign, old: F.struct(
        *[F.col(f"old_{k}" if old else k).cast("string").alias(k) for k in KEYS],
        F.lit(sign).cast("bigint").alias("n_docs"),
        *[(sign * F.coalesce(F.col(a if old else b).cast("bigint"), F.lit(0))).alias(b) for a, b in (("old_tokens", "n_tokens"), ("old_chars", "n_chars"))],
    )
    for c, kind in (*((f"old_{k}", "string") for k in KEYS), ("old_tokens", "bigint"), ("old_chars", "bigint")):
        if c not in changes.columns:
            changes = changes.withColumn(c, F.lit(None).cast(kind))
    parts = F.when(known == "insert", F.array(entry(1, False))).when(known == "delete", F.array(entry(-1, False))).otherwise(F.array(entry(-1, True), entry(1, False)))
    rows = changes.select(F.explode(parts).alias("e")).select("e.*")
    return rows.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS])


class TokenLedger:
    """Committed batches of sums in one folder of a file system that all machines share: log/<number> are the entries,
    data/ holds what they name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.path}/log"))
        self._fs.mkdirs(self._path(f"{self.path}/staging"))

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/log"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _entries(self) -> DataFrame:
        if not self._numbers():
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).json(f"{self.path}/log")

    def _claim(self, entry: dict) -> bool:
        """Gives the entry its number, unless another has taken it."""
        staged = self._path(f"{self.path}/staging/{uuid.uuid4().hex}")
        target = self._path(f"{self.path}/log/{entry['number']:012d}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a hard link is made or it fails; a local rename would replace
                paths = [self._jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self._jvm.String, 0)) for p in (target, staged)]
                self._jvm.java.nio.file.Files.createLink(*paths)
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                choice = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                choice[0] = none
                context.rename(staged, target, choice)
        except Py4JJavaError:
            if not self._fs.exists(target):
                raise
            return False
        finally:
            self._fs.delete(staged, False)
        return True

    def _last_compaction(self, entries: DataFrame):
        return entries.where("batch is null").orderBy(F.col("number").desc()).limit(1).collect()

    def committed(self, batch: str) -> bool:
        entries = self._entries()
        if entries.where(F.col("batch") == batch).take(1):
            return True
        last = self._last_compaction(entries)
        return bool(last) and bool(self.spark.read.schema("batch string").parquet(f"{self.path}/data/{last[0]['folder']}/ids").where(F.col("batch") == batch).take(1))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False if its id is committed already, in which case nothing is read or written."""
        if not batch:
            raise ValueError("a batch needs an id")
        if self.committed(batch):
            return False
        folder = uuid.uuid4().hex
        signed(changes).write.parquet(f"{self.path}/data/{folder}/sums")
        while True:
            numbers = self._numbers()  # taken before the look for the id: an entry after them fails the claim
            if self.committed(batch):
                self._fs.delete(self._path(f"{self.path}/data/{folder}"), True)
                return False
            if self._claim({"number": numbers[-1] + 1 if numbers else 1, "batch": batch, "folder": folder, "upto": None}):
                return True

    def _live(self) -> list[str]:
        """The folders whose sums make the totals: the last compaction's and those of later batches."""
        entries = self._entries()
        last = self._last_compaction(entries)
        after = last[0]["upto"] if last else 0
        own = entries.where(F.col("batch").isNotNull() & (F.col("number") > after)).select("folder").collect()  # bounded by compaction
        return [*(r["folder"] for r in last), *(r["folder"] for r in own)]

    def compact(self) -> None:
        """Adds an entry that stands for all up to now. Readers see either the parts or the whole."""
        numbers = self._numbers()
        if not numbers:
            return
        upto = numbers[-1]
        entries = self._entries().where(F.col("number") <= upto)
        last = self._last_compaction(entries)
        after = last[0]["upto"] if last else 0
        own = entries.where(F.col("batch").isNotNull() & (F.col("number") > after))
        folder = uuid.uuid4().hex
        ids = own.select("batch")
        folders = [r[0] for r in own.select("folder").collect()]
        if last:
            ids = ids.union(self.spark.read.schema("batch string").parquet(f"{self.path}/data/{last[0]['folder']}/ids"))
            folders.append(last[0]["folder"])
        self._summed(folders).write.parquet(f"{self.path}/data/{folder}/sums")
        ids.write.parquet(f"{self.path}/data/{folder}/ids")
        while not self._claim({"number": self._numbers()[-1] + 1, "batch": None, "folder": folder, "upto": upto}):
            pass

    def vacuum(self) -> None:
        """Removes what the last compaction replaced. For when no reader or compaction that began before it still runs."""
        entries = self._entries()
        last = self._last_compaction(entries)
        if last:
            old = entries.where((F.col("number") <= last[0]["upto"]) | (F.col("batch").isNull() & (F.col("number") < last[0]["number"])))
            for number, folder in old.select("number", "folder").collect():
                self._fs.delete(self._path(f"{self.path}/log/{number:012d}"), False)
                self._fs.delete(self._path(f"{self.path}/data/{folder}"), True)

    def _summed(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/data/{f}/sums" for f in folders])
        sums = rows.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS])
        return sums.where(" or ".join(f"{s} != 0" for s in SUMS))

    def totals(self) -> DataFrame:
        return self._summed(self._live())


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Three batches and a repeated one over all documents: every document is inserted with the tokens of
    its raw text; those whose text changes when white space is tidied are revised; then all but the first
    of equal texts are deleted (as deletes of all and inserts of the firsts, in one batch). The totals are those of the tidy, distinct texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("text").cast("string").alias("text"))
    tidy = F.trim(F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))
    pair = docs.withColumn("tidy", tidy).withColumn("digest", F.md5(F.coalesce("tidy", F.lit(""))))
    shown = ["doc_id", "source", "lang", "digest", "n_chars", "same", "tidy_chars", "tidy"]
    pair = pair.withColumns({"n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("bigint"), "same": F.coalesce(F.col("tidy") == F.col("text"), F.lit(True)), "tidy_chars": F.coalesce(F.length("tidy"), F.lit(0)).cast("bigint")})
    first = count_tokens(pair.withColumn("tidy", F.when(~F.col("same"), F.col("tidy"))), shown, "text").withColumnRenamed("n_tokens", "raw_tokens")
    # texts that tidying leaves alone keep their count; the others' tidy form is counted as well
    both = count_tokens(first, [c for c in first.columns if c != "tidy"], "tidy")
    counts = stored(both.withColumn("n_tokens", F.when(F.col("same"), F.col("raw_tokens")).otherwise(F.col("n_tokens"))), "token-counts")
    # all are deleted and one of each digest inserted again: the same sums as deleting the copies, without a join on digests
    shown = ["doc_id", "source", "lang", "n_tokens", "tidy_chars"]
    firsts = counts.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *shown)).alias("f")).select(F.lit("insert").alias("op"), *[f"f.{c}" for c in shown])
    copies = counts.select(F.lit("delete").alias("op"), *shown).union(firsts)
    ledger = TokenLedger(spark, fresh_path(spark, "ledger"))
    version = F.lit("byte_bpe_50k")
    inserts = counts.select(F.lit("insert").alias("op"), "source", "lang", version.alias("tokenizer"), F.col("raw_tokens").alias("n_tokens"), "n_chars")
    revised = counts.where("not same").select(
        F.lit("revise").alias("op"), "source", "lang", version.alias("tokenizer"), "n_tokens", F.col("tidy_chars").alias("n_chars"),
        F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), version.alias("old_tokenizer"), F.col("raw_tokens").alias("old_tokens"), F.col("n_chars").alias("old_chars"),
    )
    deletes = copies.select("op", "source", "lang", version.alias("tokenizer"), "n_tokens", F.col("tidy_chars").alias("n_chars"))
    for batch, changes in (("load", inserts), ("tidy", revised), ("copies", deletes), ("tidy", revised)):
        ledger.commit(batch, changes)
    return ledger.totals()
