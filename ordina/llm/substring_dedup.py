"""Operator 13: words covered by 20-word windows that occur earlier are removed, found by recompression.

Recompression. Words are symbols; each round joins runs of one symbol, and pairs whose left symbol is of the round's left
half and whose right one is of its right half, into new symbols. A symbol is named by a hash of the words it stands for, so
every task gives equal strings equal names, and a round is the same everywhere without an exchanged dictionary. Whether a
limit between symbols survives a round depends on the symbols around it; `parsed` carries how many words to either side
decide it. Inside of equal windows, limits whose context lies within the window are therefore equal.

1. A limit is named by its level and the words that decide it (LEAST or more). Each window takes the limit of the least name
   among those it holds, so neighbours mostly take the same: its anchor. A window that holds none is its own. There is an
   anchor for every four windows or so.
2. Anchors are counted over all documents: only windows whose anchor occurs elsewhere can repeat (shared high-level symbols
   reveal them).
3. Those windows are compared as a whole (96 bits of their words), with the smallest doc_id of each (which verifies them).
4. Every document drops what its repeated windows cover.

Scale. Documents are packed into blocks of BLOCK_BYTES, written once, bucketed by block, and never shuffled. A block sends
each anchor or window once, sorted arrays cut into segments by value, so a passage with many copies is one entry a block;
what comes back goes to the block. Segments follow the number of anchors. Nothing is broadcast or capped.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null, empty and shorter texts lose nothing (null: no words). A window is
repeated if it starts in a document of smaller doc_id, or earlier in its own; rows of one doc_id are different documents of
which neither is smaller, and a null doc_id is neither smaller nor larger than any: both only lose what repeats inside
of them or in smaller ones. Texts may have any length. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import fresh_path, mapped, table

WINDOW = 20
#: Words of context that an anchor needs, and rounds of recompression.
LEAST, ROUNDS = 10, 6
BLOCK_BYTES = 8 << 20
SEGMENT_KEYS = 200_000
NO_ID = np.iinfo(np.int64).max

_BLOCK = "block bigint, docs binary, keys binary, twice binary, n_keys bigint"
_PART = "segment int, block bigint, a binary, b binary, c binary, flag binary"
_BACK = "block bigint, a binary, b binary, c binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed array<int>"


class Names:
    """Hashes of runs of words: [i, j) of all words of a slice."""

    def __init__(self, hashes: np.ndarray) -> None:
        power, self.inverse = tb._power_tables(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[: len(hashes)], out=self.sums[1:])

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return tb.mix((self.sums[j] - self.sums[i]) * self.inverse[i])


class Words:
    """Words of a slice of texts, their names, and the windows of all its documents."""

    def __init__(self, texts: tb.Texts, strong: bool = True) -> None:
        self.texts, self.words = texts, texts.words(tb.NON_SPACE)
        self.names = Names(tb.word_hashes(texts.data, self.words))
        self.second = Names(tb.word_hashes(texts.data, self.words, 1)) if strong else None
        counts = self.words.counts()
        self.first, self.last = np.repeat(self.words.offsets[:-1], counts), np.repeat(self.words.offsets[1:], counts)
        at = np.arange(len(self.words.starts))
        self.windows = at[at + WINDOW <= self.last]

    def docs(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.offsets, at, "right") - 1

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the windows that start at these words."""
        return self.names.of(at, at + WINDOW), (self.second.of(at, at + WINDOW) >> np.uint64(32)).astype(np.uint32)

    def parsed(self):
        """Of each round: the limits that survive it, and how many words before and behind them decide that."""
        n = len(self.words.starts)
        limits = np.arange(n)
        first = self.first == limits
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for level in range(1, ROUNDS + 1):
            ends = np.append(limits[1:], n)
            size = ends - limits
            name = self.names.of(limits, ends)
            half = tb.mix(name ^ np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)
            k = np.flatnonzero(~first)
            k = k[(name[k - 1] != name[k]) & ((half[k - 1] == 1) | (half[k] == 0))]
            after_left, after_right = np.append(left, min(level - 1, 1)), np.append(right, min(level - 1, 1))
            new_left = np.maximum(np.maximum(left[k], size[k - 1] + left[k - 1]), after_left[k + 1] - size[k])
            new_right = np.maximum(np.maximum(right[k], size[k] + after_right[k + 1]), right[k - 1] - size[k - 1])
            yield limits[k], new_left, new_right
            left[k], right[k] = new_left, new_right
            left[first] = right[first] = 1  # elsewhere, what stands beyond a text's ends would decide these
            stay = first.copy()
            stay[k] = True
            limits, first, left, right = limits[stay], first[stay], left[stay], right[stay]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The key of each window's anchor, and the keys of all anchors, each place once."""
        n = len(self.words.starts)
        of, done, offered = np.full(n, np.iinfo(np.uint64).max), np.zeros(n, bool), []
        if not len(self.windows):
            return of[:0], of[:0]
        for level, (x, left, right) in enumerate(self.parsed()):
            fits = (left + right >= LEAST) & (left + right <= WINDOW)
            x, left, right = x[fits], left[fits], right[fits]
            low, high = np.maximum(x + right - WINDOW, self.first[x]), np.minimum(x - left, self.last[x] - WINDOW)
            some = high >= low
            x, left, right, low, high = x[some], left[some], right[some], low[some], high[some]
            key = tb.mix(self.names.of(x - left, x) * np.uint64(0xD6E8FEB86659FD93) + self.names.of(x, x + right) + np.uint64(level))
            count = high - low + 1
            source = np.repeat(np.arange(len(x)), count)
            window = low[source] + np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
            np.minimum.at(of, window, key[source])
            done[window] = True
            offered.append((window, source, key))
        used = [key[np.unique(source[of[window] == key[source]])] for window, source, key in offered]
        alone = self.windows[~done[self.windows]]
        of[alone] = tb.mix(self.names.of(alone, alone + WINDOW))
        return of[self.windows], np.concatenate([*used, of[alone]])


def _segments(keys: np.ndarray, n: int) -> np.ndarray:
    """Segment numbers of 64-bit keys, in their order."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _u64(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _packed(ids: list, texts: list) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_string())], names=["doc_id", "text"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> tuple[pa.Array, pa.Array]:
    t = pa.ipc.open_stream(raw).read_all()
    return (t.column(c).combine_chunks() for c in ("doc_id", "text"))


def _blocks():
    names = [f.split()[0] for f in _BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def packed() -> pa.RecordBatch:
            found = [Words(own, False).anchors()[1] for _, _, own in tb.slices(pa.array(texts, pa.large_string()))]
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            values = [block, _packed(ids, texts), keys.tobytes(), (counts > 1).tobytes(), len(keys)]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

        for batch in batches:
            pa.default_memory_pool().release_unused()
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                held += 16 + len(texts[-1])
                if held >= BLOCK_BYTES:
                    yield packed()
                    block, ids, texts, held = block + 1, [], [], 0
        if ids:
            yield packed()

    return run


def _by_block(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, bucketed by block, so that what belongs to a block comes to it and not it to that."""
    spark, name = df.sparkSession, f"ordina_blocks_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.format("parquet").option("path", fresh_path(spark, "repeats")).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay
    return out


def _key_parts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _parts(block, _u64(keys), n, flag=np.frombuffer(twice, bool))

    return run


def _parts(block: int, keys: np.ndarray, n: int, b: np.ndarray | None = None, c: np.ndarray | None = None, flag: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each segment that a block's sorted keys touch."""
    of = _segments(keys, n)
    cut = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(of))[: len(cut)]
    cols = [[None if x is None else x[i:j].tobytes() for i, j in zip(cut, ends, strict=True)] for x in (keys, b, c, flag)]
    if len(cut):
        yield pa.RecordBatch.from_arrays([pa.array(of[cut].astype(np.int32)), pa.array(np.full(len(cut), block)), *(pa.array(x, pa.binary()) for x in cols)], names=["segment", "block", "a", "b", "c", "flag"])


def _joined(part: pa.Table) -> tuple[np.ndarray, ...]:
    """Blocks, keys, second keys, ids and flags of a segment's rows."""
    raw = {c: part.column(c).to_pylist() for c in ("block", "a", "b", "c", "flag")}
    whole = lambda c, kind: np.frombuffer(b"".join(x or b"" for x in raw[c]), kind)
    return np.repeat(np.array(raw["block"], np.int64), [len(x) // 8 for x in raw["a"]]), whole("a", np.uint64), whole("b", np.uint32), whole("c", np.int64), whole("flag", bool)


_BACK_ARROW = pa.schema([("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _returned(blocks: np.ndarray, keys: np.ndarray, b: np.ndarray | None = None, c: np.ndarray | None = None) -> pa.Table:
    """One row for each block: its keys in order."""
    order = np.lexsort((keys, blocks))
    blocks = blocks[order]
    cut = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(blocks))[: len(cut)]
    cols = [[None if x is None else x[order[i:j]].tobytes() for i, j in zip(cut, ends, strict=True)] for x in (keys, b, c)]
    return pa.table([pa.array(blocks[cut]), *(pa.array(x, pa.binary()) for x in cols)], schema=_BACK_ARROW)


def _repeated_anchors(part: pa.Table) -> pa.Table:
    blocks, keys, _, _, twice = _joined(part)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    counts = counts + np.bincount(inverse, weights=twice)
    keep = counts[inverse] > 1
    return _returned(blocks[keep], keys[keep])


def _repeated_windows(part: pa.Table) -> pa.Table:
    blocks, keys, second, ids, more = _joined(part)
    order = np.lexsort((second, keys))
    k, s = keys[order], second[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
    count = np.diff(np.append(first, len(k)))
    least, many = np.minimum.reduceat(ids[order], first), np.logical_or.reduceat(more[order], first) | (count > 1)
    smallest, keep = np.empty(len(k), np.int64), np.empty(len(k), bool)
    smallest[order], keep[order] = np.repeat(least, count), np.repeat(many, count)
    keep &= more | (smallest < ids)  # a block whose only place is the first one loses nothing
    return _returned(blocks[keep], keys[keep], second[keep], smallest[keep])


def _back_of(rows: pa.Table) -> list[np.ndarray]:
    """What came back to a block: keys in order (segments follow each other), with what stands beside them."""
    kinds = {"a": np.uint64, "b": np.uint32, "c": np.int64}
    cols = [np.frombuffer(b"".join(x or b"" for x in rows.column(c).to_pylist()), kind) for c, kind in kinds.items()]
    order = np.lexsort((cols[1], cols[0])) if len(cols[1]) else np.argsort(cols[0])
    return [c[order] if len(c) else c for c in cols]


def _found(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of values among sorted keys, -1 where they are not."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _suspects(n: int):
    """A block's windows whose anchors occur elsewhere, once each with the smallest doc_id that holds them."""

    def run(key, docs: pa.Table, back: pa.Table) -> pa.Table:
        anchors = _back_of(back)[0]
        out = []
        for packed in docs.column("docs").to_pylist():
            ids, texts = _unpacked(packed)
            ids = ids.fill_null(NO_ID).to_numpy()
            for i, _, own in tb.slices(texts):
                words = Words(own)
                at = words.windows[_found(anchors, words.anchors()[0]) >= 0]
                out.append((*words.keys(at), ids[i + words.docs(at)]))
        if not out:
            return _PART_ARROW.empty_table()
        keys, second, ids = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((second, keys))
        keys, second, ids = keys[order], second[order], ids[order]
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (second[1:] != second[:-1]))[: len(keys)])
        if not len(first):
            return _PART_ARROW.empty_table()
        parts = _parts(key[0].as_py(), keys[first], n, second[first], np.minimum.reduceat(ids, first), np.diff(np.append(first, len(keys))) > 1)
        return pa.Table.from_batches(parts).cast(_PART_ARROW)

    return run


_PART_ARROW = pa.schema([("segment", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("flag", pa.binary())])


def _places(back: list[np.ndarray], keys: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of windows among those that came back, -1 where they are not; both keys must agree."""
    at = _found(back[0], keys)
    there = at >= 0
    while there.any():  # more than once only where different windows share the first key
        odd = np.flatnonzero(there)
        odd = odd[back[1][at[odd]] != second[odd]]
        if not len(odd):
            break
        at[odd] += 1
        out = (at[odd] >= len(back[0])) | (back[0][np.minimum(at[odd], len(back[0]) - 1)] != keys[odd])
        at[odd[out]] = -1
        there[:] = False
        there[odd[~out]] = True
    return at


def removed_words(words: Words, ids: np.ndarray, back: list[np.ndarray]) -> np.ndarray:
    """Flags of the words that repeated windows cover; ids: of each document, NO_ID for none."""
    at = words.windows
    place = _places(back, *words.keys(at))
    at, place = at[place >= 0], place[place >= 0]
    doc = words.docs(at)
    earlier = back[2][place] < ids[doc] if len(place) else np.zeros(0, bool)
    earlier &= ids[doc] != NO_ID
    _, firsts = np.unique(doc * (len(back[0]) + 1) + place, return_index=True)
    again = np.ones(len(at), bool)
    again[firsts] = False
    return tb.covered(len(words.words.starts), at[earlier | again], WINDOW)


def kept_bytes(words: Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: bytes, and the documents' offsets in them."""
    own, data = words.words, np.append(words.texts.data, np.uint8(0x20))
    kept = np.flatnonzero(~gone)
    doc = words.docs(kept)
    inner = np.append(doc[1:] == doc[:-1], False)[: len(kept)]  # a kept word of the document follows
    steps = np.zeros(len(data) + 1, np.int8)
    steps[own.starts[kept]] += 1
    np.add.at(steps, own.ends[kept] + inner, -1)
    data[own.ends[kept[inner]]] = 0x20
    flags = np.cumsum(steps[:-1], dtype=np.int8) > 0
    return data[flags], np.concatenate([[0], np.cumsum(flags)])[words.texts.offsets]


def _results(texts_too: bool):
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int32()))]
    schema = pa.schema(fields + [("kept", pa.string())] * texts_too)

    def run(key, docs: pa.Table, back: pa.Table) -> pa.Table:
        found, out = _back_of(back), []
        for packed in docs.column("docs").to_pylist():
            ids, texts = _unpacked(packed)
            numbers = ids.fill_null(NO_ID).to_numpy()
            for i, j, own in tb.slices(texts):
                words = Words(own)
                gone = removed_words(words, numbers[i:j], found)
                data, cut = kept_bytes(words, gone)
                raw = [data[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                edges = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
                starts, offsets = np.flatnonzero(edges != 0), words.words.offsets
                runs = []
                for d in np.flatnonzero(tb.flag_sums(gone, offsets)):  # a run that goes on into the next text is cut here
                    a, b = offsets[d], offsets[d + 1]
                    mine = starts[(starts > a) & (starts < b)] - a
                    mine = np.concatenate([[0] if gone[a] else [], mine, [b - a] if gone[b - 1] else []])
                    runs.append((d, mine.astype(np.int32)))
                removed: list = [np.zeros(0, np.int32)] * (j - i)
                for d, mine in runs:
                    removed[d] = mine
                cols = [ids.slice(i, j - i), pa.array(words.words.counts()), pa.array(tb.flag_sums(gone, offsets)), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(removed, pa.list_(pa.int32()))]
                out.append(pa.table(cols + [pa.array([r.decode("utf-8", "replace") for r in raw])] * texts_too, schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def repeats(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, digest of the kept words, `removed` (first and last-plus-one word of each removed
    run, in turn), and with texts also `kept`, the words that stay, joined by one space."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _by_block(mapped(rows, _blocks(), _BLOCK))
    total = blocks.agg(F.sum("n_keys").alias("n")).first()["n"] or 0
    n = max(16, int(total) // SEGMENT_KEYS)
    own = blocks.select("block", "docs")
    by_segment = mapped(blocks.select("block", "keys", "twice"), _key_parts(n), _PART).groupBy("segment")
    anchors = by_segment.applyInArrow(_repeated_anchors, _BACK)
    suspects = own.groupBy("block").cogroup(anchors.select(F.col("block").alias("of"), "a", "b", "c").groupBy("of")).applyInArrow(_suspects(n), _PART)
    windows = suspects.groupBy("segment").applyInArrow(_repeated_windows, _BACK)
    return own.groupBy("block").cogroup(windows.select(F.col("block").alias("of"), "a", "b", "c").groupBy("of")).applyInArrow(_results(texts), RESULT + ", kept string" * texts)


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("removed")


REPEATS_SQL = r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
 p AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS s FROM d)),
 k AS (SELECT g, min(doc_id) AS least FROM p GROUP BY g HAVING count(*) > 1),
 f AS (SELECT doc_id, g, min(s) AS first FROM p GROUP BY doc_id, g),
 r AS (SELECT p.doc_id, p.s FROM p JOIN k ON p.g = k.g JOIN f ON p.doc_id = f.doc_id AND p.g = f.g WHERE least < p.doc_id OR first < p.s),
 c AS (SELECT doc_id, list(DISTINCT place) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS place FROM r) GROUP BY doc_id),
 q AS (SELECT d.doc_id, i, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) u(i) ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM c) z ON d.doc_id = z.doc_id AND u.i = z.i),
 t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM q GROUP BY doc_id)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
 FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""
