"""Operator 11: how the tokens of two tokenizers lie over the same bytes (elementary intervals).

A text, with a space before it, is encoded by a byte-level BPE (A) and a SentencePiece model (B). The union of both
arrays of token ends cuts the bytes into elementary intervals; a search tells the one A and the one B token that own an
interval, so each interval is one overlap (link). Where both tokens end, a group is closed.

Scale. Both tokenizers cut before a space that follows no white space (`chunks`; checked against the vocabulary when it is
loaded), so a chunk, mostly a word, is encoded and aligned once per task and looked up afterwards. Counts of id pairs are
corpus-wide: documents are worked on in blocks of BLOCK_BYTES; a block sends each of its pairs once, with the number of
its documents that hold it, the sums by pair come back to the blocks, and each block finishes its own documents. Nothing
is broadcast, a frequent pair is one row a block, and a document's links never leave its block.

Defined results: null and empty texts, and texts whose tokens' bytes are not space + text (B reads U+2581 as a space), have
no tokens: zeros, empty arrays and an empty digest. Special tokens' strings are plain text. Texts may have any length (a
chunk without spaces is one unit of work). Repeated rows are documents of their own, each counted. Ties for an A id's
highest count all are best. An empty table gives no rows. Kept columns whose names clash get `_in` at their ends.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .common import by_texts, mapped, stored, table, to_arrow

VOCABULARIES = "/opt/tokenizers"
BLOCK_BYTES = 8 << 20
#: A task's memory of chunks is dropped with the block in which it exceeds this many chunks or pairs, or bytes of groups.
MOST_CHUNKS, MOST_PAIRS, MOST_TEXT = 300_000, 1_500_000, 64 << 20
#: Longer chunks are not remembered.
LONG_CHUNK = 256
_SPACE_SIGN = "▁".encode()

DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, times array<int>"
STAGE = f"block bigint, {DOC}, codes array<bigint>, docs array<int>"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


class Alignment:
    """Ids, links and groups of consecutive chunks; offsets tell each chunk's part."""

    def __init__(self, a_ids, b_ids, ends_a, ends_b, limits) -> None:
        self.a_ids, self.b_ids = a_ids, b_ids
        ends = np.union1d(ends_a, ends_b)
        self.owner_a, self.owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        closed = np.flatnonzero((ends_a[self.owner_a] == ends) & (ends_b[self.owner_b] == ends)) if len(ends) else np.zeros(0, np.int64)
        self.closed = closed  # the last interval of each group
        at = lambda own: np.concatenate([[0], np.searchsorted(own, limits, "right")])
        self.a_offsets, self.b_offsets, self.link_offsets, self.group_offsets = at(ends_a), at(ends_b), at(ends), at(ends[closed])
        # tokens of A and of B up to the end of each group
        self.a_cut, self.b_cut = np.concatenate([[0], self.owner_a[closed] + 1]), np.concatenate([[0], self.owner_b[closed] + 1])

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """All token pairs of each group: A tokens times B tokens."""
        n_a, n_b = np.diff(self.a_cut), np.diff(self.b_cut)
        size = n_a * n_b
        group = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        return self.a_cut[group] + place // n_b[group], self.b_cut[group] + place % n_b[group]

    def group_texts(self) -> list[bytes]:
        """`a1,a2|b1` of the groups of each chunk, joined by `;`: every id's digits and the mark that follows it, written side by side."""
        n_a, n_b = np.diff(self.a_cut), np.diff(self.b_cut)
        n = len(n_a)
        ids, marks = np.empty(len(self.a_ids) + len(self.b_ids), np.int64), np.full(len(self.a_ids) + len(self.b_ids), ord(","), np.uint8)
        first = np.cumsum(n_a + n_b) - n_a - n_b
        ids[np.repeat(first - self.a_cut[:-1], n_a) + np.arange(len(self.a_ids))] = self.a_ids
        ids[np.repeat(first + n_a - self.b_cut[:-1], n_b) + np.arange(len(self.b_ids))] = self.b_ids
        marks[first + n_a - 1], marks[first + n_a + n_b - 1] = ord("|"), ord(";")
        digits = np.searchsorted(_TENS, ids, "right") + 1
        ends = np.cumsum(digits + 1)
        out = np.empty(ends[-1] if n else 0, np.uint8)
        out[ends - 1] = marks
        for k in range(int(digits.max(initial=0))):
            at = digits > k
            out[ends[at] - 2 - k] = 0x30 + ids[at] // 10**k % 10
        whole, last = out.tobytes(), np.append(0, ends)[np.append(first, len(ids))]
        cut = last[self.group_offsets].tolist()
        return [whole[x : max(x, y - 1)] for x, y in zip(cut[:-1], cut[1:], strict=True)]


_TENS = 10 ** np.arange(1, 18)


class Tokenizers:
    """Both vocabularies, loaded once per process."""

    _loaded: dict = {}

    def __init__(self, folder: str = VOCABULARIES, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{a}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b}")
        values = _byte_values()
        self.bytes_a = [bytes(values.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        self.bytes_b, inner = [], False
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            plain = not (self.b.is_control(i) or self.b.is_unknown(i))
            self.bytes_b.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode() if plain else b"")
            inner |= plain and "▁" in piece.lstrip("▁")
        #: Pieces that hold a space behind another character would cross the chunks' limits; then a text is one chunk.
        self.split = not inner
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))

    @classmethod
    def load(cls, *args: str) -> Tokenizers:
        if args not in cls._loaded:
            cls._loaded[args] = cls(*args)
        return cls._loaded[args]

    def encode(self, parts: list[bytes]) -> tuple[list, list]:
        """Ids by A and B of parts that begin with a space."""
        texts = [p.decode("utf-8", "replace") for p in parts]
        space = [self.b.piece_to_id("▁")]  # of a part that is one space: B would add its own to nothing
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)], [x if t != " " else space for x, t in zip(b, texts, strict=True)]

    def align(self, parts: list[bytes]) -> tuple[Alignment, np.ndarray]:
        """The alignment of all parts; parts whose bytes the tokens do not give have none, and are told."""
        a, b = self.encode(parts)
        good = np.array([self.same(x, y, p) for x, y, p in zip(a, b, parts, strict=True)], bool)
        flat = lambda own: np.array([i for ids, ok in zip(own, good, strict=True) if ok for i in ids], np.int64)
        return self.aligned(flat(a), flat(b), [len(p) if ok else 0 for p, ok in zip(parts, good, strict=True)]), good

    def align_chunks(self, parts: list[bytes]) -> tuple[Alignment, np.ndarray]:
        """The same for chunks that end in a character that is no white space: cuts are between them, so they are encoded as one text."""
        if parts:
            whole = b"".join(parts)
            (a,), (b,) = self.encode([whole])
            if self.same(a, b, whole):
                return self.aligned(np.array(a, np.int64), np.array(b, np.int64), [len(p) for p in parts]), np.ones(len(parts), bool)
        return self.align(parts)

    def same(self, a: list[int], b: list[int], raw: bytes) -> bool:
        return b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b])

    def aligned(self, a_ids: np.ndarray, b_ids: np.ndarray, lengths: list[int]) -> Alignment:
        return Alignment(a_ids, b_ids, np.cumsum(self.size_a[a_ids]), np.cumsum(self.size_b[b_ids]), np.cumsum(lengths))


def _byte_values() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def spaced(texts: tb.Texts) -> tb.Texts:
    """Each text with a space before it."""
    n = len(texts)
    data = np.full(len(texts.data) + n, 0x20, np.uint8)
    data[np.arange(len(texts.data)) + np.repeat(np.arange(1, n + 1), np.diff(texts.offsets))] = texts.data
    return tb.Texts(data, texts.offsets + np.arange(n + 1))


def chunks(own: tb.Texts, split: bool = True) -> tb.Words:
    """Texts cut before each space that follows no white space (of any kind: see `_white_before`)."""
    starts = own.offsets[:-1]
    if split:
        at = np.flatnonzero(own.data == 0x20)
        inside = np.ones(len(at), bool)
        inside[np.searchsorted(at, starts)] = False
        at = at[inside]
        starts = np.sort(np.concatenate([starts, at[~_white_before(own.data, at)]]))
    return tb.Words(starts, np.append(starts[1:], len(own.data)), np.searchsorted(starts, own.offsets))


def _white_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a byte up to the space, or a space character beyond ASCII, ends at each place (more are told than are white: that only joins chunks)."""
    p1, p2, p3 = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (p3 == 0xE1) & ((p2 == 0x9A) & (p1 == 0x80) | (p2 == 0xA0) & (p1 == 0x8E))
    wide |= (p3 == 0xE2) & ((p2 == 0x80) & ((p1 <= 0x8F) | (p1 >= 0xA8) & (p1 <= 0xAF)) | (p2 == 0x81) & (p1 >= 0x9F) & (p1 <= 0xAF))
    wide |= (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80) | (p3 == 0xEF) & (p2 == 0xBB) & (p1 == 0xBF)
    return (p1 <= 0x20) | wide


class Memory:
    """Chunks that a task has aligned: numbers, group texts, and links as numbers of id pairs."""

    def __init__(self, coders: Tokenizers) -> None:
        self.coders = coders
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.groups: list[bytes] = []
        self.text = 0
        self.pair_of: dict[int, int] = {}
        self.codes: list[int] = []
        self.size = np.zeros((0, 5), np.int64)  # A tokens, B tokens, groups, links, whether it is good
        self.links: np.ndarray = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def full(self) -> bool:
        return len(self.groups) > MOST_CHUNKS or len(self.codes) > MOST_PAIRS or self.text > MOST_TEXT

    def find(self, own: tb.Texts, parts: tb.Words) -> np.ndarray:
        """The number of each chunk; new ones are aligned, all together."""
        hashes = tb.word_hashes(own.data, parts)
        keys, firsts, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        numbers = np.empty(len(keys), np.int64)
        new, raw = [], []
        for i, k in enumerate(keys.tolist()):
            numbers[i] = n = self.known.get(k, -1)
            if n < 0:
                new.append(i)
                raw.append(own.data[parts.starts[firsts[i]] : parts.ends[firsts[i]]].tobytes())
        plain = [0x21 <= r[-1] < 0x80 and _SPACE_SIGN not in r and len(r) <= LONG_CHUNK for r in raw]
        for joined in (True, False):
            own_new = [k for k, p in zip(range(len(raw)), plain, strict=True) if p == joined]
            for i in range(0, len(own_new), 5_000):
                some = own_new[i : i + 5_000]
                self._add(keys, [new[k] for k in some], [raw[k] for k in some], numbers, self.coders.align_chunks if joined and self.coders.split else self.coders.align)
        return numbers[inverse]

    def _add(self, keys: np.ndarray, new: list[int], raw: list[bytes], numbers: np.ndarray, align) -> None:
        made, good = align(raw)
        codes, inverse = np.unique((made.a_ids[made.owner_a] << 32) | made.b_ids[made.owner_b], return_inverse=True)
        index = np.empty(len(codes), np.int32)
        for j, c in enumerate(codes.tolist()):
            n = self.pair_of.get(c)
            if n is None:
                n = self.pair_of[c] = len(self.codes)
                self.codes.append(c)
            index[j] = n
        self.links = np.concatenate([self.links, index[inverse]])
        self.first = np.concatenate([self.first, self.first[-1] + made.link_offsets[1:]])
        own = np.stack([*(np.diff(o) for o in (made.a_offsets, made.b_offsets, made.group_offsets, made.link_offsets)), good.astype(np.int64)], 1)
        self.size = np.concatenate([self.size, own])
        base = len(self.groups)
        texts = made.group_texts()
        self.groups += texts
        self.text += sum(map(len, texts))
        numbers[new] = np.arange(base, base + len(new))
        for j, (i, r) in enumerate(zip(new, raw, strict=True)):
            if len(r) <= LONG_CHUNK:
                self.known[int(keys[i])] = base + j


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def measured(memory: Memory, texts: tb.Texts) -> dict:
    """Of each text: token, group and link counts, digest of groups, its distinct pairs and how often each is linked."""
    n = len(texts)
    own = spaced(texts)
    parts = chunks(own, memory.coders.split)
    numbers, doc = memory.find(own, parts), parts.texts()
    good = (np.bincount(doc, weights=1 - memory.size[numbers, 4], minlength=n) == 0) & (np.diff(texts.offsets) > 0)
    sizes = np.stack([np.bincount(doc, weights=memory.size[numbers, c], minlength=n) for c in range(4)], 1).astype(np.int64) * good[:, None]
    listed, cut, digests = numbers.tolist(), parts.offsets.tolist(), []
    for i in range(n):
        digests.append(hashlib.sha256(b";".join([memory.groups[k] for k in listed[cut[i] : cut[i + 1]]])).hexdigest() if good[i] else "")
    keep = good[doc]
    held, times = np.unique(doc[keep] * len(memory.groups) + numbers[keep], return_counts=True)  # chunks of a text, once each
    doc, chunk = np.divmod(held, max(len(memory.groups), 1))
    links = memory.first[chunk + 1] - memory.first[chunk]
    key = np.repeat(doc, links) * max(len(memory.codes), 1) + memory.links[_expand(memory.first[chunk], links)]
    order = np.argsort(key)
    key, weight = key[order], np.repeat(times, links)[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    doc, pair = np.divmod(key[first], max(len(memory.codes), 1))
    return {"sizes": sizes, "digests": digests, "offsets": np.searchsorted(doc, np.arange(n + 1)), "pairs": pair.astype(np.int32), "times": np.add.reduceat(weight, first).astype(np.int32) if len(first) else np.zeros(0, np.int32)}


def _blocks(folder: str):
    """Rows of documents by block, and behind them one row with the block's pairs and their documents."""
    schema = to_arrow(T._parse_datatype_string(STAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(Tokenizers.load(folder))
        block, held, counts = TaskContext.get().partitionId() << 32, 0, np.zeros(0, np.int64)

        def summary() -> pa.RecordBatch:
            used = np.flatnonzero(counts)
            lists = {"pairs": used.astype(np.int32), "codes": np.array(memory.codes, np.int64)[used], "docs": counts[used].astype(np.int32)}
            return pa.RecordBatch.from_arrays([pa.array([lists.get(f.name, block if f.name == "block" else None)], f.type) for f in schema], schema=schema)

        for batch in batches:
            pa.default_memory_pool().release_unused()
            for i, j, texts in tb.slices(batch.column(1)):
                made = measured(memory, texts)
                seen = np.bincount(made["pairs"], minlength=len(memory.codes))
                seen[: len(counts)] += counts
                counts, held = seen, held + len(texts.data)
                n = j - i
                lists = [pa.ListArray.from_arrays(pa.array(made["offsets"], pa.int32()), pa.array(made[c], pa.int32())) for c in ("pairs", "times")]
                cols = [pa.array(np.full(n, block)), batch.column(0).slice(i, n), *(pa.array(made["sizes"][:, c]) for c in range(4)), pa.array(made["digests"], pa.string()), *lists, pa.nulls(n, schema.field("codes").type), pa.nulls(n, schema.field("docs").type)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
                if held >= BLOCK_BYTES or memory.full():
                    yield summary()
                    block, held = block + 1, 0
                    if memory.full():
                        memory.clear()
                    counts = np.zeros(len(memory.codes), np.int64)
        if held:
            yield summary()

    return run


def _finish():
    """Gives the documents of one block the corpus-wide counts of their pairs."""
    schema = to_arrow(T._parse_datatype_string(RESULT))

    def run(key, docs: pa.Table, sums: pa.Table) -> pa.Table:
        index = sums.column("pair").to_numpy()
        order = np.argsort(index)
        index, count, best = index[order], sums.column("n").to_numpy()[order], sums.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        pairs, times = (docs.column(c).combine_chunks() for c in ("pairs", "times"))
        counts = pairs.value_lengths().to_numpy().astype(np.int64)
        at, times = np.searchsorted(index, pairs.flatten().to_numpy()), times.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        best_sum, count_sum = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        np.add.at(best_sum, doc, best[at] * times)
        np.add.at(count_sum, doc, count[at] * times)
        named = {"n_best": pa.array(best_sum), "count_sum": pa.array(count_sum)}
        return pa.table([named[f.name] if f.name in named else docs.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def blocks_of(docs: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """The stored first pass over doc_id and text: documents and pairs by block."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(mapped(rows, _blocks(folder), STAGE), "aligned")


def pair_counts(stage: DataFrame) -> DataFrame:
    """a_id, b_id, n: documents corpus-wide that hold the linked pair; best: whether it is the A id's highest (ties included).
    The window is over the B ids that meet one A id: the vocabulary bounds it."""
    sent = stage.where("codes is not null").select(F.explode(F.arrays_zip("codes", "docs")).alias("p"))
    sums = sent.groupBy(F.col("p.codes").alias("code")).agg(F.sum(F.col("p.docs").cast("bigint")).alias("n"))
    a, b = F.shiftright("code", 32), F.col("code").bitwiseAND(0xFFFFFFFF)
    return sums.select("code", a.alias("a_id"), b.alias("b_id"), "n", (F.col("n") == F.max("n").over(Window.partitionBy(a))).alias("best"))


def alignment_counts(docs: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """Per document: token, group and link counts, links to an A id's best partners, the sum of pair counts, digest of groups."""
    stage = blocks_of(docs, folder)
    sums = pair_counts(stage).select("code", "n", "best")
    own = stage.where("codes is not null").select("block", F.explode(F.arrays_zip("pairs", "codes")).alias("p")).select(F.col("block").alias("of"), F.col("p.pairs").alias("pair"), F.col("p.codes").alias("code"))
    back = own.join(sums, "code").select("of", "pair", "n", "best")
    rows = stage.where("codes is null").drop("codes", "docs")
    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_finish(), RESULT)


def aligned(docs: DataFrame, keep: list[str], text: str = "text", folder: str = VOCABULARIES, level: str = "overlap") -> DataFrame:
    """The alignment itself: a_ids, b_ids; a_cut, b_cut (tokens up to each group's end); link_a, link_b (places of linked
    tokens: overlapping ones, or with level `group` every A token of a group with every B token of it)."""
    if level not in ("overlap", "group"):
        raise ValueError(f"unknown level {level}")
    names = ("a_ids", "b_ids", "a_cut", "b_cut", "link_a", "link_b")

    def work():
        coders = Tokenizers.load(folder)

        def of(texts: tb.Texts, n: int) -> dict:
            out: dict = {c: [] for c in names}
            for i in range(n):
                raw = texts.raw(i)
                made, good = coders.align([b" " + raw] if raw else [])
                link = made.products() if level == "group" else (made.owner_a, made.owner_b)
                for c, v in zip(names, (made.a_ids, made.b_ids, made.a_cut[1:], made.b_cut[1:], *link), strict=True):
                    out[c].append(v.astype(np.int32))
            return out

        return of

    return by_texts(docs, keep, text, ", ".join(f"{c} array<int>" for c in names), work)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents"))
