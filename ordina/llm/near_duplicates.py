"""Operator 8: near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five consecutive words (A-Z lower-cased, split at ASCII white space); a text of one to four
words is one shingle. A shingle weighs tf * idf with idf = 1 + min(1, ln(N / df) / ln(1 / rate)), where
df counts all documents and rate = max(RATE, LEAST / N): shingles rarer than that share the top weight
2, frequent ones go down to 1. Two texts are linked if their weighted Jaccard similarity is 0.8 or
more; classes are the connected components of links, named by their smallest doc_id.

1. df: only shingles with df > rate * N need a number, and there are at most (mean shingles a document) /
   rate of those, whatever the size of the corpus. A first scan adds up counts in a fixed hash table of
   2**22 cells; a shingle can be frequent only if its cell is, so a second scan counts just those exactly.
2. Signatures: K = 48 samples in 16 bands of 3. Light texts take K samples over all their shingles; heavy
   ones spread their shingles over K bins and take one sample in each (empty bins borrow from a fixed
   sequence of others). Texts near the limit do both, so any two similar texts share a scheme.
3. Equal texts are one vertex. The vertex of a band key that shares most keys with others is its leader; every
   vertex is verified against the leader it meets most often, which joins most groups at once, at one pair
   a member. Keys that then still hold several components (of keys with the same members, one) are answered
   exactly: all members outside a key's largest component (usually few), in blocks of BLOCK members or BLOCK_BYTES, meet all
   members of the key, in such blocks too, and a product of matrices gives their weighted overlaps. So a key costs its
   size times what is outside, and a large group is dealt to many tasks. Only links that join two components leave a
   block. Every pair that shares a key has been verified or lies inside one component; no partner, candidate or key
   is capped, and one round is enough.

Vertices are numbered by text, not by doc_id, so different texts under one doc_id stay apart.

Defined results: empty texts are one class; a null text is a class of its own; rows that repeat a doc_id
with its text get the same class; a null doc_id gets the class of its text if another document has it. A doc_id that
repeats with different texts may name several classes: class_key (the digest of the class's first text) tells them apart.
An empty table gives no rows. Columns beside doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import by_texts, mapped, renamed, stored, table
from .decontamination import Lookup

WORDS = 5
SIMILAR = 0.8
RATE, LEAST = 1e-3, 16
SAMPLES, ROWS = 48, 3
#: Total weight from which a text's shingles are spread over bins; up to 1 / SIMILAR of it they also take all samples.
HEAVY = 384.0
_CELL_BITS, _SEGMENT_BITS = 22, 16
#: A segment's counts of all tasks are first summed in so many groups.
_BRANCHES = 256
#: Members of a band key, and bytes of their vectors, in one of its blocks at most. A smaller key is dealt to SPREAD blocks
#: too, unless they would have fewer than LEAST_BLOCK members.
BLOCK, BLOCK_BYTES = 4096, 32 << 20
LEAST_BLOCK, SPREAD = 512, 6
#: Elements whose columns are in memory at once, and vertices outside the largest component.
_COLUMNS, _ROWS = 1024, 256
#: Rows of at most so many bytes are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_U = np.uint64


def shingles(texts: tb.Texts, length: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (ascending), how often each occurs, and the texts' offsets."""
    data = tb.LOWER[texts.data]
    words = texts.words(tb.NON_SPACE)
    hashes = tb.word_hashes(data, words)
    runs, offsets, _ = tb.grams(hashes, words.offsets, length)
    counts = words.counts()
    few = np.flatnonzero((counts > 0) & (counts < length))
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if len(few):
        whole = np.array([tb.grams(hashes[words.offsets[d] : words.offsets[d + 1]], np.array([0, counts[d]]), int(counts[d]))[0][0] for d in few], np.uint64)
        runs, owner = np.concatenate([runs, whole]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        runs, owner = runs[order], owner[order]
        offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    parts, tfs, bounds = [], [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = np.sort(runs[a:b])
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if b > a else np.zeros(0, np.int64)
        parts.append(own[first])
        tfs.append(np.diff(np.append(first, b - a)))
        bounds.append(bounds[-1] + len(first))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate(tfs), np.array(bounds)


class Weights:
    """idf by shingle: the frequent ones by name, the top weight for all others."""

    def __init__(self, n: int, hashes: np.ndarray, dfs: np.ndarray) -> None:
        rate = min(1.0, max(RATE, LEAST / max(n, 1)))
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        top = np.log(1 / rate) or 1.0
        self.idf = 1 + np.minimum(1, np.log(max(n, 1) / np.maximum(dfs[order], 1)) / top)

    def of(self, shingle: np.ndarray, tf: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_lookup"):
            self._lookup = Lookup(self.hashes)
        at = self._lookup.find(shingle)
        out = 2.0 * tf
        known = np.flatnonzero(at >= 0)
        out[known] = tf[known] * self.idf[at[known]]
        return out


def document_frequencies(docs: DataFrame, text: str = "text") -> Weights:
    """The weights of the corpus, from two scans."""
    n = docs.count()
    limit = max(RATE * n, LEAST)
    cells, segment = 1 << _CELL_BITS, 1 << _SEGMENT_BITS
    only = docs.select(F.col(f"`{text}`").cast("string").alias("__text"))

    def fill(batches):
        counts = np.zeros(cells, np.uint32)
        for batch in batches:
            for _, _, texts in tb.slices(batch.column(0)):
                counts += np.bincount((shingles(texts)[0] >> _U(64 - _CELL_BITS)).astype(np.int64), minlength=cells).astype(np.uint32)
        for s in range(cells // segment):
            own = counts[s * segment : (s + 1) * segment]
            if own.any():
                packed = own.astype(np.uint8) if own.max() < 256 else own
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([packed.itemsize], pa.int32()), pa.array([zlib.compress(packed.tobytes(), 1)], pa.binary())], names=["segment", "width", "counts"])

    def summed(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, width, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = np.frombuffer(zlib.decompress(raw), f"u{width}")
                sums[s] = sums.get(s, np.zeros(segment, np.int64)) + own
        return sums

    def subtotal(batches):
        for s, own in summed(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([8], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["segment", "width", "counts"])

    def total(batches):
        for s, own in summed(batches).items():
            if (own > limit).any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(own > limit).tobytes()], pa.binary())], names=["segment", "bits"])

    # a tree: the tables of all tasks are summed by segment and some tasks at a time, then by segment
    kinds = "segment int, width int, counts binary"
    counted = mapped(only, fill, kinds).withColumn("branch", F.pmod(F.spark_partition_id(), F.lit(_BRANCHES)))
    parts = mapped(mapped(counted.repartition("segment", "branch"), subtotal, kinds).repartition("segment"), total, "segment int, bits binary").toArrow()
    maybe = np.zeros(cells, bool)  # one bit for each cell reaches the driver, whatever the corpus
    for s, bits in zip(parts["segment"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        maybe[s * segment : (s + 1) * segment] = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    if not maybe.any():
        return Weights(n, np.zeros(0, np.uint64), np.zeros(0))
    sieve = np.packbits(maybe)

    def recount(batches):
        open_cells = np.unpackbits(sieve).astype(bool)
        for batch in batches:
            found = []
            for _, _, texts in tb.slices(batch.column(0)):
                own = shingles(texts)[0]
                found.append(own[open_cells[(own >> _U(64 - _CELL_BITS)).astype(np.int64)]])
            at, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(counts.astype(np.int64))], names=["shingle", "df"])

    frequent = mapped(only, recount, "shingle bigint, df bigint").groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") > limit).toArrow()
    return Weights(n, frequent["shingle"].to_numpy().view(np.uint64), frequent["df"].to_numpy())


def _uniform(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) from each 64-bit value."""
    return ((z >> _U(32)).astype(np.float64) + 0.5) * 2.0**-32, ((z & _U(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32


def icws(shingle: np.ndarray, log_weight: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Improved consistent weighted sampling: ln(a) of each shingle, whose smallest is the sample, and its step t."""
    z = tb.mix(shingle + _U((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))
    u1, u2 = _uniform(z)
    z = tb.mix(z + _U(0xA0761D6478BD642F))
    u3, u4 = _uniform(z)
    beta, _ = _uniform(z * _U(0xE7037ED1A0B428DB) + _U(0x8EBC6AF09C88C6E3))
    r = -np.log(u1 * u2)
    t = np.floor(log_weight / r + beta)
    return np.log(-np.log(u3 * u4)) - r * (t - beta + 1), t


def _named(shingle: np.ndarray, t: np.ndarray) -> np.ndarray:
    return tb.mix(shingle ^ tb.mix(t.astype(np.int64).view(np.uint64)))


_probes = np.stack([np.random.default_rng(1000 + k).permutation(SAMPLES) for k in range(SAMPLES)])


def samples_of_all(shingle: np.ndarray, weight: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """K samples over all shingles of each text; every text has some."""
    out = np.empty((len(starts), SAMPLES), np.uint64)
    log_weight = np.log(weight)
    for k in range(SAMPLES):
        a, t = icws(shingle, log_weight, k + 1)
        least = np.repeat(np.minimum.reduceat(a, starts), lengths)
        at = np.flatnonzero(a == least)
        at = at[np.searchsorted(at, starts)]
        out[:, k] = _named(shingle[at], t[at])
    return out


def samples_of_bins(shingle: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One sample in each of K bins of each text's shingles; every text has some shingle."""
    a, t = icws(shingle, np.log(weight), 0)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    cell = owner * SAMPLES + (tb.mix(shingle ^ _U(0x5851F42D4C957F2D)) % _U(SAMPLES)).astype(np.int64)
    order = _by_cell(cell, a)
    cells = cell[order]
    first = order[np.append(True, cells[1:] != cells[:-1])]
    out, filled = np.zeros(len(lengths) * SAMPLES, np.uint64), np.zeros(len(lengths) * SAMPLES, bool)
    out[cell[first]], filled[cell[first]] = _named(shingle[first], t[first]), True
    out, filled = out.reshape(-1, SAMPLES), filled.reshape(-1, SAMPLES)
    done, donor = filled.copy(), out.copy()
    for j in range(SAMPLES):
        if done.all():
            break
        source = _probes[:, j]
        take = ~done & filled[:, source]
        out[take] = tb.mix(donor[:, source] + _U(1))[take]
        done |= take
    return out


def _by_cell(cell: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Order by cell, then a (as a 32-bit float whose bits sort like its value)."""
    bits = a.astype(np.float32).view(np.uint32)
    bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))
    return np.argsort((cell.astype(np.uint64) << _U(32)) | bits, kind="stable")


def bands(sampled: np.ndarray, scheme: int) -> np.ndarray:
    out = []
    for b in range(SAMPLES // ROWS):
        h = np.full(len(sampled), (scheme * 1000 + b + 1), np.uint64)
        for j in range(ROWS):
            h = tb.mix(h) + sampled[:, b * ROWS + j]
        out.append(tb.mix(h))
    return np.stack(out, axis=1).view(np.int64)


def signatures(texts: tb.Texts, weights: Weights) -> tuple[list[np.ndarray], np.ndarray]:
    """Band keys of each text, 16 for each scheme it takes part in, and how many shingles it has with repeats."""
    shingle, tf, offsets = shingles(texts)
    weight = weights.of(shingle, tf)
    lengths = np.diff(offsets)
    totals = tb.segment_sums(weight, offsets[:-1], offsets[1:])
    keys: list[list[np.ndarray]] = [[] for _ in range(len(texts))]
    for scheme, picked in ((1, (lengths > 0) & (totals <= HEAVY / SIMILAR + 1)), (2, totals >= HEAVY - 1)):
        own = np.flatnonzero(picked)
        if not len(own):
            continue
        inside = np.repeat(picked, lengths)
        counts = lengths[own]
        starts = np.cumsum(counts) - counts
        sampled = samples_of_all(shingle[inside], weight[inside], starts, counts) if scheme == 1 else samples_of_bins(shingle[inside], weight[inside], counts)
        for d, row in zip(own.tolist(), bands(sampled, scheme), strict=True):
            keys[d].append(row)
    sizes = tb.segment_sums(tf, offsets[:-1], offsets[1:]).astype(np.int64)
    return [np.concatenate(k) if len(k) > 1 else k[0] if k else np.zeros(0, np.int64) for k in keys], sizes


def vectors(texts: tb.Texts, weights: Weights) -> tuple[list[bytes], list[bytes]]:
    """Each text's vector: an element for every occurrence of a shingle (32 bits of a hash, ascending) and the elements'
    weights. A shingle that occurs n times has n elements, so the overlap of two vectors is a sum over common elements."""
    shingle, tf, offsets = shingles(texts)
    idf = (weights.of(shingle, tf) / tf).astype(np.float32)
    at = np.repeat(np.arange(len(shingle)), tf)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(tf) - tf, tf)
    element = (shingle[at] ^ np.where(nth > 0, tb.mix(nth.astype(np.uint64)), _U(0))).astype(np.uint32)
    weight = idf[at]
    bounds = np.append(0, np.cumsum(tf))[offsets].tolist()
    elements, own = [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        order = np.argsort(element[a:b], kind="stable")
        elements.append(element[a:b][order].tobytes())
        own.append(weight[a:b][order].tobytes())
    return elements, own


def similarity(x: np.ndarray, u: np.ndarray, y: np.ndarray, v: np.ndarray) -> float:
    """Weighted Jaccard similarity of two vectors (ascending elements, their weights)."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    if len(x) > len(y):
        x, y, u, v = y, x, v, u
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    least = float(np.minimum(u[both], v[at[both]]).sum(dtype=np.float64))
    return least / (float(u.sum(dtype=np.float64)) + float(v.sum(dtype=np.float64)) - least)


def _answers(pairs: DataFrame, threshold: float) -> DataFrame:
    """For rows of (vid, other, both vectors): the pairs that are similar enough, and how similar they are."""

    def run(batches):
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            own = [[np.frombuffer(c[n][i].as_buffer(), kind) for n, kind in (("elements", np.uint32), ("weights", np.float32), ("other_elements", np.uint32), ("other_weights", np.float32))] for i in range(batch.num_rows)]
            alike = np.array([similarity(*v) for v in own])
            near = np.flatnonzero(alike >= threshold)
            yield pa.RecordBatch.from_arrays([c["vid"].take(near), c["other"].take(near), pa.array(alike[near])], names=["vid", "other", "similarity"])

    return mapped(pairs.select("vid", "other", "elements", "weights", "other_elements", "other_weights"), run, "vid bigint, other bigint, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(vid, component) of every vertex with an edge: alternating large and small stars until all are stars. The
    smallest neighbours are written before they are joined, so that adaptive execution can split a hub."""
    now = edges.select(F.greatest("vid", "other").alias("u"), F.least("vid", "other").alias("v")).where("u != v").distinct()
    while True:
        both = now.union(now.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = stored(small.where("u != v").distinct(), "edges")
        if not now.join(now.select(F.col("v").alias("u")), "u", "left_semi").take(1):
            break
    stars = now.select(F.col("u").alias("vid"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("vid"), "component").distinct())


def _meetings(members: DataFrame) -> DataFrame:
    """Rows of (key, vid, component, size) as they meet in groups (key, low, high): those outside their key's largest
    component, in blocks (`low`), with all members of the key, in blocks (`high`). A key of one block has its members once."""
    own = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sides = own.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("all_size"), F.max_by(F.struct("component", "n", "size"), F.struct("n", -F.col("component"))).alias("main"))
    block = F.least(F.greatest(F.col("n") / SPREAD, F.lit(LEAST_BLOCK)), F.lit(BLOCK))
    parts = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size * 8 / BLOCK_BYTES))
    lows, highs = parts(F.col("n") - F.col("main.n"), F.col("all_size") - F.col("main.size")), parts(F.col("n"), F.col("all_size"))
    met = _with(members, sides.select("key", F.col("main.component").alias("main"), lows.alias("lows"), highs.alias("highs")), "inner", "key")
    places = """inline(if(lows = 1 and highs = 1, array(struct(0L as low, 0L as high, component != main as outside, true as against)), concat(
        if(component != main, transform(sequence(0L, highs - 1), h -> struct(pmod(xxhash64(vid, 1), lows) as low, h as high, true as outside, false as against)), array()),
        transform(sequence(0L, lows - 1), l -> struct(l as low, pmod(xxhash64(vid), highs) as high, false as outside, true as against)))))"""
    return met.select("key", "vid", "component", F.expr(places))


def groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal values in these columns; only the last run of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.concat_batches([*held, batch])
        key = np.stack([whole.column(n).to_numpy() for n in names])
        starts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield whole.slice(a, b - a)
        held = [whole.slice(starts[-1])]
    if held:
        yield pa.concat_batches(held)


class Block:
    """Vectors of some vertices, for the similarity of each pair."""

    def __init__(self, vector: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.vector, n = vector, len(vector)
        self.totals = np.array([w.sum(dtype=np.float64) for _, w in vector])
        if n <= 4:
            return
        element, weight = (np.concatenate([v[i] for v in vector]) for i in (0, 1))
        owner = np.repeat(np.arange(n), [len(e) for e, _ in vector])
        order = np.argsort(element, kind="stable")
        element, self.weight, self.owner = element[order], weight[order], owner[order]
        starts = np.flatnonzero(np.append(True, element[1:] != element[:-1])) if len(element) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(element)))
        several = np.repeat(counts > 1, counts)  # elements of one vertex only are in no overlap
        self.weight, self.owner = self.weight[several], self.owner[several]
        self.column = np.repeat(np.arange(np.count_nonzero(counts > 1)), counts[counts > 1])

    def similarities(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Of each of these vertices with each of those; what is next to a threshold has to be looked at by `similarity`."""
        n = len(self.vector)
        if n <= 4:
            return np.array([[similarity(*self.vector[r], *self.vector[c]) for c in columns.tolist()] for r in rows.tolist()])
        overlap = np.zeros((len(rows), len(columns)))
        for c in range(0, int(self.column[-1]) + 1 if len(self.column) else 0, _COLUMNS):
            a, b = np.searchsorted(self.column, (c, c + _COLUMNS))
            present = np.zeros((n, _COLUMNS), np.float32)
            present[self.owner[a:b], self.column[a:b] - c] = 1
            weight = np.zeros(_COLUMNS, np.float32)
            weight[self.column[a:b] - c] = self.weight[a:b]
            overlap += (present[rows] * weight) @ present[columns].T
        union = self.totals[rows, None] + self.totals[None, columns] - overlap
        return np.where(union > 0, overlap / np.maximum(union, 1e-9), 1.0)


def joining(vids: np.ndarray, component: np.ndarray, outside: np.ndarray, against: np.ndarray, block: Block, threshold: float) -> list[tuple[int, int, float]]:
    """Links that join components of a group: each row that is outside is compared with all rows that are against and have
    another component, and a link for each component it is joined with is given unless earlier links of the group have
    joined both. Over all groups of a key, a pair of two components meets: one of them is not the largest."""
    root = np.unique(component, return_inverse=True)[1]
    columns = np.flatnonzero(against)
    out = []
    for rows in np.split(np.flatnonzero(outside), np.arange(_ROWS, np.count_nonzero(outside), _ROWS)):
        may = (block.similarities(rows, columns) >= threshold - 1e-4) & (component[rows, None] != component[None, columns])
        for k, r in enumerate(rows.tolist()):
            others = columns[may[k]]
            while len(others := others[root[others] != root[r]]):
                c = int(others[0])
                exact = similarity(*block.vector[r], *block.vector[c])
                if exact >= threshold:
                    out.append((int(vids[r]), int(vids[c]), exact))
                    root[root == root[c]] = root[r]
                others = others[1:]
    return out


def _links(members: DataFrame, threshold: float) -> DataFrame:
    """(vid, other, similarity) of the joining links under rows of (key, vid, component, low, high, outside, against, elements, weights)."""
    place = ("key", "low", "high")

    def run(batches):
        for group in groups(batches, place):
            vids, component = (group.column(n).to_numpy() for n in ("vid", "component"))
            outside, against = (group.column(n).to_numpy(zero_copy_only=False) for n in ("outside", "against"))
            if not outside.any() or not against.any() or (component == component[0]).all():
                continue
            vector = [(np.frombuffer(e.as_buffer(), np.uint32), np.frombuffer(w.as_buffer(), np.float32)) for e, w in zip(group.column("elements"), group.column("weights"), strict=True)]
            found = joining(vids, component, outside, against, Block(vector), threshold)
            if found:
                a, b, alike = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(alike, pa.float64())], names=["vid", "other", "similarity"])

    return mapped(members.repartition(*place).sortWithinPartitions(*place), run, "vid bigint, other bigint, similarity double")


def _with(rows: DataFrame, few: DataFrame, how: str, *keys: str) -> DataFrame:
    """rows joined with others on keys (nulls are equal); others that are few are broadcast, else shuffled. Their bytes
    are known from their number: all columns have a fixed width, or are digests (32 characters)."""
    own = few.toDF(*[f"__few_{c}" if c in keys else c for c in few.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__few_{k}")) for k in keys])
    width = sum(64 if f.dataType.simpleString() == "string" else 8 for f in own.schema.fields)
    return rows.join(F.broadcast(own) if own.count() * width <= BROADCAST_BYTES else own, on, how).drop(*[f"__few_{k}" for k in keys])


class Graph:
    """What is known of a corpus: `signed` (doc_id, no_text, digest) by row, `vertices` (vid, digest, doc_id: the smallest)
    by text, the `links` (vid, other, similarity) that join them, and `joined` (vid, component)."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str, threshold: float) -> None:
        rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
        weights = document_frequencies(rows)

        def sign():
            def of(texts: tb.Texts, n: int) -> dict:
                keys, sizes = signatures(texts, weights)
                return {"digest": [hashlib.md5(texts.raw(i)).hexdigest() for i in range(n)], "bands": keys, "size": sizes}

            return of

        signed = by_texts(rows.withColumn("no_text", F.col("text").isNull()), ["doc_id", "no_text"], "text", "digest string, bands array<bigint>, size bigint", sign)
        self.signed = stored(signed, "signatures")
        distinct = self.signed.where("not no_text").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("size").alias("size"))
        # numbered as they are written, so the numbers are the same wherever the table is read
        self.vertices = stored(distinct.withColumn("vid", F.monotonically_increasing_id()), "vertices")
        self.links = self.joined = None
        keys = self.vertices.select("vid", "size", F.explode("bands").alias("key"))
        common = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "common")
        shared = stored(keys.join(common, "key"), "shared")
        degree = shared.groupBy("vid").agg(F.sum("n").alias("degree"))
        leaders = stored(shared.join(degree, "vid").groupBy("key").agg(F.max_by("vid", F.struct("degree", -F.col("vid"))).alias("leader")), "leaders")
        pairs = stored(shared.join(leaders, "key").where("vid != leader").groupBy("vid", "leader").agg(F.count("*").alias("n")), "pairs")
        best = pairs.groupBy("vid").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("other"))
        heads = pairs.select(F.col("leader").alias("vid")).distinct().withColumn("head", F.lit(True))
        texts = self.vertices.select("vid", "doc_id", "digest")
        wanted = stored(best.join(heads, "vid", "full").join(texts, "vid").select("vid", "doc_id", "digest", "other", F.coalesce("head", F.lit(False)).alias("head")), "wanted")
        if not wanted.take(1):
            return

        def vector():
            def of(texts: tb.Texts, n: int) -> dict:
                return dict(zip(("elements", "weights"), vectors(texts, weights), strict=True))

            return of

        found = _with(rows.where("text is not null").withColumn("digest", F.md5("text")), wanted, "inner", "digest", "doc_id")
        made = by_texts(found, ["vid", "other", "head"], "text", "elements binary, weights binary", vector)
        if self.signed.where("not no_text").groupBy("doc_id", "digest").count().where("count > 1").take(1):
            made = made.dropDuplicates(["vid"])
        made = stored(made, "vectors")
        named = [F.col("vid").alias("other"), F.col("elements").alias("other_elements"), F.col("weights").alias("other_weights")]
        self.links = stored(_answers(made.where("other is not null").join(made.where("head").select(*named), "other"), threshold), "answers")
        self.joined = components(self.links)
        members = stored(shared.join(self.joined, "vid", "left").withColumn("component", F.coalesce("component", "vid")), "members")
        several = members.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("vid")).alias("x"), F.bit_xor(F.xxhash64("vid", F.lit(1))).alias("y"))
        several = stored(several.where("a != b").groupBy("n", "size", "x", "y").agg(F.min("key").alias("key")), "several")
        if not several.take(1):
            return
        met = _meetings(stored(_with(members.select("key", "vid", "component", "size"), several.select("key"), "left_semi", "key"), "open"))
        more = stored(_links(met.join(made.select("vid", "elements", "weights"), "vid"), threshold), "links")
        if more.take(1):
            self.links = self.links.union(more)
            self.joined = components(self.links)

    def classes(self) -> DataFrame:
        """(digest, class_id, class_key) by text: the smallest doc_id of the class, and the first digest that has it."""
        named = self.vertices.select("digest", "vid", "doc_id")
        if self.joined is None:
            return named.select("digest", F.col("doc_id").alias("class_id"), F.col("digest").alias("class_key"))
        named = stored(named.join(self.joined, "vid", "left").select("digest", "doc_id", F.coalesce("component", "vid").alias("component")), "named")
        first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("f"))
        return stored(named.join(first, "component").select("digest", F.col("f.doc_id").alias("class_id"), F.col("f.digest").alias("class_key")), "classes")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILAR) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_key (null for a null text)."""
    graph = Graph(docs, text, doc_id, threshold)
    out = graph.signed.where("not no_text").select("doc_id", "digest").join(graph.classes(), "digest").select("doc_id", "class_id", "class_key")
    return out.union(graph.signed.where("no_text").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(None).cast("string").alias("class_key")))


def verified_links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = SIMILAR) -> DataFrame:
    """The links that join the classes, between the smallest doc_ids of two texts: doc_id, other_id, similarity. Equal
    texts, and pairs that other links have joined already, have none."""
    graph = Graph(docs, text, doc_id, threshold)
    if graph.links is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, other_id bigint, similarity double")
    names = graph.vertices.select("vid", "doc_id")
    return graph.links.join(names, "vid").join(names.select(F.col("vid").alias("other"), F.col("doc_id").alias("other_id")), "other").select("doc_id", "other_id", "similarity")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns: its smallest doc_id (the first digest of several texts with that id). Rows
    without a text all stay, but for repeats of a doc_id."""
    graph = Graph(docs, "text", "doc_id", SIMILAR)
    own, named = renamed(docs)
    rows = own.withColumns({"doc_id": F.col(named["doc_id"]).cast("bigint"), "digest": F.md5(F.col(named["text"]).cast("string"))})
    gone = graph.signed.where("not no_text").select("doc_id", "digest").join(graph.classes(), "digest")
    gone = stored(gone.where("digest != class_key or not (doc_id <=> class_id)").select("doc_id", "digest").distinct(), "gone")
    kept = _with(rows, gone, "left_anti", "doc_id", "digest")
    if graph.signed.groupBy("doc_id", "digest").count().where("count > 1").take(1):
        kept = kept.dropDuplicates(["doc_id", "digest"])
    return kept.select(*[F.col(n).alias(c) for c, n in named.items()])


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
