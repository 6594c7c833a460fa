"""Vectorised views of text columns as UTF-8 bytes.

The operators that read every word of a corpus work on the bytes of an Arrow string column: one
lookup table says which bytes belong to words, and a polynomial hash over prefix sums gives the hash
of every word without a Python loop over words. Nulls read as empty texts. Everything is done in
slices of about a MB, so that a worker's memory does not depend on the size of a batch; a single long
text is one slice, and needs about ten times its own size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SLICE_BYTES = 1 << 20
_GROUP = 1 << 20
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _GROUP + 1)
        out = []
        for base in (BASE, INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
        if size > 8 * _GROUP:  # a giant word: not kept for later
            kept = out[0], out[1]
            _powers.clear()
            return kept
    return _powers[0], _powers[1]


def byte_set(chars: bytes = b"", ranges: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Words of the quality contracts: everything between ASCII white space.
SPACES = byte_set(b" \t\n\x0b\x0c\r")
NON_SPACE = ~SPACES
#: Words of the decontamination contract: digits, letters and everything beyond ASCII.
ALNUM = byte_set(ranges=((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Texts:
    """A run of texts: their bytes back to back and their offsets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def text(self, i: int) -> str:
        return self.raw(i).decode("utf-8", "replace")

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each text that are in the table."""
        return self.sums(table[self.data])

    def sums(self, flags: np.ndarray) -> np.ndarray:
        where = np.flatnonzero(flags)
        return np.diff(np.searchsorted(where, self.offsets)).astype(np.int64)

    def words(self, table: np.ndarray) -> Words:
        flags = table[self.data]
        return runs(flags, self.offsets)


class Words:
    """Word spans in byte positions, and the offsets of each text's words."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> None:
        self.starts, self.ends, self.offsets = starts, ends, offsets

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def texts(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def runs(flags: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of flagged bytes; none crosses from one text into the next."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[1:-1] = flags[1:] != flags[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge[:-1]) if len(flags) else np.zeros(0, np.int64)
    nexts = np.append(at[1:], len(flags))
    keep = flags[at] if len(flags) else np.zeros(0, bool)
    starts, ends = at[keep], nexts[keep]
    return Words(starts, ends, np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    starts, ends = words.starts, words.ends
    out = np.empty(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _GROUP, "right")))
        stop = int(ends[j - 1])
        power, inverse = _power_tables(stop - base + 1)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1 + seed)) * power[: stop - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out + np.uint64(seed))


def grams(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, the offsets of each text's runs, and each run's first word."""
    counts = np.maximum(np.diff(offsets) - (k - 1), 0)
    outs = np.concatenate([[0], np.cumsum(counts)])
    if len(hashes) < k:
        return np.zeros(0, np.uint64), outs, np.zeros(0, np.int64)
    n = len(hashes) - k + 1
    h = hashes[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += hashes[j : j + n]
    # a start is valid unless its run would leave the text
    ok = np.ones(n, bool)
    for j in range(1, k):
        bad = offsets[1:] - j
        ok[bad[(bad >= offsets[:-1]) & (bad < n)]] = False
    return mix(h[ok]), outs, np.flatnonzero(ok)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Flags the keys that occur twice or more."""
    flags = np.zeros(len(keys), bool)
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if len(twice):
        twice = twice[np.append(True, twice[1:] != twice[:-1])]
        sieve = np.zeros(1 << 16, bool)
        sieve[(twice & np.uint64(0xFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(sieve[(keys & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(twice, keys[maybe]), len(twice) - 1)
        flags[maybe[twice[at] == keys[maybe]]] = True
    return flags


def covered(n: int, firsts: np.ndarray, length: int) -> np.ndarray:
    """Flags of the n words that lie in any of the runs of `length` words with these first words."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, firsts, 1)
    np.add.at(steps, firsts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def flag_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flagged entries between offsets."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets)).astype(np.int64)


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end], each summed by itself, so that neighbours in a slice have no influence."""
    if not len(values):
        return np.zeros(len(starts))
    pairs = np.empty(2 * len(starts), np.int64)
    padded = np.append(values, 0).astype(np.float64)
    pairs[0::2], pairs[1::2] = starts, ends
    return np.where(ends > starts, np.add.reduceat(padded, np.minimum(pairs, len(values)))[0::2], 0.0)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES):
    """Yields (first row, row after the last, Texts) so that each holds about `limit` bytes at most."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, j, Texts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def of(texts: list[str | None]) -> Texts:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
