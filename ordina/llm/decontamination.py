"""Operator 6: benchmark decontamination.

A generalised suffix automaton of the normalised test items is built once on the driver. Training
tokens are streamed through it, which tracks the longest match that ends at each token; words in
matches of `window` words (or of a whole shorter item) are hit. The automaton's state also names the
items that hold the window. `decontaminate` removes the hit spans and drops documents whose hit share
exceeds a limit.

Streaming is skipped where it can only give short matches: a match of n words needs n - 1 consecutive
word pairs of the items, which is found for a whole slice of texts at once. The longest match of every
run of such pairs is then tracked by the automaton alone.

Items are a reference set, not corpus data, and may still be many: they are dealt by a hash of their id to as
many parts as keep one part's words at MAX_PART_WORDS or so (one item is never split). With several parts the documents are
still scanned once: a sieve of bits knows the hashes of all windows, and of items that are shorter, together and part by part,
and names the parts that a text may hold. It misses none. Only such texts go to the automata of the parts named, which decide; texts that the sieve
passes by wrongly (one in some hundreds for each scan) come out clean. One sieve holds SIEVE_PARTS parts, so its size has a
bound (130 MB); each further SIEVE_PARTS parts are one more scan.

Removing a span joins what stood around it, so a text that was cut is scanned again until nothing is hit; all that was
removed counts towards the limit of coverage.

Defined results: null and empty texts have no words; items without a word are unused; several items
with one id count once; items with a null id are unused; ids that are no integers are strings; repeated documents get a
row each; texts of any length are read whole; empty tables give no rows, or no hits. Columns named by `keep` that clash
with a result's are passed on with `_in` at the end of their names; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .common import by_texts, fresh_path, mapped, renamed, replaced, stored, table

WINDOW = 10
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what counts as a word of an item (after A-Z became a-z)
MAX_PART_WORDS = 200_000
#: Parts in one sieve; its bits for each window, together and again by part; places of a window among them.
SIEVE_PARTS, _BITS, _PROBES = 64, 32, 3
#: A part's texts are dealt to so many tasks before they are written.
_SHARES = 64
#: Documents whose hit share is above this go; from others the hit spans go.
MAX_COVERAGE = 0.5


class SuffixAutomaton:
    """All substrings of several word sequences; built one sequence at a time."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _copy(self, p: int, q: int, w: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, q, w)
        new, p = len(self.next), last
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, q, w)
        return new

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self.extend(last, w)

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """State and length of the longest match that ends with w."""
        while state and w not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        q = self.next[state].get(w)
        return (0, 0) if q is None else (q, length + 1)

    def holder(self, state: int, n: int) -> int:
        """The state of the last n words of what `state` has read."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state


class Benchmark:
    """The automaton of the items, with what is needed to find where streaming is worth it."""

    def __init__(self, items: list[tuple[int | str, str]], window: int = WINDOW) -> None:
        self.window = window
        texts = tb.of([t for _, t in items])
        data = tb.LOWER[texts.data]
        words = tb.Texts(data, texts.offsets).words(tb.ALNUM)
        hashes = tb.word_hashes(data, words)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        self.automaton = SuffixAutomaton()
        of_item = [ids[a:b].tolist() for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
        for own in of_item:
            self.automaton.add(own)
        self.holders: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for (item, _), own in zip(items, of_item, strict=True):
            state = length = 0
            for n, w in enumerate(own, 1):
                state, length = self.automaton.step(state, length, w)
                if n >= window:
                    self.holders.setdefault(self.automaton.holder(state, window), set()).add(item)
            if 0 < len(own) < window:
                self.whole.setdefault(self.automaton.holder(state, len(own)), []).append((len(own), item))
        # chain[v]: the nearest state from v along suffix links that ends a short item, or -1
        self.chain = [-1] * len(self.automaton.next)
        for v in sorted(range(1, len(self.chain)), key=self.automaton.length.__getitem__):
            self.chain[v] = v if v in self.whole else self.chain[self.automaton.link[v]]
        pairs = [np.array(own[:-1], np.int64) * len(self.vocabulary) + np.array(own[1:], np.int64) for own in of_item if len(own) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.short: dict[int, np.ndarray] = {}
        for n in sorted({len(own) for own in of_item if 0 < len(own) < window}):
            flags = [i for i, own in enumerate(of_item) if len(own) == n]
            self.short[n] = np.unique([tb.grams(hashes[words.offsets[i] : words.offsets[i + 1]], np.array([0, n]), n)[0][0] for i in flags])
        self._seen: dict[bytes, tuple[np.ndarray, frozenset[int]]] = {}

    def ready(self) -> Benchmark:
        self._words = Lookup(self.vocabulary)
        self._pairs = Lookup(tb.mix(self.pairs.view(np.uint64)))
        self._short = {n: Lookup(h) for n, h in self.short.items()}
        return self

    def stream(self, ids: list[int]) -> tuple[np.ndarray, frozenset[int]]:
        """Which of the words are hit, and by which items."""
        key = np.array(ids, np.int32).tobytes()
        if key in self._seen:
            return self._seen[key]
        a, items, steps = self.automaton, set(), np.zeros(len(ids) + 1, np.int32)
        state = length = 0
        for i, w in enumerate(ids):
            state, length = a.step(state, length, w)
            if length >= self.window:
                items |= self.holders[a.holder(state, self.window)]
                steps[i + 1 - self.window] += 1
                steps[i + 1] -= 1
            at = self.chain[state]
            while at > 0:
                for n, item in self.whole[at]:
                    if n <= length:
                        items.add(item)
                        steps[i + 1 - n] += 1
                        steps[i + 1] -= 1
                at = self.chain[a.link[at]]
        out = np.cumsum(steps[:-1]) > 0, frozenset(items)
        if len(self._seen) > 20_000:
            self._seen.clear()
        self._seen[key] = out
        return out

    def scan(self, texts: tb.Texts) -> tuple[tb.Words, np.ndarray, dict[int, set[int]]]:
        """The words of the texts, flags of those that are hit, and the items found by text."""
        data = tb.LOWER[texts.data]
        words = tb.Texts(data, texts.offsets).words(tb.ALNUM)
        hit, items = np.zeros(len(words.starts), bool), {}
        if not len(self.vocabulary) or not len(hit):
            return words, hit, items
        hashes = tb.word_hashes(data, words)
        ids = self._words.find(hashes)
        linked = (ids[:-1] >= 0) & (ids[1:] >= 0)
        crossing = words.offsets[1:-1]
        linked[crossing[(crossing > 0) & (crossing < len(hit))] - 1] = False
        at = np.flatnonzero(linked)
        found = self._pairs.find(tb.mix((ids[at] * len(self.vocabulary) + ids[at + 1]).view(np.uint64))) >= 0
        linked[at[~found]] = False
        begins = np.append(0, np.flatnonzero(~linked) + 1)
        ends = np.append(begins[1:], len(hit))
        wanted = ends - begins >= self.window
        for n, lookup in self._short.items():
            h, _, firsts = tb.grams(hashes, words.offsets, n)
            firsts = firsts[lookup.find(h) >= 0]
            wanted[np.searchsorted(begins, firsts, "right") - 1] = True
        owners = np.searchsorted(words.offsets, begins[wanted], "right") - 1
        for b, e, d in zip(begins[wanted].tolist(), ends[wanted].tolist(), owners.tolist(), strict=True):
            flags, own = self.stream(ids[b:e].tolist())
            if own:
                hit[b:e] |= flags
                items.setdefault(d, set()).update(own)
        return words, hit, items


class Lookup:
    """Positions of 64-bit values in a sorted set, -1 for others: one table access for most values."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values if np.all(values[1:] > values[:-1]) else np.sort(values)
        self.mask = (1 << max(16, int(len(values) * 16).bit_length())) - 1
        slots = (self.values & np.uint64(self.mask)).astype(np.int64)
        self.table = np.full(self.mask + 1, -1, np.int32)
        self.table[slots[::-1]] = np.arange(len(values), dtype=np.int32)[::-1]
        self.rest = np.flatnonzero(self.table[slots] != np.arange(len(values)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.full(len(hashes), -1, np.int64)
        at = self.table[(hashes & np.uint64(self.mask)).astype(np.int64)].astype(np.int64)
        bad = np.flatnonzero((at >= 0) & (self.values[at] != hashes))
        if len(bad) and len(self.rest):
            others = self.values[self.rest]
            p = np.minimum(np.searchsorted(others, hashes[bad]), len(others) - 1)
            at[bad] = np.where(others[p] == hashes[bad], self.rest[p], -1)
        else:
            at[bad] = -1
        return at


class Bits:
    """A set of 64-bit values that says no only for values it does not hold."""

    def __init__(self, n: int) -> None:
        self.mask = (1 << max(16, int(n * _BITS).bit_length())) - 1
        self.bytes = np.zeros((self.mask + 1) >> 3, np.uint8)

    def _places(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return (tb.mix(hashes + np.uint64(k + 1)) & np.uint64(self.mask)).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for k in range(_PROBES):
            at = self._places(hashes, k)
            np.bitwise_or.at(self.bytes, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the values that it may hold."""
        left = np.arange(len(hashes))
        for k in range(_PROBES):
            at = self._places(hashes[left], k)
            left = left[(self.bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
        return left


class Sieve:
    """The parts whose windows, or whole shorter items, a text may hold."""

    def __init__(self, words: dict[int, int]) -> None:
        self.all = Bits(sum(words.values()))
        self.own = {part: Bits(n) for part, n in words.items()}
        self.lengths: set[int] = set()

    def add(self, part: int, length: int, hashes: np.ndarray) -> None:
        self.lengths.add(length)
        self.all.add(hashes)
        self.own[part].add(hashes)

    def parts(self, texts: tb.Texts) -> tuple[tb.Words, list[set[int]]]:
        data = tb.LOWER[texts.data]
        words = tb.Texts(data, texts.offsets).words(tb.ALNUM)
        out: list[set[int]] = [set() for _ in range(len(texts))]
        hashes = tb.word_hashes(data, words)
        for length in sorted(self.lengths):
            grams, _, firsts = tb.grams(hashes, words.offsets, length)
            at = self.all.find(grams)
            grams, owners = grams[at], np.searchsorted(words.offsets, firsts[at], "right") - 1
            for part, bits in self.own.items() if len(at) else ():
                for d in np.unique(owners[bits.find(grams)]).tolist():
                    out[d].add(part)
        return words, out


class Items:
    """The items of a benchmark table, in parts whose automata fit on one machine."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW) -> None:
        self.whole = isinstance(benchmark.schema["item_id"].dataType, T.IntegralType)
        kind = "bigint" if self.whole else "string"
        self.id_type = f"array<{kind}>"
        self.rows = benchmark.select(F.col("item_id").cast(kind).alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
        self.window = window
        self._words = F.sum(F.regexp_count(F.lower("text"), F.lit(_WORD)))
        self.parts = max(1, -(-(self.rows.agg(self._words).first()[0] or 0) // MAX_PART_WORDS))
        self._one: Benchmark | None = None

    def part(self, k: int) -> Benchmark:
        if self._one is None or self.parts > 1:
            own = self._dealt().where(F.col("part") == k).toArrow()
            self._one = Benchmark(list(zip(own["item_id"].to_pylist(), own["text"].to_pylist(), strict=True)), self.window)
        return self._one

    def _dealt(self) -> DataFrame:
        return self.rows.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(self.parts)).cast("int"))

    def sieves(self) -> Iterator[Sieve]:
        """One for each SIEVE_PARTS parts. Windows are hashed by Spark's tasks; the driver holds the bits."""
        window = self.window

        def windows():
            def of(texts: tb.Texts, n: int) -> dict:
                data = tb.LOWER[texts.data]
                words = tb.Texts(data, texts.offsets).words(tb.ALNUM)
                hashes, lengths, grams = tb.word_hashes(data, words), np.minimum(words.counts(), window), []
                for a, b, length in zip(words.offsets[:-1], words.offsets[1:], lengths.tolist(), strict=True):
                    grams.append(np.unique(tb.grams(hashes[a:b], np.array([0, b - a]), length)[0]).tobytes() if length else b"")
                return {"length": lengths, "grams": grams}

            return of

        for first in range(0, self.parts, SIEVE_PARTS):
            own = self._dealt().where(F.col("part").between(first, first + SIEVE_PARTS - 1))
            sieve = Sieve({r["part"]: r["n"] for r in own.groupBy("part").agg(self._words.alias("n")).collect()})
            for row in by_texts(own, ["part"], "text", "length int, grams binary", windows).where("length > 0").toLocalIterator():
                sieve.add(row["part"], row["length"], np.frombuffer(row["grams"], np.uint64))
            yield sieve


def load(benchmark: DataFrame, window: int = WINDOW) -> Items:
    return Items(benchmark, window)


def hit_runs(hit: np.ndarray) -> np.ndarray:
    """First and next-to-last flagged positions of each run, flat."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))


def matches(docs: DataFrame, items: Items, keep: list[str], text: str = "text") -> DataFrame:
    """n_words, n_hit and the sorted ids of the items found, by document."""
    if items.parts == 1:
        return by_texts(docs, keep, text, f"n_words bigint, n_hit bigint, items {items.id_type}", _counted(items.part(0)))
    own = {f"__column_{i}": f"{c}_in" if c in ("n_words", "n_hit", "items") else c for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, own, strict=True)], F.col(f"`{text}`").cast("string").alias("__body"))
    texts = _sieved(rows, list(own), items)
    union = F.aggregate(
        F.array_sort("__runs"), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], acc["end"]))).cast("bigint").alias("n"), F.greatest(acc["end"], r["b"]).alias("end")),
    )
    hits = _found(texts.where("size(__parts) > 0"), items).select("__row", union["n"].alias("n_hit"), "items")
    named = [F.col(n).alias(c) for n, c in own.items()] + [F.col("__words").alias("n_words")]
    results = [F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast(items.id_type)).alias("items")]
    clean = texts.where("size(__parts) = 0").select(*named, F.lit(0).cast("bigint").alias("n_hit"), F.array().cast(items.id_type).alias("items"))
    return clean.union(texts.where("size(__parts) > 0").join(hits, "__row", "left").select(*named, *results))


def _sieved(rows: DataFrame, names: list[str], items: Items) -> DataFrame:
    """The rows with a number (__row), the number of their words, the parts that __body may hold, and __body if there are some."""
    names, found = list(names), []
    for g, sieve in enumerate(items.sieves()):
        if g:
            rows = stored(rows, "sieved")
        rows = by_texts(rows, [*names, "__body"], "__body", f"__words_{g} bigint, __parts_{g} array<int>", _parts_of(sieve, g))
        names += [f"__words_{g}", f"__parts_{g}"]
        found.append(F.col(f"__parts_{g}"))
    parts = F.concat(*found)
    own = [F.col(n) for n in names if not n.startswith(("__words_", "__parts_"))]
    made = rows.select(*own, F.monotonically_increasing_id().alias("__row_new"), F.col("__words_0").alias("__words"), parts.alias("__parts"), F.when(F.size(parts) > 0, F.col("__body")).alias("__body"))
    return stored(made.drop("__row_new") if "__row" in names else made.withColumnRenamed("__row_new", "__row"), "sieved")


def _parts_of(sieve: Sieve, g: int):
    def work():
        def of(texts: tb.Texts, n: int) -> dict:
            words, parts = sieve.parts(texts)
            return {f"__words_{g}": words.counts(), f"__parts_{g}": [sorted(p) for p in parts]}

        return of

    return work


def _found(texts: DataFrame, items: Items) -> DataFrame:
    """__row, the hit __runs (a, b) of all parts and the sorted items, of those of the texts (__row, __body, __parts) that are hit."""
    spark = texts.sparkSession
    path = fresh_path(spark, "parts")
    dealt = texts.select("__row", "__body", F.explode("__parts").alias("__part"))
    dealt.repartition("__part", F.pmod(F.xxhash64("__row"), F.lit(_SHARES))).write.partitionBy("__part").parquet(path)
    dealt = spark.read.schema("__row bigint, __body string, __part int").parquet(path)
    out = spark.createDataFrame([], f"__row bigint, __flat array<bigint>, __items {items.id_type}")
    for k in sorted(r["__part"] for r in dealt.select("__part").distinct().collect()):  # part numbers, not texts
        own = by_texts(dealt.where(F.col("__part") == k), ["__row"], "__body", f"__flat array<bigint>, __items {items.id_type}", _runs_of(items.part(k)))
        out = out.union(stored(own.where("size(__items) > 0"), "matches"))
    gathered = out.groupBy("__row").agg(F.flatten(F.collect_list(_pairs("__flat"))).alias("__runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("items"))
    return gathered  # a row has one entry a part at most


def _pairs(runs: str) -> Column:
    """The runs of a flat array, which has some, as structs (a, b)."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(runs) / 2).cast("int") - 1), lambda i: F.struct(F.element_at(runs, 2 * i + 1).alias("a"), F.element_at(runs, 2 * i + 2).alias("b")))


def _counted(items: Benchmark):
    def work():
        own = items.ready()

        def of(texts: tb.Texts, n: int) -> dict:
            words, hit, found = own.scan(texts)
            return {"n_words": words.counts(), "n_hit": tb.flag_sums(hit, words.offsets), "items": [sorted(found.get(d, ())) for d in range(n)]}

        return of

    return work


def _runs_of(items: Benchmark):
    def work():
        own = items.ready()

        def of(texts: tb.Texts, n: int) -> dict:
            words, hit, found = own.scan(texts)
            runs = [hit_runs(hit[words.offsets[d] : words.offsets[d + 1]]) if d in found else np.zeros(0, np.int64) for d in range(n)]
            return {"__flat": runs, "__items": [sorted(found.get(d, ())) for d in range(n)]}

        return of

    return work


def without(raw: bytes, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> str:
    """The text without its hit spans, each from the first hit word to the last in a row."""
    parts, at = [], 0
    for a, b in hit_runs(hit).reshape(-1, 2):
        parts.append(raw[at : starts[a]])
        at = ends[b - 1]
    parts.append(raw[at:])
    return b"".join(parts).decode("utf-8", "replace")


def cut(items: Benchmark, text: str) -> tuple[str, int]:
    """The text without what the items hit, until nothing is hit, and how many words went."""
    gone = 0
    while True:
        own = tb.of([text])
        words, hit, _ = items.scan(own)
        if not hit.any():
            return text, gone
        gone += int(hit.sum())
        text = without(own.raw(0), words.starts, words.ends, hit)


def decontaminate(docs: DataFrame, items: Items, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """All columns of docs without hit spans in `text` (n_chars follows) and without documents hit beyond the limit."""
    own, named = renamed(docs)
    names = own.columns
    if items.parts > 1:
        out = _cut_in_parts(own.withColumn("__body", F.col(named["text"]).cast("string")), names, items)
        return replaced(docs, out.where(F.col("hits") <= max_coverage * F.col("words")), named, "now")
    part = items.part(0)

    def work():
        part.ready()

        def of(texts: tb.Texts, n: int) -> dict:
            words, hit, found = part.scan(texts)
            total, hits = words.counts(), tb.flag_sums(hit, words.offsets)
            clean: list[str | None] = [None] * n
            for d in found:
                a, b = words.offsets[d], words.offsets[d + 1]
                at = texts.offsets[d]
                clean[d], more = cut(part, without(texts.raw(d), words.starts[a:b] - at, words.ends[a:b] - at, hit[a:b]))
                hits[d] += more
            return {"now": clean, "words": total, "hits": hits}

        return of

    out = by_texts(own, names, named["text"], "now string, words bigint, hits bigint", work)
    return replaced(docs, out.where(F.col("hits") <= max_coverage * F.col("words")), named, "now")


def _cut_in_parts(rows: DataFrame, names: list[str], items: Items) -> DataFrame:
    """The rows with their words, how many of them went (hits) and the text that is left (now; null if nothing went). What the
    parts hit is removed at once, as with one part; only texts that were cut come to the next round."""
    texts = _sieved(rows, names, items)
    open_texts, rounds = texts.where("size(__parts) > 0").select("__row", "__body", "__parts"), []
    while True:
        found = _found(open_texts, items).select("__row", F.flatten(F.transform("__runs", lambda r: F.array(r["a"], r["b"]))).alias("__flat"))
        done = stored(mapped(open_texts.select("__row", "__body").join(found, "__row"), _cut_rows, "__row bigint, __body string, __gone bigint"), "cut")
        if not done.take(1):
            break
        rounds.append(done.withColumn("__round", F.lit(len(rounds))))
        open_texts = _sieved(done.select("__row", "__body"), ["__row"], items).where("size(__parts) > 0").select("__row", "__body", "__parts")
    own = [F.col(n) for n in names] + [F.col("__words").alias("words")]
    untouched = [F.lit(0).cast("bigint").alias("hits"), F.lit(None).cast("string").alias("now")]
    clean = texts.where("size(__parts) = 0").select(*own, *untouched)
    rest = texts.where("size(__parts) > 0")
    if not rounds:
        return clean.union(rest.select(*own, *untouched))
    last = reduce(DataFrame.union, rounds).groupBy("__row").agg(F.sum("__gone").alias("hits"), F.max_by("__body", "__round").alias("now"))
    return clean.union(rest.join(last, "__row", "left").select(*own, F.coalesce("hits", F.lit(0).cast("bigint")).alias("hits"), "now"))


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__row, __body, __flat: runs of hit words) to (__row, what is left of __body, how many words went)."""
    for batch in batches:
        bodies, gone = [], []
        for body, flat in zip(batch.column(1), batch.column(2), strict=True):
            own = tb.of([body.as_py()])
            words = own.words(tb.ALNUM)
            hit = np.zeros(len(words.starts), bool)
            for a, b in np.array(flat.as_py(), np.int64).reshape(-1, 2):
                hit[a:b] = True
            bodies.append(without(own.raw(0), words.starts, words.ends, hit))
            gone.append(int(hit.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(gone, pa.int64())], names=["__row", "__body", "__gone"])


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), load(table(spark, sf_dir, "benchmark")), ["doc_id"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
