"""Operator 12: items joined to the lines of other items whose unit price is near theirs (a sweep line).

A line's unit price u and an item's price p are whole cents; an item's band is [p - w, p + w] with w the larger of 10 and
p / 500. Bands' starts, prices and ends and the lines' prices are events on one axis, sorted as a whole.

* Lines of one u become one event: how many there are, the sum of their checksums, and the few lines that can be among
  anyone's first pairs (`Best`: ten by order, five of one item at most). Tasks reduce their own lines before the shuffle.
* Items of one price share a band, so each price sweeps once; their own lines are taken off afterwards.
* The axis is cut into RANGES at quantiles; a sweep streams through its range in order. Running totals of the ranges before
  (one row a range) come first, so every event knows the totals of all lines before it; a band's counts and sums are
  differences of them. A band that reaches over a cut appears in each range it touches.
* The sweep keeps the nearest lines passed (`Best` again) and the set of active bands, which collect the lines that
  follow and leave when they have enough or end. Neither grows with the input.
* An item's own lines in its band come from a join: lines are summed by item and u first, then meet their item's band by
  item and slot of prices, so neither an item of very many lines nor one of very many prices is one task's work.

Nothing that grows goes through one task, the driver (RANGES cuts) or a broadcast (RANGES totals).

Defined results: lines null in sale_id, item_id, quantity or amount, of no quantity or of no finite amount, and items null
in item_id or price (or of no finite price) never pair. A null line_no sorts first and is written as nothing in the checksum. Repeated
lines each count and take a rank each; each row of `items` gives its own rows. Ties in gap go by u, sale_id, line_no,
line_item_id. Items without pairs give one row of rank 0; without items there are no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, stored, table

RANGES = 64
TOP = 5
#: Stands for a null line_no inside of the sweep.
NO_LINE = -(1 << 40)
CHUNK = 300_000

_REDUCED = "u bigint, n bigint, crc bigint, sale_id bigint, line_no bigint, item_id bigint"
_SWEPT = "p bigint, n bigint, gap_sum bigint, crc bigint, near array<struct<gap:bigint,u:bigint,sale_id:bigint,line_no:bigint,line_item_id:bigint>>"
# kinds of events at one place of the axis, in their order
TOTALS, HEAD, START, LINE, PRICE, END, TAIL = range(7)


def cents(c: Column) -> Column:
    finite = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 9e13)
    return F.when(finite, F.floor(100 * c + 0.5).cast("bigint"))


def priced_lines(lines: DataFrame) -> DataFrame:
    """Lines that can pair: u, sale_id, line_no, item_id and the checksum of the last three."""
    sign = F.when(F.col("quantity") < 0, -1).otherwise(1).cast("bigint")
    q, a = F.col("quantity").cast("bigint") * sign, cents(F.col("amount").cast("double")) * sign
    ids = [F.col(c).cast("bigint").alias(c) for c in ("sale_id", "line_no", "item_id")]
    rows = lines.where("sale_id is not null and item_id is not null and quantity is not null and quantity <> 0 and amount is not null").select((2 * a + q).alias("__n"), (2 * q).alias("__d"), *ids)
    u = F.expr("(__n - pmod(__n, __d)) div __d")
    text = F.concat(F.col("sale_id").cast("string"), F.lit(","), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.lit(","), F.col("item_id").cast("string"))
    return rows.where("__n is not null").select(u.alias("u"), "sale_id", F.coalesce("line_no", F.lit(NO_LINE)).alias("line_no"), "item_id", F.crc32(text).alias("crc"))


def bands(items: DataFrame) -> DataFrame:
    """item_id and p of each row, p null where it never pairs."""
    p = F.when(F.col("item_id").isNotNull(), cents(F.col("price").cast("double")))
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), p.alias("p"))


_WIDTH = "greatest(10, p div 500)"


def best(rows: np.ndarray, top: int = TOP) -> np.ndarray:
    """The rows (u, sale_id, line_no, item_id) that can be among the first `top` of anyone's pairs at their u, in order: of
    each u the first 2 * top, not counting more than `top` of one item. Whatever item is left out, `top` others (or all) remain."""
    order = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
    rows = rows[:, order]
    by_item = np.lexsort((rows[3], rows[0]))  # stable: keeps the order inside
    of = rows[:, by_item]
    keep = np.empty(rows.shape[1], bool)
    keep[by_item] = _rank(np.append(True, (of[0, 1:] != of[0, :-1]) | (of[3, 1:] != of[3, :-1]))[: rows.shape[1]]) < top
    rows = rows[:, keep]
    return rows[:, _rank(np.append(True, rows[0, 1:] != rows[0, :-1])[: rows.shape[1]]) < 2 * top]


def _rank(first: np.ndarray) -> np.ndarray:
    """Place of each entry in its group, of which the first entries are flagged."""
    at = np.arange(len(first))
    return at - np.maximum.accumulate(np.where(first, at, 0))


class Reducer:
    """Sums by u and the best lines of each u, of all batches."""

    def __init__(self) -> None:
        self.kept = np.zeros((4, 0), np.int64)
        self.sums = np.zeros((3, 0), np.int64)  # u, n, crc
        self.wait: list[np.ndarray] = []
        self.size = 0

    def add(self, rows: np.ndarray) -> None:
        """rows: u, n, crc, sale_id, line_no, item_id."""
        self.wait.append(rows)
        self.size += rows.shape[1]
        if self.size >= CHUNK:
            self.flush()

    def flush(self) -> None:
        if not self.wait:
            return
        rows = np.concatenate(self.wait, 1)
        self.wait, self.size = [], 0
        self.sums = _summed(np.concatenate([self.sums, _summed(rows[:3])], 1))
        lines = rows[[0, 3, 4, 5]]
        if self.kept.shape[1]:
            first = np.flatnonzero(np.append(True, self.kept[0, 1:] != self.kept[0, :-1]))
            full = np.diff(np.append(first, self.kept.shape[1])) == 2 * TOP
            last = np.where(full, self.kept[1, np.minimum(first + 2 * TOP - 1, self.kept.shape[1] - 1)], np.iinfo(np.int64).max)
            values = self.kept[0, first]
            at = np.minimum(np.searchsorted(values, lines[0]), len(values) - 1)
            lines = lines[:, (values[at] != lines[0]) | (lines[1] <= last[at])]
        self.kept = best(np.concatenate([self.kept, lines], 1))

    def result(self) -> np.ndarray:
        """One row a kept line; the sums stand at the first line of each u."""
        self.flush()
        n, crc = np.zeros(self.kept.shape[1], np.int64), np.zeros(self.kept.shape[1], np.int64)
        first = np.flatnonzero(np.append(True, self.kept[0, 1:] != self.kept[0, :-1])[: self.kept.shape[1]])
        n[first], crc[first] = self.sums[1], self.sums[2]
        return np.stack([self.kept[0], n, crc, *self.kept[1:]])


def _summed(rows: np.ndarray) -> np.ndarray:
    if not rows.shape[1]:
        return rows
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    first = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
    return np.stack([rows[0, first], *(np.add.reduceat(r, first) for r in rows[1:])])


def reduced(rows: DataFrame) -> DataFrame:
    """Sums and best lines of each u among the rows of each task."""
    names = ("u", "n", "crc", "sale_id", "line_no", "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Reducer()
        for batch in batches:
            own.add(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        made = own.result()
        for i in range(0, made.shape[1], 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(r[i : i + 50_000]) for r in made], names=list(names))

    return mapped(rows.select(*names), run, _REDUCED)


class Sweep:
    """Events of one range in order; finished parts of bands gather in `out`."""

    def __init__(self) -> None:
        self.n = self.s = self.x = 0
        self.group: list[tuple] = []  # best lines at the current u
        self.passed: list[tuple] = []  # the nearest lines before it, nearest first
        self.active: dict[int, tuple[int, list, dict]] = {}
        self.out: list[tuple] = []

    def nearest(self) -> list[tuple]:
        """The lines passed that a band can need, nearest first."""
        if self.group:
            seen: dict[int, int] = {}
            kept = []
            for line in (*self.group, *self.passed):
                k = seen.get(line[3], 0)
                if k < TOP:
                    seen[line[3]] = k + 1
                    kept.append(line)
                    if len(kept) == 2 * TOP:
                        break
            self.passed, self.group = kept, []
        return self.passed

    def line(self, u: int, n: int, crc: int, sale: int, no: int, item: int) -> None:
        if n:
            self.nearest()
            self.n, self.s, self.x = self.n + n, self.s + u * n, self.x + crc
        line = (u, sale, no, item)
        self.group.append(line)
        done = []
        for p, (_, kept, seen) in self.active.items():
            k = seen.get(item, 0)
            if k < TOP:
                seen[item] = k + 1
                kept.append(line)
                if len(kept) == 2 * TOP:
                    done.append(p)
        for p in done:
            self.leave(p)

    def leave(self, p: int) -> None:
        found = self.active.pop(p, None)
        if found and found[1]:
            self.give(p, 0, 0, 0, found[1])

    def give(self, p: int, n: int, gap: int, crc: int, lines: list[tuple] = ()) -> None:
        self.out.append((p, n, gap, crc, [(abs(line[0] - p), *line) for line in lines]))

    def event(self, kind: int, p: int, low: int) -> None:
        if kind == START:
            self.give(p, -self.n, self.s - p * self.n, -self.x)
        elif kind == PRICE:
            self.give(p, 0, 2 * (p * self.n - self.s), 0, [x for x in self.nearest() if x[0] >= low])
            self.active[p] = (p, [], {})
        elif kind == HEAD:
            self.active[p] = (p, [], {})
        elif kind == TAIL:
            self.give(p, 0, 0, 0, [x for x in self.nearest() if x[0] >= low])
        elif kind == END:
            self.leave(p)
            self.give(p, self.n, self.s - p * self.n, self.x)

    def close(self) -> None:
        for p in list(self.active):
            self.leave(p)


_NEAR = pa.list_(pa.struct([(c, pa.int64()) for c in ("gap", "u", "sale_id", "line_no", "line_item_id")]))
_SWEPT_ARROW = pa.schema([("p", pa.int64()), ("n", pa.int64()), ("gap_sum", pa.int64()), ("crc", pa.int64()), ("near", _NEAR)])


def _given(rows: list[tuple]) -> pa.RecordBatch:
    p, n, gap, crc, near = zip(*rows, strict=True)
    counts = np.concatenate([[0], np.cumsum([len(x) for x in near])]).astype(np.int32)
    flat = np.array([line for x in near for line in x], np.int64).reshape(-1, 5)
    lines = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(5)], fields=list(_NEAR.value_type))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (p, n, gap, crc)] + [pa.ListArray.from_arrays(pa.array(counts), lines)], schema=_SWEPT_ARROW)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, own = None, Sweep()
    for batch in batches:
        for r, u, kind, n, crc, sale, no, item, p, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != at:
                own.close()
                ended = own.out
                at, own = r, Sweep()
                own.out = ended
            if kind == LINE:
                own.line(u, n, crc, sale, no, item)
            elif kind == TOTALS:
                own.n, own.s, own.x = n, sale, crc
            else:
                own.event(kind, p, low)
        if len(own.out) > 20_000:
            yield _given(own.out)
            own.out = []
    own.close()
    if own.out:
        yield _given(own.out)


def price_totals(lines: DataFrame, prices: DataFrame, ranges: int = RANGES) -> DataFrame:
    """The sweep. lines: stored rows of `reduced`, one u in one place; prices: distinct p. Per price p: n, gap_sum and crc
    over all lines in its band and `near`, which holds the first pairs of every item of that price."""
    cuts = sorted(set(lines.agg(F.percentile_approx("u", [i / ranges for i in range(1, ranges)], 1000).alias("c")).first()["c"] or []))
    below = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    range_of = lambda v: F.size(F.filter(below, lambda c: c < v))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    rows = lines.withColumn("r", range_of(F.col("u")))
    sums = rows.groupBy("r").agg(F.sum("n").alias("n"), F.sum(F.col("u") * F.col("n")).alias("s"), F.sum("crc").alias("x"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over one row a range
    # after a range's lines: the totals that every later range begins with, also ranges without lines
    upto = sums.select("r", *[F.sum(c).over(before).alias(c) for c in ("n", "s", "x")])
    # the window gives one row for each range with lines; ranges between them repeat the last one
    until = F.coalesce(F.lead("r").over(Window.orderBy("r")), F.lit(len(cuts)))
    carried = upto.withColumn("until", until).where("r < until").select(F.explode(F.sequence(F.col("r") + 1, F.col("until"))).alias("r"), "n", "s", "x")
    totals = carried.select("r", none.alias("v"), F.lit(TOTALS).alias("kind"), "n", F.col("x").alias("crc"), F.col("s").alias("sale_id"), zero.alias("line_no"), zero.alias("item_id"), none.alias("p"), none.alias("low"))
    events = rows.select("r", F.col("u").alias("v"), F.lit(LINE).alias("kind"), "n", "crc", "sale_id", "line_no", "item_id", none.alias("p"), none.alias("low"))
    w = F.expr(_WIDTH)
    own = prices.select("p", (F.col("p") - w).alias("low"), (F.col("p") + w).alias("high")).select("*", *[range_of(F.col(c)).alias(f"r_{c}") for c in ("low", "p", "high")])
    part = lambda r, kind, v: F.struct(r.alias("r"), v.alias("v"), F.lit(kind).alias("kind"))
    heads = F.transform(F.when(F.col("r_p") < F.col("r_high"), F.sequence(F.col("r_p") + 1, F.col("r_high"))).otherwise(F.array().cast("array<int>")), lambda r: part(r, HEAD, none))
    tails = F.transform(F.when(F.col("r_low") < F.col("r_p"), F.sequence(F.col("r_low"), F.col("r_p") - 1)).otherwise(F.array().cast("array<int>")), lambda r: part(r, TAIL, F.lit((1 << 62)).cast("bigint")))
    marks = F.array(part(F.col("r_low"), START, F.col("low")), part(F.col("r_p"), PRICE, F.col("p")), part(F.col("r_high"), END, F.col("high")))
    spread = own.select("p", "low", F.explode(F.concat(marks, heads, tails)).alias("e"))
    spread = spread.select("e.r", "e.v", "e.kind", zero.alias("n"), zero.alias("crc"), zero.alias("sale_id"), zero.alias("line_no"), zero.alias("item_id"), "p", "low")
    every = events.unionByName(totals).unionByName(spread).repartition("r").sortWithinPartitions("r", "v", "kind", "sale_id", "line_no", "item_id", "p")
    swept = mapped(every, _sweep, _SWEPT)
    return swept.groupBy("p").agg(F.sum("n").alias("n"), F.sum("gap_sum").alias("gap_sum"), F.sum("crc").alias("crc"), F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))


def _slot(u: Column) -> Column:
    """Numbers that rise with u, so that a band touches two or three of them: steps of 50, beyond 5000 of 0.4 percent."""
    return F.when(u < 5000, F.floor(u / 50)).otherwise(100 + F.floor(F.log(F.greatest(u, F.lit(5000)) / 5000.0) * 250)).cast("bigint")


def near_pairs(lines: DataFrame, items: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per row of items: item_id, n_pairs, gap_sum, lines_crc over all its pairs and `pairs`, the first TOP of them in order."""
    every, own = priced_lines(lines), bands(items)
    mapped_lines = reduced(every.withColumn("n", F.lit(1).cast("bigint")))
    best_lines = stored(reduced(mapped_lines.repartition("u")), "unit_prices")
    # written, so that both sides of the join by price are dealt out for it and a price of very many items can be split
    sums = stored(price_totals(best_lines, own.where("p is not null").select("p").distinct(), ranges or RANGES), "price_totals")
    slots = lambda low, high: F.explode(F.sequence(_slot(low), _slot(high)))
    near = own.where("p is not null").distinct().withColumn("__w", F.expr(_WIDTH)).withColumn("slot", slots(F.col("p") - F.col("__w"), F.col("p") + F.col("__w")))
    by_price = every.groupBy("item_id", "u").agg(F.count("*").alias("n"), F.sum("crc").alias("crc")).withColumn("slot", _slot(F.col("u")))
    met = by_price.join(near, ["item_id", "slot"]).where("u >= p - __w and u <= p + __w")
    mine = met.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(F.abs(F.col("u") - F.col("p")) * F.col("n")).alias("own_gap"), F.sum("crc").alias("own_crc"))
    out = own.join(mine, ["item_id", "p"], "left").join(sums, "p", "left")
    less = lambda a, b: (F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))).cast("bigint")
    others = F.slice(F.filter("near", lambda x: x["line_item_id"] != F.col("item_id")), 1, TOP)
    return out.select("item_id", less("n", "own_n").alias("n_pairs"), less("gap_sum", "own_gap").alias("gap_sum"), less("crc", "own_crc").alias("lines_crc"), F.coalesce(others, F.filter("near", lambda x: F.lit(False))).alias("pairs"))


def op12_band_join(spark, sf_dir: str) -> DataFrame:
    found = near_pairs(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"))
    ranked = found.select("item_id", "n_pairs", "gap_sum", "lines_crc", F.posexplode_outer("pairs").alias("place", "q"))
    line_no = F.when(F.col("q.line_no") != NO_LINE, F.col("q.line_no"))
    return ranked.select(
        "item_id", F.coalesce(F.col("place") + 1, F.lit(0)).cast("int").alias("rank"), F.col("q.gap").alias("gap"), F.col("q.u").alias("u"), F.col("q.sale_id").alias("sale_id"), line_no.alias("line_no"),
        F.col("q.line_item_id").alias("line_item_id"), "n_pairs", "gap_sum", "lines_crc",
    )


_CENTS = "CAST(floor(100 * {} + 0.5) AS BIGINT)"
BAND_SQL = f"""WITH t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
 l0 AS (SELECT sale_id, CAST(line_no AS BIGINT) AS line_no, item_id, CAST(quantity AS BIGINT) AS q, {_CENTS.format("amount")} AS a FROM sale_lines
  WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity > 0 AND amount IS NOT NULL),
 l AS (SELECT sale_id, line_no, item_id AS line_item_id, (2 * a + q) // (2 * q) AS u, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(concat(sale_id, ',', line_no, ',', item_id), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(tab[xor(c & 255, b) + 1], c >> 8)), 4294967295) AS crc FROM l0, t),
 i AS (SELECT item_id, {_CENTS.format("price")} AS p FROM items),
 b AS (SELECT item_id, p, greatest(10, p // 500) AS w FROM i WHERE p IS NOT NULL),
 j AS (SELECT b.item_id, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, crc FROM b JOIN l ON u BETWEEN p - w AND p + w AND line_item_id <> b.item_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS rank FROM j),
 s AS (SELECT item_id, count(*) AS n_pairs, CAST(sum(gap) AS BIGINT) AS gap_sum, CAST(sum(crc) AS BIGINT) AS lines_crc FROM j GROUP BY item_id)
 SELECT i.item_id, CAST(coalesce(rank, 0) AS INTEGER) AS rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0) AS n_pairs, coalesce(gap_sum, 0) AS gap_sum, coalesce(lines_crc, 0) AS lines_crc
 FROM i LEFT JOIN s ON i.item_id = s.item_id LEFT JOIN (SELECT * FROM r WHERE rank <= 5) r ON i.item_id = r.item_id"""
