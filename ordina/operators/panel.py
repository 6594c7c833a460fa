"""Statistics of repeated-measurement panels: score to outcome, stability, agreement, distributions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import average_ranks
from ..registry import query
from ..sources.tables import PANEL_SQL, buckets_of, panel, stored, units

#: Rates on fewer independent units than this are flagged.
LOW_SUPPORT = 30


def rnd(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def acceptance_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Occurrences, accepted ones, independent units and the rate, by key; cells of few units are flagged."""
    hit = F.col("status").startswith("accepted")
    return df.groupBy(*keys).agg(
        F.count("*").alias("occurrences"), F.count_if(hit).alias("accepted"), F.count_distinct("paper_id").alias("units"),
        rnd(F.count_if(hit) / F.count("*")).alias("rate"), (F.count_distinct("paper_id") < LOW_SUPPORT).alias("low_support"),
    )


_ACCEPTANCE = """count(*) AS occurrences, CAST(count_if(status LIKE 'accepted%') AS BIGINT) AS accepted, count(DISTINCT paper_id) AS units,
 round(count_if(status LIKE 'accepted%') / count(*), 6) AS rate, count(DISTINCT paper_id) < 30 AS low_support"""


@query("score_acceptance", f"WITH {PANEL_SQL} SELECT score, {_ACCEPTANCE} FROM panel GROUP BY score")
def score_acceptance(spark, d):
    return acceptance_by(panel(spark, d), ["score"])


@query("score_acceptance_excl_withdrawn", f"WITH {PANEL_SQL} SELECT score, {_ACCEPTANCE} FROM panel WHERE status NOT IN ('withdrawn', 'desk_rejected') GROUP BY score")
def score_acceptance_excl_withdrawn(spark, d):
    return acceptance_by(panel(spark, d).where(~F.col("status").isin("withdrawn", "desk_rejected")), ["score"])


@query("low_support_cells", f"WITH {PANEL_SQL} SELECT area, score, {_ACCEPTANCE} FROM panel GROUP BY area, score")
def low_support_cells(spark, d):
    return acceptance_by(panel(spark, d), ["area", "score"])


def with_share(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by key and their share of all rows (the window is over the few result rows)."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("share", rnd(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))


_SHARE = "count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share"


@query("score_bands", f"WITH {PANEL_SQL} SELECT CASE WHEN score < 5 THEN '<5' WHEN score = 5 THEN '=5' ELSE '>5' END AS band, {_SHARE} FROM panel GROUP BY 1")
def score_bands(spark, d):
    band = F.when(F.col("score") < 5, "<5").when(F.col("score") == 5, "=5").otherwise(">5")
    return with_share(panel(spark, d).withColumn("band", band), ["band"])


@query("within_unit_stdev", f"WITH {PANEL_SQL} SELECT count(*) AS units, round(avg(ai_stdev), 6) AS mean_stdev FROM units")
def within_unit_stdev(spark, d):
    return units(spark, d).agg(F.count("*").alias("units"), rnd(F.avg("ai_stdev")).alias("mean_stdev"))


def split_of(df: DataFrame, value: str) -> DataFrame:
    """How the rounds of a unit split: same, 4:1 or 3:2 between neighbours, or a range of two or more. Exhaustive
    and exclusive; the mode is taken from counts by value, so both aggregations are partial before the shuffle."""
    counts = df.groupBy("paper_id", value).agg(F.count("*").alias("c"))
    per = counts.groupBy("paper_id").agg((F.max(value) - F.min(value)).alias("range"), F.max("c").alias("mode_n"))
    pattern = F.when(F.col("range") == 0, "same").when(F.col("range") >= 2, "range>=2").when(F.col("mode_n") == 4, "4:1").otherwise("3:2")
    return per.withColumn("pattern", pattern)


_SPLIT = f"""WITH {PANEL_SQL}, c AS (SELECT paper_id, narrow, count(*) AS c FROM panel GROUP BY paper_id, narrow),
 p AS (SELECT paper_id, max(narrow) - min(narrow) AS r, max(c) AS m FROM c GROUP BY paper_id),
 s AS (SELECT *, CASE WHEN r = 0 THEN 'same' WHEN r >= 2 THEN 'range>=2' WHEN m = 4 THEN '4:1' ELSE '3:2' END AS pattern FROM p)"""


@query("split_patterns", f"{_SPLIT} SELECT pattern, {_SHARE} FROM s GROUP BY pattern")
def split_patterns(spark, d):
    return with_share(split_of(panel(spark, d), "narrow"), ["pattern"])


@query("range_share", f"{_SPLIT} SELECT count(*) AS units, round(avg(CASE WHEN r <= 1 THEN 1 ELSE 0 END), 6) AS share_le_1, round(avg(CASE WHEN r >= 2 THEN 1 ELSE 0 END), 6) AS share_ge_2 FROM s")
def range_share(spark, d):
    r = split_of(panel(spark, d), "narrow")
    return r.agg(F.count("*").alias("units"), rnd(F.avg((F.col("range") <= 1).cast("int"))).alias("share_le_1"), rnd(F.avg((F.col("range") >= 2).cast("int"))).alias("share_ge_2"))


@query("unit_means", f"WITH {PANEL_SQL} SELECT paper_id, round(ai_mean, 6) AS ai_mean, round(human_mean, 6) AS human_mean, round(ai_stdev, 6) AS ai_stdev FROM units")
def unit_means(spark, d):
    return units(spark, d).select("paper_id", rnd("ai_mean").alias("ai_mean"), rnd("human_mean").alias("human_mean"), rnd("ai_stdev").alias("ai_stdev"))


@query("bias_mae", f"WITH {PANEL_SQL} SELECT round(avg(ai_mean - human_mean), 6) AS bias, round(avg(abs(ai_mean - human_mean)), 6) AS mae FROM units")
def bias_mae(spark, d):
    gap = F.col("ai_mean") - F.col("human_mean")
    return units(spark, d).agg(rnd(F.avg(gap)).alias("bias"), rnd(F.avg(F.abs(gap))).alias("mae"))


@query("pearson", f"WITH {PANEL_SQL} SELECT round(corr(ai_mean, human_mean), 6) AS pearson FROM units")
def pearson(spark, d):
    return units(spark, d).agg(rnd(F.corr("ai_mean", "human_mean")).alias("pearson"))


@query(
    "spearman_avg_rank",
    f"""WITH {PANEL_SQL}, r AS (SELECT rank() OVER (ORDER BY ai_mean) + (count(*) OVER (PARTITION BY ai_mean) - 1) / 2.0 AS ra,
 rank() OVER (ORDER BY human_mean) + (count(*) OVER (PARTITION BY human_mean) - 1) / 2.0 AS rh FROM units) SELECT round(corr(ra, rh), 6) AS spearman FROM r""",
)
def spearman_avg_rank(spark, d):
    """Pearson of average ranks. The panel is read once: cut points, sizes and ranks all come from the kept means (two
    numbers a unit, on disk where memory is short; Spark drops them when the session needs the room)."""
    means = units(spark, d).select("ai_mean", "human_mean").persist()
    ranked = average_ranks(average_ranks(means, "ai_mean", "ra"), "human_mean", "rh")
    return ranked.agg(rnd(F.corr("ra", "rh")).alias("spearman"))


@query(
    "acceptance_two_denominators",
    f"""WITH {PANEL_SQL} SELECT count(*) AS units, CAST(count_if(status = 'accepted') AS BIGINT) AS accepted, round(count_if(status = 'accepted') / count(*), 6) AS rate_all,
 round(count_if(status = 'accepted') / nullif(count_if(status <> 'withdrawn'), 0), 6) AS rate_decided FROM units""",
)
def acceptance_two_denominators(spark, d):
    accepted, decided = F.count_if(F.col("status") == "accepted"), F.count_if(F.col("status") != "withdrawn")
    return units(spark, d).agg(F.count("*").alias("units"), accepted.alias("accepted"), rnd(accepted / F.count("*")).alias("rate_all"), rnd(accepted / F.nullif(decided, F.lit(0))).alias("rate_decided"))


@query("mean_histogram_closed_last", f"WITH {PANEL_SQL} SELECT CAST(least(floor(human_mean), 9) AS BIGINT) AS bin, {_SHARE} FROM units GROUP BY 1")
def mean_histogram_closed_last(spark, d):
    return with_share(units(spark, d).withColumn("bin", F.least(F.floor("human_mean"), F.lit(9)).cast("bigint")), ["bin"])


@query("status_distribution", f"WITH {PANEL_SQL} SELECT status, {_SHARE} FROM units GROUP BY status")
def status_distribution(spark, d):
    return with_share(units(spark, d), ["status"])


@query("area_distribution", f"WITH {PANEL_SQL} SELECT area, {_SHARE} FROM units GROUP BY area")
def area_distribution(spark, d):
    return with_share(units(spark, d), ["area"])


@query("area_status_rollup", f"WITH {PANEL_SQL} SELECT area, status, CAST(grouping(area) * 2 + grouping(status) AS BIGINT) AS level, count(*) AS n, round(avg(ai_mean), 6) AS ai_mean FROM units GROUP BY ROLLUP (area, status)")
def area_status_rollup(spark, d):
    return units(spark, d).rollup("area", "status").agg(F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("n"), rnd(F.avg("ai_mean")).alias("ai_mean"))


@query(
    "tail_shares_median",
    f"""WITH {PANEL_SQL} SELECT round(avg(CAST(human_mean >= 6 AS INT)), 6) AS share_6, round(avg(CAST(human_mean >= 7 AS INT)), 6) AS share_7,
 round(avg(CAST(human_mean >= 8 AS INT)), 6) AS share_8, round(median(human_mean), 6) AS median FROM units""",
)
def tail_shares_median(spark, d):
    shares = [rnd(F.avg((F.col("human_mean") >= k).cast("int"))).alias(f"share_{k}") for k in (6, 7, 8)]
    return units(spark, d).agg(*shares, rnd(F.median("human_mean")).alias("median"))


@query(
    "scale_recode",
    f"""WITH {PANEL_SQL}, u AS (SELECT paper_id, avg(CASE score WHEN 1 THEN 0 WHEN 3 THEN 2 WHEN 5 THEN 4 ELSE score END) AS m FROM panel GROUP BY paper_id)
 SELECT round(avg(m), 6) AS mean, round(avg(CAST(m >= 7 AS INT)), 6) AS share_7 FROM u""",
)
def scale_recode(spark, d):
    new = F.when(F.col("score").isin(1, 3, 5), F.col("score") - 1).otherwise(F.col("score"))
    per = panel(spark, d).groupBy("paper_id").agg(F.avg(new).alias("m"))
    return per.agg(rnd(F.avg("m")).alias("mean"), rnd(F.avg((F.col("m") >= 7).cast("int"))).alias("share_7"))


@query("mean_by_outcome", f"WITH {PANEL_SQL} SELECT status = 'accepted' AS accepted, count(*) AS units, round(avg(ai_mean), 6) AS ai_mean FROM units GROUP BY 1")
def mean_by_outcome(spark, d):
    return units(spark, d).groupBy((F.col("status") == "accepted").alias("accepted")).agg(F.count("*").alias("units"), rnd(F.avg("ai_mean")).alias("ai_mean"))


@query(
    "yearly_comparison",
    f"""WITH {PANEL_SQL}, y AS (SELECT year, count(*) AS units, avg(ai_mean) AS ai, avg(human_mean) AS human, avg(ai_stdev) AS sd,
 count_if(status = 'accepted') / count(*) AS rate FROM units GROUP BY year)
 SELECT year, units, round(ai, 6) AS ai_mean, round(human, 6) AS human_mean, round(sd, 6) AS mean_stdev, round(rate, 6) AS rate,
 round(100 * (rate - lag(rate) OVER (ORDER BY year)), 6) AS rate_change_points FROM y""",
)
def yearly_comparison(spark, d):
    y = units(spark, d).groupBy("year").agg(
        F.count("*").alias("units"), F.avg("ai_mean").alias("ai"), F.avg("human_mean").alias("human"), F.avg("ai_stdev").alias("sd"),
        (F.count_if(F.col("status") == "accepted") / F.count("*")).alias("r"),
    )
    change = 100 * (F.col("r") - F.lag("r").over(Window.partitionBy(F.lit(1)).orderBy("year")))  # over a row a year
    return y.select("year", "units", rnd("ai").alias("ai_mean"), rnd("human").alias("human_mean"), rnd("sd").alias("mean_stdev"), rnd("r").alias("rate"), rnd(change).alias("rate_change_points"))


@query(
    "stratified_sample",
    f"""WITH {PANEL_SQL}, u AS (SELECT paper_id, area, CAST(least(floor(human_mean), 9) AS BIGINT) AS band FROM units),
 s AS (SELECT area, band, count(*) AS n FROM u GROUP BY area, band), q AS (SELECT *, n * 100.0 / sum(n) OVER () AS exact FROM s),
 r AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, area, band) <= 100 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM q),
 k AS (SELECT u.paper_id, u.area, u.band, quota, row_number() OVER (PARTITION BY u.area, u.band ORDER BY (u.paper_id * 7919 + 17) % 104729, u.paper_id) AS i
 FROM u JOIN r ON u.area = r.area AND u.band = r.band) SELECT paper_id, area, band FROM k WHERE i <= quota""",
)
def stratified_sample(spark, d):
    return stratified(units(spark, d).select("paper_id", "area", F.least(F.floor("human_mean"), F.lit(9)).cast("bigint").alias("band")), ["area", "band"], "paper_id", 100)


def stratified(df: DataFrame, strata: list[str], key: str, size: int, seed: int = 17) -> DataFrame:
    """A fixed sample of `size` rows: quotas by largest remainder, members by a seeded hash of an integer key. The
    quota windows run over one row a stratum; members are picked by a window inside each stratum."""
    cells = df.groupBy(*strata).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))
    cells = cells.withColumn("exact", F.col("n") * float(size) / F.sum("n").over(every)).withColumn("floor", F.floor("exact"))
    place = F.row_number().over(every.orderBy((F.col("exact") - F.col("floor")).desc(), *strata))
    quota = cells.select(*strata, (F.col("floor") + F.when(place <= size - F.sum("floor").over(every), 1).otherwise(0)).alias("quota"))
    order = Window.partitionBy(*strata).orderBy((F.col(key) * 7919 + seed) % 104729, key)
    # the constant limit lets each task keep only its first members of a stratum before the shuffle
    first = df.withColumn("i", F.row_number().over(order)).where(F.col("i") <= size)
    return first.join(F.broadcast(quota), strata).where("i <= quota").select(*df.columns)  # one row a stratum


_DRAWS = 200


# Poisson(1): a hash in a million from which on a unit counts once, twice, ... in a draw.
_POISSON = (367879, 735759, 919699, 981012, 996340, 999406, 999917, 999990)
_HASH = "((b * 7919 + paper_id * 104729 + 12345) % 1000003 * 9973 + paper_id * 31) % 1000000"
_WEIGHT = " + ".join(f"CASE WHEN {_HASH} >= {p} THEN 1 ELSE 0 END" for p in _POISSON)
_MOMENTS = "sum(w) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * y * y) AS yy, sum(w * x * y) AS xy"
_CORR = "(xy / n - x / n * (y / n)) / sqrt((xx / n - x / n * (x / n)) * (yy / n - y / n * (y / n)))"


@query(
    "bootstrap_ci",
    f"""WITH {PANEL_SQL}, d AS (SELECT b.range AS b, u.* FROM range({_DRAWS}) b, (SELECT paper_id, ai_mean AS x, human_mean AS y FROM units) u), m AS (SELECT b, {_MOMENTS} FROM (SELECT *, {_WEIGHT} AS w FROM d) GROUP BY b),
 s AS (SELECT 'mean_gap' AS statistic, x / n - y / n AS v FROM m UNION ALL SELECT 'pearson', {_CORR} FROM m)
 SELECT statistic, count(*) AS draws, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM s GROUP BY statistic""",
)
def bootstrap_ci(spark, d):
    """95 % intervals of the mean gap and of Pearson's correlation, by resampling units."""
    return bootstrap(units(spark, d).select("paper_id", F.col("ai_mean").alias("x"), F.col("human_mean").alias("y")), {"mean_gap": "x / n - y / n", "pearson": _CORR})


@query(
    "bootstrap_spearman",
    f"""WITH {PANEL_SQL}, r AS (SELECT paper_id, rank() OVER (ORDER BY ai_mean) + (count(*) OVER (PARTITION BY ai_mean) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY human_mean) + (count(*) OVER (PARTITION BY human_mean) - 1) / 2.0::DOUBLE AS y FROM units),
 d AS (SELECT b.range AS b, r.* FROM range({_DRAWS}) b, r), m AS (SELECT b, {_MOMENTS} FROM (SELECT *, {_WEIGHT} AS w FROM d) GROUP BY b)
 SELECT 'spearman' AS statistic, count(*) AS draws, round(quantile_cont({_CORR}, 0.025), 6) AS low, round(quantile_cont({_CORR}, 0.975), 6) AS high FROM m""",
)
def bootstrap_spearman(spark, d):
    """The interval of Spearman's correlation: draws weigh the units' ranks in the whole panel, which are not ranked anew."""
    u = units(spark, d).select("paper_id", "ai_mean", "human_mean").persist()
    ranked = average_ranks(average_ranks(u, "ai_mean", "x"), "human_mean", "y")
    return bootstrap(ranked, {"spearman": _CORR})


def bootstrap(u: DataFrame, statistics: dict[str, str], draws: int = _DRAWS) -> DataFrame:
    """2.5 and 97.5 % points of statistics over `draws` resamples of the rows (paper_id, x, y). A unit's count in a draw is a
    Poisson number from a hash of both, so a draw needs no other rows: one scan, sums by draw in each task, no join."""
    drawn = u.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))).alias("b")).withColumn("w", F.expr(_WEIGHT))
    moments = drawn.groupBy("b").agg(*[F.expr(m.strip().rpartition(" AS ")[0]).alias(m.strip().rpartition(" AS ")[2]) for m in _MOMENTS.split(", ")])
    each = moments.select(F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.expr(e).alias("v")) for n, e in statistics.items()])).alias("s")).select("s.*")
    low, high = (rnd(F.percentile("v", F.lit(q))) for q in (0.025, 0.975))
    return each.groupBy("statistic").agg(F.count("*").alias("draws"), low.alias("low"), high.alias("high"))


_SEEDS, _TOLERANCE = (17, 43, 71), 0.02


@query(
    "balanced_sample",
    f"""WITH {PANEL_SQL}, u AS (SELECT paper_id, area, status, CAST(least(floor(human_mean), 9) AS BIGINT) AS band FROM units), s AS (SELECT area, band, count(*) AS n FROM u GROUP BY area, band), q AS (SELECT *, n * 100.0 / sum(n) OVER () AS exact FROM s),
 r AS (SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, area, band) <= 100 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM q),
 k AS (SELECT u.*, seed, quota, row_number() OVER (PARTITION BY seed, u.area, u.band ORDER BY (u.paper_id * 7919 + seed) % 104729, u.paper_id) AS i FROM u JOIN r ON u.area = r.area AND u.band = r.band, (SELECT unnest([{', '.join(map(str, _SEEDS))}]) AS seed)),
 p AS (SELECT * FROM k WHERE i <= quota), g AS (SELECT seed, abs(avg(CASE WHEN status = 'accepted' THEN 1.0 ELSE 0 END) - (SELECT avg(CASE WHEN status = 'accepted' THEN 1.0 ELSE 0 END) FROM u)) AS gap FROM p GROUP BY seed),
 b AS (SELECT seed FROM g ORDER BY gap > {_TOLERANCE}, CASE WHEN gap > {_TOLERANCE} THEN round(gap, 9) END, seed LIMIT 1) SELECT seed, paper_id, area, band, status FROM p WHERE seed = (SELECT seed FROM b)""",
)
def balanced_sample(spark, d):
    """A stratified sample that is drawn again while its acceptance differs from that of all by more than the tolerance."""
    u = units(spark, d).select("paper_id", "area", "status", F.least(F.floor("human_mean"), F.lit(9)).cast("bigint").alias("band"))
    return balanced(u, ["area", "band"], "paper_id", 100)


def balanced(u: DataFrame, strata: list[str], key: str, size: int, seeds: tuple[int, ...] = _SEEDS, tolerance: float = _TOLERANCE) -> DataFrame:
    """The sample of the first seed whose acceptance is within the tolerance, else of the nearest. Only rates reach the driver."""
    rate = F.avg((F.col("status") == "accepted").cast("double"))
    every = u.agg(rate).first()[0] or 0.0
    best = None
    for seed in seeds:
        sample = stratified(u, strata, key, size, seed).withColumn("seed", F.lit(seed))
        gap = abs((sample.agg(rate).first()[0] or 0.0) - every)
        if best is None or round(gap, 9) < best[0]:
            best = round(gap, 9), sample
        if gap <= tolerance:
            best = gap, sample
            break
    return best[1].select("seed", *u.columns)


_PARTS = "kind int, y double, x double, w array<bigint>, wr array<double>, below array<bigint>"


def bootstrap_ranked(u: DataFrame, key: str, draws: int = _DRAWS) -> DataFrame:
    """Spearman's correlation v of x and y in each resample b of the units, ranked anew in it. Counts of
    units in draws are those of `bootstrap`. The rank of a value in a draw is the weight below it plus half of its own. Units stream
    through partitions in the order of y, all draws of a unit at once, so they are never multiplied by the draws: a task sums weights,
    and weights times ranks of y, by x, and knows ranks from its own start on. What is in the partitions before is added to
    sums, one row a partition and draw; the first and the last y of a partition, which others may share, come apart. x is the side with fewer values."""
    u = u.select(F.col(key).cast("bigint").alias("paper_id"), *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in ("x", "y")]).where("paper_id is not null")
    n = u.agg(F.approx_count_distinct("x"), F.approx_count_distinct("y")).first()
    if n[0] > n[1]:
        u = u.withColumnsRenamed({"x": "y", "y": "x"}).select("paper_id", "x", "y")
    order = F.col("y").asc_nulls_last()
    ordered = u.repartitionByRange(buckets_of(u.sparkSession), order, "paper_id").sortWithinPartitions(order)
    hashed = ordered.select("x", "y", F.expr("paper_id * 104729 + 12345").alias("h"), F.expr("paper_id * 31").alias("k"))
    parts = stored(hashed.mapInArrow(_ranked_parts(draws), _PARTS).withColumn("part", F.spark_partition_id()), "ranked_parts")
    cells = parts.select("part", "kind", "x", "y", F.posexplode(F.arrays_zip("w", "wr", "below")).alias("b", "m")).select("part", "kind", "x", "y", F.col("b").cast("bigint").alias("b"), "m.*")
    before = Window.partitionBy("b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cells.groupBy("b", "part").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"))
    offsets = sizes.select("b", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    cells = cells.join(F.broadcast(offsets), ["b", "part"]).withColumn("off", F.col("off").cast("double"))
    inner = cells.where("kind = 0").select("b", "x", "w", F.expr("wr + off * w AS wr"), F.expr("2 * off * wr + off * off * w AS wrr"))
    squares = cells.where("kind = 2").groupBy("b").agg(F.sum("wr").alias("more"))
    same = Window.partitionBy("b", "y")
    rank = F.min(F.col("off") + F.col("below")).over(same) + (F.sum("w").over(same) + 1) / 2
    edges = cells.where("kind = 1").withColumn("r", rank).select("b", "x", "w", F.expr("w * r AS wr"), F.expr("w * r * r AS wrr"))
    every = inner.unionByName(edges).unionByName(squares.select("b", F.lit(None).cast("double").alias("x"), F.lit(0).cast("bigint").alias("w"), F.lit(0.0).alias("wr"), F.col("more").alias("wrr")))
    by_x = every.groupBy("b", "x").agg(*[F.sum(c).alias(c) for c in ("w", "wr", "wrr")])
    upto = F.sum("w").over(Window.partitionBy("b").orderBy(F.col("x").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = by_x.withColumn("rx", upto - F.col("w") + (F.col("w") + 1) / 2)
    moments = {"n": "sum(w)", "x": "sum(w * rx)", "y": "sum(wr)", "xx": "sum(w * rx * rx)", "yy": "sum(wrr)", "xy": "sum(rx * wr)"}
    return ranked.groupBy("b").agg(*[F.expr(e).alias(m) for m, e in moments.items()]).where("n > 0").select("b", F.expr(_CORR).alias("v"))


def _ranked_parts(draws: int, cells: int = 2**20, most: int = 2**21):
    """What a task knows of its units (x, y, h and k of the hash; in the order of y), as rows with one number a draw:
    kind 0, by x: the weights w, and wr, w times rank; kind 1, by x, of a run of one y at the start or end of a slice (others may go on with
    it): w, and the weight `below` the run; kind 2: w times squared ranks in wr. Ranks count from the task's start. A task
    works on slices of `cells` weights and gives out its sums by x when there are `most`."""
    points, step, slots = _POISSON, max(1, cells // draws), max(1, most // draws)

    def rows(kind, y, xs, w, wr, below):
        lists = [pa.array([[]] * len(xs) if v is None else list(v), pa.list_(t)) for v, t in ((w, pa.int64()), (wr, pa.float64()), (below, pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(xs), pa.int32()), pa.array([y] * len(xs), pa.float64()), pa.array(xs, pa.float64()), *lists], names=["kind", "y", "x", "w", "wr", "below"])

    def by(codes, *tables):
        order = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        return codes[order[starts]], *[np.add.reduceat(t[order], starts, axis=0) for t in tables]

    def run(batches):
        counts = np.searchsorted(points, np.arange(1_000_000), side="right")
        shift, below, squares, inner = np.arange(draws) * 7919, np.zeros(draws, np.int64), np.zeros(draws), {}
        for batch in batches:
            h, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "k"))
            (xs, xv), (ys, yv) = ((c.indices.to_numpy(), c.dictionary.to_pylist()) for c in (batch.column(n).dictionary_encode("encode") for n in ("x", "y")))
            for i in range(0, len(h), step):
                x, y = xs[i : i + step], ys[i : i + step]
                v = np.fmod(np.fmod(h[i : i + step, None] + shift, 1000003) * 9973 + k[i : i + step, None], 1_000_000)
                w = counts[np.maximum(v, 0)]
                starts = np.flatnonzero(np.diff(y, prepend=-1))
                sums = np.add.reduceat(w, starts, axis=0)
                lows = below + np.cumsum(sums, axis=0) - sums
                below = below + sums.sum(axis=0)
                a, z = np.append(starts, len(y))[1], starts[-1]
                for low, o in ((lows[0], slice(0, a)), (lows[-1], slice(z, len(y))))[: len(starts)]:
                    codes, own = by(x[o], w[o])
                    yield rows(1, yv[y[o][0]], [xv[c] for c in codes], own, None, [low] * len(codes))
                if a < z:
                    ranks = lows[1:-1] + (sums[1:-1] + 1) / 2
                    squares += (sums[1:-1] * ranks * ranks).sum(axis=0)
                    ranks = np.repeat(ranks, np.diff(starts[1:]), axis=0)
                    for c, *more in zip(*by(x[a:z], w[a:z], w[a:z] * ranks), strict=True):
                        inner[xv[c]] = [p + q for p, q in zip(inner[xv[c]], more, strict=True)] if xv[c] in inner else more
                if len(inner) > slots:
                    yield rows(0, None, list(inner), *zip(*inner.values(), strict=True), None)
                    inner.clear()
        if inner:
            yield rows(0, None, list(inner), *zip(*inner.values(), strict=True), None)
        yield rows(2, None, [None], None, [squares], None)

    return run


_RANKED = "sum(w) OVER (PARTITION BY b ORDER BY {0}) - sum(w) OVER (PARTITION BY b, {0}) + (sum(w) OVER (PARTITION BY b, {0}) + 1) / 2.0::DOUBLE"


@query(
    "bootstrap_spearman_ranked",
    f"""WITH {PANEL_SQL}, d AS (SELECT b.range AS b, u.* FROM range({_DRAWS}) b, (SELECT paper_id, ai_mean AS vx, human_mean AS vy FROM units) u), k AS (SELECT * FROM (SELECT *, {_WEIGHT} AS w FROM d) WHERE w > 0),
 r AS (SELECT b, w, {_RANKED.format("vx")} AS x, {_RANKED.format("vy")} AS y FROM k), m AS (SELECT b, {_MOMENTS} FROM r GROUP BY b)
 SELECT 'spearman' AS statistic, count(*) AS draws, round(quantile_cont({_CORR}, 0.025), 6) AS low, round(quantile_cont({_CORR}, 0.975), 6) AS high FROM m""",
)
def bootstrap_spearman_ranked(spark, d):
    """The interval of Spearman's correlation with ranks taken anew in each draw."""
    u = stored(units(spark, d).select("paper_id", F.col("ai_mean").alias("x"), F.col("human_mean").alias("y")), "panel_means")
    low, high = (rnd(F.percentile("v", F.lit(q))) for q in (0.025, 0.975))
    return bootstrap_ranked(u, "paper_id").agg(F.lit("spearman").alias("statistic"), F.count("*").alias("draws"), low.alias("low"), high.alias("high")).select("statistic", "draws", "low", "high")
