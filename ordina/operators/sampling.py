"""Samples whose counts follow those of all rows in two margins at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import units

_EPS = 1e-9


def controlled(exact: np.ndarray) -> np.ndarray:
    """Whole numbers beside each entry (it or its neighbour above or below) whose row and column sums, and whose sum, are
    beside the exact ones as well: amounts move around cycles of fractional entries until none is left."""
    n, m = exact.shape
    a = np.zeros((n + 1, m + 1))
    a[:n, :m] = exact
    a[:n, m], a[n, :m] = np.ceil(exact.sum(1) - _EPS) - exact.sum(1), np.ceil(exact.sum(0) - _EPS) - exact.sum(0)
    a[n, m] = np.ceil(a[n, :m].sum() - _EPS) - a[n, :m].sum()
    while True:
        a = np.where(abs(a - np.rint(a)) < _EPS, np.rint(a), a)
        open_cells = a != np.rint(a)
        if not open_cells.any():
            return a[:n, :m].astype(int)
        # from a row to one of its open entries, on to another open entry of that column, and so on, until a row comes again
        row, path, seen = int(np.flatnonzero(open_cells.any(1))[0]), [], {}
        while row not in seen:
            seen[row] = len(path)
            columns = [c for c in np.flatnonzero(open_cells[row]) if not path or c != path[-1][1]]
            path.append((row, int(columns[0])))
            rows = [r for r in np.flatnonzero(open_cells[:, columns[0]]) if r != row]
            row = int(rows[0])
            path.append((row, int(columns[0])))
        cycle = path[seen[row] :]
        up, down = cycle[0::2], cycle[1::2]
        step = min([np.ceil(a[c]) - a[c] for c in up] + [a[c] - np.floor(a[c]) for c in down])
        for sign, cells in ((1, up), (-1, down)):
            for c in cells:
                a[c] += sign * step


def two_margins(df: DataFrame, strata: list[str], margin: str, key: str, size: int, seed: int = 17) -> DataFrame:
    """`size` rows (all, if there are fewer) of which each stratum, each value of margin and each of their cells has its share, rounded up or
    down. Shares are decided once, on one row a cell; members are the first of their cell by a seeded hash of an integer key."""
    cells = df.groupBy(*strata, margin).agg(F.count("*").alias("n"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema if f.name != "n")

    def quotas(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values([*strata, margin], na_position="first").reset_index(drop=True)
        rows, columns = own.groupby(strata, dropna=False, sort=True).ngroup(), own.groupby(margin, dropna=False, sort=True).ngroup()
        exact = np.zeros((rows.max() + 1, columns.max() + 1))
        exact[rows, columns] = own["n"] * min(1.0, size / own["n"].sum())
        return own.assign(quota=controlled(exact)[rows, columns])[[*strata, margin, "quota"]]

    # one row a cell: the table of shares
    quota = cells.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(quotas, f"{fields}, quota bigint")
    quota = quota.toDF(*[f"__{c}" for c in quota.columns])
    order = Window.partitionBy(*strata, margin).orderBy((F.col(key) * 7919 + seed) % 104729, key)
    first = df.withColumn("__i", F.row_number().over(order)).where(F.col("__i") <= size)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*strata, margin)]
    return first.join(quota, same).where(F.col("__i") <= F.col("__quota")).select(*df.columns)


@query("two_margin_sample")
def two_margin_sample(spark, d):
    """A sample by area and band of means that also keeps the shares of statuses (tested by its margins)."""
    u = units(spark, d).select("paper_id", "area", "status", F.least(F.floor("human_mean"), F.lit(9)).cast("bigint").alias("band"))
    return two_margins(u, ["area", "band"], "status", "paper_id", 100)
