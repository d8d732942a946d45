"""Order statistics of columns that no machine holds: ranks by a distributed sort, and selection by narrowing ranges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Table

#: Rows of a range that are sorted in one task at most, and the accuracy of the sketch that narrows longer ranges.
SORTED, ACCURACY = 1 << 20, 10_000


def ranked(values: DataFrame, value: str, by: tuple[str, ...] = (), tie: str | None = None) -> tuple[Table, DataFrame]:
    """(the table to drop when done, (by, value, rank, n)): the rank from 0 within a group of n rows.

    One exchange by ranges sorts the rows; what stands before a task's rows of a group is the sum of the counts of the
    tasks before it. ``tie`` deals out rows of equal values, so that a frequent value is no task's alone.
    """
    order = [*by, value, *([tie] if tie else [])]
    placed = values.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = Table(placed, "ranked")
    rows = table.df.withColumn("_task", F.shiftright("_at", 33))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = rows.groupBy(*by, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    tasks = counts.select(
        *(F.col(c).alias(f"_of_{c}") for c in by), F.col("_task").alias("_of_task"),
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("n"),
    )
    same = F.col("_task") == F.col("_of_task")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return table, rows.join(tasks, same).select(*by, value, (F.col("_at") + F.col("_shift")).alias("rank"), "n")


@dataclass
class Range:
    """Ranks first to last lie among the ``size`` rows from ``lo`` to ``hi``, before which there are ``below`` rows."""

    first: int
    last: int
    size: int
    lo: float = float("-inf")
    hi: float = float("inf")
    below: int = 0
    margin: float = 2 / ACCURACY
    least: float = float("-inf")
    most: float = float("inf")

    @property
    def open(self) -> bool:
        return self.size > SORTED and self.least < self.most

    def holds(self, x: Column) -> Column:
        return (x >= self.lo) & (x <= self.hi)


def _narrowed(values: DataFrame, value: str, ranges: list[Range]) -> None:
    """One round: sketched bounds around the ranks, then exact counts below and within them. Bounds that missed their ranks are dropped."""
    x = F.col(value)
    shares = [[min(1.0, max(0.0, s)) for s in ((r.first - r.below) / r.size - r.margin, (r.last - r.below + 1) / r.size + r.margin)] for r in ranges]
    sketch = [F.percentile_approx(F.when(r.holds(x), x), s, ACCURACY) for r, s in zip(ranges, shares, strict=True)]
    found = values.agg(*(c.alias(f"s{i}") for i, c in enumerate(sketch))).first()
    tried = []
    for i, (r, (low, high)) in enumerate(zip(ranges, shares, strict=True)):
        lo, hi = found[i]
        tried.append(Range(r.first, r.last, r.size, r.lo if low == 0 else lo, r.hi if high == 1 else hi, r.below, r.margin))
    asked = []
    for i, (r, t) in enumerate(zip(ranges, tried, strict=True)):
        within = t.holds(x)
        asked += [F.count_if(r.holds(x) & (x < t.lo)).alias(f"b{i}"), F.count_if(within).alias(f"n{i}"), F.min(F.when(within, x)).alias(f"l{i}"), F.max(F.when(within, x)).alias(f"m{i}")]
    got = values.agg(*asked).first()
    for i, (r, t) in enumerate(zip(ranges, tried, strict=True)):
        below, size = r.below + got[f"b{i}"], got[f"n{i}"]
        if below <= r.first and r.last < below + size and size < r.size:
            r.lo, r.hi, r.below, r.size, r.least, r.most = t.lo, t.hi, below, size, got[f"l{i}"], got[f"m{i}"]
        else:
            r.margin *= 8
            if r.margin > 1:  # nothing narrows it: sort what there is
                r.least = r.most = float("nan")


def order_statistics(values: DataFrame, value: str, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Gives the values at ranks from 0 of a column of n finite numbers.

    Ranges of values around the wanted ranks are narrowed until they are short, in two passes a round, with the sketch's and
    a few counts' memory; only the rows of these short ranges are sorted, and only values asked for come back.
    """

    def look_up(ranks: np.ndarray) -> np.ndarray:
        wanted = np.unique(ranks)
        cuts = np.flatnonzero((np.diff(wanted) > SORTED // 4)) + 1
        ranges = [Range(int(part[0]), int(part[-1]), n) for whole in np.split(wanted, cuts) for part in _short(whole)]
        while still := [r for r in ranges if r.open]:
            _narrowed(values, value, still)
        x = F.col(value)
        known = {k: r.least for r in ranges if r.least == r.most for k in wanted[(wanted >= r.first) & (wanted <= r.last)].tolist()}
        rest = [r for r in ranges if r.least != r.most]
        if rest:
            tags = F.array_compact(F.array(*(F.when(r.holds(x), F.lit(i)) for i, r in enumerate(rest))))
            below = F.element_at(F.array(*(F.lit(r.below) for r in rest)), F.col("_range") + 1)
            tagged = values.select(x.alias("_x"), F.explode(tags).alias("_range"))
            placed = tagged.select("_x", "_range", (F.row_number().over(Window.partitionBy("_range").orderBy("_x")) - 1 + below).alias("_rank"))
            asked = pd.DataFrame([(i, int(k)) for i, r in enumerate(rest) for k in wanted[(wanted >= r.first) & (wanted <= r.last)]], columns=["_range", "_rank"])
            sent = F.broadcast(values.sparkSession.createDataFrame(asked, "_range int, _rank long"))
            known |= {r["_rank"]: r["_x"] for r in placed.join(sent, ["_range", "_rank"]).collect()}
        return np.array([known[int(k)] for k in np.asarray(ranks).ravel()]).reshape(np.shape(ranks))

    return look_up


def _short(ranks: np.ndarray) -> list[np.ndarray]:
    """The ranks in stretches none of which spans more than half of what one task sorts."""
    return [ranks[(ranks - ranks[0]) // (SORTED // 2) == k] for k in np.unique((ranks - ranks[0]) // (SORTED // 2))]
