"""From rows to counts: everything a comparison needs comes from one pass, grouped by id and then summed.

Both steps combine before they shuffle, so an id that holds a large share of the rows costs one row
of sums from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FAILURES, Metric
from .trials import _ERROR, _error, difference, effective_outcome, key, points2, row_error, trials

SIDES = ("baseline", "candidate")


def _policies(metrics: list[Metric]) -> list[str]:
    return sorted({m.policy for m in metrics if not m.numeric})


def name(policy: str) -> str:
    return policy.replace("-", "_")


def by_key(df: DataFrame, metrics: list[Metric], by: tuple[str, ...] = (), context: str = "") -> DataFrame:
    """One row of sums for each id (and each row without id)."""
    rows = trials(df).withColumn("key", key())
    aggregates: list[Column] = [
        F.count("*").alias("n"),
        F.max(F.col("id").isNotNull()).alias("has_id"),
        F.min("line").alias("line"),
        F.max("line").alias("last"),
        F.min(row_error(metrics, context)).alias("error"),
        *(F.count_if(F.col(f"{s}_status") == k).alias(f"{s}_{k}") for s in SIDES for k in FAILURES),
    ]
    for p in _policies(metrics):
        o = effective_outcome(p)
        aggregates += [
            F.count_if(o == "candidate_win").alias(f"w_{name(p)}"),
            F.count_if(o == "draw").alias(f"d_{name(p)}"),
            F.count_if(o == "baseline_win").alias(f"l_{name(p)}"),
            F.coalesce(F.sum(points2(o)), F.lit(0)).alias(f"p_{name(p)}"),
        ]
    if any(m.numeric for m in metrics):
        d = difference()
        aggregates += [F.count(d).alias("n_diff"), F.avg(d).alias("diff")]
    return rows.groupBy(*by, "key").agg(*aggregates)


def net(keys: DataFrame, metrics: list[Metric], paired: bool) -> DataFrame:
    """With ``paired``, two records of an id become one outcome, by their points, or one mean difference."""
    for p in _policies(metrics):
        w, d, n = (F.col(f"{x}_{name(p)}") for x in "wdl")
        keys = keys.withColumn(f"size_{name(p)}", w + d + n)
        if paired:
            two, points = F.col(f"size_{name(p)}") == 2, F.col(f"p_{name(p)}")
            net_w, net_d, net_l = (F.when(two, c.cast("bigint")).otherwise(F.col(f"{x}_{name(p)}")) for x, c in (("w", points > 2), ("d", points == 2), ("l", points < 2)))
            keys = keys.withColumns({f"w_{name(p)}": net_w, f"d_{name(p)}": net_d, f"l_{name(p)}": net_l})
    return keys


def repeated(df: DataFrame, metrics: list[Metric], paired: bool) -> DataFrame:
    """(line, rank, kind, detail, id) of the first record beyond those that an id may have: the second, or with ``paired`` the third.

    A row number below a limit is cut off within tasks before rows are exchanged, so a hot id sends a few rows from each.
    """
    most = 2 if paired else 1
    counts = [difference().isNotNull()] if any(m.numeric for m in metrics) else []
    counts += [effective_outcome(p).isNotNull() for p in _policies(metrics)] if paired else []
    rows, found = trials(df).where(F.col("id").isNotNull()), None
    words = "more than two records" if paired else "more than one record"
    for use in counts:
        k = F.row_number().over(Window.partitionBy("id").orderBy("line"))
        late = rows.where(use).select("id", "line", k.alias("k")).where(F.col("k") <= most + 1).where(F.col("k") == most + 1)
        found = late if found is None else found.unionByName(late)
    error = _error(F.col("line"), 5, "DuplicateId", F.concat(F.lit(f"{words} of id "), F.col("id")))
    return found.select(error.alias("e"), "id").orderBy("e").limit(1).select("e.*", "id")


def totals(keys: DataFrame, metrics: list[Metric], paired: bool, by: tuple[str, ...] = (), sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """One row of counts for each group of ``by`` (or for all, or for each of the sets of keys), with the first error of rows and of ids."""
    keys = net(keys, metrics, paired)
    late = F.lit(None).cast(_ERROR)
    if any(m.numeric for m in metrics):
        if paired:
            late = F.when(F.col("n_diff") > 2, _error(F.col("last"), 5, "DuplicateId", F.concat(F.lit("more than two records of id "), F.expr("substr(key, 2)"))).cast(_ERROR)).otherwise(late)
        else:
            late = F.when(F.col("n_diff") > 1, _error(F.col("last"), 5, "DuplicateId", F.concat(F.lit("more than one record of id "), F.expr("substr(key, 2)"))).cast(_ERROR)).otherwise(late)
    if paired:
        for p in _policies(metrics):
            late = F.when(F.col(f"size_{name(p)}") > 2, _error(F.col("last"), 5, "DuplicateId", F.concat(F.lit("more than two records of id "), F.expr("substr(key, 2)"))).cast(_ERROR)).otherwise(late)
    out = [
        F.sum("n").alias("n_rows"),
        F.min("error").alias("error"),
        F.min(late).alias("late_error"),
        *(F.sum(f"{s}_{k}").alias(f"{s}_{k}") for s in SIDES for k in FAILURES),
        F.coalesce(F.sum(F.when(F.col("has_id"), F.col("n"))), F.lit(0)).alias("records_with_id"),
        F.coalesce(F.max(F.when(F.col("has_id"), F.col("n"))), F.lit(0)).alias("max_id_count"),
    ]
    for p in _policies(metrics):
        out += [F.sum(f"{x}_{name(p)}").alias(f"{x}_{name(p)}") for x in "wdl"]
        out += [F.count_if(F.col(f"size_{name(p)}") > 0).alias(f"clusters_{name(p)}"), F.max(f"size_{name(p)}").alias(f"largest_{name(p)}")]
    if any(m.numeric for m in metrics):
        d = F.col("diff")
        out += [F.count(d).alias("n_diff"), F.avg(d).alias("mean_diff"), F.count_if(d > 0).alias("pos"), F.count_if(d < 0).alias("neg"), F.stddev_samp(d).alias("sd_diff")]
    if sets is None:
        return keys.groupBy(*by).agg(*out)
    return keys.groupingSets([list(s) for s in sets], *by).agg(F.grouping_id().alias("grouping_id"), *out)


def cluster_table(keys: DataFrame, policy: str) -> DataFrame:
    """(w, d, l, clusters): how many ids have these counts. All that a cluster bootstrap needs to know of them."""
    w, d, n = (F.col(f"{x}_{name(policy)}").alias(x) for x in "wdl")
    return keys.select(w, d, n).where("w + d + l > 0").groupBy("w", "d", "l").agg(F.count("*").alias("clusters"))


def pentanomial(keys: DataFrame, policy: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of games by their joint score: bucket_0 (no point) to bucket_4 (two), games and pairs."""
    size, p = F.col(f"w_{name(policy)}") + F.col(f"d_{name(policy)}") + F.col(f"l_{name(policy)}"), F.col(f"p_{name(policy)}")
    late = (
        F.when((size > 0) & ~F.col("has_id"), _error(F.col("line"), 4, "SchemaMismatch", "pentanomial: a record has no id").cast(_ERROR))
        .when((size > 0) & (size != 2), _error(F.col("last"), 5, "DuplicateId", F.concat(F.lit("pentanomial needs exactly two records of id "), F.expr("substr(key, 2)"))).cast(_ERROR))
    )
    return keys.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.min("error").alias("error"),
        F.min(late).alias("late_error"),
        *(F.sum(f"{s}_{k}").alias(f"{s}_{k}") for s in SIDES for k in FAILURES),
        *(F.count_if((size == 2) & (p == b)).alias(f"bucket_{b}") for b in range(5)),
        F.sum(size).alias("games"),
        F.count_if(size > 0).alias("pairs"),
    )
