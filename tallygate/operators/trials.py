"""Trial and match records, row by row: parsed words, effective outcomes, differences, errors. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import fail
from ..functions.columns import points2
from ..schema import FAILURES, MATCH_COLUMNS, MATCH_OUTCOMES, OUTCOMES, STATUSES, TRIAL_COLUMNS, Metric

_ERROR = "struct<line:bigint,rank:int,kind:string,detail:string>"


def _conform(df: DataFrame, names: tuple[str, ...], doubles: tuple[str, ...]) -> DataFrame:
    have = set(df.columns)
    cols = [(F.col(c) if c in have else F.lit(None)).cast("double" if c in doubles else "string").alias(c) for c in names]
    line = F.col("line").cast("bigint") if "line" in have else F.monotonically_increasing_id() + 1
    early = F.col("_error").cast("string") if "_error" in have else F.lit(None).cast("string")
    keys = [F.col(c) for c in df.columns if c not in (*names, "line", "_error")]
    return df.select(*keys, *cols, line.alias("line"), early.alias("_error"))


def trials(df: DataFrame) -> DataFrame:
    """Any table as trial records: absent columns are null, absent lines are numbered; further columns stay, to group by."""
    return _conform(df, TRIAL_COLUMNS, ("baseline", "candidate"))


def matches(df: DataFrame) -> DataFrame:
    return _conform(df, MATCH_COLUMNS, ())


def failed(status: Column) -> Column:
    return F.coalesce(status.isin(*FAILURES), F.lit(False))


def effective_outcome(policy: str) -> Column:
    """The outcome that counts under a failure policy; null if the row has none."""
    b, c, result = failed(F.col("baseline_status")), failed(F.col("candidate_status")), F.col("result")
    if policy == "report-only":
        return result
    if policy == "exclude":
        return F.when(~(b | c), result)
    return F.when(b & c, "draw").when(b, "candidate_win").when(c, "baseline_win").otherwise(result)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def difference() -> Column:
    """candidate - baseline, where both are there."""
    return F.col("candidate") - F.col("baseline")


def _error(line: Column, rank: int, kind: str, detail: Column | str) -> Column:
    return F.struct(line.alias("line"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def row_error(metrics: list[Metric], context: str = "") -> Column:
    """What is wrong with a row, if anything: the first of the checks that it fails."""
    line, checks = F.col("line"), []
    checks.append((F.col("_error").isNotNull(), lambda: F.struct(line.alias("line"), F.lit(0).alias("rank"), F.get(F.split("_error", ":", 2), F.lit(0)).alias("kind"), F.get(F.split("_error", ":", 2), F.lit(1)).alias("detail"))))
    for side in ("baseline_status", "candidate_status"):
        checks.append((~F.col(side).isin(*STATUSES), lambda side=side: _error(line, 1, "UnrecognizedStatus", F.concat(F.lit(f"{side} is "), F.col(side)))))
    status = F.col("baseline_status").isNotNull() | F.col("candidate_status").isNotNull()
    both = F.col("baseline").isNotNull() & F.col("candidate").isNotNull()
    for m in metrics:
        if m.numeric:
            checks.append((both & ~(finite(F.col("baseline")) & finite(F.col("candidate"))), lambda m=m: _error(line, 2, "InvalidValue", f"{m.kind} needs finite numbers")))
            checks.append((~(both | status), lambda m=m: _error(line, 3, "SchemaMismatch", f"{m.kind}: neither a pair of numbers nor a status")))
        else:
            checks.append((~effective_outcome(m.policy).isin(*OUTCOMES), lambda: _error(line, 2, "UnrecognizedOutcome", F.concat(F.lit("result is "), F.col("result")))))
            checks.append((~(F.col("result").isNotNull() | status), lambda m=m: _error(line, 3, "SchemaMismatch", f"{context or m.kind}: neither a result nor a status")))
    out = F.lit(None).cast(_ERROR)
    for test, made in reversed(checks):
        out = F.when(F.coalesce(test, F.lit(False)), made().cast(_ERROR)).otherwise(out)
    return out


def match_error() -> Column:
    line = F.col("line")
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(False))
    absent = F.col("a").isNull() | F.col("b").isNull() | F.col("result").isNull()
    return (
        F.when(F.col("_error").isNotNull(), F.struct(line.alias("line"), F.lit(0).alias("rank"), F.get(F.split("_error", ":", 2), F.lit(0)).alias("kind"), F.get(F.split("_error", ":", 2), F.lit(1)).alias("detail")).cast(_ERROR))
        .when(absent, _error(line, 1, "InvalidJson", "a, b and result are required").cast(_ERROR))
        .when(empty("a") | empty("b"), _error(line, 2, "SchemaMismatch", "a competitor's name is empty").cast(_ERROR))
        .when(F.col("a") == F.col("b"), _error(line, 3, "SchemaMismatch", "a competitor plays itself").cast(_ERROR))
        .when(~F.col("result").isin(*MATCH_OUTCOMES), _error(line, 4, "UnrecognizedOutcome", F.concat(F.lit("result is "), F.col("result"))).cast(_ERROR))
    )


def raise_error(row) -> None:
    if row is not None:
        fail(row["kind"], row["detail"], row["line"])


def key() -> Column:
    """Rows of one id share a key; a row without id has its own, also where lines repeat. For a projection, before rows are grouped."""
    own = F.concat_ws(":", F.lit("l"), F.col("line").cast("string"), F.monotonically_increasing_id().cast("string"))
    return F.when(F.col("id").isNotNull(), F.concat(F.lit("i"), "id")).otherwise(own)
