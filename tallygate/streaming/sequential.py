"""Running sequential tests: the counts are the state, and each micro-batch re-evaluates the closed form on them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import columns, numeric
from ..operators.trials import effective_outcome, row_error, trials
from ..schema import Metric, SprtConfig


def running_counts(stream: DataFrame, by: tuple[str, ...] = (), policy: str = "report-only") -> DataFrame:
    """Wins, draws, losses and bad rows of a stream of trials; three counters of state for each group."""
    rows = trials(stream) if "line" in stream.columns else trials(stream.withColumn("line", F.lit(0).cast("long")))
    o, bad = effective_outcome(policy), row_error([Metric("winrate", policy=policy)], "sprt").isNotNull()
    return rows.groupBy(*by).agg(F.count_if(o == "candidate_win").alias("wins"), F.count_if(o == "draw").alias("draws"), F.count_if(o == "baseline_win").alias("losses"), F.count_if(bad).alias("bad_rows"))


def running_sprt(stream: DataFrame, config: SprtConfig, variant: str = "wald", by: tuple[str, ...] = (), policy: str = "report-only") -> DataFrame:
    """Counts, llr and verdict after each micro-batch (output mode update or complete)."""
    rows = running_counts(stream, by, policy)
    counts = F.col("wins"), F.col("draws"), F.col("losses")
    llr = columns.wald_llr(config, counts[0], counts[2]) if variant == "wald" else columns.trinomial_llr(config, *counts)
    return rows.withColumn("llr", llr).withColumn("verdict", columns.sprt_verdict(F.col("llr"), config))


def running_pairs(stream: DataFrame, policy: str = "report-only", forget_ms: int = 86_400_000) -> DataFrame:
    """(id, bucket): one row when the second game of an id arrives. Half pairs are state by id, forgotten after a day unless told otherwise."""

    def pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        games, points = state.get if state.exists else (0, 0)
        for f in frames:
            games, points = games + len(f), points + int(f["p"].sum())
        if games >= 2:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"id": [key[0]], "bucket": [points if games == 2 else -1]})
        else:
            state.update((games, points))
            state.setTimeoutDuration(forget_ms)

    rows = trials(stream if "line" in stream.columns else stream.withColumn("line", F.lit(0).cast("long")))
    o = effective_outcome(policy)
    games = rows.where(o.isNotNull() & F.col("id").isNotNull()).select("id", columns.points2(o).alias("p"))
    return games.groupBy("id").applyInPandasWithState(pair, "id string, bucket int", "games int, points int", "update", GroupStateTimeout.ProcessingTimeTimeout)


def pentanomial_verdict(buckets: list[int], config: SprtConfig) -> tuple[float, str]:
    llr = numeric.pentanomial_llr(config.elo0, config.elo1, buckets)
    lo, hi = numeric.wald_bounds(config.alpha, config.beta)
    return llr, "pass" if llr >= hi else "fail" if llr <= lo else "inconclusive"
