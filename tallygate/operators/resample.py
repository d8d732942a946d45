"""Bootstraps as a dataflow over resample numbers. Every draw depends on (seed, resample) alone, never on a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..sources.scratch import Table
from . import ranks

#: Redraws while a resample has no decisive outcome.
REDRAWS = 1_000


def generator(seed: int, *counter: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed, counter[0]], counter=[0, 0, *([0, 0, *counter[1:]][-2:])]))


def _slices(spark: SparkSession, resamples: int) -> int:
    return max(1, min(resamples, 2 * spark.sparkContext.defaultParallelism))


def per_resample(spark: SparkSession, resamples: int, draw: Callable[[int], float]) -> np.ndarray:
    """``draw(r)`` for each resample, in parallel."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"r": f["id"], "x": [draw(int(r)) for r in f["id"]]})

    rows = spark.range(0, resamples, 1, _slices(spark, resamples)).mapInPandas(run, "r long, x double").toPandas()
    return rows.sort_values("r")["x"].to_numpy()


# --- means ----------------------------------------------------------------------------------------------

# Steps of the counters, and the shifts and factors of the splitmix64 finaliser.
STEP, NODE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
# Step, shifts and factors of the 32-bit mixing of single draws.
DRAW, MIX32 = 0x9E3779B9, ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1))
#: Rows of a block, blocks that are drawn from together, draws of a split that are made one by one.
BLOCK, TOGETHER, SINGLY = 1024, 64, 64
#: Draws that are made at a time, and the least number of pieces that a part's resamples fall in, which bounds a piece's sums.
CELLS, PIECES = 1 << 16, 8


def mix(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each counter; every SQL engine with unsigned integers repeats them."""
    for shift, factor in MIX:
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def block_sums(values: np.ndarray, k: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each resample, the sum of the k values that its stream draws from a block.

    A stream is named by 64 bits: the low half starts a counter, the high half enters its mixing. Streams are taken in order of
    length, CELLS draws at a time in memory that is used again, so that few draws are made in vain and all stay in the cache.
    """
    total, most = np.zeros(len(k)), int(k.max(initial=0))
    if not most:
        return total
    order, rows = np.argsort(k, kind="stable"), max(1, CELLS // most)
    steps = np.arange(most, dtype=np.uint32) * np.uint32(DRAW)
    low, high, size = bits.astype(np.uint32), (bits >> np.uint64(32)).astype(np.uint32), np.uint64(len(values))
    space = [np.empty(rows * most, t) for t in (np.uint32, np.uint32, np.uint64, float)]
    for at in range(0, len(k), rows):
        own = order[at : at + rows]
        least, width = int(k[own[0]]), int(k[own[-1]])
        if not width:
            continue
        x, shifted, place, drawn = (a[: len(own) * width].reshape(len(own), width) for a in space)
        np.add(low[own, None], steps[:width], out=x)
        for i, (shift, factor) in enumerate(MIX32):
            np.right_shift(x, np.uint32(shift), out=shifted)
            np.bitwise_xor(x, shifted, out=x)
            if factor != 1:
                np.multiply(x, np.uint32(factor), out=x)
            if i == 0:
                np.bitwise_xor(x, high[own, None], out=x)
        np.multiply(x, size, out=place)
        np.right_shift(place, np.uint64(32), out=place)
        np.take(values, place.view(np.int64), out=drawn, mode="clip")
        drawn[:, least:] *= np.arange(least, width) < k[own, None]
        total[own] = drawn.sum(1)
    return total


def _counter(x: np.ndarray, by: int, step: int = STEP) -> np.ndarray:
    return x + np.uint64(by * step % 2**64)


def split(k: np.ndarray, p: float, s: np.ndarray) -> np.ndarray:
    """Of k draws, how many go to the left, each with chance p near a half; from the bits s alone.

    Few draws are made one by one. For more, the binomial's quantile at a uniform number is that of the normal with its
    mean, variance and skewness, rounded.
    """
    z = numeric.normal_quantiles(((s >> np.uint64(11)).astype(float) + 0.5) / 2**53)
    left = np.floor(k * p + z * np.sqrt(k * p * (1 - p)) + (z * z - 1) * (1 - 2 * p) / 6 + 0.5)
    left = np.clip(left, 0, k).astype(np.int64)
    for i in np.flatnonzero(k <= SINGLY):
        bits = mix(np.full(k[i], s[i]) + np.arange(k[i], dtype=np.uint64) * np.uint64(STEP))
        left[i] = np.count_nonzero((bits >> np.uint64(11)).astype(float) / 2**53 < p)
    return left


def shares(n: int, blocks: int, seed: int, resamples: np.ndarray, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, draws, bits) of the blocks from first to before last: how many of n draws each resample takes from the block.

    Draws are halved down a tree over the blocks; a node's split depends on (seed, resample, node) alone.
    """
    base = mix(np.full(len(resamples), seed % 2**64, np.uint64) + resamples.astype(np.uint64) * np.uint64(STEP))
    start = lambda i: i * n // blocks

    def walk(node: int, lo: int, hi: int, k: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= last:
            return
        bits = mix(_counter(base, node, NODE))
        if hi - lo == 1:
            yield lo, k, bits
            return
        mid = (lo + hi) // 2
        left = split(k, (start(mid) - start(lo)) / (start(hi) - start(lo)), bits)
        yield from walk(2 * node, lo, mid, left)
        yield from walk(2 * node + 1, mid, hi, k - left)

    yield from walk(1, 0, blocks, np.full(len(resamples), n, np.int64))


def drawn_sums(values: np.ndarray, n: int, part: int, seed: int, resamples: np.ndarray, block: int = BLOCK, together: int = TOGETHER) -> np.ndarray:
    """For each resample, the sum of what it draws from the sorted values of one part of n rows."""
    blocks = -(-n // block)
    first, last = part * together, min(blocks, (part + 1) * together)
    total = np.zeros(len(resamples))
    for b, k, bits in shares(n, blocks, seed, resamples, first, last):
        lo, hi = (i * n // blocks - first * n // blocks for i in (b, b + 1))
        total += block_sums(values[lo:hi], k, bits)
    return total


def bootstrap_means(values: DataFrame, value: str, resamples: int, seed: int, by: tuple[str, ...] = (), tie: str | None = None) -> tuple[Table, DataFrame]:
    """(the table to drop when done, (by, n, draws)): for each group the means of its resamples, by resample.

    Rows lie in blocks of about BLOCK by their rank, so draws depend on the values alone, not on lines or partitions. A task
    takes TOGETHER blocks of a group, for some of the resamples where there are few blocks; a large group is many tasks'
    work, and a row's value is never repeated for a resample. Sums of parts are added in order.
    """
    spark, size, together = values.sparkSession, BLOCK, TOGETHER
    table, rows = ranks.ranked(values, value, by, tie)
    blocks = F.ceil(F.col("n") / size)
    block = F.floor(((F.col("rank") + 1) * blocks - 1) / F.col("n"))
    group = F.struct(F.lit(0).alias("_"), *by).alias("g")
    parts = rows.select(group, "n", F.floor(block / together).cast("long").alias("part"), value).groupBy("g", "n", "part").agg(F.sort_array(F.collect_list(value)).alias("v"))
    # As many pieces as keep all tasks busy, few for a small group, and no more copies of the values than that needs.
    work = spark.sparkContext.defaultParallelism * 8
    of_part = F.ceil(F.lit(work) / F.ceil(blocks / together))
    wanted = F.least(F.floor(F.lit(work // 4) * F.col("n") / (size * 8)), F.greatest(of_part, F.lit(PIECES)))
    slices = F.greatest(F.lit(1), F.least(F.lit(max(1, resamples // 64)), wanted)).cast("int")
    dealt = parts.withColumn("slices", slices).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).repartition(work, "g", "part", "slice")
    kind = next(f for f in dealt.schema if f.name == "g").dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                row = whole.slice(i, 1)
                n, part, k, c = (row.column(x)[0].as_py() for x in ("n", "part", "slices", "slice"))
                rs = np.arange(c * resamples // k, (c + 1) * resamples // k)
                sums = drawn_sums(row.column("v").flatten().to_numpy(zero_copy_only=False), n, part, seed, rs, size, together)
                yield pa.RecordBatch.from_arrays([*(row.column(x) for x in ("g", "n", "part", "slice")), pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["g", "n", "part", "slice", "x"])

    sums = dealt.select("g", "n", "part", "slices", "slice", "v").mapInArrow(run, f"g {kind}, n long, part long, slice int, x array<double>")
    added = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(1))), F.get("xs", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda u, v: u + v))
    in_order = lambda *key: F.transform(F.sort_array(F.collect_list(F.struct(*key, "x"))), lambda s: s["x"]).alias("xs")
    one = sums.groupBy("g", "n", "slice").agg(in_order("part")).select("g", "n", "slice", added.alias("x"))
    draws = one.groupBy("g", "n").agg(in_order("slice")).select("g", "n", F.transform(F.flatten("xs"), lambda x: x / F.col("n")).alias("draws"))
    return table, draws.select(*(F.col("g")[c].alias(c) for c in by), "n", "draws")


# --- quantiles ------------------------------------------------------------------------------------------


def bootstrap_quantiles(ordered: Callable[[np.ndarray], np.ndarray], n: int, q: float, resamples: int, seed: int) -> np.ndarray:
    """Type-7 quantiles of resamples of n values, of which ``ordered`` gives those at given ranks from 0.

    The k-th of n draws with replacement is the value at rank floor(n * U), with U the k-th of n uniforms;
    two neighbours of these are enough for a quantile, so a resample costs two draws and not n.
    """
    g = generator(seed, 0, 3)
    h = q * (n - 1)
    k = int(np.floor(h))
    u = g.beta(k + 1, n - k, resamples)
    v = 1 - (1 - u) * g.beta(max(1, n - k - 1), 1, resamples) if k + 1 < n else u
    ranks = np.minimum(np.floor(n * np.stack([u, v])).astype(np.int64), n - 1)
    at = ordered(np.unique(ranks))
    lo, hi = (at[np.searchsorted(np.unique(ranks), r)] for r in ranks)
    return lo + (h - k) * (hi - lo)


def cluster_bootstrap(spark: SparkSession, table: pd.DataFrame, n: int, statistic: Callable[[np.ndarray], np.ndarray], confidence: float, resamples: int, seed: int) -> dict:
    """Interval, design effect and effective sample size from the counts (w, d, l, clusters) of cluster kinds.

    A resample of all clusters is a multinomial draw over the kinds. Its twin draws the single outcomes.
    """
    kinds, counts = table[["w", "d", "l"]].to_numpy(float), table["clusters"].to_numpy()
    outcomes = (kinds * counts[:, None]).sum(0)

    def draws(values: np.ndarray, sizes: np.ndarray, tag: int) -> np.ndarray:
        k = int(sizes.sum())

        def draw(r: int) -> float:
            for attempt in range(REDRAWS):
                s = statistic(generator(seed, r, attempt + 1, tag).multinomial(k, sizes / k) @ values)
                if np.isfinite(s):
                    return float(s)
            return 0.0

        return per_resample(spark, resamples, draw)

    clustered, single = draws(kinds, counts, 1), draws(np.eye(3), outcomes.astype(np.int64), 2)
    a = (1 - confidence) / 2
    lo, hi = numeric.ranks(a, 1 - a, resamples)
    s = np.sort(clustered)
    spread = single.var(ddof=1) if resamples > 1 else 0.0
    effect = float(clustered.var(ddof=1) / spread) if spread > 0 else 1.0
    return {"ci_low": float(s[lo]), "ci_high": float(s[hi]), "design_effect": effect, "effective_sample_size": n / effect if effect > 0 else float(n)}
