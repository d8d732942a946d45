"""Ratings on the graph of who played whom: edges by Spark, then the fit of a graph small enough for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GateError, fail
from ..functions import numeric
from .resample import generator
from .trials import _ERROR, _error, match_error, matches

#: Steps and tolerance of the fit; share of resamples in which a pair must be connected.
STEPS, TOLERANCE, CONNECTED = 10_000, 1e-9, 0.9
#: Pairs whose draws meet in one group; resamples that a task hands on at a time.
PAIR_BLOCK, RESAMPLE_BLOCK = 256, 64


def canonical(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def match_edges(df: DataFrame, paired: bool) -> DataFrame:
    """(lo, hi, lo_wins, hi_wins, draws) of unordered pairs, with the first error of all rows in ``error``.

    With ``paired``, two records of a pair with the same id, of whatever file, become one game by their points.
    """
    rows = matches(df)
    lo, hi = canonical(F.col("a"), F.col("b"))
    won = F.when(F.col("result") == "draw", 1).when((F.col("result") == "a_win") == (F.col("a") == lo), 2).otherwise(0)
    keyed = rows.select(lo.alias("lo"), hi.alias("hi"), "line", match_error().alias("error"), won.alias("p"), F.coalesce(F.concat(F.lit("i"), "id"), F.concat(F.lit("l"), F.col("line").cast("string"), F.lit(":"), F.monotonically_increasing_id().cast("string"))).alias("key"))
    if paired:
        games = keyed.groupBy("lo", "hi", "key").agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.max("line").alias("line"), F.min("error").alias("error"))
        many = F.when((F.col("n") > 2) & F.col("key").startswith("i"), _error(F.col("line"), 5, "DuplicateId", F.concat(F.lit("more than two records of id "), F.expr("substr(key, 2)"))).cast(_ERROR))
        games = games.withColumn("error", F.coalesce("error", many)).withColumn("p", F.when(F.col("n") == 1, F.col("p")).when(F.col("p") > 2, 2).when(F.col("p") < 2, 0).otherwise(1))
    else:
        games = keyed
    return games.groupBy("lo", "hi").agg(F.count_if(F.col("p") == 2).alias("lo_wins"), F.count_if(F.col("p") == 0).alias("hi_wins"), F.count_if(F.col("p") == 1).alias("draws"), F.min("error").alias("error"))


def merge_edges(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.groupBy("lo", "hi").agg(*(F.sum(c).alias(c) for c in ("lo_wins", "hi_wins", "draws")))


def node_totals(edges: DataFrame) -> DataFrame:
    """(node, wins, draws, games)."""
    ends = F.explode(F.array(F.struct(F.col("lo").alias("node"), F.col("lo_wins").alias("wins")), F.struct(F.col("hi").alias("node"), F.col("hi_wins").alias("wins"))))
    rows = edges.select(ends.alias("e"), "draws", (F.col("lo_wins") + F.col("hi_wins") + F.col("draws")).alias("games"))
    return rows.groupBy("e.node").agg(F.sum("e.wins").alias("wins"), F.sum("draws").alias("draws"), F.sum("games").alias("games"))


class Graph:
    """Numbered nodes and edges (a, b, a_wins, b_wins, draws), sorted."""

    def __init__(self, nodes: int, edges: list[tuple[int, int, int, int, int]]):
        self.nodes = nodes
        table = np.array(sorted(edges), np.int64).reshape(-1, 5)
        self.a, self.b, self.games = table[:, 0], table[:, 1], table[:, 2:].astype(float)

    def components(self, games: np.ndarray | None = None) -> np.ndarray:
        """Strongly connected components, a win pointing from winner to loser and a draw both ways; numbered from 0.

        Depth first, twice: sources of the second round are taken by falling time of leaving in the first.
        """
        g = self.games if games is None else games
        to: list[list[int]] = [[] for _ in range(self.nodes)]
        back: list[list[int]] = [[] for _ in range(self.nodes)]
        for a, b, (wa, wb, d) in zip(self.a.tolist(), self.b.tolist(), g.tolist(), strict=True):
            for u, v, n in ((a, b, wa + d), (b, a, wb + d)):
                if n:
                    to[u].append(v)
                    back[v].append(u)
        left: list[int] = []
        self._visit(range(self.nodes), to, lambda root, nodes: left.extend(nodes))
        label = np.full(self.nodes, -1)
        count = iter(range(self.nodes))

        def name(root: int, nodes: list[int]) -> None:
            label[nodes] = next(count)

        self._visit(reversed(left), back, name)
        return label

    def _visit(self, order, to: list[list[int]], done) -> None:
        seen = [False] * self.nodes
        for root in order:
            if seen[root]:
                continue
            seen[root], out, stack = True, [], [(root, iter(to[root]))]
            while stack:
                u, rest = stack[-1]
                for v in rest:
                    if not seen[v]:
                        seen[v] = True
                        stack.append((v, iter(to[v])))
                        break
                else:
                    out.append(u)
                    stack.pop()
            done(root, out)

    def fit(self, games: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(component, elo) of every node: minorise-maximise steps, all components at once, each pinned to 0 at its least node."""
        g = self.games if games is None else games
        label = self.components(g)
        inside = label[self.a] == label[self.b]
        a, b, g = self.a[inside], self.b[inside], g[inside]
        pin = np.array([np.flatnonzero(label == c)[0] for c in label])
        wins = np.bincount(a, g[:, 0] + g[:, 2] / 2, self.nodes) + np.bincount(b, g[:, 1] + g[:, 2] / 2, self.nodes)
        n = g.sum(1)
        lone = wins == 0
        strength = np.ones(self.nodes)
        live = np.ones(self.nodes, bool)  # a component that has settled stays as it is
        for _ in range(STEPS):
            share = n / (strength[a] + strength[b])
            new = wins / np.maximum(np.bincount(a, share, self.nodes) + np.bincount(b, share, self.nodes), 1e-300)
            new[lone] = 1.0
            new /= new[pin]
            new = np.where(live, new, strength)
            change = np.abs(new - strength) / np.maximum(strength, 1e-300)
            strength = new
            worst = np.zeros(self.nodes)
            np.maximum.at(worst, label, change)
            live &= worst[label] >= TOLERANCE
            if not live.any():
                return label, 400 * np.log10(strength)
        return fail("BradleyTerryDidNotConverge", f"no convergence in {STEPS} steps")

    def joined(self, games: np.ndarray) -> bool:
        """Whether all nodes are one strongly connected component: the first reaches every node, and every node it."""
        to = np.zeros((self.nodes, self.nodes), bool)
        to[self.a, self.b] = games[:, 0] + games[:, 2] > 0
        to[self.b, self.a] = games[:, 1] + games[:, 2] > 0
        for step in (to, to.T):
            seen = new = np.arange(self.nodes) == 0
            while new.any():
                new = step[new].any(0) & ~seen
                seen = seen | new
            if not seen.all():
                return False
        return True

    def fit_joined(self, games: np.ndarray) -> np.ndarray:
        """Elo of every node of a graph that is one component and of which most pairs have played, on whole matrices."""
        n = np.zeros((self.nodes, self.nodes))
        n[self.a, self.b] = n[self.b, self.a] = games.sum(1)
        half = games[:, 2] / 2
        wins = np.bincount(self.a, games[:, 0] + half, self.nodes) + np.bincount(self.b, games[:, 1] + half, self.nodes)
        strength = np.ones(self.nodes)
        for _ in range(STEPS):
            new = wins / (n / (strength[:, None] + strength)).sum(1)
            new /= new[0]
            settled = (np.abs(new - strength) < TOLERANCE * strength).all()
            strength = new
            if settled:
                return 400 * np.log10(strength)
        return fail("BradleyTerryDidNotConverge", f"no convergence in {STEPS} steps")

    def differences(self, games: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Elo differences of the pairs in a resample; NaN where it doesn't connect them or has no fit."""
        i, j = pairs.T
        try:
            if 8 * len(self.a) >= self.nodes**2 and self.joined(games):
                elo = self.fit_joined(games)
                return elo[i] - elo[j]
            label, elo = self.fit(games)
        except GateError:
            return np.full(len(pairs), np.nan)
        return np.where(label[i] == label[j], elo[i] - elo[j], np.nan)


def _in_blocks(first: int, rows: np.ndarray) -> Iterator[pd.DataFrame]:
    """A matrix with a column a pair as rows (block, first, x), x the values of a block of pairs, row by row."""
    blocks = range(0, rows.shape[1], PAIR_BLOCK)
    yield pd.DataFrame({"block": range(len(blocks)), "first": first, "x": [rows[:, b : b + PAIR_BLOCK].ravel() for b in blocks]})


def _matrix(f: pd.DataFrame, width: int) -> np.ndarray:
    return np.concatenate([np.asarray(x).reshape(-1, width) for x in f.sort_values("first")["x"]])


def pairwise_intervals(spark: SparkSession, graph: Graph, label: np.ndarray, elo: np.ndarray, *, resamples: int, seed: int, confidence: float, method: str) -> DataFrame:
    """(a, b, ci_low, ci_high): bootstrap intervals of the rating differences of all connected pairs, by the nodes' numbers.

    A resample redraws the games of every edge and fits the graph once for all pairs. Pairs connected in fewer
    than nine tenths of the resamples get none. Resamples run as tasks, which hand on their draws in blocks of pairs;
    intervals are computed where a block's draws meet, and stay a table.
    """
    i, j = np.triu_indices(graph.nodes, 1)
    keep = label[i] == label[j]
    pairs = np.stack([i[keep], j[keep]], 1)
    schema = "a long, b long, ci_low double, ci_high double"
    if not len(pairs):
        return spark.createDataFrame([], schema)
    total = graph.games.sum(1).astype(np.int64)
    effect = elo[pairs[:, 0]] - elo[pairs[:, 1]]
    skew = _acceleration(spark, graph, pairs, effect) if method == "bca" else np.zeros(len(pairs))
    sent = spark.sparkContext.broadcast((graph, pairs, total, graph.games / total[:, None], effect, skew))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, p, n, q = sent.value[:4]
        for f in frames:
            for lo in range(0, len(f), RESAMPLE_BLOCK):
                rs = f["id"].tolist()[lo : lo + RESAMPLE_BLOCK]
                yield from _in_blocks(rs[0], np.stack([g.differences(generator(seed, r).multinomial(n, q).astype(float), p) for r in rs]))

    need = resamples * CONNECTED

    def close(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        at = int(key[0]) * PAIR_BLOCK
        e, a = (v[at : at + PAIR_BLOCK] for v in sent.value[4:])
        ends_of = sent.value[1][at : at + PAIR_BLOCK].tolist()
        draws, ends = _matrix(f, len(e)), []
        for k in range(len(e)):
            d = draws[~np.isnan(draws[:, k]), k]
            if len(d) < need:
                continue
            if method == "basic":
                lo, hi = numeric.basic_interval(d, e[k], confidence)
            elif method == "bca":
                lo, hi = numeric.bca_interval(d, e[k], a[k], confidence)
            else:
                lo, hi = numeric.percentile_interval(d, confidence)
            ends.append((*ends_of[k], lo, hi))
        return pd.DataFrame(ends, columns=["a", "b", "ci_low", "ci_high"])

    slices = max(1, min(resamples, 2 * spark.sparkContext.defaultParallelism))
    draws = spark.range(0, resamples, 1, slices).mapInPandas(run, "block long, first long, x array<double>")
    return draws.groupBy("block").applyInPandas(close, schema)


def _acceleration(spark: SparkSession, graph: Graph, pairs: np.ndarray, effect: np.ndarray) -> np.ndarray:
    """Of each pair, the skewness of its leave-one-game-out differences.

    One fit for each edge and result stands for all games of that kind. Fits run as tasks, which add up the weights
    and their products with the first three powers of the differences from the effect.
    """
    kinds = np.argwhere(graph.games > 0)
    sent = spark.sparkContext.broadcast((graph, pairs, effect, kinds))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, p, at, ks = sent.value
        sums = np.zeros((4, len(p)))
        for f in frames:
            for e, k in ks[f["id"].to_numpy()]:
                games = g.games.copy()
                games[e, k] -= 1
                d = g.differences(games, p) - at
                ok = ~np.isnan(d)
                sums[:, ok] += g.games[e, k] * np.stack([np.ones(ok.sum()), d[ok], d[ok] ** 2, d[ok] ** 3])
        yield from _in_blocks(0, sums)

    def add(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [int(key[0])], "x": [np.sum(np.stack([np.asarray(x) for x in f["x"]]), 0)]})

    slices = max(1, min(len(kinds), 2 * spark.sparkContext.defaultParallelism))
    parts = spark.range(0, len(kinds), 1, slices).mapInPandas(run, "block long, first long, x array<double>")
    rows = sorted(parts.groupBy("block").applyInPandas(add, "block long, x array<double>").collect())
    n, s1, s2, s3 = np.concatenate([np.array(r.x).reshape(4, -1) for r in rows], 1)
    mean = s1 / np.maximum(n, 1)
    squares, cubes = s2 - n * mean**2, s3 - 3 * mean * s2 + 2 * n * mean**3
    return np.array([numeric.acceleration_from_sums(-c, q) for c, q in zip(cubes, squares, strict=True)])
