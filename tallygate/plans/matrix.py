"""Pairwise rating matrices: in closed form where all games are against the baseline, else by a fitted graph."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import fail
from ..functions import columns, numeric
from ..operators import graph, netting
from ..operators.trials import matches, raise_error
from ..schema import BASELINE, DEFAULT_SEED, SCHEMA_VERSION, Metric, check_confidence
from ..sources.readers import Files

_ELO = [Metric("elo")]


def legacy_totals(rows: DataFrame, paired: bool) -> DataFrame:
    """Counts of each candidate's trials against the baseline: all files in one pass, by the column ``of_file``."""
    return netting.totals(netting.by_key(rows, _ELO, ("of_file",)), _ELO, paired, ("of_file",))


def _as_files(tables: list) -> Files:
    """Tables, or pairs of a name and a table, as records of many files."""
    named = [t if isinstance(t, tuple) else (str(i), t) for i, t in enumerate(tables)]
    numbered = [df.withColumn("of_file", F.lit(i)) for i, (_, df) in enumerate(named)]
    both = numbered[0]
    for t in numbered[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    return Files([n for n, _ in named], both)


def matrix(spark: SparkSession, legacy: Files | list[tuple[str, DataFrame]], match_tables: Files | list[DataFrame], *, confidence: float = 0.95, paired: bool = False, resamples: int = 2000, seed: int = DEFAULT_SEED, method: str = "percentile") -> dict:
    """``legacy`` are trials by candidate, ``match_tables`` head-to-head records; the order names the candidates.

    Files read together are one scan each for trials and matches.
    """
    check_confidence(confidence)
    trial_files = legacy if isinstance(legacy, Files) else _as_files(legacy) if legacy else None
    match_files = match_tables if isinstance(match_tables, Files) else _as_files(match_tables) if match_tables else None
    names = trial_files.names if trial_files else []
    if len(set(names)) < len(names):
        fail("InvalidThreshold", "two files have the same name")
    if BASELINE in names:
        fail("InvalidThreshold", f"a candidate can't be named {BASELINE}")
    edges: dict[tuple[str, str], list[int]] = {}
    summaries: dict[str, dict] = {}

    def add(a: str, b: str, wins: int, losses: int, draws: int) -> None:
        if wins + losses + draws:
            e = edges.setdefault((min(a, b), max(a, b)), [0, 0, 0])
            for i, k in enumerate((wins, losses) if a < b else (losses, wins)):
                e[i] += k
            e[2] += draws

    if trial_files:
        rows = {names[r["of_file"]]: r.asDict() for r in legacy_totals(trial_files.rows, paired).collect()}
        for n in names:
            if n not in rows:
                fail("EmptyInput", f"{n} has no records")
            raise_error(rows[n]["error"])
            if rows[n]["late_error"]:
                raise_error(netting.repeated(trial_files.rows.where(F.col("of_file") == names.index(n)), _ELO, paired).first())
            summaries[n] = rows[n]
            w, d, x = (int(rows[n][f"{k}_report_only"]) for k in "wdl")
            add(n, BASELINE, w, x, d)
    order = list(names)
    if match_files:
        both = matches(match_files.rows).withColumnRenamed("of_file", "file").persist()
        try:
            for r in graph.match_edges(both, paired).collect():
                raise_error(r["error"])
                add(r["lo"], r["hi"], r["lo_wins"], r["hi_wins"], r["draws"])
            order += [n for n in first_seen(both) if n not in order and n != BASELINE]
        finally:
            both.unpersist()
    if not order:
        fail("EmptyInput", "there are no records")
    star = all(BASELINE in pair for pair in edges)
    build = _star if star else _general
    candidates, found = build(spark, order, summaries, edges, confidence=confidence, resamples=resamples, seed=seed, method=method)
    return {"schema_version": SCHEMA_VERSION, "confidence": confidence, "candidates": candidates, "matrix": found}


def first_seen(rows: DataFrame) -> list[str]:
    """Competitors by file, line and side of their first record."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("name"), F.lit(0).alias("side")), F.struct(F.col("b").alias("name"), F.lit(1).alias("side"))))
    seen = rows.select("file", "line", ends.alias("e")).groupBy("e.name").agg(F.min(F.struct("file", "line", "e.side")).alias("at"))
    return [r["name"] for r in seen.orderBy("at").collect()]


def _summary(name: str, elo: float, ci: tuple | None, losses: int, wins: int, n: int, row: dict | None, component: int) -> dict:
    failures = netting_failures(row)
    return {"name": name, "elo": elo, "ci_low": ci and ci[0], "ci_high": ci and ci[1], "baseline_count": losses, "candidate_count": wins, "paired_count": n, **failures, "component": component}


def netting_failures(row: dict | None) -> dict:
    return {f: sum(int(row[f"{s}_{k}"] or 0) for s in netting.SIDES) if row else 0 for f, k in (("timeouts", "timeout"), ("crashes", "crash"), ("invalid", "invalid"))}


def _cell(row: str, col: str, diff: float | None, ci: tuple | None, status: str) -> dict:
    return {"row": row, "col": col, "elo_diff": diff, "ci_low": ci and ci[0], "ci_high": ci and ci[1], "direct": status == "direct", "status": status}


def _star(spark, order, summaries, edges, *, confidence, **_) -> tuple[list[dict], list[dict]]:
    found = []
    for name in order:
        row = summaries.get(name)
        if row:
            w, d, x = (int(row[f"{k}_report_only"]) for k in "wdl")
        else:
            lo, hi, d = edges[(min(name, BASELINE), max(name, BASELINE))]
            w, x = (lo, hi) if name < BASELINE else (hi, lo)
        n = w + d + x
        score = (w + d / 2) / n if n else None
        elo, ci = (numeric.elo_from_score(score), numeric.elo_interval(score, n, confidence)) if n else (0.0, (0.0, 0.0))
        found.append(_summary(name, elo, ci, x, w, n, row, 0))
    cells = [_cell(BASELINE, c["name"], -c["elo"], (-c["ci_high"], -c["ci_low"]), "direct") for c in found]
    for i, a in enumerate(found):
        for b in found[i + 1 :]:
            diff, margin = a["elo"] - b["elo"], math.hypot(*((c["ci_high"] - c["ci_low"]) / 2 for c in (a, b)))
            cells.append(_cell(a["name"], b["name"], diff, (diff - margin, diff + margin), "inferred"))
    return found, cells


def _general(spark, order, summaries, edges, *, confidence, resamples, seed, method) -> tuple[list[dict], list[dict]]:
    nodes = [BASELINE] * any(BASELINE in pair for pair in edges) + order
    number = {n: i for i, n in enumerate(nodes)}
    listed = []
    for (lo, hi), (lo_wins, hi_wins, draws) in edges.items():
        listed.append((number[lo], number[hi], lo_wins, hi_wins, draws))
    g = graph.Graph(len(nodes), listed)
    label, elo = g.fit()
    intervals = graph.pairwise_intervals(spark, g, label, elo, resamples=resamples, seed=seed, confidence=confidence, method=method)
    totals = {n: [0, 0, 0] for n in nodes}
    for (lo, hi), (lo_wins, hi_wins, draws) in edges.items():
        for n, w in ((lo, lo_wins), (hi, hi_wins)):
            totals[n] = [x + y for x, y in zip(totals[n], (w, draws, lo_wins + hi_wins + draws), strict=True)]
    found = []
    for n in order:
        w, d, games = totals[n]
        found.append(_summary(n, float(elo[number[n]]), None, games - w - d, w, games, None, int(label[number[n]])))
    rated = [(n, i, int(label[i]), float(elo[i])) for n, i in number.items()]
    made = cells(spark.createDataFrame(rated, "node string, place long, component long, elo double"), spark.createDataFrame([*edges], "lo string, hi string"), intervals)
    ci = lambda r: None if r.ci_low is None else (r.ci_low, r.ci_high)
    return found, [_cell(r.row_name, r.col_name, r.elo_diff, ci(r), r.status) for r in made.orderBy("row_place", "col_place").collect()]


#: Tiles that names are dealt to, so that a pair is looked up among few.
TILES = 64


def cells(nodes: DataFrame, edges: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """(row_name, col_name, row_place, col_place, elo_diff, ci_low, ci_high, status) of all pairs, as one declared plan.

    ``nodes`` are (node, place, component, elo), and a pair's row is the end of the lower place. A pair of one component has a
    difference, and is ``direct`` if ``edges`` (lo, hi; each pair once) holds it, else ``inferred``; other pairs are ``disconnected``.
    ``intervals`` are (a, b, ci_low, ci_high) by places, a < b. The nodes' join with one another has their number squared as its
    result, which is what a matrix is. Pairs are made last and aren't moved: the nodes, whose number's square can be written, are
    broadcast by tile. Pairs of unlike components need no more than both names, which most pairs of a graph of many components are. Within a component
    a row brings whom it met, by tile of the others' names, and nodes are looked up by component and tile.
    """
    spark = nodes.sparkSession
    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(TILES)).cast("int").alias("tile")
    a, b = (nodes.select(F.col("node").alias(f"{s}_name"), F.col("place").alias(f"{s}_place"), F.col("component").alias(f"{s}_of"), F.col("elo").alias(f"{s}_elo")) for s in ("row", "col"))
    sides = edges.select(F.col("lo").alias("row_name"), F.col("hi").alias("other")).union(edges.select("hi", "lo"))
    lists = sides.groupBy("row_name", tile("other")).agg(F.collect_set("other").alias("met")).groupBy("row_name").agg(F.map_from_entries(F.collect_list(F.struct("tile", "met"))).alias("lists"))
    dealt, ahead, one = 4 * spark.sparkContext.defaultParallelism, F.col("row_place") < F.col("col_place"), F.col("row_of") == F.col("col_of")
    shown, none = ("row_name", "col_name", "row_place", "col_place"), F.lit(None).cast("double")
    tiles = lambda df: df.repartition(dealt, "row_name").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(TILES - 1))))
    of_tile, same = b.withColumn("col_tile", tile("col_name")), F.col("tile") == F.col("col_tile")
    apart = tiles(a.drop("row_elo")).join(F.broadcast(of_tile.drop("col_elo")), same & ahead & ~one)
    apart = apart.select(*shown, *(none.alias(c) for c in ("elo_diff", "ci_low", "ci_high")), F.lit("disconnected").alias("status"))
    rows = tiles(a.join(lists, "row_name", "left")).withColumn("met", F.try_element_at("lists", F.col("tile"))).drop("lists")
    linked = rows.join(F.broadcast(of_tile), one & same & ahead)
    if intervals is None:
        linked = linked.withColumns({c: none for c in ("ci_low", "ci_high")})
    else:
        linked = linked.join(intervals.withColumnsRenamed({"a": "row_place", "b": "col_place"}), ["row_place", "col_place"], "left")
    diff, status = F.col("row_elo") - F.col("col_elo"), F.when(F.array_contains("met", F.col("col_name")), "direct").otherwise("inferred")
    return apart.union(linked.select(*shown, diff.alias("elo_diff"), "ci_low", "ci_high", status.alias("status")))


def star_cells(edges: DataFrame, confidence: float) -> DataFrame:
    """The star matrix as one declared plan over edges with the baseline: (row_name, col_name, elo_diff, ci_low, ci_high).

    The join of candidates with one another has their number squared as its result, which is what a matrix is.
    """
    base = F.col("lo") == BASELINE
    side = lambda a, b: F.when(base, F.col(a)).otherwise(F.col(b))
    rows = edges.where(base | (F.col("hi") == BASELINE)).select(side("hi", "lo").alias("name"), side("hi_wins", "lo_wins").alias("w"), F.col("draws").alias("d"), (F.col("lo_wins") + F.col("hi_wins") + F.col("draws")).alias("n"))
    score = (F.col("w") + F.col("d") / 2) / F.col("n")
    lo, hi = (columns.elo_from_score(x) for x in columns.wilson(score, F.col("n"), confidence))
    c = rows.where("n > 0").select("name", columns.elo_from_score(score).alias("elo"), lo.alias("lo"), hi.alias("hi"))
    first = c.select(F.lit(BASELINE).alias("row_name"), F.col("name").alias("col_name"), (-F.col("elo")).alias("elo_diff"), (-F.col("hi")).alias("ci_low"), (-F.col("lo")).alias("ci_high"))
    a, b = (c.select(*(F.col(x).alias(f"{x}_{s}") for x in c.columns)) for s in "ab")
    diff = F.col("elo_a") - F.col("elo_b")
    margin = F.hypot((F.col("hi_a") - F.col("lo_a")) / 2, (F.col("hi_b") - F.col("lo_b")) / 2)
    rest = a.join(b, F.col("name_a") < F.col("name_b")).select(F.col("name_a").alias("row_name"), F.col("name_b").alias("col_name"), diff.alias("elo_diff"), (diff - margin).alias("ci_low"), (diff + margin).alias("ci_high"))
    return first.union(rest)
