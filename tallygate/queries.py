"""The gate's registered queries: trial tables derived from the tables of a folder, and the same in plain SQL.

The views below are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns, numeric
from .operators import graph, large_graph, netting, ranks, resample, trials
from .plans import compare as comparisons
from .plans import correction
from .plans import matrix as matrices
from .plans import power, recommend
from .plans import sprt as sequential
from .schema import BASELINE, DEFAULT_SEED, FailureCaps, Metric, Options, SprtConfig, Thresholds
from .sources.readers import read, read_files
from .sources.scratch import Table, shared_folder
from .streaming.windows import paired_windows, replay

PAIRS = """SELECT CAST(l_orderkey AS STRING) AS id, CAST(l_orderkey AS BIGINT) AS line,
    avg(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DOUBLE) END) AS baseline, avg(CASE WHEN l_returnflag <> 'N' THEN CAST(l_extendedprice AS DOUBLE) END) AS candidate
    FROM {lineitem} GROUP BY l_orderkey HAVING count(CASE WHEN l_returnflag = 'N' THEN 1 END) > 0 AND count(CASE WHEN l_returnflag <> 'N' THEN 1 END) > 0"""
OUTCOMES = f"""SELECT id, line, CASE WHEN abs(candidate - baseline) < 0.05 * baseline THEN 'draw' WHEN candidate > baseline THEN 'candidate_win' ELSE 'baseline_win' END AS result FROM ({PAIRS}) p"""
STATUSES = f"""SELECT id, line, result, CASE line % 97 WHEN 0 THEN 'timeout' WHEN 3 THEN 'crash' ELSE 'ok' END AS baseline_status,
    CASE line % 97 WHEN 1 THEN 'crash' WHEN 2 THEN 'invalid' WHEN 3 THEN 'crash' ELSE 'ok' END AS candidate_status FROM ({OUTCOMES}) o"""
CLUSTERS = """SELECT CAST(user_id AS STRING) AS id, CAST(event_id AS BIGINT) AS line, CASE WHEN value > 60 THEN 'candidate_win' WHEN value < 40 THEN 'baseline_win' ELSE 'draw' END AS result FROM {events}"""
GAMES = """SELECT user_id, concat(CAST(user_id AS STRING), '-', CAST((k + 1) DIV 2 AS STRING)) AS id, line, CASE WHEN value > 60 THEN 'candidate_win' WHEN value < 40 THEN 'baseline_win' ELSE 'draw' END AS result, k > n - n % 2 AS single
    FROM (SELECT user_id, CAST(event_id AS BIGINT) AS line, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM {events}) e"""
# A user's odd game has no second one: for the pentanomial test its trial timed out.
PAIRED_GAMES = f"SELECT id, line, CASE WHEN NOT single THEN result END AS result, CASE WHEN single THEN 'timeout' ELSE 'ok' END AS candidate_status FROM ({GAMES}) g"
MATCHES = """SELECT CAST(NULL AS STRING) AS id, line, a, b, CASE WHEN abs(value - next) <= 5 THEN 'draw' WHEN value > next THEN 'a_win' ELSE 'b_win' END AS result
    FROM (SELECT CAST(event_id AS BIGINT) AS line, event_type AS a, lead(event_type) OVER w AS b, value, lead(value) OVER w AS next FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) e WHERE b IS NOT NULL AND a <> b"""
STAR = f"""SELECT id, line, CASE WHEN a = 'view' THEN '{BASELINE}' ELSE a END AS a, CASE WHEN b = 'view' THEN '{BASELINE}' ELSE b END AS b, result FROM ({MATCHES}) m WHERE a = 'view' OR b = 'view'"""

CONFIG, RESAMPLES, SEED, DIGITS = SprtConfig(0, 5), 10_000, 7, 6


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"{([a-z]+)}", sql))})


def duck(sql: str) -> str:
    return re.sub(r"{([a-z]+)}", r"\1", sql).replace(" DIV ", " // ")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of digits, so that sums in another order compare equal; no negative zero."""
    return df.select(*((F.round(c, DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Fields of reports as a table."""
    names = [c.split()[0] for c in schema.split(", ")]
    return rounded(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = duck(sql)
        return f

    return register


# --- closed-form metrics ------------------------------------------------------------------------

_Z = 1.959963984540054  # the normal quantile at 0.975
_R = f"round({{}}, {DIGITS}) + 0.0"


def _elo_sql(p: str) -> str:
    return f"(-400 * log10(1 / least(greatest({p}, 1e-4), 1 - 1e-4) - 1))"


def _closed_sql(counts: str, scale: Callable[[str], str], metric: str, draws: bool = False, keys: str = "") -> str:
    """SQL for report rows from a subquery with w, d and l, and with ``keys``."""
    more = f"{keys}, " if keys else ""
    total, wins = ("w + d + l", "w + d / 2.0") if draws else ("w + l", "1.0 * w")
    return f"""SELECT {more}'{metric}' AS metric, baseline_count, candidate_count, paired_count, {_R.format(scale("p"))} AS effect, {_R.format(scale("lo"))} AS ci_low, {_R.format(scale("hi"))} AS ci_high, false AS has_error,
        CASE WHEN {scale("lo")} >= 0 THEN 'pass' WHEN {scale("hi")} <= 0 THEN 'fail' ELSE 'inconclusive' END AS verdict
        FROM (SELECT *, greatest(0, (p + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) - {_Z} / (1 + {_Z * _Z} / n) * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n))) AS lo,
            least(1, (p + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) + {_Z} / (1 + {_Z * _Z} / n) * sqrt(p * (1 - p) / n + {_Z * _Z} / (4 * n * n))) AS hi
            FROM (SELECT {more}l AS baseline_count, w AS candidate_count, ({total})::BIGINT AS paired_count, ({total})::DOUBLE AS n, ({wins}) / ({total}) AS p FROM ({counts}) c) x) y"""


def _tally(source: str, keep: str = "true", outcome: str = "result") -> str:
    return f"SELECT count(*) FILTER (o = 'candidate_win') AS w, count(*) FILTER (o = 'draw') AS d, count(*) FILTER (o = 'baseline_win') AS l FROM (SELECT {outcome} AS o FROM ({source}) s WHERE {keep}) t"


_PP = lambda x: f"({x} - 0.5)"
_SIGNS = f"SELECT count(*) FILTER (candidate > baseline) AS w, 0 AS d, count(*) FILTER (candidate < baseline) AS l FROM ({PAIRS}) p"
_FAILED = {s: f"{s}_status IN ('timeout', 'crash', 'invalid')" for s in ("baseline", "candidate")}
_NETTED = f"SELECT user_id, CASE WHEN p > n THEN 'candidate_win' WHEN p < n THEN 'baseline_win' ELSE 'draw' END AS result FROM (SELECT user_id, id, count(*) AS n, sum(CASE result WHEN 'candidate_win' THEN 2 WHEN 'draw' THEN 1 ELSE 0 END) AS p FROM ({GAMES}) g GROUP BY user_id, id) n"


def _metric(spark: SparkSession, sf_dir: str, sql: str, *metrics: Metric, **options) -> DataFrame:
    return rounded(comparisons.closed_form(view(spark, sf_dir, sql), list(metrics), Options(**options)))


@query(_closed_sql(_tally(OUTCOMES), _PP, "winrate"))
def winrate_wilson(spark, sf_dir):
    return _metric(spark, sf_dir, OUTCOMES, Metric("winrate"))


@query(_closed_sql(_tally(OUTCOMES), _elo_sql, "elo", True))
def elo(spark, sf_dir):
    return _metric(spark, sf_dir, OUTCOMES, Metric("elo"))


@query(_closed_sql(_SIGNS, _PP, "sign-test"))
def sign_test(spark, sf_dir):
    return _metric(spark, sf_dir, PAIRS, Metric("sign-test"))


@query(f"({_closed_sql(_tally(OUTCOMES), _PP, 'winrate')}) UNION ALL ({_closed_sql(_tally(OUTCOMES), _elo_sql, 'elo', True)}) UNION ALL ({_closed_sql(_SIGNS, _PP, 'sign-test')})")
def multi_metric(spark, sf_dir):
    return _metric(spark, sf_dir, _BOTH, Metric("winrate"), Metric("elo"), Metric("sign-test"))


@query(_closed_sql(_tally(_NETTED), _PP, "winrate"))
def winrate_paired(spark, sf_dir):
    return _metric(spark, sf_dir, GAMES, Metric("winrate"), paired=True)


@query(_closed_sql(_tally(_NETTED), _elo_sql, "elo", True))
def elo_paired(spark, sf_dir):
    return _metric(spark, sf_dir, GAMES, Metric("elo"), paired=True)


@query(_closed_sql(_tally(STATUSES), _PP, "winrate"))
def policy_report_only(spark, sf_dir):
    return _metric(spark, sf_dir, STATUSES, Metric("winrate", policy="report-only"))


@query(_closed_sql(_tally(STATUSES, f"NOT ({_FAILED['baseline']} OR {_FAILED['candidate']})"), _PP, "winrate"))
def policy_exclude(spark, sf_dir):
    return _metric(spark, sf_dir, STATUSES, Metric("winrate", policy="exclude"))


@query(_closed_sql(_tally(STATUSES, outcome=f"CASE WHEN {_FAILED['baseline']} AND {_FAILED['candidate']} THEN 'draw' WHEN {_FAILED['baseline']} THEN 'candidate_win' WHEN {_FAILED['candidate']} THEN 'baseline_win' ELSE result END"), _PP, "winrate"))
def policy_loss(spark, sf_dir):
    return _metric(spark, sf_dir, STATUSES, Metric("winrate", policy="loss"))


_BY_USER = f"SELECT id AS team, count(*) FILTER (result = 'candidate_win') AS w, count(*) FILTER (result = 'draw') AS d, count(*) FILTER (result = 'baseline_win') AS l FROM ({CLUSTERS}) c GROUP BY id"


@query(_closed_sql(_BY_USER, _elo_sql, "elo", True, "team"))
def grouped_elo(spark, sf_dir):
    """One report for each group, in one plan."""
    rows = view(spark, sf_dir, CLUSTERS).withColumn("team", F.col("id"))
    return rounded(comparisons.closed_form(rows, [Metric("elo")], by=("team",)))


_SQUADS = f"SELECT user_id % 7 AS squad, user_id % 3 AS league, id, line, result FROM ({GAMES}) g"


def _sets_sql() -> str:
    """SQL for win rates and ratings of squads, leagues, both and all, from pairs netted once."""
    counts = f"""SELECT user_id % 7 AS squad, user_id % 3 AS league, GROUPING(squad, league)::BIGINT AS grouping_id, count(*) FILTER (result = 'candidate_win') AS w, count(*) FILTER (result = 'draw') AS d,
        count(*) FILTER (result = 'baseline_win') AS l FROM ({_NETTED}) n GROUP BY GROUPING SETS ((squad, league), (squad), (league), ())"""
    counts = f"SELECT * REPLACE (coalesce(squad::VARCHAR, 'all') AS squad, coalesce(league::VARCHAR, 'all') AS league) FROM ({counts}) t"
    keys = "squad, league, grouping_id"
    return " UNION ALL ".join(f"({_closed_sql(counts, scale, metric, draws, keys)})" for scale, metric, draws in ((_PP, "winrate", False), (_elo_sql, "elo", True)))


@query(_sets_sql())
def grouping_sets(spark, sf_dir):
    """Reports at several grains, from tallies netted once by id."""
    sets = [("squad", "league"), ("squad",), ("league",), ()]
    made = comparisons.closed_form_sets(view(spark, sf_dir, _SQUADS), [Metric("winrate"), Metric("elo")], sets, Options(paired=True))
    return rounded(made.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("squad", "league")}))


# --- readers: the trials written as files and read again ---------------------------------------------


def _written(spark: SparkSession, sf_dir: str, fmt: str, trials: str) -> DataFrame:
    path = f"{shared_folder(spark)}/trials-{uuid.uuid4().hex}.{fmt}"
    rows = view(spark, sf_dir, trials).select("id", "baseline", "candidate", "result")
    rows.write.options(header=True, escape='"').format("json" if fmt == "jsonl" else fmt).save(path)
    return rounded(read(spark, path).select("id", "baseline", "candidate", "result"))


_BOTH = f"SELECT p.id, p.line, p.baseline, p.candidate, o.result FROM ({PAIRS}) p JOIN ({OUTCOMES}) o USING (line)"
_READ = f"SELECT id, {_R.format('baseline')} AS baseline, {_R.format('candidate')} AS candidate, result FROM ({_BOTH}) b"


@query(_READ)
def read_jsonl(spark, sf_dir):
    return _written(spark, sf_dir, "jsonl", _BOTH)


@query(_READ)
def read_csv(spark, sf_dir):
    return _written(spark, sf_dir, "csv", _BOTH)


_MANY_LINES = f"SELECT concat('a \"', id, '\",', chr(10), chr(10), '\"', line, '\"') AS id, baseline, candidate, result FROM ({_BOTH}) b"


@query(f"SELECT id, {_R.format('baseline')} AS baseline, {_R.format('candidate')} AS candidate, result FROM ({_MANY_LINES}) m")
def read_csv_quoted(spark, sf_dir):
    """Every record has a cell of three lines, with quotes and commas."""
    return _written(spark, sf_dir, "csv", _MANY_LINES)


@query("SELECT concat('event_type=', event_type) AS name, count(*) FILTER (value > 60) AS wins, count(*) FILTER (value BETWEEN 40 AND 60) AS draws, count(*) FILTER (value < 40) AS losses, count(*) AS n_rows, min(event_id)::BIGINT AS first_id FROM events GROUP BY event_type")
def read_many_files(spark, sf_dir):
    """Trials of several candidates, a folder of files each, read in one scan and counted by candidate."""
    path = f"{shared_folder(spark)}/many-{uuid.uuid4().hex}"
    rows = view(spark, sf_dir, f"SELECT CAST(line AS STRING) AS id, result, event_type FROM ({CLUSTERS}) c JOIN {{events}} e ON event_id = line")
    rows.write.partitionBy("event_type").json(path)
    kinds = sorted(r[0] for r in rows.select("event_type").distinct().collect())
    files = read_files(spark, [f"{path}/event_type={k}" for k in kinds])
    first = files.rows.groupBy("of_file").agg(F.min(F.col("id").cast("long")).alias("first_id"))
    names = F.get(F.array(*map(F.lit, files.names)), F.col("of_file"))
    counts = matrices.legacy_totals(files.rows, False).join(first, "of_file")
    return counts.select(names.alias("name"), *(F.col(f"{k}_report_only").alias(n) for k, n in (("w", "wins"), ("d", "draws"), ("l", "losses"))), "n_rows", "first_id")


# --- counts ------------------------------------------------------------------------------------------


@query(f"SELECT {', '.join(f'count(*) FILTER ({s}_status = {k!r}) AS {s}_{k}' for s in netting.SIDES for k in ('timeout', 'crash', 'invalid'))} FROM ({STATUSES}) s")
def failure_breakdown(spark, sf_dir):
    m = [Metric("winrate")]
    rows = netting.totals(netting.by_key(view(spark, sf_dir, STATUSES), m), m, False)
    return rows.select(*(f"{s}_{k}" for s in netting.SIDES for k in ("timeout", "crash", "invalid")))


@query(f"SELECT sum(n)::BIGINT AS records_with_id, max(n)::BIGINT AS max_id_count FROM (SELECT id, count(*) AS n FROM ({CLUSTERS}) c GROUP BY id) x")
def id_diversity(spark, sf_dir):
    m = [Metric("winrate")]
    return netting.totals(netting.by_key(view(spark, sf_dir, CLUSTERS), m), m, False).select("records_with_id", "max_id_count")


@query(f"SELECT w, d, l, count(*) AS clusters FROM (SELECT id, count(*) FILTER (result = 'candidate_win') AS w, count(*) FILTER (result = 'draw') AS d, count(*) FILTER (result = 'baseline_win') AS l FROM ({CLUSTERS}) c GROUP BY id) x GROUP BY ALL")
def cluster_kinds(spark, sf_dir):
    return netting.cluster_table(netting.by_key(view(spark, sf_dir, CLUSTERS), [Metric("winrate")]), "report-only")


@query(f"SELECT {_R.format('avg(candidate - baseline)')} AS effect, count(*) AS paired_count, {_R.format('stddev_samp(candidate - baseline)')} AS sd FROM ({PAIRS}) p")
def mean_diff_point(spark, sf_dir):
    m = [Metric("mean-diff")]
    rows = netting.totals(netting.by_key(view(spark, sf_dir, PAIRS), m), m, False)
    return rounded(rows.select(F.col("mean_diff").alias("effect"), F.col("n_diff").alias("paired_count"), F.col("sd_diff").alias("sd")))


@query(f"SELECT q, {_R.format('v')} AS effect FROM (SELECT unnest([0.1, 0.5, 0.9]) AS q, unnest(quantile_cont(candidate - baseline, [0.1, 0.5, 0.9])) AS v FROM ({PAIRS}) p) x")
def quantile_diff_point(spark, sf_dir):
    """Looked up by the operator that reports use."""
    rows = view(spark, sf_dir, PAIRS).select((F.col("candidate") - F.col("baseline")).alias("d"))
    n = rows.count()
    at = [q * (n - 1) for q in (0.1, 0.5, 0.9)]
    ends = ranks.order_statistics(rows, "d", n)(np.floor([at, np.ceil(at)]).astype(int)) if n else np.empty((2, 0))
    made = [{"q": q, "effect": float(lo + (h - int(h)) * (hi - lo))} for q, h, lo, hi in zip((0.1, 0.5, 0.9), at, *ends)]
    return table(spark, made, "q double, effect double")


_REPEATED = "SELECT CAST(user_id AS STRING) AS id, CAST(event_id AS BIGINT) AS line, 50.0 AS baseline, value AS candidate FROM {events}"


def _duplicate_sql(kth: int) -> str:
    ordered = f"SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY line) AS k FROM ({_REPEATED}) r"
    return f"SELECT 'DuplicateId' AS kind, line, id FROM ({ordered}) o WHERE k = {kth} ORDER BY line LIMIT 1"


@query(_duplicate_sql(2))
def duplicate_id(spark, sf_dir):
    """The first record whose id came before: what a report of numbers refuses."""
    return netting.repeated(view(spark, sf_dir, _REPEATED), [Metric("mean-diff")], False).select("kind", "line", "id")


@query(_duplicate_sql(3))
def duplicate_id_paired(spark, sf_dir):
    return netting.repeated(view(spark, sf_dir, _REPEATED), [Metric("mean-diff")], True).select("kind", "line", "id")


_BAD = """SELECT CAST(event_id AS STRING) AS id, CAST(event_id AS BIGINT) AS line, CASE WHEN event_type = 'error' THEN 'boom' ELSE 'ok' END AS baseline_status,
    CASE WHEN value > 60 THEN 'candidate_win' WHEN value < 3 THEN 'tie' WHEN value < 40 THEN 'baseline_win' ELSE 'draw' END AS result FROM {events}"""


@query(f"""SELECT kind, detail, count(*) AS n_rows, min(line) AS line FROM (SELECT line, CASE WHEN baseline_status = 'boom' THEN 'UnrecognizedStatus' WHEN result = 'tie' THEN 'UnrecognizedOutcome' END AS kind,
    CASE WHEN baseline_status = 'boom' THEN 'baseline_status is boom' ELSE concat('result is ', result) END AS detail FROM ({_BAD}) b) e WHERE kind IS NOT NULL GROUP BY kind, detail""")
def row_errors(spark, sf_dir):
    """What is wrong with rows, by kind."""
    rows = trials.trials(view(spark, sf_dir, _BAD)).select(trials.row_error([Metric("elo")]).alias("e")).where("e is not null")
    return rows.groupBy("e.kind", "e.detail").agg(F.count("*").alias("n_rows"), F.min("e.line").alias("line"))


# --- paired differences and matches -----------------------------------------------------------------------

_TWICE = "SELECT CAST(l_orderkey AS STRING) || '-' || CAST((l_linenumber + 1) DIV 2 AS STRING) AS id, CAST(l_orderkey AS BIGINT) * 100 + l_linenumber AS line, 40000.0 AS baseline, CAST(l_extendedprice AS DOUBLE) AS candidate FROM {lineitem}"
_MEANS = f"SELECT id, avg(candidate - baseline) AS diff, count(*) AS n FROM ({_TWICE}) t GROUP BY id"


@query(f"SELECT count(*) AS paired_count, count(*) FILTER (diff > 0) AS pos, count(*) FILTER (diff < 0) AS neg, {_R.format('avg(diff)')} AS effect, {_R.format('stddev_samp(diff)')} AS sd FROM ({_MEANS}) m WHERE n <= 2")
def paired_diffs(spark, sf_dir):
    """Two records of an id are one mean difference."""
    m = [Metric("mean-diff")]
    rows = netting.totals(netting.by_key(view(spark, sf_dir, _TWICE), m).where("n_diff <= 2"), m, True)
    return rounded(rows.select(F.col("n_diff").alias("paired_count"), "pos", "neg", F.col("mean_diff").alias("effect"), F.col("sd_diff").alias("sd")))


# Odd and even games of two types of event, by the minute, are a pair.
_PAIRED_MATCHES = f"SELECT CASE WHEN k <= n - n % 2 THEN CAST((k + 1) DIV 2 AS STRING) END AS id, line, a, b, result FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY line) AS k, count(*) OVER (PARTITION BY least(a, b), greatest(a, b)) AS n FROM ({MATCHES}) m) p"
_MATCH_POINTS = f"SELECT least(a, b) AS lo, greatest(a, b) AS hi, coalesce(id, 'x' || line) AS game, count(*) AS n, sum(CASE WHEN result = 'draw' THEN 1 WHEN (result = 'a_win') = (a < b) THEN 2 ELSE 0 END) AS p FROM ({_PAIRED_MATCHES}) m GROUP BY ALL"


@query(f"SELECT lo, hi, count(*) FILTER (p > n) AS lo_wins, count(*) FILTER (p < n) AS hi_wins, count(*) FILTER (p = n) AS draws FROM ({_MATCH_POINTS}) g GROUP BY lo, hi")
def matrix_edges_paired(spark, sf_dir):
    """Two matches of a pair with one id are one game; a match without id is its own."""
    return graph.match_edges(view(spark, sf_dir, _PAIRED_MATCHES), True).drop("error")


# --- streams --------------------------------------------------------------------------------------------

_TIMED = f"SELECT g.user_id % 7 AS squad, id, line, result, ts FROM ({GAMES}) g JOIN {{events}} e ON event_id = line"
# Records come up to an hour after their time, one in ten of them once more up to five hours later.
_DELIVERED = f"SELECT *, ts + make_interval(0, 0, 0, 0, 0, 0, line * 7919 % 3600) AS arrival FROM ({_TIMED}) t UNION ALL SELECT *, ts + make_interval(0, 0, 0, 0, 4, 0, line * 7919 % 3600) FROM ({_TIMED}) t WHERE line % 10 = 0"
_COUNTED = f"SELECT squad, id, max(ts) AS last, count(*) AS n, sum(CASE result WHEN 'candidate_win' THEN 2 WHEN 'draw' THEN 1 ELSE 0 END) AS p FROM ({_TIMED}) t GROUP BY squad, id"


@query(f"""SELECT strftime(CASE WHEN n = 1 THEN last + INTERVAL 20 DAY ELSE last END, '%Y-%m-%d') AS day, squad, {', '.join(f"count(*) FILTER (n = 2 AND p = {b}) AS bucket_{b}" for b in range(5))},
    count(*) FILTER (n = 1) AS unpaired, 0::BIGINT AS excess FROM ({_COUNTED}) c GROUP BY ALL""")
def stream_pairs(spark, sf_dir):
    """Pentanomial counts by day and squad from micro-batches in event time, with repeated and late deliveries."""
    rows = view(spark, sf_dir, _DELIVERED)
    days = Table(rows.select(F.datediff("arrival", F.lit("2024-01-01").cast("date")).alias("day"), *rows.columns), "delivered").df
    last = view(spark, sf_dir, "SELECT max(ts) AS ts FROM {events}").first()["ts"]
    end = spark.createDataFrame([(0, "end", -1, "draw", last + timedelta(days=400))], "squad long, id string, line long, result string, ts timestamp")
    pieces = [days.where(F.floor(F.col("day") / 11) == k).drop("day", "arrival") for k in range(3)]
    found = replay(spark, [*pieces, end.select(*(F.col(c).cast(t) for c, t in pieces[0].dtypes))], lambda s: paired_windows(s, ("squad",), delay="6 hours", forget="20 days"), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    return found.withColumn("start", F.date_format("start", "yyyy-MM-dd")).withColumnRenamed("start", "day")


# --- mean bootstraps --------------------------------------------------------------------------------------


def _mixed_sql(source: str) -> str:
    """SQL for the rows of ``source`` with their column h mixed as 64 bits."""
    for shift, factor in resample.MIX:
        mixed = f"xor(h, h >> {shift})" if factor == 1 else f"(xor(h, h >> {shift})::UHUGEINT * {factor}::UHUGEINT % {2**64}::UHUGEINT)::UBIGINT"
        source = f"SELECT * REPLACE ({mixed} AS h) FROM ({source}) m"
    return source


def _counter_sql(base: str, by: str, step: int) -> str:
    return f"(({base}::UHUGEINT + {by}::UHUGEINT * {step}::UHUGEINT) % {2**64}::UHUGEINT)::UBIGINT"


def _places_sql(source: str) -> str:
    """SQL for rows (r, g, start, size, low, high, j) with the position that a stream's j-th draw gives."""
    x = f"SELECT *, (low + j::UBIGINT * {resample.DRAW}::UBIGINT) & 4294967295 AS x FROM ({source}) s"
    for i, (shift, factor) in enumerate(resample.MIX32):
        mixed = f"(xor(x, x >> {shift}) * {factor}::UBIGINT) & 4294967295"
        x = f"SELECT * REPLACE ({f'xor({mixed}, high)' if i == 0 else mixed} AS x) FROM ({x}) s"
    return f"SELECT g, r, start + (x * size::UBIGINT >> 32)::BIGINT AS pos FROM ({x}) s"


def _quantile_sql(u: str) -> str:
    """SQL for the normal quantile of a column by its rational approximations."""

    def poly(coefficients: tuple[float, ...], x: str) -> str:
        out = "0.0"
        for c in coefficients:
            out = f"({out} * {x} + {c!r})"
        return out

    q, t = f"({u} - 0.5)", f"sqrt(-2 * ln(least({u}, 1 - {u})))"
    centre = f"{q} * {poly(numeric._CENTRE_NUM, f'({q} * {q})')} / {poly(numeric._CENTRE_DEN, f'({q} * {q})')}"
    tail = f"{poly(numeric._TAIL_NUM, t)} / {poly(numeric._TAIL_DEN, t)}"
    return f"(CASE WHEN {u} BETWEEN {numeric.TAIL} AND {1 - numeric.TAIL} THEN {centre} WHEN {u} < 0.5 THEN {tail} ELSE -({tail}) END)"


def _means_sql(values: str, resamples: int, seed: int) -> str:
    """SQL for CTEs over rows (g, diff): s (g, n, e, cubes, squares) and o (g, ms), the sorted means of all resamples of each group.

    Splits are of more than SINGLY draws here, so the rule for fewer is left out.
    """
    start = "{} * n // nb"
    bits = _mixed_sql(f"SELECT * REPLACE ({_counter_sql('base', 'node', resample.NODE)} AS h) FROM t WHERE hi - lo {{}} 1")
    gap = "(diff - e) / (n - 1)"
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT g, diff, row_number() OVER (PARTITION BY g ORDER BY diff) - 1 AS pos FROM ({values}) p),
        c AS MATERIALIZED (SELECT g, count(*) AS n, ceil(count(*) / {resample.BLOCK}.0)::BIGINT AS nb, avg(diff) AS e FROM v GROUP BY g),
        s AS MATERIALIZED (SELECT g, any_value(n) AS n, any_value(e) AS e, sum({gap} * {gap} * {gap}) AS cubes, sum({gap} * {gap}) AS squares FROM v JOIN c USING (g) GROUP BY g),
        b AS MATERIALIZED ({_mixed_sql(f"SELECT r, {_counter_sql(str(seed), 'r', resample.STEP)} AS h FROM range({resamples}) x(r)")}),
        t AS (SELECT g, r, h AS base, 1::BIGINT AS node, 0::BIGINT AS lo, nb AS hi, n AS k, n, nb, h FROM b, c
            UNION ALL SELECT g, r, base, 2 * node + side, CASE side WHEN 0 THEN lo ELSE mid END, CASE side WHEN 0 THEN mid ELSE hi END, CASE side WHEN 0 THEN gone ELSE k - gone END, n, nb, base
            FROM (SELECT *, least(k, greatest(0, floor(k * p + z * sqrt(k * p * (1 - p)) + (z * z - 1) * (1 - 2 * p) / 6 + 0.5)))::BIGINT AS gone
                FROM (SELECT *, {_quantile_sql("u")} AS z, ({start.format("mid")} - {start.format("lo")}) / ({start.format("hi")} - {start.format("lo")}) AS p
                    FROM (SELECT *, (lo + hi) // 2 AS mid, ((h // 2048)::DOUBLE + 0.5) / {2**53} AS u FROM ({bits.format(">")}) x) y) z) w, (VALUES (0), (1)) f(side)),
        l AS (SELECT g, r, k, {start.format("lo")} AS start, {start.format("hi")} - {start.format("lo")} AS size, h & 4294967295 AS low, h >> 32 AS high FROM ({bits.format("=")}) x),
        j AS ({_places_sql("SELECT g, r, start, size, low, high, j FROM l, unnest(range(k)) x(j)")}),
        m AS (SELECT g, r, avg(diff) AS m FROM j JOIN v USING (g, pos) GROUP BY g, r),
        o AS MATERIALIZED (SELECT g, list(m ORDER BY m) AS ms FROM m GROUP BY g)"""


def _ends_sql(method: str, resamples: int) -> tuple[str, str]:
    """SQL for the ends of an interval at 95 % from o and s."""
    lo, hi = numeric.ranks(0.025, 0.975, resamples)
    if method == "percentile":
        return f"ms[{lo + 1}]", f"ms[{hi + 1}]"
    if method == "basic":
        return f"2 * e - ms[{hi + 1}]", f"2 * e - ms[{lo + 1}]"
    skew = "(CASE WHEN squares < 1e-12 THEN 0 ELSE cubes / (6 * pow(squares, 1.5)) END)"
    shift = lambda z: f"(z0 + (z0 + {z}) / (1 - {skew} * (z0 + {z})))"
    level = lambda z: f"({_normal_sql(shift(z))} * {resamples})"
    return f"ms[least(floor({level(-_Z)})::BIGINT, {resamples - 1}) + 1]", f"ms[least(greatest(ceil({level(_Z)})::BIGINT - 1, 0), {resamples - 1}) + 1]"


def _share_below_sql(resamples: int) -> str:
    """SQL for s and o with z0, the normal quantile of the share of means below the effect."""
    below = f"least(greatest(len(list_filter(ms, lambda x: x < e)) / {resamples}.0, {0.5 / resamples}), {1 - 0.5 / resamples})"
    return f"SELECT *, {_quantile_sql('below')} AS z0 FROM (SELECT *, {below} AS below FROM s JOIN o USING (g)) q"


_DIFFS = f"SELECT 0 AS g, candidate - baseline AS diff FROM ({PAIRS}) p"


def _boot_sql(method: str) -> str:
    lo, hi = _ends_sql(method, RESAMPLES)
    return f"{_means_sql(_DIFFS, RESAMPLES, SEED)} SELECT {_R.format(lo)} AS ci_low, {_R.format(hi)} AS ci_high FROM s JOIN o USING (g)"


def _boot(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """The operator's draws, closed to an interval in the plan."""
    diffs = view(spark, sf_dir, PAIRS).select((F.col("candidate") - F.col("baseline")).alias("diff"))
    _, means = resample.bootstrap_means(diffs, "diff", RESAMPLES, SEED)
    effect = diffs.agg(F.avg("diff")).scalar()
    lo, hi = columns.bootstrap_interval(F.col("draws"), effect, method, 0.95, RESAMPLES)
    return rounded(means.select(lo.alias("ci_low"), hi.alias("ci_high")))


@query(_boot_sql("percentile"))
def mean_boot_percentile(spark, sf_dir):
    return _boot(spark, sf_dir, "percentile")


@query(_boot_sql("basic"))
def mean_boot_basic(spark, sf_dir):
    return _boot(spark, sf_dir, "basic")


# --- sequential tests ---------------------------------------------------------------------------------

_UP, _DOWN = "ln(2 / (1 + pow(10, -5 / 400.0)))", "ln(2 / (1 + pow(10, 5 / 400.0)))"  # of a win and a loss, elo 5 against 0
_DECIDE = "CASE WHEN llr >= ln(0.95 / 0.05) THEN 'pass' WHEN llr <= ln(0.05 / 0.95) THEN 'fail' ELSE 'inconclusive' END AS verdict"


@query(f"SELECT wins, draws, losses, {_R.format('llr')} AS llr, {_DECIDE} FROM (SELECT w AS wins, d AS draws, l AS losses, w * {_UP} + l * ({_DOWN}) AS llr FROM ({_tally(OUTCOMES)}) t) x")
def sprt_wald(spark, sf_dir):
    return rounded(sequential.by_group(view(spark, sf_dir, OUTCOMES), CONFIG, "wald"))


def _trinomial_sql() -> str:
    p = lambda sign, e: f"(1 / (1 + pow(10, (g {sign} {e}) / 400)))"
    terms = []
    for k, f in (("w", lambda e: p("-", e)), ("d", lambda e: f"(1 - {p('-', e)} - {p('+', e)})"), ("l", lambda e: p("+", e))):
        terms.append(f"CASE WHEN {k} > 0 THEN {k} * ln({f(CONFIG.elo1)} / {f(CONFIG.elo0)}) ELSE 0 END")
    clamp = lambda k: f"least(greatest({k} / (w + d + l), 1e-4), 1 - 1e-4)"
    g = f"200 * log10((1 - {clamp('l')}) / {clamp('l')} * (1 - {clamp('w')}) / {clamp('w')})"
    return f"SELECT w AS wins, d AS draws, l AS losses, {_R.format('llr')} AS llr, {_R.format('g')} AS drawelo, {_DECIDE} FROM (SELECT *, {' + '.join(terms)} AS llr FROM (SELECT *, {g} AS g FROM ({_tally(OUTCOMES)}) t) u) x"


@query(_trinomial_sql())
def sprt_trinomial(spark, sf_dir):
    return rounded(sequential.by_group(view(spark, sf_dir, OUTCOMES), CONFIG, "trinomial"))


_BUCKETS = ", ".join(f"count(*) FILTER (p = {b} AND NOT single) AS bucket_{b}" for b in range(5))
_PAIR_POINTS = f"SELECT id, single, count(*) AS n, sum(CASE result WHEN 'candidate_win' THEN 2 WHEN 'draw' THEN 1 ELSE 0 END) AS p FROM ({GAMES}) g GROUP BY id, single"


@query(f"SELECT {_BUCKETS}, coalesce(sum(n) FILTER (NOT single), 0)::BIGINT AS games, count(*) FILTER (NOT single) AS pairs, count(*) FILTER (single) AS candidate_timeout FROM ({_PAIR_POINTS}) x")
def pentanomial_counts(spark, sf_dir):
    rows = netting.pentanomial(netting.by_key(view(spark, sf_dir, PAIRED_GAMES), [Metric("winrate")]), "report-only")
    return rows.select(*(f"bucket_{b}" for b in range(5)), "games", "pairs", "candidate_timeout")


# --- graphs -----------------------------------------------------------------------------------------------


def _edges_sql(source: str) -> str:
    lo = "least(a, b)"
    return f"SELECT {lo} AS lo, greatest(a, b) AS hi, count(*) FILTER (result = 'a_win' AND a = {lo} OR result = 'b_win' AND b = {lo}) AS lo_wins, count(*) FILTER (result = 'a_win' AND a <> {lo} OR result = 'b_win' AND b <> {lo}) AS hi_wins, count(*) FILTER (result = 'draw') AS draws FROM ({source}) m GROUP BY ALL"


@query(_edges_sql(MATCHES))
def matrix_edges(spark, sf_dir):
    return graph.match_edges(view(spark, sf_dir, MATCHES), False).drop("error")


@query(f"SELECT node, sum(wins)::BIGINT AS wins, sum(draws)::BIGINT AS draws, sum(games)::BIGINT AS games FROM (SELECT lo AS node, lo_wins AS wins, draws, lo_wins + hi_wins + draws AS games FROM ({_edges_sql(MATCHES)}) e UNION ALL SELECT hi, hi_wins, draws, lo_wins + hi_wins + draws FROM ({_edges_sql(MATCHES)}) e) n GROUP BY node")
def node_totals(spark, sf_dir):
    return graph.node_totals(graph.match_edges(view(spark, sf_dir, MATCHES), False))


def _star_sql() -> str:
    one = _closed_sql("SELECT name, w, d, l FROM c", _elo_sql, "elo", True).replace("SELECT 'elo' AS metric, ", "SELECT name, ", 1).replace("SELECT l AS baseline_count", "SELECT name, l AS baseline_count").replace(f"round({_elo_sql('p')}, {DIGITS}) + 0.0", _elo_sql("p")).replace(f"round({_elo_sql('lo')}, {DIGITS}) + 0.0", _elo_sql("lo")).replace(f"round({_elo_sql('hi')}, {DIGITS}) + 0.0", _elo_sql("hi"))
    margin = "sqrt(pow((a.ci_high - a.ci_low) / 2, 2) + pow((b.ci_high - b.ci_low) / 2, 2))"
    return f"""WITH c AS (SELECT CASE WHEN lo = '{BASELINE}' THEN hi ELSE lo END AS name, CASE WHEN lo = '{BASELINE}' THEN hi_wins ELSE lo_wins END AS w, draws AS d, CASE WHEN lo = '{BASELINE}' THEN lo_wins ELSE hi_wins END AS l FROM ({_edges_sql(STAR)}) e),
        s AS ({one})
        SELECT '{BASELINE}' AS row_name, name AS col_name, {_R.format("-effect")} AS elo_diff, {_R.format("-ci_high")} AS ci_low, {_R.format("-ci_low")} AS ci_high FROM s
        UNION ALL SELECT a.name, b.name, {_R.format("a.effect - b.effect")}, {_R.format(f"a.effect - b.effect - {margin}")}, {_R.format(f"a.effect - b.effect + {margin}")} FROM s a JOIN s b ON a.name < b.name"""


@query(_star_sql())
def matrix_star(spark, sf_dir):
    return rounded(matrices.star_cells(graph.match_edges(view(spark, sf_dir, STAR), False), 0.95))


# --- reports ------------------------------------------------------------------------------------------------

_EFFECT = "metric string, baseline_count long, candidate_count long, paired_count long, effect double, ci_low double, ci_high double, verdict string"


def _compare(spark: SparkSession, sf_dir: str, sql: str, *metrics: Metric, **options) -> list[dict]:
    made = comparisons.compare(view(spark, sf_dir, sql), list(metrics), Options(**options))
    return made.get("reports", [made])


def _simpson(f: Callable[[str], str], lo: str, hi: str, steps: int = 1000) -> str:
    """SQL for the integral of ``f`` by Simpson's rule."""
    weight = f"(CASE WHEN j = 0 OR j = {steps} THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END)"
    at = f"({lo} + ({hi} - {lo}) * j / {steps}.0)"
    return f"(({hi} - {lo}) / {3 * steps} * list_sum(list_transform(range({steps} + 1), lambda j: {weight} * {f(at)})))"


def _normal_sql(x: str) -> str:
    """SQL for the normal distribution function."""
    return f"(0.5 + {_simpson(lambda t: f'exp(-{t} * {t} / 2)', '0.0', x)} / sqrt(2 * pi()))"


def _beta_sql(ends: str) -> str:
    """SQL for (side, x), the quantiles of beta distributions, from rows (side, p, a, b): bisection of the integrated density."""
    density = lambda t: f"exp((a - 1) * ln(greatest({t}, 1e-300)) + (b - 1) * ln(greatest(1 - {t}, 1e-300)) + lgamma(a + b) - lgamma(a) - lgamma(b))"
    return f"""SELECT side, (lo + hi) / 2 AS x FROM (
        WITH RECURSIVE e AS ({ends}),
        m AS (SELECT *, a / (a + b) AS mean, 12 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS wide FROM e),
        s AS (SELECT side, p, a, b, greatest(mean - wide, 0.0) AS origin, greatest(mean - wide, 0.0) AS lo, least(mean + wide, 1.0) AS hi, 0 AS i FROM m
            UNION ALL SELECT side, p, a, b, origin, CASE WHEN below < p THEN mid ELSE lo END, CASE WHEN below < p THEN hi ELSE mid END, i + 1
            FROM (SELECT *, {_simpson(density, "origin", "mid")} AS below FROM (SELECT *, (lo + hi) / 2 AS mid FROM s WHERE i < 50) t) u)
        SELECT * FROM s WHERE i = 50) q"""


def _binomial_sql(counts: str, metric: str, lower: str, upper: str) -> str:
    """SQL for a win-rate row whose ends are quantiles of beta distributions of these parameters."""
    ends = f"SELECT 'lo' AS side, 0.025 AS p, {lower} FROM k UNION ALL SELECT 'hi', 0.975, {upper} FROM k"
    return f"""WITH k AS MATERIALIZED (SELECT w::DOUBLE AS w, l::DOUBLE AS l FROM ({counts}) c), q AS ({_beta_sql(ends)}),
        r AS (SELECT w, l, w / (w + l) - 0.5 AS e, (SELECT x FROM q WHERE side = 'lo') - 0.5 AS lo, (SELECT x FROM q WHERE side = 'hi') - 0.5 AS hi FROM k)
        SELECT '{metric}' AS metric, l::BIGINT AS baseline_count, w::BIGINT AS candidate_count, (w + l)::BIGINT AS paired_count, {_R.format("e")} AS effect,
            {_R.format("lo")} AS ci_low, {_R.format("hi")} AS ci_high, CASE WHEN lo >= 0 THEN 'pass' WHEN hi <= 0 THEN 'fail' ELSE 'inconclusive' END AS verdict FROM r"""


_EXACT, _JEFFREYS = ("w AS a, l + 1 AS b", "w + 1, l"), ("w + 0.5 AS a, l + 0.5 AS b", "w + 0.5, l + 0.5")


@query(_binomial_sql(_tally(OUTCOMES), "winrate", *_EXACT))
def winrate_exact(spark, sf_dir):
    return table(spark, _compare(spark, sf_dir, OUTCOMES, Metric("winrate", ci_method="exact")), _EFFECT)


@query(_binomial_sql(_tally(OUTCOMES), "winrate", *_JEFFREYS))
def winrate_jeffreys(spark, sf_dir):
    return table(spark, _compare(spark, sf_dir, OUTCOMES, Metric("winrate", ci_method="jeffreys")), _EFFECT)


@query(_binomial_sql(_SIGNS, "sign-test", *_EXACT))
def sign_test_exact(spark, sf_dir):
    return table(spark, _compare(spark, sf_dir, PAIRS, Metric("sign-test", ci_method="exact")), _EFFECT)


_CLAIMS = "metric string, verdict string, achieved_alpha double, adjusted_alpha_threshold double, family_adjusted_verdict string"


def _claims_sql(method: str) -> str:
    """SQL for two claims. A lower end by Wilson's method clears a proportion at the level of the one-sample test against it.

    Holm's order is that of the levels, and of the claims where levels are equal, as all below the least level searched are.
    """
    holm = method == "holm"
    first, second, place = ("1 AS place, ", "2, ", "place, ") if holm else ("", "", "")
    k = f"SELECT {first}'winrate' AS metric, w, l FROM ({_tally(OUTCOMES)}) c UNION ALL SELECT {second}'sign-test', w, l FROM ({_SIGNS}) d"
    alpha, level, stands = f"2 * (1 - {_normal_sql('z')})", "0.05 / 2", "alpha <= level"
    if holm:
        density = lambda t: f"exp(-{t} * {t} / 2)"
        alpha = f"greatest(2 * {_simpson(density, 'z', '(z + 10)')} / sqrt(2 * pi()), {correction.FLOOR})"
        level = "0.05 / (2 - (row_number() OVER (ORDER BY alpha, place) - 1))"
        stands = "min(CASE WHEN alpha <= level THEN 1 ELSE 0 END) OVER (ORDER BY alpha, place) = 1"
    return f"""WITH k AS ({k}), z AS (SELECT {place}metric, (w / (w + l)::DOUBLE - 0.4875) / sqrt(0.4875 * 0.5125 / (w + l)) AS z FROM k),
        a AS (SELECT {place}metric, z, {alpha} AS alpha FROM z), p AS (SELECT {place}metric, alpha FROM a WHERE z >= {_Z}),
        v AS (SELECT {place}metric, alpha, {level} AS level FROM p), f AS (SELECT metric, alpha, level, {stands} AS stands FROM v)
        SELECT metric, CASE WHEN alpha IS NULL THEN 'inconclusive' ELSE 'pass' END AS verdict, {_R.format("alpha")} AS achieved_alpha, {_R.format("level")} AS adjusted_alpha_threshold,
            CASE WHEN stands THEN 'pass' ELSE 'inconclusive' END AS family_adjusted_verdict FROM k LEFT JOIN f USING (metric)"""


def _claims(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    made = _compare(spark, sf_dir, _BOTH, Metric("winrate"), Metric("sign-test"), thresholds=Thresholds(-0.0125, -0.2), correction=method)
    return table(spark, made, _CLAIMS)


@query(_claims_sql("holm"))
def claim_correction(spark, sf_dir):
    return _claims(spark, sf_dir, "holm")


@query(_claims_sql("bonferroni"))
def claim_correction_bonferroni(spark, sf_dir):
    return _claims(spark, sf_dir, "bonferroni")


_FAILURES = ", ".join(f"count(*) FILTER (baseline_status = '{k}') + count(*) FILTER (candidate_status = '{k}') AS {n}" for k, n in (("timeout", "timeouts"), ("crash", "crashes"), ("invalid", "invalid")))


@query(f"""SELECT CASE WHEN crashes > 10 THEN 'invalid' ELSE 'valid' END AS validity, 'inconclusive' AS verdict, 'not_promoted' AS promotion, timeouts, crashes, invalid,
    concat('INVALID: ', crashes, ' crash(es) exceed the cap of 10. Strength not evaluated.') AS reason FROM (SELECT {_FAILURES} FROM ({STATUSES}) s) t""")
def failure_caps(spark, sf_dir):
    made = _compare(spark, sf_dir, STATUSES, Metric("elo", policy="loss"), caps=FailureCaps(max_crashes=10))
    return table(spark, made, "validity string, verdict string, promotion string, timeouts long, crashes long, invalid long, reason string")


def _resampled(name: str, sql: str, metric: Metric, extra: str = "", **options) -> None:
    """Bootstrap reports: their draws come from a generator that SQL doesn't have, so tests check them by their properties."""
    QUERIES[name] = lambda spark, sf_dir: table(spark, _compare(spark, sf_dir, sql, metric, **options), _EFFECT + extra)


def _mean_diff_sql(method: str) -> str:
    """SQL for a report of the mean difference at the default number of resamples."""
    lo, hi = _ends_sql(method, RESAMPLES)
    source = _share_below_sql(RESAMPLES) if method == "bca" else "SELECT * FROM s JOIN o USING (g)"
    return f"""{_means_sql(_DIFFS, RESAMPLES, DEFAULT_SEED)} SELECT 'mean-diff' AS metric, n AS baseline_count, n AS candidate_count, n AS paired_count, {_R.format("e")} AS effect,
        {_R.format("lo")} AS ci_low, {_R.format("hi")} AS ci_high, CASE WHEN lo >= 0 THEN 'pass' WHEN hi <= 0 THEN 'fail' ELSE 'inconclusive' END AS verdict
        FROM (SELECT n, e, {lo} AS lo, {hi} AS hi FROM ({source}) z) x"""


@query(_mean_diff_sql("percentile"))
def mean_diff_percentile(spark, sf_dir):
    return table(spark, _compare(spark, sf_dir, PAIRS, Metric("mean-diff")), _EFFECT)


@query(_mean_diff_sql("basic"))
def mean_diff_basic(spark, sf_dir):
    return table(spark, _compare(spark, sf_dir, PAIRS, Metric("mean-diff", bootstrap="basic")), _EFFECT)


@query(_mean_diff_sql("bca"))
def mean_diff_bca(spark, sf_dir):
    return table(spark, _compare(spark, sf_dir, PAIRS, Metric("mean-diff", bootstrap="bca")), _EFFECT)


_TEAMS = f"SELECT o_orderpriority AS team, id, line, baseline, candidate FROM ({PAIRS}) p JOIN {{orders}} o ON o_orderkey = line"


def _grouped_sql(method: str) -> str:
    lo, hi = _ends_sql(method, RESAMPLES)
    return f"""{_means_sql(f"SELECT team AS g, candidate - baseline AS diff FROM ({_TEAMS}) p", RESAMPLES, DEFAULT_SEED)} SELECT g AS team, n AS paired_count, {_R.format("e")} AS effect,
        {_R.format("lo")} AS ci_low, {_R.format("hi")} AS ci_high, CASE WHEN lo >= 0 THEN 'pass' WHEN hi <= 0 THEN 'fail' ELSE 'inconclusive' END AS verdict, false AS has_error
        FROM (SELECT g, n, e, {lo} AS lo, {hi} AS hi FROM s JOIN o USING (g)) x"""


@query(_grouped_sql("percentile"))
def grouped_mean_diff(spark, sf_dir):
    """An interval for each group, in one plan."""
    return rounded(comparisons.grouped_mean_diff(view(spark, sf_dir, _TEAMS), ("team",)))


@query(_grouped_sql("basic"))
def grouped_mean_diff_basic(spark, sf_dir):
    return rounded(comparisons.grouped_mean_diff(view(spark, sf_dir, _TEAMS), ("team",), method="basic"))


_resampled("quantile_diff", PAIRS, Metric("quantile-diff", quantile=0.5), ", quantile double")
_resampled("quantile_diff_basic", PAIRS, Metric("quantile-diff", quantile=0.9, bootstrap="basic"), ", quantile double")
_resampled("cluster_bootstrap", CLUSTERS, Metric("winrate"), ", cluster_count long, max_cluster_size long, design_effect double", clustered=True)


def _pentanomial_sql() -> str:
    """SQL for the ratio of the likeliest distributions whose means are the scores of elo 0 and 5, found by bisection."""
    counts = ", ".join(f"count(*) FILTER (p = {b} AND NOT single) AS b{b}" for b in range(5))
    total = lambda f: f"list_sum(list_transform(range(5), lambda j: {f}))"
    return f"""WITH RECURSIVE c AS MATERIALIZED (SELECT {counts} FROM ({_PAIR_POINTS}) x),
        n AS MATERIALIZED (SELECT [{", ".join(f"greatest(b{b}, 0.001)::DOUBLE" for b in range(5))}] AS n FROM c),
        s AS (SELECT k, sc, n, -1 / (1 - sc) + 1e-9 AS lo, 1 / sc - 1e-9 AS hi, 0 AS i FROM n, (SELECT k, 1 / (1 + pow(10, -5.0 * k / 400)) AS sc FROM (VALUES (0), (1)) v(k)) e
            UNION ALL SELECT k, sc, n, CASE WHEN g > 0 THEN mid ELSE lo END, CASE WHEN g > 0 THEN hi ELSE mid END, i + 1
            FROM (SELECT *, {total("n[j + 1] * (j / 4.0 - sc) / (1 + mid * (j / 4.0 - sc))")} AS g FROM (SELECT *, (lo + hi) / 2 AS mid FROM s WHERE i < 100) t) u),
        f AS (SELECT k, {total("n[j + 1] * ln(1 + (lo + hi) / 2 * (j / 4.0 - sc))")} AS t FROM s WHERE i = 100),
        r AS (SELECT c.*, (SELECT t FROM f WHERE k = 0) - (SELECT t FROM f WHERE k = 1) AS llr FROM c)
        SELECT b3 + b4 AS candidate_wins, b2 AS draws, b0 + b1 AS baseline_wins, {_R.format("llr")} AS llr, {_DECIDE} FROM r"""


@query(_pentanomial_sql())
def sprt_pentanomial(spark, sf_dir):
    made = sequential.sprt(view(spark, sf_dir, PAIRED_GAMES), CONFIG, "pentanomial", paired=True)
    return table(spark, [made], "candidate_wins long, draws long, baseline_wins long, llr double, verdict string")


def _ratings_sql() -> str:
    """SQL for the fitted ratings: minorise-maximise steps over the list of strengths, pinned to 1 at the first name."""
    games = "list_sum(list_transform(list_filter(es, lambda e: e.a = i OR e.b = i), lambda e: e.n / (s[e.a] + s[e.b])))"
    return f"""WITH RECURSIVE e AS MATERIALIZED ({_edges_sql(MATCHES)}), t AS MATERIALIZED (SELECT name, min(seen) AS seen FROM (SELECT a AS name, 2 * line AS seen FROM ({MATCHES}) m UNION ALL SELECT b, 2 * line + 1 FROM ({MATCHES}) m) x GROUP BY name),
        v AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY seen) AS i FROM t),
        w AS (SELECT list(k ORDER BY i) AS ws FROM (SELECT i, sum(CASE WHEN name = lo THEN lo_wins ELSE hi_wins END + draws / 2.0)::DOUBLE AS k FROM v JOIN e ON name = lo OR name = hi GROUP BY i) y),
        g AS MATERIALIZED (SELECT ws, es FROM w, (SELECT list({{'a': p.i, 'b': q.i, 'n': (lo_wins + hi_wins + draws)::DOUBLE}}) AS es FROM e JOIN v p ON p.name = lo JOIN v q ON q.name = hi) z),
        r AS (SELECT list_transform(ws, lambda x: 1.0::DOUBLE) AS s, 0 AS k FROM g
            UNION ALL SELECT list_transform(u, lambda x: x / u[1]), k + 1 FROM (SELECT list_transform(range(1, len(ws) + 1), lambda i: ws[i] / {games}) AS u, k FROM r, g WHERE k < 300) h)
        SELECT name, {_R.format("400 * log10(s[i])").replace(f", {DIGITS})", ", 3)")} AS elo, 0::BIGINT AS component FROM v, r WHERE k = 300"""


def _matrix(spark: SparkSession, sf_dir: str, **options) -> dict:
    return matrices.matrix(spark, [], [view(spark, sf_dir, MATCHES)], **options)


@query(_ratings_sql())
def matrix_ratings(spark, sf_dir):
    """Competitors with their ratings; all have won and lost, so they are one component."""
    made = table(spark, _matrix(spark, sf_dir, resamples=100)["candidates"], "name string, elo double, component long")
    return made.withColumn("elo", F.round("elo", 3) + F.lit(0.0))


# Suppliers of one nation meet where lines of an order follow each other; the dearer line wins.
_SUPPLIERS = """SELECT line, CAST(a AS STRING) AS a, CAST(b AS STRING) AS b, CASE WHEN abs(x - y) < 0.02 * x THEN 'draw' WHEN x > y THEN 'a_win' ELSE 'b_win' END AS result
    FROM (SELECT CAST(l_orderkey AS BIGINT) * 100 + l_linenumber AS line, l_suppkey AS a, l_extendedprice AS x, lead(l_suppkey) OVER w AS b, lead(l_extendedprice) OVER w AS y
        FROM {lineitem} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_extendedprice)) l
    JOIN {supplier} s ON s.s_suppkey = a JOIN {supplier} t ON t.s_suppkey = b WHERE a <> b AND s.s_nationkey = t.s_nationkey"""


def _components_sql() -> str:
    """SQL for CTEs e (edges), n (nodes with component) of the suppliers' graph, by reach from every node."""
    arcs = "SELECT lo AS u, hi AS v FROM e WHERE lo_wins + draws > 0 UNION ALL SELECT hi, lo FROM e WHERE hi_wins + draws > 0"
    return f"""WITH RECURSIVE e AS MATERIALIZED ({_edges_sql(_SUPPLIERS)}), arc AS MATERIALIZED ({arcs}), node AS (SELECT lo AS x FROM e UNION SELECT hi FROM e),
        reach(x, y) AS (SELECT x, x FROM node UNION SELECT reach.x, v FROM reach JOIN arc ON u = y), pair AS MATERIALIZED (SELECT x, y FROM reach),
        n AS MATERIALIZED (SELECT p.x AS node, min(p.y) AS component FROM pair p JOIN pair q ON p.x = q.y AND p.y = q.x GROUP BY p.x)"""


@query(f"{_components_sql()} SELECT component, count(*) AS nodes FROM n GROUP BY component")
def large_graph_components(spark, sf_dir):
    """Strongly connected components by joins, with their sizes."""
    edges = graph.match_edges(view(spark, sf_dir, _SUPPLIERS), False)
    arcs = [edges.where(F.col(w) + F.col("draws") > 0).select(F.col(u).alias("u"), F.col(v).alias("v")) for u, v, w in (("lo", "hi", "lo_wins"), ("hi", "lo", "hi_wins"))]
    nodes = edges.select(F.col("lo").alias("node")).union(edges.select("hi"))
    return large_graph.strong_components(nodes, arcs[0].union(arcs[1])).groupBy("component").agg(F.count("*").alias("nodes"))


#: CTE q: the suppliers' ratings (node, component, elo) by four hundred steps.
_RATED = f"""{_components_sql()}, k AS MATERIALIZED (SELECT node, component, row_number() OVER (ORDER BY node) AS i FROM n),
    w AS (SELECT k.node, k.i, q.i AS pin, coalesce(sum(CASE WHEN k.node = lo THEN lo_wins ELSE hi_wins END + draws / 2.0) FILTER (o.component = k.component), 0)::DOUBLE AS w
        FROM k JOIN k q ON q.node = k.component LEFT JOIN e ON k.node = lo OR k.node = hi LEFT JOIN k o ON o.node = CASE WHEN k.node = lo THEN hi ELSE lo END GROUP BY ALL),
    l AS MATERIALIZED (SELECT list(w ORDER BY i) AS ws, list(pin ORDER BY i) AS pins FROM w),
    p AS MATERIALIZED (SELECT list(es ORDER BY i) AS es FROM (SELECT k.i, list({{'j': o.i, 'n': (lo_wins + hi_wins + draws)::DOUBLE}}) FILTER (o.component = k.component) AS es
        FROM k LEFT JOIN e ON k.node = lo OR k.node = hi LEFT JOIN k o ON o.node = CASE WHEN k.node = lo THEN hi ELSE lo END GROUP BY k.i) z),
    r AS (SELECT list_transform(ws, lambda x: 1.0::DOUBLE) AS s, 0 AS t FROM l
        UNION ALL SELECT list_transform(range(1, len(u) + 1), lambda i: u[i] / u[pins[i]]), t + 1
        FROM (SELECT list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN ws[i] > 0 THEN ws[i] / list_sum(list_transform(es[i], lambda x: x.n / (s[i] + s[x.j]))) ELSE 1.0 END) AS u, pins, t FROM r, l, p WHERE t < 400) h),
    q AS MATERIALIZED (SELECT node, component, 400 * log10(s[i]) AS elo FROM k, r WHERE t = 400)"""


@query(f"{_RATED} SELECT node, component, round(elo, 3) + 0.0 AS elo FROM q")
def large_graph_ratings(spark, sf_dir):
    """Ratings of a graph of many components by steps of joins."""
    made = large_graph.ratings(graph.match_edges(view(spark, sf_dir, _SUPPLIERS), False).drop("error"))
    return made.withColumn("elo", F.round("elo", 3) + F.lit(0.0))


@query(f"""{_RATED} SELECT a.node AS row_name, b.node AS col_name, CASE WHEN a.component = b.component THEN round(a.elo - b.elo, 3) + 0.0 END AS elo_diff,
    CASE WHEN a.component <> b.component THEN 'disconnected' WHEN lo IS NULL THEN 'inferred' ELSE 'direct' END AS status
    FROM q a JOIN q b ON a.node < b.node LEFT JOIN e ON lo = a.node AND hi = b.node""")
def large_graph_cells(spark, sf_dir):
    """All pairs of a graph of many components: differences, and whether the two have met, are only linked or can't be compared."""
    edges = Table(graph.match_edges(view(spark, sf_dir, _SUPPLIERS), False).drop("error"), "met").df
    nodes = Table(large_graph.ratings(edges).withColumn("place", F.col("node")), "rated").df
    return matrices.cells(nodes, edges).select("row_name", "col_name", (F.round("elo_diff", 3) + F.lit(0.0)).alias("elo_diff"), "status")


_CELLS = "row string, col string, elo_diff double, ci_low double, ci_high double, status string"


def matrix_general(spark, sf_dir):
    return table(spark, _matrix(spark, sf_dir)["matrix"], _CELLS)


def matrix_bca(spark, sf_dir):
    return table(spark, _matrix(spark, sf_dir, method="bca")["matrix"], _CELLS)


# A full round of up to 100 competitors: suppliers by the last two digits of their number.
_ROUND = """SELECT line, CAST(a AS STRING) AS a, CAST(b AS STRING) AS b, CASE WHEN abs(x - y) < 0.02 * x THEN 'draw' WHEN x > y THEN 'a_win' ELSE 'b_win' END AS result
    FROM (SELECT CAST(l_orderkey AS BIGINT) * 100 + l_linenumber AS line, l_suppkey % 100 AS a, l_extendedprice AS x, lead(l_suppkey % 100) OVER w AS b, lead(l_extendedprice) OVER w AS y
        FROM {lineitem} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_extendedprice)) l WHERE a <> b"""


def matrix_dense(spark, sf_dir):
    """The matrix of 100 competitors by 2,000 resamples."""
    return table(spark, matrices.matrix(spark, [], [view(spark, sf_dir, _ROUND)])["matrix"], _CELLS)


QUERIES |= {f.__name__: f for f in (matrix_general, matrix_bca, matrix_dense)}


def _plan_sql() -> str:
    """SQL for a plan at 20 Elo: against the baseline the games are searched for by halving, else widths fall as the root of the fewer games."""
    wilson = lambda sign, k: f"((p + {_Z * _Z} / (2 * {k})) / (1 + {_Z * _Z} / {k}) {sign} {_Z} / (1 + {_Z * _Z} / {k}) * sqrt(p * (1 - p) / {k} + {_Z * _Z} / (4.0 * {k} * {k})))"
    half = lambda k: f"(({_elo_sql(wilson('+', k))} - {_elo_sql(wilson('-', k))}) / 2)"
    count = "CASE WHEN lo = '{b}' THEN {x} ELSE {y} END".replace("{b}", BASELINE)
    return f"""WITH RECURSIVE t AS MATERIALIZED (SELECT CASE WHEN a = '{BASELINE}' THEN b ELSE a END AS name, min(line) AS seen FROM ({STAR}) m GROUP BY 1),
        c AS (SELECT CASE WHEN lo = '{BASELINE}' THEN hi ELSE lo END AS name, {count.format(x="hi_wins", y="lo_wins")} + draws / 2.0 AS points, lo_wins + hi_wins + draws AS n FROM ({_edges_sql(STAR)}) e),
        s AS MATERIALIZED (SELECT name, seen, n, points::DOUBLE / n AS p FROM c JOIN t USING (name)),
        h AS MATERIALIZED (SELECT *, {half("n")} AS now FROM s),
        b AS (SELECT name, n, p, now, n AS lo, greatest((n * (now / 20) * (now / 20) * 2)::BIGINT, n + 1) AS hi, 0 AS i FROM h WHERE now > 20
            UNION ALL SELECT name, n, p, now, CASE WHEN {half("mid")} <= 20 THEN lo ELSE mid + 1 END, CASE WHEN {half("mid")} <= 20 THEN mid ELSE hi END, i + 1
            FROM (SELECT *, (lo + hi) // 2 AS mid FROM b WHERE lo < hi) x),
        r AS (SELECT '{BASELINE}' AS "row", h.name AS col, 'direct' AS status, h.now AS width, coalesce(b.lo - h.n, 0)::BIGINT AS games FROM h LEFT JOIN b ON h.name = b.name AND b.lo >= b.hi
            UNION ALL SELECT x.name, y.name, 'inferred', sqrt(x.now * x.now + y.now * y.now), CASE WHEN sqrt(x.now * x.now + y.now * y.now) <= 20 THEN 0 ELSE
                greatest(0, floor(least(x.n, y.n) * (x.now * x.now + y.now * y.now) / 400)::BIGINT - least(x.n, y.n)) END FROM h x JOIN h y ON x.seen < y.seen)
        SELECT "row", col, status, {_R.format("width")} AS current_ci_half_width, games AS estimated_additional_trials, row_number() OVER (ORDER BY games DESC, "row", col) AS place FROM r"""


@query(_plan_sql())
def plan_star(spark, sf_dir):
    made = recommend.plan(spark, [], [view(spark, sf_dir, STAR)], min_elo=20)["recommendations"]
    rows = [r | {"place": k} for k, r in enumerate(made, 1)]
    return table(spark, rows, "row string, col string, status string, current_ci_half_width double, estimated_additional_trials long, place long")


# Trials whose candidate wins about three in five, from which power reports take the effect that they assume.
_PILOT = "SELECT CAST(event_id AS STRING) AS id, CAST(event_id AS BIGINT) AS line, CASE WHEN value > 25 THEN 'candidate_win' ELSE 'baseline_win' END AS result FROM {events}"
_WON = f"(SELECT count(*) FILTER (result = 'candidate_win')::DOUBLE / count(*) AS p1 FROM ({_PILOT}) s)"


def _pilot_effect(spark: SparkSession, sf_dir: str, kind: str) -> float:
    return comparisons.closed_form(view(spark, sf_dir, _PILOT), [Metric(kind)]).first()["effect"]


# The first of 20 sizes in a row at which 80 % is reached.
@query(f"""WITH f AS MATERIALIZED (SELECT n, p1, ceil(0.5 * n + {_Z} * sqrt(0.25 * n) - 1e-9)::BIGINT AS k FROM range(1, 1301) r(n), {_WON} w),
    p AS (SELECT n, coalesce(list_sum(list_transform(range(k, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p1) + (n - j) * ln(1 - p1)))), 0) AS power FROM f),
    m AS (SELECT n, power, min(power) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS least FROM p)
    SELECT n AS estimated_trials, {_R.format("power")} AS achieved_power, 'exact_binomial_search' AS method FROM m WHERE least >= 0.8 ORDER BY n LIMIT 1""")
def power_exact(spark, sf_dir):
    """How many trials show the effect of a pilot."""
    return table(spark, [power.estimate_trials("winrate", 0.0, _pilot_effect(spark, sf_dir, "winrate"))], "estimated_trials long, achieved_power double, method string")


@query(f"""WITH d AS (SELECT stddev_samp(candidate - baseline) AS sd FROM ({PAIRS}) p), n AS (SELECT sd, ceil(pow(({_Z} + 0.8416212335729143) * sd / 1000, 2))::BIGINT AS n FROM d)
    SELECT n AS estimated_trials, {_R.format("sd")} AS assume_sd, {_R.format(_normal_sql(f"(1000 * sqrt(n) / sd - {_Z})"))} AS achieved_power FROM n""")
def power_pilot(spark, sf_dir):
    sd = power.pilot_sd(view(spark, sf_dir, PAIRS))
    made = power.estimate_trials("mean-diff", 0.0, 1000.0, assume_sd=sd, sd_source="pilot")
    return table(spark, [made], "estimated_trials long, assume_sd double, achieved_power double")


@query(f"""WITH u AS (SELECT p1, ln(p1 / 0.5) AS up, ln((1 - p1) / 0.5) AS down, ln(0.95 / 0.05) AS top FROM {_WON} s)
    SELECT ceil((0.05 * top - 0.95 * top) / (0.5 * up + 0.5 * down))::BIGINT AS expected_trials_under_h0, ceil((0.95 * top - 0.05 * top) / (p1 * up + (1 - p1) * down))::BIGINT AS expected_trials_under_h1 FROM u""")
def sprt_asn(spark, sf_dir):
    """Expected lengths of a sequential test for the rating of a pilot."""
    config = SprtConfig(0, _pilot_effect(spark, sf_dir, "elo"))
    return table(spark, [power.sprt_trials(config)], "expected_trials_under_h0 long, expected_trials_under_h1 long")


def sprt_horizon(spark, sf_dir):
    """The risk of no decision within 120 trials of a test for the rating of a pilot, by simulation."""
    config = SprtConfig(0, _pilot_effect(spark, sf_dir, "elo"))
    return table(spark, [power.sprt_trials(config, horizon=120, spark=spark)], "horizon long, probability_no_decision_by_horizon double")


QUERIES["sprt_horizon"] = sprt_horizon
