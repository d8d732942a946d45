"""URL filter: prefix rules, and where none fits, the likelihood ratio of two character models.

URLs that the rules allow or block train a smoothed variable-order Markov model each: the probability of
a character mixes the counts after its longest contexts with those after shorter ones, in proportion
to what was seen there. A URL is judged by the difference of its log likelihoods per character against
a threshold calibrated on rule-decided URLs that the models didn't learn from.

The models are counts in a fixed number of cells, one for each hashed context and character, so what is
broadcast to score the URLs doesn't grow with them. All of it is built-in column functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let
from .shared import Table

#: Longest context in characters; cells of each order, so many rows of three numbers are broadcast at most.
ORDER, CELLS = 4, 1 << 15
#: What a shorter context weighs against one count of a longer one.
SMOOTH = 2.0
#: Every so many of the rule-decided URLs calibrate, by hash; bins of the scores they are counted in.
CALIBRATE, BINS = 4, 400
_START, _NONE, _LIMIT = "\u0002", "\u0003", 2.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str  # with its leading slash
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def rules(block: list[str], allow: list[str]) -> list[Rule]:
    """From strings like ``example.com/en/``."""
    made = [Rule(h, "/" + p, ok) for texts, ok in ((block, False), (allow, True)) for h, _, p in (t.partition("/") for t in texts)]
    return sorted(made, key=lambda r: (-len(r.text), r.text))


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next slash, question mark or hash; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, listed: list[Rule], value) -> Column:
    """``value`` of the longest rule that fits; null if none does."""
    out = F.lit(None)
    for r in reversed(listed):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, value(r)).otherwise(out)
    return out.cast("string")


def _cells(url: Column) -> Column:
    """For each character of a lower-cased URL without its scheme, the cells of its n-grams and contexts.

    The field g of order k is the cell of the character with the k before it, the field c that of the k alone.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    chars = F.filter(F.split(F.concat(F.lit(_START * ORDER), bare), ""), lambda x: x != "")

    def cell(c: Column, i: Column, k: int, last: Column) -> Column:
        return (F.lit(k * CELLS) + F.pmod(F.xxhash64(last, *(F.get(c, i - j) for j in range(1, k + 1))), F.lit(CELLS))).cast("int")

    def at(c: Column) -> Column:
        fields = lambda i: [f for k in range(ORDER + 1) for f in (cell(c, i, k, F.get(c, i)).alias(f"g{k}"), cell(c, i, k, F.lit(_NONE)).alias(f"c{k}"))]
        return F.when(F.size(c) > ORDER, F.transform(F.sequence(F.lit(ORDER), F.size(c) - 1), lambda i: F.struct(*fields(i))))

    return let(chars, at)


def _model(rows: DataFrame) -> Table:
    """(cell, a, b): counts over the allowed and the blocked URLs; (ORDER + 1) * CELLS rows at most."""
    at = rows.select("y", F.explode(_cells(F.col("url"))).alias("x"))
    cells = at.select("y", F.explode(F.array(*(f"x.{f}{k}" for k in range(ORDER + 1) for f in "gc"))).alias("cell"))
    return Table(cells.groupBy("cell").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")), "model")


def _scored(rows: DataFrame, model: Table) -> DataFrame:
    """``rows`` with llr, the difference of the log likelihoods per character; 0 for a URL without any."""
    keys = rows.columns
    at = rows.withColumn("__row", F.monotonically_increasing_id()).select("*", F.explode_outer(_cells(F.col("url"))).alias("x"))
    at = at.select("__row", *keys, "x.*")
    p = q = F.lit(1.0 / 64)
    for k in range(ORDER + 1):
        for f in (f"g{k}", f"c{k}"):
            side = F.broadcast(model.df.select(F.col("cell").alias(f"n_{f}"), F.col("a").alias(f"a_{f}"), F.col("b").alias(f"b_{f}")))
            at = at.join(side, F.col(f) == F.col(f"n_{f}"), "left")
        n = lambda c: F.coalesce(F.col(c), F.lit(0))
        p = (n(f"a_g{k}") + SMOOTH * p) / (n(f"a_c{k}") + SMOOTH)
        q = (n(f"b_g{k}") + SMOOTH * q) / (n(f"b_c{k}") + SMOOTH)
    at = at.withColumn("d", F.when(F.col("g0").isNotNull(), F.log(p) - F.log(q)))
    return at.groupBy("__row", *keys).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("llr")).drop("__row")


def _threshold(scored: DataFrame) -> float:
    """Where the share of allowed URLs above and that of blocked ones below add up to the most, by bins."""
    clipped = F.least(F.greatest(F.col("llr"), F.lit(-_LIMIT)), F.lit(_LIMIT))
    bins = F.floor((clipped + _LIMIT) / (2 * _LIMIT) * BINS)
    rows = scored.where("y is not null").groupBy(bins.alias("bin")).agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).collect()
    a, b = sum(r.a for r in rows), sum(r.b for r in rows)
    if not a or not b:
        return 0.0
    best, at, low, over = -1.0, 0.0, 0, a
    found = {r.bin: (r.a, r.b) for r in rows}
    for k in range(BINS + 1):
        if low / b + over / a > best + 1e-12:
            best, at = low / b + over / a, k
        x, y = found.get(k, (0, 0))
        low, over = low + y, over - x
    return at * 2 * _LIMIT / BINS - _LIMIT


def filter_urls(pages: DataFrame, listed: list[Rule], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), llr for every row of ``pages``.

    The longest rule that fits decides; its text is in ``rule``. Other URLs are allowed if their log likelihood
    difference per character, ``llr``, reaches the calibrated threshold; it is null for URLs that trained the models.

    A null URL, or one without ``://``, has empty host and path; it is judged by its characters, one without
    characters by a difference of 0. If the rules decide no URL one way, the others are allowed. Null ids and
    repeated rows are kept; an empty table gives none; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fit = lambda value: _rule(F.col("host"), F.col("path"), listed, value)
    rows = rows.withColumns({"rule": fit(lambda r: F.lit(r.text)), "y": fit(lambda r: F.lit(str(int(r.allow)))).cast("int")})
    trains = F.col("y").isNotNull() & (F.pmod(F.xxhash64(F.lit("calibrate"), "url"), F.lit(CALIBRATE)) != 0)
    model = _model(rows.where(trains))
    both = model.df.agg(F.sum("a") * F.sum("b")).first()[0]
    scored = Table(_scored(rows.where(~trains), model), "scored").df
    at = _threshold(scored) if both else -float("inf")
    word = lambda c: F.when(c, F.lit("allow")).otherwise(F.lit("block"))
    done = rows.where(trains).withColumn("llr", F.lit(None).cast("double")).union(scored.select(*rows.columns, "llr"))
    return done.select("page_id", "host", "path", "rule", word(F.coalesce(F.col("y") == 1, F.col("llr") >= at)).alias("verdict"), "llr")
