"""N-gram Jaccard join by set relations: index blocks skipped by position, answers derived from a similar set's.

Exact self-join of the documents' word-shingle sets at a Jaccard threshold, reported as components.

* Copies: a set is named by the digest of its members. Copies share the name, so they are one set.
* Index: shingles are ordered from rare to common by a fixed-size table of bucket counts over all
  documents (any order gives exact results; this one keeps the lists short). Two sets that link
  share SHARED shingles among the first ones of either, fewer of the smaller set than of the larger.
* Skipped blocks: the deeper a shingle stands in a set, the smaller a partner must be for the shingles
  from there on to suffice; that size is the entry's reach. Lists are cut into blocks by the size
  classes of both partners, and an entry enters only the blocks within its reach. So whole blocks are
  skipped by position before any pair meets.
* Derived answers: in every list each set is first verified against one set of a class only, the one in
  which the shingle stands first, which so has the fewest shingles of its own. A set found similar takes over
  that set's component, and what that set shares with others bounds what the similar set can share with
  them: by the shingles in which the two differ, most answers of the second round follow without
  looking at the sets. That round compares sets of different components alone. So a group of mutually
  similar sets costs its size, not the square of it, and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Table, WordHash, components, fold_arrays, lean, pack_array, shingle_set, small, split_by_ids, texts

#: Buckets of the table of shingle counts, which fixes the order of the index; 8 MB at any input size.
COUNT_BUCKETS = 1 << 21
#: Sets whose shingles a task need not write again (copies); forgotten and begun anew when full.
SEEN_SETS = 500_000

#: Shingles that a pair must share in the index before its sets are compared.
SHARED = 3
#: A shingle whose bucket counts so many more than eight times the average is hot; parts its list is dealt to.
HOT, PARTS = 1 << 16, 64
_CELLS = 256

_PARITY = ["b0", "b1", "b2", "b3"]
_SETS = "doc_id long, n_shingles long, set_id long, b0 long, b1 long, b2 long, b3 long, counts binary"
_POSTINGS = "token long, part int, set_id long, n int, pos int"


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The sets of the documents by name, with their parities; and one row of bucket counts for each task."""
    cache, counts = WordHash(), np.zeros(COUNT_BUCKETS, np.uint32)
    names = ["doc_id", "n_shingles", "set_id", *_PARITY, "counts"]
    for batch in small(batches):
        n, ids, parity = [], [], []
        for text in texts(batch):
            s = shingle_set(cache.array(text.lower().split()), words)
            n.append(len(s))
            ids.append(_set_id(s))
            parity.append(np.packbits(np.bincount((s >> np.uint64(32)).astype(np.int64) & (_CELLS - 1), minlength=_CELLS) & 1).tobytes())
            np.add.at(counts, _bucket(s), np.uint32(1))
        bits = np.frombuffer(b"".join(parity), np.int64).reshape(-1, 4)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), *(pa.array(bits[:, j]) for j in range(4)), pa.nulls(len(n), pa.binary())], names=names)
    if counts.any():
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in names[:-1]), pa.array([pack_array(counts)], pa.binary())], names=names)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)


def _set_id(s: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None


def _postings(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int, counts, hot: float) -> Iterator[pa.RecordBatch]:
    """The first shingles of each set, rare ones first; a hot one's list is dealt to parts by set, from 1 on."""
    cache, order, seen = WordHash(), counts.value, set()
    for batch in small(batches):
        tokens, ids, sizes, parts = [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            if doc_id is None:
                continue
            s = shingle_set(cache.array(text.lower().split()), words)
            n, set_id = len(s), _set_id(s)
            if set_id is None or set_id in seen:
                continue
            if len(seen) >= SEEN_SETS:
                seen.clear()
            seen.add(set_id)
            rank = order[_bucket(s)]
            first = np.argsort(rank, kind="stable")[: n + num * n // -den + SHARED]
            tokens.append(s[first])
            ids.append(set_id)
            sizes.append(n)
            parts.append(np.where(rank[first] > hot, 1 + set_id % PARTS, 0))
        if not ids:
            continue
        length = [len(t) for t in tokens]
        columns = [
            pa.array(np.concatenate(tokens).view(np.int64)),
            pa.array(np.concatenate(parts).astype(np.int32)),
            pa.array(np.repeat(np.array(ids, np.int64), length)),
            pa.array(np.repeat(np.array(sizes, np.int32), length)),
            pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in length])),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "part", "set_id", "n", "pos"])


def _members(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    cache = WordHash()
    for batch in small(batches):
        sets = [shingle_set(cache.array(t.lower().split()), words) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "members"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        n = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)
            n.append((len(p), len(q), both))
        columns = [pa.array([x[k] for x in n], pa.int64()) for k in range(3)]
        given = ["a", "b", "a_leads", "b_leads"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, given), *columns], names=[*given, "na", "nb", "both"])


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, a_leads, b_leads, na, nb, both) of pairs of set ids: with the sizes and the exact overlap of the sets."""
    x = sets.select(F.col("set_id").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("set_id").alias("b"), F.col("members").alias("y"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", "a_leads", "b_leads", "x", "y")
    return met.mapInArrow(_verify, "a long, b long, a_leads boolean, b_leads boolean, na long, nb long, both long")


class _Index:
    """Entries (token, set_id, n, pos) of the shingles that two sets have among their first, and what pairs them."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def need(self, na: Column, nb: Column) -> Column:
        """The overlap from which sets of these sizes link."""
        return F.ceil((na + nb) * self.num / (self.num + self.den) - 1e-9)

    def differ(self) -> Column:
        """The most shingles that a linked pair has in one set alone."""
        return F.col("na") + F.col("nb") - 2 * self.need(F.col("na"), F.col("nb"))

    def linked(self) -> Column:
        return F.col("both") * self.den >= (F.col("na") + F.col("nb") - F.col("both")) * self.num

    def size_class(self, n: Column) -> Column:
        """A pair's larger set lies in the class of the smaller or the next."""
        return F.floor(F.log(n.cast("double")) / (math.log(self.den / self.num) + 1e-9)).cast("int")

    def shared(self, postings: DataFrame) -> DataFrame:
        """Each set's entries in lists of two sets or more, with their reach, after one exchange."""
        lists = Window.partitionBy("token", "part")
        rows = postings.withColumns({"lo": F.min("set_id").over(lists), "hi": F.max("set_id").over(lists)})
        rows = rows.where((F.col("lo") < F.col("hi")) | (F.col("part") > 0))
        rows = rows.groupBy("token", "part", "set_id").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
        left = F.col("n").cast("long") - F.col("pos") + (SHARED - 1)
        reach = F.floor(left * (self.num + self.den) / self.num + 1e-9) - F.col("n")
        return rows.select("token", "set_id", "n", "pos", reach.alias("reach"))

    def _cut(self, entries: DataFrame) -> DataFrame:
        """The entries with their size class and the farthest within reach."""
        return entries.withColumns({"own": self.size_class(F.col("n")), "far": self.size_class(F.greatest("reach", F.lit(1)))})

    def _side(self, rows: DataFrame, s: str, *extra: str) -> DataFrame:
        keys = [c for c in ("small", "large") if c in rows.columns]
        return rows.select("token", *keys, F.col("set_id").alias(s), *(F.col(c).alias(c + s) for c in ("n", "pos", "reach", *extra)))

    def central(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of each list and class of the larger set, the entry that stands first in its set, as a; and the entries to try with it, as b.

        Of both only such as reach a set of their own size: two that link share enough of these, unless their sizes lie far apart.
        """
        cut = self._cut(entries).where("reach >= n")
        smaller = cut.withColumn("large", F.explode(F.array(F.col("own"), F.col("own") + 1))).where("large <= far")
        first = self._side(smaller, "a").groupBy("token", "large").agg(F.min(F.struct("posa", "a", "na", "reacha")).alias("x"))
        return first.select("token", "large", "x.*"), self._side(cut.withColumn("large", F.col("own")), "b")

    def sides(self, entries: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
        """The entries as a, the smaller set of a pair, and as b, the larger, in the blocks (small, large) within their reach."""
        cut = self._cut(entries).withColumn("step", F.explode(F.array(F.lit(0), F.lit(1))))
        smaller = cut.where("reach >= n").withColumns({"small": F.col("own"), "large": F.col("own") + F.col("step")}).where("large <= far")
        larger = cut.withColumns({"small": F.col("own") - F.col("step"), "large": F.col("own")}).where("small <= far")
        return self._side(smaller, "a", *extra), self._side(larger, "b", *extra)

    def pairs(self, smaller: DataFrame, larger: DataFrame, which: Column) -> DataFrame:
        """(a, b, na, nb, a_leads, b_leads), a < b, of the sets that share enough entries in common blocks; it leads as the smaller."""
        near = (F.col("nb") * self.num <= F.col("na") * self.den) & (F.col("na") * self.num <= F.col("nb") * self.den)
        within = (F.col("nb") <= F.col("reacha")) & (F.col("na") <= F.col("reachb"))
        met = smaller.join(larger, [c for c in ("token", "small", "large") if c in smaller.columns]).where(near & within & which)
        turn = F.col("a") < F.col("b")
        one = lambda x, y, to: F.when(turn, F.col(x)).otherwise(F.col(y)).alias(to)
        met = met.select(one("a", "b", "a"), one("b", "a", "b"), one("na", "nb", "na"), one("nb", "na", "nb"), turn.alias("turn"))
        counted = met.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("turn").alias("a_leads"), F.max(~F.col("turn")).alias("b_leads"), F.count("*").alias("k"))
        return counted.where(F.col("k") >= F.least(self.need(F.col("na"), F.col("nb")), F.lit(SHARED))).drop("k")

    def alike(self) -> Column:
        """Whether the parities differ in no more cells than the sets may differ in shingles."""
        odd = [F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) for c in _PARITY]
        return sum(odd[1:], odd[0]) <= self.differ()

    def possible(self, pairs: DataFrame, parities: DataFrame) -> DataFrame:
        """The pairs that are alike."""
        columns = pairs.columns
        for s in "ab":
            pairs = pairs.join(parities.select(F.col("set_id").alias(s), *(F.col(c).alias(c + s) for c in _PARITY)), s)
        return pairs.where(self.alike()).select(*columns)

    def derived(self, pairs: DataFrame, answers: DataFrame) -> DataFrame:
        """``pairs`` with the least and the most that they can share, from the ``answers`` (r, x, nr, both) of sets r tried with either.

        With a similar to r, a & b holds all of r & b but what a lacks of r, and beyond it only what a has besides r.
        """
        a = answers.select("r", F.col("x").alias("a"), "nr", F.col("both").alias("ra"))
        b = answers.select("r", F.col("x").alias("b"), F.col("both").alias("rb"))
        most = F.least(F.col("rb") + F.col("na") - F.col("ra"), F.col("ra") + F.col("nb") - F.col("rb"))
        least = F.col("ra") + F.col("rb") - F.col("nr")
        met = pairs.join(a, "a", "left").join(b, ["r", "b"], "left")
        return met.groupBy("a", "b", "na", "nb", "a_leads", "b_leads").agg(F.min(most).alias("most"), F.max(least).alias("least"))


def _answers(tried: DataFrame) -> DataFrame:
    """(r, x, nr, both): what the sets r that led a pair share with the others; a set is x to few, one for each entry of it at most."""
    first = tried.where("a_leads").select(F.col("a").alias("r"), F.col("b").alias("x"), F.col("na").alias("nr"), "both")
    return first.union(tried.where("b_leads").select("b", "a", "nb", "both"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Documents link when ``den * |x & y| >= num * |x | y|`` over sets of ``words``-word shingles of
    their ASCII-lower-cased words; component_id is the least doc_id reachable by links.

    A null or empty text, or one without words, has no shingles and is linked with nothing, not even
    with its like; a text of fewer words than ``words`` has its whole sequence as the one shingle.
    Repeated rows give repeated rows; a null id is kept, takes no part in links of others and, if its
    text has a component, gets that. An empty table gives none. Other columns are ignored.
    """
    num, den = threshold
    index, spark = _Index(num, den), docs.sparkSession
    docs = lean(docs, id_col, text_col)
    table = Table(docs.mapInArrow(lambda it: _sets(it, words), _SETS), "sets")
    named = table.df.where("counts is null").select("doc_id", "n_shingles", "set_id")
    counted = fold_arrays(table.df.where("counts is not null").select("counts"), np.uint32, np.add, np.zeros(COUNT_BUCKETS, np.uint32))
    counts, hot = spark.sparkContext.broadcast(counted), HOT + 8 * float(counted.mean())
    first = table.df.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), *(F.first(b).alias(b) for b in _PARITY))
    first = Table(first, "first")
    entries = Table(index.shared(docs.mapInArrow(lambda it: _postings(it, words, num, den, counts, hot), _POSTINGS)), "entries")

    def overlaps(pairs: DataFrame) -> Table:
        """By the sets of the documents in question alone."""
        used = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        wanted = Table(first.df.join(used, "set_id", "left_semi").select("doc_id"), "wanted")
        maybe, _ = split_by_ids(docs, wanted.df)
        chosen = maybe.join(wanted.df, "doc_id", "left_semi")
        sets = chosen.mapInArrow(lambda it: _members(it, words), "set_id long, members binary").dropDuplicates(["set_id"])
        out = Table(_overlaps(pairs, sets), "overlaps")
        wanted.drop()
        return out

    counts.destroy()

    # First round: against one set of each list and class, one pair for each entry at most.
    central, others = index.central(entries.df)
    pairs = Table(index.possible(index.pairs(central, others, F.col("a") != F.col("b")), first.df), "pairs")
    tried = overlaps(pairs.df)
    pairs.drop()
    reached = Table(components(tried.df.where(index.linked()).select("a", "b")), "reached")

    # Second round: only lists that still hold different components, only pairs across them, each once.
    roots = first.df.select("set_id", *_PARITY).join(reached.df.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
    rooted = Table(entries.df.join(roots.withColumn("root", F.coalesce("root", "set_id")), "set_id"), "rooted")
    entries.drop()
    mixed = rooted.df.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    open_ = Table(rooted.df.join(mixed, "token", "left_semi"), "open")
    rooted.drop()
    smaller, larger = index.sides(open_.df, "root", *_PARITY)
    across = (F.col("roota") != F.col("rootb")) & (F.struct("na", "a") < F.struct("nb", "b"))
    pairs = index.pairs(smaller, larger, across & index.alike()).join(tried.df.select("a", "b"), ["a", "b"], "left_anti")
    pairs = Table(index.derived(pairs, _answers(tried.df)), "pairs")
    open_.drop()
    need = index.need(F.col("na"), F.col("nb"))
    doubtful = pairs.df.where(F.coalesce(F.col("most") >= need, F.lit(True)) & F.coalesce(F.col("least") < need, F.lit(True)))
    fresh = overlaps(doubtful)
    stars = reached.df.select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = fresh.df.where(index.linked()).select("a", "b").union(pairs.df.where(F.col("least") >= need).select("a", "b")).union(stars)

    # Among the sets' least documents, so that the least of a component names it.
    for s in "ab":
        links = links.join(first.df.select(F.col("set_id").alias(s), F.col("doc_id").alias(f"doc_{s}")), s)
    links = Table(links.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")), "links")
    for t in (pairs, fresh, tried, reached):
        t.drop()
    roots = components(links.df.where("a <> b")).select(F.col("node").alias("doc_id"), "root")
    class_of = first.df.join(roots, "doc_id", "left").select("set_id", F.coalesce("root", "doc_id").alias("component_id"))
    class_of = Table(class_of, "classes")
    for t in (links, first):
        t.drop()
    out = named.join(class_of.df, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
