"""Records of CSV files of any size: each file is read in blocks by many tasks, whatever newlines its cells hold.

Whether a line starts inside a quoted cell depends on all lines before it. A line is a function on that one bit: how it
ends when it starts outside, and when it starts inside. A task follows both cases through its block; the blocks' own
functions, one row each, are then put together in the order of the file, which tells every line its case and its record's number.
Only lines of records of several lines are shuffled. A file's lines are read three times, and never by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A quoted cell that is closed, and a cell after its comma. Possessive, so that long cells need no stack.
_CLOSED = r'(^|,)"[^"]*+(?:""[^"]*+)*+"'
_OPEN = r'(?:^|,)"'
_CELL = r',("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'
_QUOTED = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*+)\z'
_PLACE = ["file", "start", "id"]
_TRACED = "value string, file string, start long, id long, s0 boolean, s1 boolean, a0 boolean, a1 boolean, n0 long, n1 long, d0 long, d1 long, head string"


def _unquoted(record: Column) -> Column:
    """The record with each closed quoted cell as one letter: the commas left separate cells."""
    return F.when(F.contains(record, F.lit('"')), F.regexp_replace(record, _CLOSED, "$1x")).otherwise(record)


class _Case:
    """One of the two assumptions about a block's start, followed through its lines."""

    def __init__(self, inside: bool):
        self.state, self.done = inside, 0

    def follow(self, opens: np.ndarray, stays: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each line: inside before and after it, records finished before and after it."""
        moves = np.flatnonzero(opens | ~stays)  # other lines leave the state as it is
        states = [self.state]
        for i in moves:
            states.append(bool((stays if states[-1] else opens)[i]))
        after = np.repeat(states, np.diff([0, *moves, len(opens)]))
        before = np.concatenate([[self.state], after[:-1]]).astype(bool)
        ends = ~after & ~(blank & ~before)
        done = self.done + np.cumsum(ends)
        self.state, self.done = bool(after[-1]), int(done[-1])
        return before, after, done - ends, done


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, cases, head = None, (), None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        value, file, start = (batch.column(c) for c in ("value", "file", "start"))
        opens, stays = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("opens", "stays"))
        blank = pc.is_in(value, pa.array(["", "\r"])).to_numpy(zero_copy_only=False).astype(bool)
        new = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(start.slice(1), start.slice(0, n - 1)))
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1), n]
        parts, heads = [], [None] * n
        for i, j in zip(cuts, cuts[1:], strict=False):
            if (own := (file[i].as_py(), start[i].as_py())) != block:
                block, cases, head = own, (_Case(False), _Case(True)), [] if own[1] == 0 else None
            a, b = (c.follow(opens[i:j], stays[i:j], blank[i:j]) for c in cases)
            parts.append((a[0], b[0], a[1], b[1], a[2], b[2], a[3], b[3]))
            if head is not None:
                for k in np.flatnonzero((a[2] == 0) & ~(blank[i:j] & ~a[0])):
                    head.append(value[int(i + k)].as_py())
                    if a[3][k]:
                        heads[i + k], head = "\n".join(head), None
                        break
        traced = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
        columns = [*(batch.column(c) for c in ("value", *_PLACE)), *traced, pa.array(heads, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _TRACED.split(", ")])


def _blocks(traced: DataFrame) -> DataFrame:
    """(file, start, inside, first, head): how each block starts, the records that end before it, the file's header."""
    last = F.max_by(F.struct("a0", "a1", "d0", "d1"), "id").alias("last")
    b = traced.groupBy("file", "start").agg(last, F.max("head").alias("head")).select("file", "start", "head", "last.*")
    in_file = Window.partitionBy("file")
    upto, before = (in_file.orderBy("start").rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    swap = F.col("a0") & ~F.col("a1")  # outside to inside, and inside to outside
    b = b.withColumn("swap", swap.cast("int")).withColumn("swaps", F.sum("swap").over(upto))
    # A block that ends alike in both cases fixes the state; after it only swaps count.
    known = F.last(F.when(F.col("a0") == F.col("a1"), F.struct("a0", "swaps")), ignorenulls=True).over(before)
    b = b.withColumn("known", known)
    since = F.col("swaps") - F.col("swap") - F.coalesce("known.swaps", F.lit(0))
    b = b.withColumn("inside", F.coalesce("known.a0", F.lit(False)) != (since % 2 == 1))
    done = F.sum(F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0"))).over(before)
    return b.select("file", "start", "inside", F.coalesce(done, F.lit(0)).alias("first"), F.max("head").over(in_file).alias("head"))


def _cells(record: Column) -> Column:
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))
    return F.transform(found, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, _QUOTED, "$1$2"), F.lit('""'), F.lit('"'))).otherwise(c))


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, number, head, cells, n_cells) of all records but the headers; ``number`` is 1 for the first after the header.

    ``head`` has the cells of the file's own header, so files may differ in it. A quote opens a cell only as its first
    character, and is doubled inside; what follows the closing one belongs to the cell. Blank lines outside quotes are
    passed over, a byte order mark is too. Lines end in a newline, or in a carriage return and a newline; inside quotes
    both stay as they are. A quoted cell that nothing closes makes one record of the rest of its file, which a single task must hold.
    """
    value = F.col("value")
    quotes = F.contains(value, F.lit('"'))
    open_after = lambda s: quotes & F.regexp_like(F.regexp_replace(s, _CLOSED, "$1x"), F.lit(_OPEN))
    stays = F.when(quotes, open_after(F.concat(F.lit('"'), value))).otherwise(True)
    place = {"file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start"), "id": F.monotonically_increasing_id()}
    raw = spark.read.option("lineSep", "\n").text(paths).select("value", *(c.alias(n) for n, c in place.items()))
    unmarked = F.when(F.col("start") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(value)
    lines = raw.withColumn("value", unmarked).withColumns({"opens": open_after(value), "stays": stays})
    traced = lines.mapInArrow(_trace, _TRACED)
    placed = traced.join(_blocks(traced).withColumnsRenamed({"file": "of", "start": "at", "head": "header"}), (F.col("file") == F.col("of")) & (F.col("start") == F.col("at")))
    case = lambda c: F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    known = placed.select(*_PLACE, "value", "header", (F.col("first") + case("n")).alias("number"), case("s").alias("before"), case("a").alias("after"))
    known = known.where(F.col("before") | ~value.isin("", "\r")).where("number > 0")
    whole = known.where("NOT before AND NOT after").select("file", "number", "header", "value")
    parts = F.array_sort(F.collect_list(F.struct("start", "id", "value")))
    joined = F.array_join(F.transform(parts, lambda p: p["value"]), "\n")
    many = known.where("before OR after").groupBy("file", "number").agg(F.first("header").alias("header"), joined.alias("value"))
    record = F.regexp_replace("value", "\r\\z", "")
    rows = whole.unionByName(many).select("file", "number", F.regexp_replace("header", "\r\\z", "").alias("header"), record.alias("record"))
    left = _unquoted(F.col("record"))
    n_cells = F.length(left) - F.length(F.replace(left, F.lit(","), F.lit(""))) + 1
    return rows.select("file", "number", _cells(F.col("header")).alias("head"), _cells(F.col("record")).alias("cells"), n_cells.alias("n_cells"))
