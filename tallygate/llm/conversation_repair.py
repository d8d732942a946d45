"""Conversation structure repair: the cheapest edits that turn a conversation into ``(s?(ua)+)?``, by a fold over its turns.

Fault flags come from windows. Turns are collected, sorted, in blocks of a bounded number, and ``aggregate()`` carries
four (cost, audit) structs over a block: what it costs to have written nothing, to end in a system turn, in a user's,
in an assistant's. A block is folded from each of the four, since what stands before it isn't known there; a
conversation's blocks are then put together by another ``aggregate()``. So a conversation that holds a third of all
rows is folded in many tasks. No text takes part: rows carry a role's initial, three flags and a digest of the text.

The audit (one letter a turn, I for an inserted one) is replayed over the turns, which pass by in order and are never
held together, into repaired turns or into their digest. A digest of a whole conversation is sequential by nature.

Nulls in role or text are one space. Rows are in order of turn (nulls first), then role, then digest of the text;
rows alike in all three are repeats. A turn of an empty role is never kept as it is. A null conv_id is a conversation of its own. Empty tables give no rows. Further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Table, partitions

#: Turns in a block, and blocks in a group of blocks, at most.
BLOCK = 256
#: Costs of the edits; an undeleted truncated turn adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

_SPACE = " \t\n\x0b\x0c\r"
_STATES = "esua"  # nothing written, a system turn last, a user's, an assistant's
_PATH = "struct<cost:bigint,audit:string>"
_FOUR = "struct<" + ",".join(f"{s}:{_PATH}" for s in _STATES) + ">"


# --- rows ---------------------------------------------------------------------------------------------


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) of a table of conversations."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Turns with faults by crc32 of ``conv_id:turn``: dropped, emptied, without full stops, repeated, given to the user."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_")).drop("_")


def flagged(rows: DataFrame) -> DataFrame:
    """One row a turn without its text: place in its block, initial, first fault, and what the report counts."""
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    blank = last == ""
    light = rows.select(
        "conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
        F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~blank & ~last.isin(".", "!", "?")).alias("open"),
        F.floor(F.col("turn") / BLOCK).alias("span"),
    )
    turn = F.col("turn").asc_nulls_first()
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(turn))
    light = light.withColumn("again", (seen > 1) & ~F.col("blank"))
    within = Window.partitionBy("conv_id", "span").orderBy(turn, "role", "digest", "again")
    before, pair = F.lag("turn").over(within), F.concat(F.lag("initial").over(within), "initial")
    return light.select(
        "conv_id", "span", "turn", "initial", "blank", "again",
        (F.col("open") & ~F.col("again")).alias("open"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(before)).alias("new_turn"),
        (~pair.isin("su", "ua", "au")).alias("illegal"),
        (F.row_number().over(within) - 1).alias("at"),
    )


# --- the fold -----------------------------------------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _four(**paths: Column) -> Column:
    return F.struct(*(paths.get(s, F.lit(None)).cast(_PATH).alias(s) for s in _STATES)).cast(_FOUR)


def _add(path: Column, cost: Column | int, letter: Column | str) -> Column:
    cost, letter = (x if isinstance(x, Column) else F.lit(x) for x in (cost, letter))
    return F.when(path.isNotNull(), F.struct((path["cost"] + cost).alias("cost"), F.concat(path["audit"], letter).alias("audit")).cast(_PATH))


def _inserted(x: Column) -> Column:
    """The four after what insertions may come here: a user's turn, an assistant's, or both."""
    user = F.least(x["u"], _add(F.least(x["e"], x["s"], x["a"]), INSERT, "I"))
    both = lambda u: _four(e=x["e"], s=x["s"], u=u, a=F.least(x["a"], _add(u, INSERT, "I")))
    return _let(user, both)


def _step(acc: Column, t: Column) -> Column:
    """The four after one more turn. Of two paths to a state the cheaper stays, of equal cost the one whose audit is less."""

    def edited(x: Column) -> Column:
        dead, more = t["blank"] | t["again"], F.when(t["open"], TRUNCATED).otherwise(0)
        gone = {s: _add(x[s], DELETE, "D") for s in _STATES}

        def written(path: Column, initial: str) -> Column:
            keeps = t["initial"] == initial
            return F.when(~dead, _add(path, more + F.when(keeps, 0).otherwise(REROLE), F.when(keeps, "K").otherwise("R")))

        system = F.when(~dead & (t["initial"] == "s"), _add(x["e"], more, "K"))
        return _four(
            e=gone["e"],
            s=F.least(gone["s"], system),
            u=F.least(gone["u"], written(F.least(x["e"], x["s"], x["a"]), "u")),
            a=F.least(gone["a"], written(x["u"], "a")),
        )

    return _let(_inserted(acc), edited)


def _start(state: str) -> Column:
    return _four(**{state: F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))})


def _from_each(fold: Callable[[Column], Column]) -> Column:
    """A fold from each of the four states: sixteen paths."""
    return F.struct(*(fold(_start(s)).alias(s) for s in _STATES))


def _onward(acc: Column, block: Column) -> Column:
    """The four after a block whose sixteen paths are known."""
    joined = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit")).cast(_PATH))
    return _four(**{end: F.least(*(joined(acc[s], block[s][end]) for s in _STATES)) for end in _STATES})


def repairs(rows: DataFrame) -> DataFrame:
    """For each conversation with turns: gaps, blank, duplicate, truncated, illegal, cost, audit.

    Blocks are stretches of the turn number, cut where rows of equal turns make them too long.
    """
    block = F.floor(F.col("at") / BLOCK)
    turn = F.struct("at", "initial", "blank", "again", "open")
    count = lambda c: F.count_if(F.col(c))
    ends = F.struct("at", "initial")
    blocks = flagged(rows).groupBy("conv_id", "span", block.alias("part")).agg(
        F.sort_array(F.collect_list(turn)).alias("ts"), F.min(ends)["initial"].alias("first"), F.max(ends)["initial"].alias("last"),
        F.min("turn").alias("least"), F.max("turn").alias("most"), count("new_turn").alias("turns"),
        count("blank").alias("blank"), count("again").alias("duplicate"), count("open").alias("truncated"), count("illegal").alias("illegal"),
    )
    paths = _from_each(lambda start: F.aggregate("ts", start, _step))
    blocks = blocks.withColumn("paths", paths).drop("ts")
    order = Window.partitionBy("conv_id").orderBy(F.col("span").asc_nulls_first(), "part")
    crossing = (F.col("part") == 0) & ~F.concat(F.lag("last").over(order), "first").isin("su", "ua", "au")
    blocks = blocks.withColumns({"at": F.row_number().over(order) - 1, "illegal": F.col("illegal") + F.coalesce(crossing, F.lit(False)).cast("long")})
    sums = [F.min("least").alias("least"), F.max("most").alias("most"), *(F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal"))]

    def gathered(df: DataFrame, *keys: Column | str) -> DataFrame:
        return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "paths"))), lambda x: x["paths"]).alias("ps"), F.min("at").alias("at"), *sums)

    groups = gathered(blocks, "conv_id", F.floor(F.col("at") / BLOCK).alias("group"))
    whole = F.when(F.size("ps") == 1, F.get("ps", F.lit(0))).otherwise(_from_each(lambda start: F.aggregate("ps", start, _onward)))
    convs = gathered(groups.withColumn("paths", whole).drop("ps"), "conv_id")
    best = F.aggregate("ps", _start("e"), _onward, lambda x: _let(_inserted(x), lambda y: F.least(y["e"], y["a"])))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    return convs.withColumn("best", best).select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit")


# --- replaying the audit --------------------------------------------------------------------------------


class Replay:
    """Gives the audit's turns in order, from the turns that pass by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _next(self) -> str:
        self.last = "assistant" if self.last == "user" else "user"
        return self.last

    def _insertions(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._next(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what comes to stand before the turn, and of it."""
        yield from self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.last = {"u": "user", "a": "assistant"}.get(role[:1], "")
            yield edit, role, text
        elif edit == "R":
            yield edit, self._next(), text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._insertions()


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns, within a task."""
    kind = dict(rows.dtypes)["conv_id"]
    text = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text")
    head = found.select(F.col("conv_id").cast(kind), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    every = head.unionByName(text).repartition(partitions(rows.sparkSession), "conv_id")
    return every.sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest").select("conv_id", "kind", "role", "text")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str, str]], bool]]:
    """(conv_id, turns written, whether it is over), a few turns at a time."""
    now = None
    for batch in batches:
        for conv, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if kind == 0:
                if now:
                    yield now[0], list(now[1].end()), True
                now = conv, Replay(text)
            else:
                yield conv, list(now[1].turn(role, text)), False
    if now:
        yield now[0], list(now[1].end()), True


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired ``role:text``, newline-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, h, some = [], hashlib.sha256(), False
        for conv, written, over in _replayed(batches):
            for _, role, text in written:
                h.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True
            if over:
                done.append((conv, h.hexdigest()))
                h, some = hashlib.sha256(), False
            if len(done) >= 5000:
                yield _batch(done, schema)
                done = []
        yield _batch(done, schema)

    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", _arrow(kind)), ("repaired_sha256", pa.string())])
    return _in_order(rows, found).mapInArrow(run, f"conv_id {kind.simpleString()}, repaired_sha256 string")


def repaired_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired conversations, turn by turn from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, at = [], 0
        for conv, written, over in _replayed(batches):
            for edit, role, text in written:
                done.append((conv, at, edit, role, text))
                at += 1
            at = 0 if over else at
            if len(done) >= 1000:
                yield _batch(done, schema)
                done = []
        yield _batch(done, schema)

    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", _arrow(kind)), ("position", pa.int64()), *((c, pa.string()) for c in ("edit", "role", "text"))])
    return _in_order(rows, found).mapInArrow(run, f"conv_id {kind.simpleString()}, position long, edit string, role string, text string")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """What was found and done in every conversation of the first table, whose turns are now ``rows``; zeros where none is left."""
    found = Table(repairs(rows), "repairs").df
    hashed = digests(rows, found)
    ids = conversations.select("conv_id").distinct()
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"])
    out = ids.join(found, same(ids, found), "left").drop(found["conv_id"])
    out = out.join(hashed, same(ids, hashed), "left").drop(hashed["conv_id"])
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
