"""Conversation repair against an exhaustive search over edits, against its SQL, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from tallygate.llm import conversation_repair as repair
from tallygate.llm import queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def ordered(rows):
    """The turns of a conversation in order, with their first faults."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, out = set(), []
    for turn, role, text in rows:
        fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, repaired turns) by trying every sequence of edits that costs no more than deleting all."""
    bound, best = 2 * len(rows), [None]

    def go(i, cost, audit, out):
        if cost > bound or (best[0] and cost > best[0][0]):
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best[0] is None or (cost, audit) < best[0][:2]):
                best[0] = cost, audit, list(out)
        else:
            _, role, text, fault = rows[i]
            late = 5 * (fault == "truncated")
            go(i + 1, cost + 2, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                go(i + 1, cost + late, audit + "K", [*out, (role, text)])
                for to in ("user", "assistant"):
                    go(i + 1, cost + late + 1, audit + "R", [*out, (to, text)])
        for to in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*out, (to, "")])

    go(0, 0, "", [])
    return best[0]


def brute(conversations, damaged):
    out = {}
    for conv in {r[0] for r in conversations}:
        rows = ordered([r[1:] for r in damaged if r[0] == conv])
        cost, audit, fixed = cheapest(rows)
        turns = [r[0] for r in rows if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
        count = lambda f, rows=rows: sum(r[3] == f for r in rows)
        whole = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, whole)
    return out


def harmed(rows):
    """The contract's damage in plain Python."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def conversations():
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), r.choice(["Yes.", "no", "", " \t\n", "What? ", "a. ", None, "ok!\r\n", f"{c} {t}."])) for c in range(150) for t in range(r.randint(1, 5))]
    rows += [(200, None, "user", "x."), (200, None, "assistant", "y."), (200, 7, "user", "z."), (201, None, "user", "a."), (None, 0, "user", "n."), (None, 1, "assistant", "m.")]
    rows += [(202, 3, "user", "same."), (202, 3, "user", "same."), (202, 3, "assistant", "other."), (203, -600, "user", "Low."), (203, 700, "assistant", "High."), (204, 0, "", "none."), (205, 0, "system", "alone.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, span string, again string, audit int"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in conversations()], SCHEMA).repartition(3).cache()


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("block", [1, 2, 256])
def test_cheapest_edits(spark, table, monkeypatch, block):
    """Blocks of any length give the same: what they hold is put together by their sixteen paths."""
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = repair.turns(table)
    damaged = repair.damage(rows)
    assert sorted(map(repr, (tuple(r) for r in damaged.collect()))) == sorted(map(repr, harmed(conversations())))
    assert got(repair.report(rows, damaged)) == brute(conversations(), harmed(conversations()))


def test_repaired_turns(spark, table):
    rows = repair.turns(table)
    found = repair.repairs(rows)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in conversations()]
    made = {}
    for r in sorted(repair.repaired_turns(rows, found).collect(), key=lambda r: r.position):
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv in {r[0] for r in plain}:
        assert made.get(conv, []) == cheapest(ordered([r[1:] for r in plain if r[0] == conv]))[2]


def test_no_conversations_and_a_long_one(spark):
    none = repair.turns(spark.createDataFrame([], SCHEMA))
    assert repair.report(none, repair.damage(none)).count() == 0
    long = repair.turns(spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"{t} " * 50 + ".") for t in range(3000)] + [(2, 0, "user", "w " * 200_000 + ".")], "conv_id long, turn long, role string, text string"))
    r = {x.conv_id: x for x in repair.report(long, long).collect()}
    assert r[1].audit == "K" * 3000 and r[1].cost == 0 and (r[2].audit, r[2].cost) == ("D", 2)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{SF}/conversations.parquet')")
    a, b = queries.QUERIES["op13_conversation_repair"](spark, SF).toPandas(), con.execute(queries.ORACLE["op13_conversation_repair"]).df()
    pd.testing.assert_frame_equal(*(x.sort_values("conv_id", ignore_index=True)[sorted(x.columns)] for x in (a, b)), check_dtype=False)
