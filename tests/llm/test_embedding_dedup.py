"""Embedding near-duplicates against a comparison of all pairs, on planted groups and awkward rows."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallygate.llm import embedding_dedup as near
from tallygate.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, node long, dim string, v int, size long, h1 int, root int"


def planted(seed=1, dim=16):
    g = np.random.default_rng(seed)
    base = near.unit(g.standard_normal((400, dim)))
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    for k in range(40):  # pairs from well above to just below the threshold
        y = g.standard_normal(dim)
        y = near.unit((y - (y @ base[k]) * base[k])[None])[0]
        c = 0.885 + 0.11 * k / 40
        rows.append((1000 + k, ((c * base[k] + math.sqrt(1 - c * c) * y) * g.uniform(0.1, 90)).tolist()))
    rows += [(2000 + k, (base[50] + 0.02 * g.standard_normal(dim)).tolist()) for k in range(300)]  # a large group
    chain = base[60]
    for k in range(12):  # neighbours are near, ends aren't
        chain = near.unit((chain + 0.09 * g.standard_normal(dim))[None])[0]
        rows.append((3000 + k, chain.tolist()))
    rows += [(4000 + k, rows[70][1]) for k in range(50)]  # equal ones
    zero, nan, inf = [0.0] * dim, [float("nan")] * dim, [1.0] * (dim - 1) + [float("inf")]
    rows += [(5000, None), (5001, []), (5002, zero), (5003, zero), (5004, nan), (5005, inf), (5006, [1.0] * (dim - 1) + [None]), (5007, None)]
    rows += [(6000, rows[80][1]), (6000, rows[80][1]), (6000, rows[81][1]), (None, rows[90][1]), (None, None), (-4, rows[91][1])]
    rows += [(7000 + k, [1.0 + k / 100, 2.0, 3.0]) for k in range(6)] + [(7100, [2.0]), (7101, [-2.0]), (7102, [5.0])]
    rows += [(7200, [1e300] * dim), (7201, [3e-200] * dim)]
    random.Random(seed).shuffle(rows)
    return rows


def brute(rows, cosine=0.9):
    def sound(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [i for i, (_, v) in enumerate(rows) if sound(v)]
    links = {i: [] for i in range(len(rows))}
    for dim in {len(rows[i][1]) for i in ok}:
        at = [i for i in ok if len(rows[i][1]) == dim]
        u = near.unit(np.array([rows[i][1] for i in at], float))
        for a, b in zip(*np.nonzero(u @ u.T >= cosine), strict=True):
            if a != b:
                links[at[a]].append(at[b])
    out, seen = [None] * len(rows), set()
    for i in links:
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] == least)
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "d", 3, 4, 5, 6) for i, v in rows], SCHEMA).repartition(3)


def test_all_links_of_planted_groups(spark, monkeypatch):
    """Tiles smaller than the groups; windows that see all, so that nothing is left to chance."""
    monkeypatch.setattr(near, "TILE", 64)
    rows = planted()
    got = [tuple(r) for r in near.near_vectors(table(spark, rows), window=1024).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))


def test_recall_of_small_windows(spark):
    """At least 0.9 of the links, and none that isn't one; large groups are counted in full."""
    rows = planted(2, 32)
    got = sorted((tuple(r) for r in near.near_vectors(table(spark, rows), window=8).collect()), key=lambda r: (repr(r[0]), r[1:]))
    expected = sorted(brute(rows), key=lambda r: (repr(r[0]), r[1:]))
    n, m = (sum(r[1] for r in x) for x in (got, expected))
    assert 0.9 * m <= n <= m
    single = {r[0] for r in rows if r[0] is not None and sum(x[0] == r[0] for x in rows) == 1}
    one, other = ({r[0]: r for r in x if r[0] in single} for x in (got, expected))
    assert all(one[i][1] <= other[i][1] and one[i][2] >= other[i][2] for i in single)
    assert sum(one[i][1] == other[i][1] for i in single) > 0.95 * len(single)


def test_partitions_and_passes_hold_the_recall(spark):
    """Pairs at the threshold alone, among many other vectors."""
    g = np.random.default_rng(3)
    x = near.unit(g.standard_normal((3000, 24)))
    y = g.standard_normal((300, 24))
    y = near.unit(y - (y * x[:300]).sum(1)[:, None] * x[:300])
    pairs = 0.901 * x[:300] + math.sqrt(1 - 0.901**2) * y
    rows = [*enumerate(x.tolist()), *((10_000 + i, v) for i, v in enumerate(pairs.tolist()))]
    true = sum(r[1] for r in brute(rows))
    for parts in (1, 7):
        assert near.near_vectors(table(spark, rows).repartition(parts), window=16).agg({"n_links": "sum"}).first()[0] >= 0.9 * true


def test_passes_grow_with_the_table():
    need = [near.plan(n, 64, 256, 0.9, 0.95)[1] for n in (200, 10_000, 10**6, 10**9)]
    assert need == sorted(need) and need[0] == 1 and need[-1] < 60
    root = near.local_roots(8, np.array([1, 2, 6, 5]), np.array([2, 4, 7, 7]))
    assert root.tolist() == [0, 1, 1, 3, 1, 5, 5, 5]


def test_empty_and_float_tables(spark):
    assert near.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in near.near_vectors(only).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("name", ["op11_embedding_dedup"])
def test_sql(spark, tmp_path, name):
    """The query and its SQL on the given table with near copies of some of its vectors."""
    given = queries.table(spark, SF, "embeddings")
    more = given.selectExpr("vec_id + 100000 AS vec_id", "transform(embedding, (x, i) -> cast(x * IF(i = vec_id % 60, 1.3, 1) AS float)) AS embedding", "label").where("vec_id % 3 = 0")
    given.unionByName(more).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    a, b = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(queries.ORACLE[name]).df()
    assert a.n_links.sum() > 100
    pd.testing.assert_frame_equal(*(x.sort_values("vec_id", ignore_index=True)[sorted(x.columns)] for x in (a, b)), check_dtype=False)
