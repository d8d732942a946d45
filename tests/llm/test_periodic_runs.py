"""Periodic runs against a search over all periods, on random and awkward texts."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tallygate.llm import periodic_runs as periodic
from tallygate.llm import queries

SF = "/root/testdata/sf0.001"


def brute(w, least=24, power=3):
    """Stretches in which words p apart are equal, for each p; of one stretch the smallest p counts."""
    out = {}
    for p in range(1, len(w) // power + 1):
        equal, i = [a == b for a, b in zip(w, w[p:])] + [False], 0
        while i < len(equal):
            j = i
            while equal[j]:
                j += 1
            if j > i and j - i + p >= max(least, power * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def made(r, most=300):
    letters = r.choice([1, 2, 2, 3, 5, 30])
    w = [b"%d" % r.randrange(letters) for _ in range(r.randint(0, 40))]
    for _ in range(r.randint(0, 4)):
        kind = r.randrange(3)
        if kind == 0 and w:
            a = r.randrange(len(w))
            b = a + r.randint(1, 6)
            w = w[:b] + w[a:b] * r.randint(1, 9) + w[b:]
        elif kind == 1 and w:
            w = w + w[r.randrange(len(w)) :]
        else:
            w = [*w, b"z"]
    return w[:most]


@pytest.mark.parametrize(("least", "power"), [(24, 3), (6, 3), (4, 2), (2, 2), (12, 4)])
def test_all_runs(least, power):
    r = random.Random(least)
    for _ in range(400):
        docs = [made(r) for _ in range(r.randint(0, 4))]
        assert periodic.runs_of_documents(docs, least, power) == [brute(w, least, power) for w in docs]


def test_slices_don_t_matter(monkeypatch):
    r = random.Random(5)
    docs = [made(r) for _ in range(80)]
    whole = periodic.runs_of_documents(docs)
    monkeypatch.setattr(periodic, "SLICE", 1)
    assert periodic.runs_of_documents(docs) == whole and sum(map(len, whole)) > 30


def test_previous_factors_and_blocks():
    r = random.Random(6)
    for _ in range(100):
        x = np.array([r.randrange(3) for _ in range(r.randint(0, 30))] + [9])
        ranks = periodic.Ranks(x)
        sa = ranks.suffix_array()
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        longest, source = periodic.previous_factors(sa, np.append(0, ranks.onwards(sa[:-1], sa[1:])))
        same = lambda i, j, x=x: next((k for k in range(len(x)) if max(i, j) + k >= len(x) or x[i + k] != x[j + k]), 0)
        for i in range(len(x)):
            assert longest[i] == max((same(i, j) for j in range(i)), default=0)
            assert longest[i] == 0 or (source[i] < i and same(i, source[i]) == longest[i])


def expected(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    assert top == periodic.best(runs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    spans = sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode())
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, spans, sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def rows():
    r = random.Random(9)
    texts = [b" ".join(made(r)).decode() for _ in range(150)]
    return [*enumerate(texts), (900, None), (901, ""), (902, " \n\x0b "), (903, "w " * 5000), (904, "a b " * 40), (None, "x y " * 20), (None, None), (905, texts[1]), (905, texts[1]), (-7, "é " * 25), (906, "  \x1c " * 30)]


def test_query_against_brute_force(spark, tmp_path):
    clash = [(i, t, "x", 1, "r", "k", 2) for i, t in rows()]
    spark.createDataFrame(clash, "doc_id long, text string, w string, h int, runs string, kept string, a int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(x) for x in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(expected(*x)) for x in rows())
    assert sum(x[1] > 0 for x in got) > 20


def test_given_documents(spark):
    docs = {x.doc_id: x.text for x in queries.table(spark, SF, "documents").collect()}
    for x in queries.QUERIES["op12_periodic_runs"](spark, SF).collect():
        if len((docs[x.doc_id] or "").split()) < 1500:
            assert tuple(x) == expected(x.doc_id, docs[x.doc_id])


def test_no_documents_and_a_long_one(spark):
    schema = "doc_id long, text string"
    assert periodic.periodic_runs(spark.createDataFrame([], schema)).count() == 0
    r = random.Random(4)
    stretch = " ".join(str(r.randrange(1000)) for _ in range(30_000))
    x = periodic.periodic_runs(spark.createDataFrame([(1, f"start {stretch} {stretch} {stretch} end")], schema)).first()
    assert [tuple(v) for v in x.runs] == [(1, 90_000, 30_000)] and x.kept == f"start {stretch} end"
