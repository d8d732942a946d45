"""The pipeline's stages: columns kept, decisions taken, and the whole of it against its operators."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tallygate.llm import decontamination, jaccard_join, pii, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, SF, "documents")


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_filtering_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    scores = quality.quality_scores(docs, queries.table(spark, SF, "labels"))
    first = stages["quality_classifier"](spark, docs, SF)
    assert first.columns == docs.columns and ids(first) == ids(scores.where("predicted = 1"))
    second = stages["ngram_jaccard_join"](spark, first, SF)
    assert second.columns == docs.columns and ids(second) == ids(jaccard_join.jaccard_components(first).where("component_id = doc_id"))
    third = stages["benchmark_decontamination"](spark, second, SF)
    assert third.columns == docs.columns and ids(third) == ids(second) - ids(decontamination.contaminated(second, queries.table(spark, SF, "benchmark")))
    fourth = stages["pii"](spark, third, SF)
    assert fourth.columns == docs.columns and ids(fourth) == ids(third)
    assert pii.find_personal_data(fourth).agg({"n_email": "sum"}).first()[0] in (0, None)
    pieces = stages["packing"](spark, fourth, SF)
    assert ids(pieces) == ids(fourth)
    whole = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.where("start = 0").collect())
    assert key(whole) == key(pieces)


def test_no_documents(spark, docs):
    out = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() == 0


AWKWARD = "doc_id long, text string, row_key string, found_id int, component_id string, n_chars long"


def stage_on(spark, monkeypatch, name, rows, **tables):
    """The (doc_id, text) that the stage keeps of the rows, counted; ``tables`` take the place of those of the folder."""
    monkeypatch.setattr(queries, "table", lambda _spark, _dir, table: tables[table])
    docs = spark.createDataFrame([(i, t, "x", 1, "y", n) for n, (i, t) in enumerate(rows)], AWKWARD).repartition(3)
    kept = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert kept.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in kept.collect())


def text(seed, n=40):
    r = random.Random(seed)
    return " ".join(f"{r.choice('abcdefgh')}{r.randint(0, 999)}" for _ in range(n))


def test_near_duplicates_of_awkward_rows(spark, monkeypatch):
    a, b, c, d, e = map(text, range(5))
    near = a + " more"
    rows = [(1, a), (2, a), (2, a), (3, near), (4, b), (4, b), (None, a), (None, c), (None, c), (None, c + " more"), (5, None), (5, None), (6, ""), (7, " "), (None, None), (None, "")]
    rows += [(8, d), (9, d), (9, e), (10, e)]  # the rows of 9 stay, since 10 is like one of them alone
    got = stage_on(spark, monkeypatch, "ngram_jaccard_join", rows)
    one_of_c = {k: n for k, n in got.items() if k[0] is None and k[1] and k[1].startswith(c)}
    assert sum(one_of_c.values()) == 1
    assert got - Counter(one_of_c) == Counter([(1, a), (4, b), (5, None), (6, ""), (7, " "), (None, None), (None, ""), (8, d), (9, d), (9, e)])


def test_decontamination_of_awkward_rows(spark, monkeypatch):
    a, b, c = map(text, range(3))
    items = spark.createDataFrame([(1, c), (1, c), (None, b), (2, None), (3, "")], "item_id long, text string")
    rows = [(1, a), (1, a), (2, f"{a} {c}"), (2, f"{a} {c}"), (3, c.upper()), (None, a), (None, f"x {c} y"), (None, b), (4, None), (5, ""), (None, None), (6, "x " * 50_000), (7, a), (7, c)]
    assert stage_on(spark, monkeypatch, "benchmark_decontamination", rows, benchmark=items) == Counter(
        [(1, a), (1, a), (None, a), (4, None), (5, ""), (None, None), (6, "x " * 50_000)]
    )
    assert stage_on(spark, monkeypatch, "benchmark_decontamination", rows, benchmark=items.limit(0)) == Counter(rows)


def test_quality_of_awkward_rows(spark, monkeypatch):
    r = random.Random(4)
    good = [" ".join(r.choice(["alpha", "beta", "of", "the", "gamma"]) + r.choice("abcdefghij") for _ in range(r.randint(20, 60))) + "." for _ in range(150)]
    bad = [" ".join(r.choice(["x%%%", "y$$$", "z###"]) for _ in range(r.randint(20, 60))) for _ in range(150)]
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 0), (1, None)], "doc_id long, quality int")
    rows = list(enumerate(good + bad)) + [(1, good[1]), (299, bad[149]), (None, good[0]), (None, bad[0]), (None, bad[0])]
    got = stage_on(spark, monkeypatch, "quality_classifier", rows, labels=labels)
    assert sum((got - Counter((i, t) for i, t in rows if t in good)).values()) <= 3 and sum(got.values()) >= 147
    assert got[(None, good[0])] == 1 and (None, bad[0]) not in got and (299, bad[149]) not in got and got[(1, good[1])] == 2


def test_last_stages_of_awkward_rows(spark, monkeypatch):
    rows = [(1, "mail a@b.co now"), (1, "mail a@b.co now"), (None, "a@b.co"), (2, None), (None, None), (3, "")]
    assert stage_on(spark, monkeypatch, "pii", rows) == Counter([(1, "mail <EMAIL> now")] * 2 + [(None, "<EMAIL>"), (2, None), (None, None), (3, "")])
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    pieces = corpus_pipeline.packed(spark, docs, SF).where("start = 0")
    assert Counter(r.doc_id for r in pieces.collect()) == Counter(i for i, _ in rows) and pieces.where("doc_tokens = 1").count() == 3
