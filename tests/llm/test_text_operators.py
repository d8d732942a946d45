"""Every text operator against a brute-force version on a small fixture, and on the awkward rows: nulls, empty and
long texts, ties, repeated rows, empty tables and clashing column names."""

import collections
import hashlib
import math
import random
import time
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallygate.llm import boosting, decontamination, jaccard_join, licences, lm_scoring, packing, pii, quality, quality_rules, queries, shared, substring_dedup, url_filter

AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, n_shingles long, set_id string, token string, h long, word string, line string, failed string, b0 string"


def words(text):
    return (text or "").encode().split()


def low(text):
    return (text or "").encode().lower().split()


def corpus():
    r = random.Random(3)
    made = [" ".join(r.choice(["an", "er", "the", "in", "ing", "on", "re", "tion"]) + r.choice("abcdefgh") + str(r.randint(0, 40)) for _ in range(r.randint(8, 90))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(made)]
    rows += [(100 + i, made[i]) for i in range(6)]  # exact copies
    for i in range(12):  # near copies
        w = made[40].split()
        w[(7 * i) % len(w)] = f"other{i}"
        rows.append((200 + i, " ".join(w)))
    shared_passage = " ".join(f"common{i}" for i in range(30))
    rows += [(300 + i, f"{made[i]} {shared_passage} {made[i + 1]}") for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one"), (405, "one two three"), (406, "Ünï ñandú ß \u00a0 x"), (407, "w " * 30_000), (None, made[3]), (None, None), (408, made[5]), (408, made[5]), (409, "\u2028 a\x1cb \x0b c"), (-5, made[7])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 7, "x", "x", 1, "w", "l", "f", "b") for i, t in corpus()]
    return spark.createDataFrame(rows, AWKWARD).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], AWKWARD)


def same(df, expected):
    got = collections.Counter(tuple(r) for r in df.collect())
    assert got == collections.Counter(expected)


# --- shared -------------------------------------------------------------------------------------------


def test_split_and_drop_by_ids(spark, docs):
    ids = spark.createDataFrame([(200,), (408,), (9999,)], "x long")
    kept = shared.without_ids(docs, ids)
    assert kept.columns == docs.columns
    same(kept.select("doc_id", "text"), [(i, t) for i, t in corpus() if i not in (200, 408)])
    maybe, no = shared.split_by_ids(docs, ids)
    assert maybe.count() + no.count() == docs.count()


def test_components_of_chains_and_stars(spark):
    r = random.Random(1)
    chain = list(range(40))
    r.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(1000, 1000 + i) for i in range(1, 30)] + [(5000, 5000), (7000, 7001), (7001, 7000)]
    got = {x.node: x.root for x in shared.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(40)} == {0} and {got[1000 + i] for i in range(30)} == {1000}
    assert got[7001] == got[7000] == 7000 and 5000 not in got
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ------------------------------------------------------------------------------------------------


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    tokenizer = Tokenizer.from_file(path)
    rows = [r.asDict() for r in packing.pack(docs, path, size=64).collect()]
    expected = collections.Counter()
    for i, t in corpus():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        expected[(i, len(ids))] += 1
    assert collections.Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0) == expected
    one = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in corpus() if i is not None}
    for r in rows:
        if r["doc_id"] is not None:
            part = one[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    fills = []
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        fills.append(at)
        assert at <= 64
    assert sum(f < 64 for f in fills) <= 3  # one a task
    assert packing.pack(none, path).count() == 0
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>  \n<|endoftext|><|endoftext|>é", "<|endoftext| <|ENDOFTEXT|>", "\n\n <|endoftext|>\n\n", " " * 9):
        assert packing.Encoder(path).encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_a_long_document():
    """Windows are views of the document, so that its length costs no square; the rest is a copy that doesn't hold it."""
    n, size = 4_000_003, 2048
    ids, packer, begun = np.arange(n, dtype="<u4").tobytes(), packing.Packer(size), time.monotonic()
    full = list(packer.add(packing.Piece(7, 0, ids, n)))
    assert time.monotonic() - begun < 5
    ((rest,),) = packer.finish()
    pieces = [p for (p,) in full] + [rest]
    assert [p.start for p in pieces] == list(range(0, n, size)) and b"".join(bytes(p.ids) for p in pieces) == ids
    assert isinstance(rest.ids, bytes) and {p.doc_tokens for p in pieces} == {n}


def test_sum_of_squares_choice():
    p = packing.Packer(16)
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 15)
        at = p.level(n)
        cost = {}
        for h in range(17 - n):
            if h == 0 or p.count[h]:
                c = p.count.copy()
                c[h] -= h > 0
                if h + n < 16:
                    c[h + n] += 1
                cost[h] = int((c[1:] ** 2).sum())
        assert cost[at] == min(cost.values()) and at == max(h for h in cost if cost[h] == cost[at])
        list(p.add(packing.Piece(1, 0, bytes(4 * n), n)))


# --- 2 ------------------------------------------------------------------------------------------------


def test_url_rules_and_model(spark):
    listed = url_filter.rules(block=["com/en/", "example.net/de/8", "org/es/"], allow=["example.com/en/7", "net/de/"])
    urls = ["http://www.Example.COM/en/71?x#y", "https://a.com/en/7", "http://example.com/en/", "http://x.net/de/", "http://example.net/de/81", "http://notexample.net/de/81", "http://com/en/1", "http://a.org/ES/1", "nothing", None, "", "http://h", "x://h?q/en/", "a://b://c/d", "http://x.org/es/#/p"]
    r = random.Random(5)
    urls += [f"http://good{r.randint(0, 99)}.net/de/garden/{r.randint(0, 999)}" for _ in range(200)] + [f"http://spam{r.randint(0, 99)}.org/es/casino/{r.randint(0, 999)}" for _ in range(200)]
    urls += [f"http://u{i}.info/garden/{i}" for i in range(20)] + [f"http://u{i}.info/casino/{i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumnRenamed("url", "u").selectExpr("page_id", "u as url", "1 as host", "2 as llr", "3 as cell")
    got = {x.page_id: x for x in url_filter.filter_urls(df, listed).collect()}

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
        return "".join(c.lower() if c.isascii() else c for c in rest[1]), rest[2]

    table = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    for i, u in enumerate(urls):
        host, path = split(u)
        fits = [(h, p) for h, p in table if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (got[i].host, got[i].path) == (host, path), u
        assert got[i].rule == (best and best[0] + best[1]), u
        if best:
            assert got[i].verdict == table[best]
    base = len(urls) - 40
    assert sum(got[base + i].verdict == "allow" for i in range(20)) >= 18
    assert sum(got[base + 20 + i].verdict == "block" for i in range(20)) >= 18
    assert {x.verdict for x in url_filter.filter_urls(df, []).collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), listed).count() == 0


# --- 3 ------------------------------------------------------------------------------------------------

PERSONAL = [
    "write a.b+c@mail0.example.com, or x@y", "a@b.co_x@d.e", "..@x.y@z.w a@@b.c é@b.c", "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 0000.1.1.1 00000000255.1.1.1",
    "card 4111 1111 1111 1111 4111-1111-1111-1112 12 34", "+1 (578) 555-6437 +123 +(12) +12345678901234567890 +1 2 3 4 5 6 7 8 9.", "+" * 50 + "1" * 400, "4" * 500, "a" * 3000 + "@", "ñ+49 30 1234567ñ", "", None,
]


def base(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s, d: 13 <= len(d) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 9 <= len(d) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in tests.items() for m in re.finditer(p, text) if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def test_personal_data(spark, none):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    for r in pii.find_personal_data(df, redacted=True).collect():
        text = PERSONAL[r.doc_id] or ""
        b = base(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in b) for k in pii.KINDS], text
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()
        found = {(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)}
        assert set(b) <= found and len(found) == len(b) + r.n_added
        left = PERSONAL[r.doc_id]
        assert r.redacted is None if left is None else not any(left[a:b] in r.redacted for k, a, b in found if b - a > 8)
    assert pii.find_personal_data(none).count() == 0
    assert pii.redact("x a@b.c y", [("email", 2, 7)]) == "x <EMAIL> y"
    out = pii.redact_documents(df.selectExpr("doc_id", "text", "1 as spans"))
    assert out.columns == ["doc_id", "text", "spans"] and "@mail0" not in out.where("doc_id = 0").first().text


def test_spans_met_are_told_by_one_look_up():
    """As a comparison with every span tells, of spans that overlap, touch and repeat."""
    r = random.Random(3)
    for _ in range(200):
        spans = [(a, a + r.randint(1, 9)) for a in (r.randint(0, 60) for _ in range(r.randint(0, 8)))]
        taken = pii.Taken(spans)
        for _ in range(20):
            a = r.randint(0, 70)
            b = a + r.randint(1, 9)
            assert taken.meets(a, b) == any(x < b and a < y for x, y in spans)
            if not taken.meets(a, b):
                taken.add(a, b)
                spans.append((a, b))


def test_personal_data_of_a_long_list():
    """A hundred thousand addresses in one text, written plainly and out, take seconds."""
    begun = time.monotonic()
    plain = " ".join(f"u{i}@mail{i}.com" for i in range(100_000))
    found, every = pii.all_spans(plain, *pii.trained())
    assert len(found) == len(every) == 100_000
    written = " ".join(f"email u{i} [at] mail{i} [dot] com," for i in range(20_000))
    assert len(pii.all_spans(written, *pii.trained())[1]) == 20_000
    assert time.monotonic() - begun < 60


def test_boosted_candidates():
    trees, thresholds = pii.trained()
    fresh = [*pii.examples(99, 1500), *pii.further_examples(98, 1500)]
    p = trees.probability(np.array([pii.describe(*e[:4]) for e in fresh]))
    passed = np.array([x > thresholds[e[1]] for x, e in zip(p, fresh)])
    y = np.array([e[4] for e in fresh], bool)
    assert passed[y].mean() > 0.9 and passed[~y].mean() < 0.02
    _, spans = pii.all_spans("mail joe [at] foo [dot] com or call (555) 123-4567 now, on 2024-05-06 at 10", trees, thresholds)
    assert [s[0] for s in spans] == ["email", "phone"]
    # Sentences unlike the composed ones.
    told = {
        "Send it (415) 555-0199 today": "(415) 555-0199", "ring me on 020 7946 0958 tonight": "020 7946 0958", "Fax: +44 (0)20 7946 0958": "+44 (0)20 7946 0958",
        "un +1 (826) 555-4081 190.137.223.20": "+1 (826) 555-4081", "Server 2001:db8::ff00:42:8329 answered": "2001:db8::ff00:42:8329", "bob (at) example (dot) org": "bob (at) example (dot) org",
        "card 4111.1111.1111.1111": "4111.1111.1111.1111", "room 12-34 on 5/6": None, "std::map a::b": None, "score 21-19, 21-15": None, "pages 120-125 and 130-140": None,
        "visit us at example.com": None, "isbn 978-3-16-148410-0": None, "in 2019 2020 2021": None, "1 000 000 people": None,
    }
    for text, span in told.items():
        found = {text[a:b] for _, a, b in pii.all_spans(text, trees, thresholds)[1]}
        assert span in found if span else not found, text
    x = np.random.default_rng(0).normal(size=(400, 3))
    t = boosting.fit_trees(x, (x[:, 0] * x[:, 1] > 0).astype(float))
    assert ((t.probability(x) > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9


def test_every_candidate_is_judged(spark):
    every = lambda t: [(k, *m.span()) for k, p in pii._GENERATORS for m in p.finditer(t)]
    forms = ["jean [AT] exemple [DOT] fr", "bob ( at ) example.com", "bob @ example.com", "bob at example.com", "10 [DOT] 0 [DOT] 0 [DOT] 1", "10( . )0( . )0( . )1", "10[.)0[.)0[.)1", "dead:beef:cafe:babe:dead:beef:cafe:babe", "4111/1111/1111/1111", "(555) 123-4567"]
    for form in forms:
        for text in (f"mail {form} now", f"écrire à {form}, né à 中国", f"ÉCRIRE\u00a0{form}\u2028"):
            assert form in [text[a:b] for _, a, b in pii.candidates(text)] and pii.candidates(text) == every(text)
    r = random.Random(6)
    parts = ["at", " AT ", "( at]", "[AT)", "dot", " Dot ", "{ DOT )", " @ ", "@", *"([{)]}", " ", "\u00a0", ".", ". ", ":", "bob", "bob", "joe-1", "é", "\u017f", "\u212a", "-", "x" * 70, "1", "192", "abcd", "\n", "com"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 24))) for _ in range(5000)]
    assert [pii.candidates(t) for t in texts] == [every(t) for t in texts] and sum(map(len, map(every, texts))) > 50
    told = [(0, "Écrire à jean [AT] exemple [DOT] fr, né à Nîmes"), (1, "mail bob ( at ) example.com"), (2, "né; bob @ example.com"), (3, "contact bob at example.com"), (4, "ip ( 10[DOT]0[DOT]0[DOT]1 é"), (5, "né, il arrive at noon. Info"), (6, "visit us at example.com"), (7, "look at pages.\nDes gens")]
    clear = {r.doc_id: r.text for r in pii.redact_documents(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    assert [clear[i] for i in range(5)] == ["Écrire à <EMAIL>, né à Nîmes", "mail <EMAIL>", "né; <EMAIL>", "contact <EMAIL>", "ip ( <IP> é"]
    assert all(clear[i] == dict(told)[i] for i in (5, 6, 7))


# --- 4 ------------------------------------------------------------------------------------------------


def test_quality(spark, docs, none):
    r = random.Random(4)
    good = [" ".join(r.choice(["alpha", "beta", "of", "the", "gamma", "delta"]) + r.choice("abcdefghij") for _ in range(r.randint(20, 60))) + "." for _ in range(150)]
    bad = [" ".join(r.choice(["x%%%", "y$$$", "z###"]) for _ in range(r.randint(20, 60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(1, None), (9999, 1), (None, 0)], "doc_id long, quality int")
    rows = quality.quality_scores(df, labels).collect()
    assert len(rows) == 300
    for x in rows:
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and x.predicted == int(x.score >= 0.7) and 0 <= x.score <= 1
    held = [x for x in rows if x.held_out]
    assert sum(x.predicted == int(x.doc_id < 150) for x in held) >= 0.97 * len(held)
    out = quality.quality_scores(docs, labels.limit(0)).collect()
    assert len(out) == len(corpus()) and {x.score for x in out} == {0.5}
    assert quality.quality_scores(none, labels).count() == 0
    # No label, language or id is an input: labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    assert {x.doc_id: x.score for x in quality.quality_scores(df, flipped).collect()} == pytest.approx({x.doc_id: x.score for x in rows})


def test_discriminant_is_the_density_ratio():
    g = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = [g.normal(size=(500, d)), g.normal(1, 2, size=(400, d))]
    moments = np.stack([np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]) for v in x])
    m = quality.Discriminant.fit(moments, 0.0, 0.0)
    at = g.normal(size=(5, d))
    expected = []
    for v in x:
        c = np.cov(v.T)
        gap = at - v.mean(0)
        expected.append(np.log(len(v) / 900) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(c), gap))
    assert m.log_odds(at) == pytest.approx(expected[1] - expected[0], rel=1e-4)


# --- 5 ------------------------------------------------------------------------------------------------


def test_lm_scores(docs, none, monkeypatch):
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 60)  # so that rare words are met
    rows = lm_scoring.lm_scores(docs).collect()
    counts = collections.Counter()
    for i, t in corpus():
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            counts.update([*low(t), b" "])
    n, v = sum(counts.values()), len(counts)
    expected = collections.Counter()
    for i, t in corpus():
        w = [*low(t), b" "]
        expected[(i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == expected
    trained = [r for r in rows if not r.held_out and r.n_tokens < 1000]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)
    assert lm_scoring.lm_scores(none).count() == 0


def test_lm_learns_what_it_has_not_seen(spark):
    """On documents held out the model beats the counts alone."""
    held = lm_scoring.lm_scores(queries.table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").toPandas()
    assert len(held) > 80 and held.score.sum() > 0.97 * held.base_score.sum() and (held.score > held.base_score).mean() > 0.85


def test_lm_words_beyond_the_table_count_alike(spark, monkeypatch):
    """Scores are the same whether words are looked up in the table or by the join, and long words are words like others."""
    long = ["x" * 90 + str(i) for i in range(6)]
    rows = [(i, " ".join(("red", "sea", long[i % 3], f"n{i % 7}", "calm") if i % 2 else ("der", long[3 + i % 3], "see", f"m{i % 5}", f"u{i}")) * 5) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = lambda d: {r.doc_id: (r.base_score, r.n_known, r.score) for r in lm_scoring.lm_scores(d).collect()}
    whole = scores(df)
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 5)
    joined = scores(df)
    for i, x in whole.items():
        assert joined[i] == pytest.approx(x, rel=1e-3)


def test_lm_trains_until_a_pass_gains_little(spark, monkeypatch):
    steps, step = [], lm_scoring._step
    monkeypatch.setattr(lm_scoring, "_step", lambda *a: steps.append(a) or step(*a))
    df = spark.createDataFrame([(i, " ".join("abcdefg"[(i + j) % 7] * (1 + i % 3) for j in range(40))) for i in range(80)], "doc_id long, text string")
    first = lm_scoring.lm_scores(df).agg(F.sum("score")).first()[0]
    assert len(steps) > 3
    monkeypatch.setattr(lm_scoring, "GAIN", 100.0)
    assert first > lm_scoring.lm_scores(df).agg(F.sum("score")).first()[0]


def test_lm_with_nothing_learnt(spark):
    unseen = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = lm_scoring.lm_scores(spark.createDataFrame([(i, "a b c") for i in unseen], "doc_id long, text string")).collect()
    assert len(rows) == len(unseen) and all(r.train_tokens == 0 and r.base_score == 0 and r.score == pytest.approx(0, abs=1e-5) for r in rows)


def test_lm_is_a_distribution():
    counts = np.array([5, 3, 2])
    v = lm_scoring.Vocabulary({b"a": 0, b"b": 1, b" ": 2}, counts, 14, 6, lm_scoring.word_classes(counts, np.eye(3, lm_scoring.SKETCH)))
    c = v.classes
    assert sorted(c[:3]) == [0, 1, 2] and c[3] == lm_scoring.CLASSES - 1
    mass = np.bincount(c[:3], v.counts, lm_scoring.CLASSES)
    g = np.random.default_rng(0)
    weights, prior = g.normal(size=(lm_scoring.BUCKETS, lm_scoring.CLASSES)).astype(np.float32), np.zeros(lm_scoring.CLASSES, np.float32)
    p = np.exp(lm_scoring._log_softmax(weights, prior, lm_scoring._features(*(np.arange(4) + k for k in range(3)))))
    assert p.sum(1) == pytest.approx(np.ones(4), rel=1e-5)
    for k in range(lm_scoring.CLASSES - 1):
        if mass[k]:
            assert sum(v.counts[i] / mass[k] for i in range(3) if c[i] == k) == pytest.approx(1)
    # The rare class shares its probability among its three known words and one unknown.
    assert sum((x + 0.1) / (4 + 0.1 * 4) for x in (2, 1, 1, 0)) == pytest.approx(1)


# --- 6 ------------------------------------------------------------------------------------------------


def sets_of(rows, k):
    out = []
    for i, t in rows:
        w = low(t)
        out.append((i, frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    return out


def linked_components(rows, k, num, den):
    sets = sets_of(rows, k)
    ids = [i for i, _ in sets]
    root = {n: n for n in range(len(sets))}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for n, i in enumerate(ids):
        if i is not None and sets[n][1]:
            least[find(n)] = min(i, least.get(find(n), i))
    return [(i, len(s), least.get(find(n), i) if s else i) for n, (i, s) in enumerate(sets)]


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 60), (1, 50)])
def test_jaccard_join(docs, k, num):
    same(jaccard_join.jaccard_components(docs, words=k, threshold=(num, 100)), linked_components(corpus(), k, num, 100))


def test_jaccard_chains_and_empty(spark, none):
    # Each is similar to the next alone, so the component comes from the second round.
    rows = [(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 60))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(jaccard_join.jaccard_components(df, words=3, threshold=(85, 100)), linked_components(rows, 3, 85, 100))
    assert jaccard_join.jaccard_components(none).count() == 0


# --- 7 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, docs, none, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    texts = dict(corpus())
    w = texts[11].split()
    gapped = w[:10] + ["gap"] + w[11:]
    items = [(0, " ".join(w[2:8])), (1, " ".join(gapped).upper()), (2, "one"), (3, None), (4, ""), (5, "nowhere to be found at all"), (6, " ".join(f"common{i}" for i in range(30))), (7, "one two three"), (None, " ".join(w[1:9]))]
    df = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for i, x in sets_of(corpus(), 5):
        for j, y in sets_of(items, 5):
            if y and 100 * len(x & y) >= 80 * len(y):
                expected.append((i, j, len(y), len(x & y)))
    same(decontamination.contaminated(docs, df), expected)
    assert len(expected) > 10
    assert decontamination.contaminated(none, df).count() == decontamination.contaminated(docs, df.limit(0)).count() == 0


def test_sketch_never_misses():
    for size in range(1, 200):
        assert decontamination.Index.sketch(size, 80, 100) > size - math.ceil(0.8 * size)


# --- 8 ------------------------------------------------------------------------------------------------


def measures(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum("A" <= c <= "Z" for c in t), len(lines), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, none):
    more = [(900, "a b c d e a b c d e f\na b\na b\n#*$%&|<>"), (901, "A b c d e f g h i j k l"), (902, "X " * 40), (903, "a b c d e b c d e f " * 3)]
    rows = corpus() + more
    df = docs.select("doc_id", "text", "line", "failed").union(spark.createDataFrame([(i, t, "", "") for i, t in more], "doc_id long, text string, line string, failed string"))
    led = quality_rules.ledger(df).cache()
    expected = []
    for i, t in rows:
        m = dict(zip(quality_rules.MEASUREMENTS, (measures(t)[k] for k in (0, 1, 2, 3, 4, 5, 6))))
        bits = sum(1 << k for k, (_, rule) in enumerate(quality_rules.RULES) if eval(rule, {}, m))
        expected.append((i, *m.values(), bits))
    same(led, expected)
    for p in quality_rules.POLICIES:
        mask = quality_rules.mask(p)
        same(quality_rules.apply_policy(led, p).select("doc_id", "kept"), [(e[0], e[-1] & mask == 0) for e in expected])
        got = {r.rule: r for r in quality_rules.ablations(led, p).collect()}
        for k, (rule, _) in enumerate(quality_rules.RULES):
            if rule in quality_rules.POLICIES[p]:
                own = [e[-1] & mask for e in expected]
                assert (got[rule].n_failed, got[rule].n_alone, got[rule].n_kept_without) == (sum(b >> k & 1 for b in own), own.count(1 << k), sum(b & ~(1 << k) == 0 for b in own))
    assert quality_rules.ledger(none).count() == 0


# --- 9 ------------------------------------------------------------------------------------------------


def test_licences(spark, docs, none):
    mit = dict(licences.KNOWN)["MIT"]
    texts = [mit, "Copyright (c) 2020 Someone\n\n" + mit.upper(), mit.replace("sublicense", "sub-license").replace(", ", " ,  "), mit + " more", "   Licenced under the Apache Licence, version 2.0!!", "", None, "\n© me\n", mit[:200]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 as digest", "2 as license_id", "3 as told")
    assert [r.license_id for r in licences.scan_licences(df).orderBy("doc_id").collect()] == ["MIT", "MIT", "MIT", None, "Apache-2.0-notice", None, None, None, None]
    own = spark.createDataFrame([("b", "Some Words"), ("a", "some  words."), ("e", " ")], "license_id string, text string")
    assert [r.license_id for r in licences.scan_licences(df.selectExpr("doc_id", "'some words' as text"), own).collect()] == ["a"] * len(texts)
    assert licences.scan_licences(docs).count() == len(corpus()) and licences.scan_licences(none).count() == 0


def test_shared_folder_is_asked_for():
    from types import SimpleNamespace as Fake

    nothing = Fake(get=lambda key, default: default)
    cluster = Fake(conf=nothing, sparkContext=Fake(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(cluster)


@pytest.mark.parametrize("name", ["op9_licences", "licence_copies"])
def test_licence_queries(spark, name):
    """As SQL tells; of the copies all but the changed ones are found, each as its own."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got = sorted(map(tuple, queries.QUERIES[name](spark, sf).collect()))
    assert got == sorted(con.execute(f"SELECT doc_id, digest, license_id FROM ({queries.ORACLE[name]}) r").fetchall())
    if name == "licence_copies":
        kinds = [k for k, _ in licences.KNOWN]
        assert all(found == (kinds[i % 9] if i % 9 < 7 else None) for i, _, found in got)


def test_licence_files(spark):
    """Whole files, as found and wrapped anew, with headings and holders."""
    wrap = lambda t, n: "\n\n".join(textwrap.fill(" ".join(p.split()), n) for p in t.split("\n\n"))
    known, files = dict(licences.KNOWN), {p.stem: p.read_text() for p in licences.TEXTS.glob("*.txt")}
    cases = [(name, text) for name, text in files.items()]
    cases += [(k, f"{head}{holder}\n\n{wrap(known[k], n)}\n") for n in range(40, 100) for k, head in (("MIT", "The MIT License (MIT)\n\n"), ("ISC", "ISC License\n\n"), ("MIT", "")) for holder in ("Copyright (c) 2020, Jane Doe", "Copyright Jane Doe\nCopyright John Doe", "© 2020 Jane Doe\nAll rights reserved.")]
    body = files["Apache-2.0"][files["Apache-2.0"].index("   TERMS AND") :]
    cases += [("Apache-2.0", wrap(body, n).replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Jane Doe")) for n in range(50, 80, 3)]
    cases += [("Apache-2.0", files["Apache-2.0"].split("END OF TERMS")[0]), ("GPL-2.0", files["GPL-2.0"].replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA"))]
    cases += [("GPL-3.0", files["GPL-3.0"].split("How to Apply")[0]), ("CC0-1.0", files["CC0-1.0"][files["CC0-1.0"].index("Statement of Purpose") :])]
    bsd = files["BSD-3-Clause"].replace("The Regents of the University of California", "2020 Jane Doe").replace("the University", "the copyright holder").replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("REGENTS OR", "COPYRIGHT HOLDER OR")
    cases += [("BSD-3-Clause", f"BSD 3-Clause License\n\n{bsd}"), ("BSD-2-Clause", bsd[: bsd.index("3. Neither")] + bsd[bsd.index("THIS SOFTWARE") :])]
    cases += [(None, files["GPL-3.0"] + " more"), (None, files["MPL-2.0"][:900]), (None, known["ISC"].replace("copyright notice and this permission notice", "")), (None, "The MIT License"), (None, "Copyright Jane Doe")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licences.scan_licences(df).collect()}
    assert {i: (got[i], t[:80]) for i, (k, t) in enumerate(cases) if got[i] != k} == {}


# --- 10 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("length", [13, 5, 1])
def test_substring_dedup(docs, length):
    own = {}
    for i, t in sorted((x for x in corpus() if x[0] is not None), key=lambda x: x[0]):
        w = words(t)
        for j in range(len(w) - length + 1):
            own.setdefault(tuple(w[j : j + length]), i)
    expected = []
    for i, t in corpus():
        w = words(t)
        gone = {j + k for j in range(len(w) - length + 1) for k in range(length) if i is not None and own[tuple(w[j : j + length])] < i}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    same(substring_dedup.remove_repeats(docs, length=length), expected)


def test_doubling_levels(spark, none):
    r = random.Random(8)
    fresh = lambda n: [f"u{r.random()}" for _ in range(n)]
    passage = fresh(60)
    rows = [(1, " ".join(fresh(9) + passage + fresh(5))), (2, " ".join(passage)), (3, " ".join(passage[:14] + fresh(3))), (4, " ".join(fresh(50)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.pos): x.n_words for x in substring_dedup.levels(df, length=13).collect()}
    expected = {}
    for n in (13, 26, 52):
        seen = collections.defaultdict(set)
        for i, t in rows:
            for j in range(len(t.split()) - n + 1):
                seen[tuple(t.split()[j : j + n])].add(i)
        for i, t in rows:
            for j in range(len(t.split()) - n + 1):
                if len(seen[tuple(t.split()[j : j + n])]) > 1:
                    expected[(i, j)] = n
    assert got == expected
    assert substring_dedup.levels(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("given, most", [(None, 4 << 20), ("1g", 4 << 20), ("1m", 1 << 20)])
def test_python_workers_are_handed_short_batches(spark, given, most):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"

    def told(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shared.pack_array(np.array([b.num_rows, b.nbytes]))], pa.binary())], names=["x"])

    usual = spark.conf.get(setting)
    sizes = spark.range(5000, numPartitions=1).selectExpr("id", "repeat('x', 4000) as text").mapInArrow(told, "x binary")
    try:
        if given:
            spark.conf.set(setting, given)
        now = spark.conf.get(setting)
        seen = [np.frombuffer(zlib.decompress(r.x), np.int64) for r in shared.Table(sizes, "sizes").df.collect()]
        folded = shared.fold_arrays(sizes, np.int64, np.maximum, np.zeros(2, np.int64))
        assert spark.conf.get(setting) == now
    finally:
        spark.conf.set(setting, usual)
    assert sum(n for n, _ in seen) == 5000
    assert max(b for _, b in seen) == folded[1] <= most + 10_000
