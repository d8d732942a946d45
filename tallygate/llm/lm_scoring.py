"""Language-model scores: hashed maximum-entropy model with a class-factored softmax.

``P(word | history) = P(class | history) * P(word | class)``. Classes hold words that stand in documents
alike, in one language or of one kind, so that the words before tell the class. It comes from a softmax over
hashed n-gram and skip features of the three words before; words of a class are told apart by their counts.
Weights are trained by gradient passes over all training documents, summed up by Spark, until a pass gains little.
Every word learnt twice or more has its class and its features, whatever its length or rank; words learnt once share
the last class with those never learnt. The most frequent words are looked up in a broadcast table of fixed
size and the others by a join, to the same effect.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table, fold_arrays, lean, pack_array, small, texts

#: Words that are looked up in what is broadcast, 30 MB at any input size: longer ones than WORD_BYTES by a digest.
VOCABULARY, WORD_BYTES = 1 << 18, 64
#: The most frequent words, from which the centres of the classes are found; each word's class is the nearest one.
CENTRED = 1 << 18
#: Hash buckets of the features; classes. Weights take 4 bytes times both.
BUCKETS, CLASSES = 1 << 16, 16
#: Training ends with the pass that finds the training tokens' log10 probability of their classes up by less than this each.
GAIN = 0.01
#: Distinct words a task counts before it hands the counts on; tokens worked on at a time.
COUNTED, BLOCK = 400_000, 16_384
#: The end of a text; no word holds a space.
END = b" "

#: Numbers that sketch a document, summed up for each word; rounds in which words are sorted into classes by them.
SKETCH, ROUNDS = 6, 12
SKETCHES = [f"s{k}" for k in range(SKETCH)]

_FEATURES = 4
_SMOOTH = 0.1
_DOC = "doc_id long, crc long, n_tokens long, known long, base double, model double, codes binary"
_CODED = pa.schema([("uid", pa.int64()), ("k", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("codes", pa.binary())])
#: The class and code of words learnt once or never; what stands before the start of a text.
_ONCE, _START = CLASSES - 1, -1


def _lower(text: bytes) -> list[bytes]:
    return text.lower().split()


def _crc(doc_id: int | None) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode())


def _key(word: bytes) -> bytes:
    """The word itself, or 128 bits of a long one after a space, which no word holds."""
    return word if len(word) <= WORD_BYTES else b" " + xxhash.xxh3_128_digest(word)


class _Tally(dict):
    """word -> row of the sums: its count and the sums of the sketches of the documents that it stands in."""

    def __init__(self):
        super().__init__()
        self.sums = np.zeros((1 + SKETCH, 1 << 12), np.int64)
        self.signs = np.zeros((SKETCH, 1 << 12), np.float32)
        self.fresh: list[int] = []

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        self.fresh.append(xxhash.xxh64_intdigest(word))
        return at

    def add(self, texts_: list[list[bytes]]) -> None:
        """Add documents. A document's sketch is the mean of random signs of its words, so that those of one language or kind are alike."""
        flat = [w for t in texts_ for w in t]
        known = len(self)
        rows = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        n = len(self)
        while self.sums.shape[1] < n:
            self.sums, self.signs = (np.concatenate([x, np.zeros_like(x)], 1) for x in (self.sums, self.signs))
        fresh = np.array(self.fresh, np.uint64)
        self.fresh.clear()
        sizes = np.array([len(t) for t in texts_])
        starts = np.cumsum(sizes) - sizes
        self.sums[0, :n] += np.bincount(rows, minlength=n)
        for k in range(SKETCH):
            self.signs[k, known:n] = np.where(fresh >> np.uint64(7 * k + 3) & np.uint64(1), 1.0, -1.0)
            mean = np.add.reduceat(self.signs[k][rows], starts) / sizes
            self.sums[1 + k, :n] += np.bincount(rows, np.repeat(np.rint(64 * mean), sizes), n).astype(np.int64)

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array([*map(_key, self)], pa.binary()), *(pa.array(self.sums[k, : len(self)]) for k in range(1 + SKETCH))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "c", *SKETCHES])


def _count(batches: Iterator[pa.RecordBatch], hold_out: int) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in small(batches):
        both = zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True)
        if learnt := [[*_lower(text), END] for doc_id, text in both if _learnt(_crc(doc_id), hold_out)]:
            tally.add(learnt)
        if len(tally) > COUNTED:
            yield tally.batch()
            tally = _Tally()
    if tally:
        yield tally.batch()


def _learnt(crc: int | None, hold_out: int) -> bool:
    return crc is not None and crc % hold_out != 0


@dataclass
class Vocabulary:
    words: dict[bytes, int]
    counts: np.ndarray  # by id
    total: int  # N
    distinct: int  # V
    classes: np.ndarray  # by id; the last two are those of words beyond and of the start


def class_centres(counts: np.ndarray, sketches: np.ndarray) -> tuple[float, np.ndarray]:
    """(scale, centres) of the classes of words that stand in documents of like sketches: started far apart, moved to their words' means.

    Words count by their logarithm.
    """
    x, weight = sketches / np.maximum(1, counts)[:, None], np.log1p(counts)
    groups = min(CLASSES - 1, len(x))
    if not groups:
        return 1.0, np.zeros((1, sketches.shape[1]))
    scale = max(1e-9, float(x.std()))
    x = x / scale
    centres = x[[int(np.argmax(weight))]]
    while len(centres) < groups:
        gap = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres = np.concatenate([centres, x[[int(np.argmax(gap * weight))]]])
    for _ in range(ROUNDS):
        label = np.argmin([((x - c) ** 2).sum(1) for c in centres], 0)
        mass = np.maximum(1e-9, np.bincount(label, weight, groups))
        centres = np.stack([np.bincount(label, weight * x[:, k], groups) / mass for k in range(x.shape[1])], 1)
    return scale, centres


def _nearest(counts: np.ndarray, sketches: np.ndarray, scale: float, centres: np.ndarray) -> np.ndarray:
    x = sketches / np.maximum(1, counts)[:, None] / scale
    return np.argmin([((x - c) ** 2).sum(1) for c in centres], 0)


def word_classes(counts: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """The classes of words by the centres found from them. Two ids are added: of words beyond, in the last class, and of the start."""
    return np.append(_nearest(counts, sketches, *class_centres(counts, sketches)), [_ONCE, 0])


def _codes(words: list[bytes], counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A word's code is a hash of it and its class, :data:`_ONCE` for words learnt once."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(2**31 // CLASSES - 1)
    return np.where(counts > 1, (1 + hashes.astype(np.int64)) * CLASSES + classes, _ONCE)


def _classed(batches: Iterator[pa.RecordBatch], scale: float, centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, BLOCK):
        c, words = batch.column("c"), batch.column("word")
        n, x = c.to_numpy(), np.stack([batch.column(k).to_numpy().astype(float) for k in SKETCHES], 1)
        yield pa.RecordBatch.from_arrays([words, c, pa.array(_codes(words.to_pylist(), n, _nearest(n, x, scale, centres)).astype(np.int32))], names=["word", "c", "code"])


def _code(batches: Iterator[pa.RecordBatch], tables) -> Iterator[pa.RecordBatch]:
    """Documents as codes, with the sums of their tokens that are in the tables; the others are numbered below zero and further rows (uid, k, word, times)."""
    known, codes, base, model = tables.value
    uid = TaskContext.get().partitionId() << 40
    for batch in small(batches):
        docs, rest = [], [[], [], [], []]
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            words = [*_lower(text), END]
            ids = np.array([known.get(w, -1) for w in words], np.int64)
            others: dict[bytes, int] = {}
            for i in np.flatnonzero(ids < 0).tolist():
                w = _key(words[i])
                n = known.get(w)
                ids[i] = -1 - others.setdefault(w, len(others)) if n is None else n
            found = ids >= 0
            at = ids[found]
            coded = ids.astype(np.int32)
            coded[found] = codes[at]
            docs.append((uid, doc_id, _crc(doc_id), len(words), len(at), base[at].sum(), model[at].sum(), coded.tobytes()))
            for column, values in zip(rest, ([uid] * len(others), others.values(), others, np.bincount(-1 - ids[~found]).tolist()), strict=True):
                column.extend(values)
            uid += 1
        columns = [pa.array(c, t) for c, t in zip(zip(*docs, strict=True), _CODED.types[:1] + _CODED.types[4:], strict=True)]
        yield pa.RecordBatch.from_arrays([columns[0], *(pa.nulls(len(docs), t) for t in _CODED.types[1:4]), *columns[1:]], schema=_CODED)
        if rest[0]:
            columns = [pa.array(c, t) for c, t in zip(rest, _CODED.types, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(rest[0]), t) for t in _CODED.types[4:])], schema=_CODED)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the codes of all their tokens."""
    for batch in small(batches):
        found, names = batch.column("found"), batch.schema.names[:-1]
        codes = []
        for x, other in zip(batch.column("codes").to_pylist(), found, strict=True):
            if other.is_valid:
                x = np.frombuffer(x, np.int32)
                x = np.where(x < 0, other.values.to_numpy()[np.minimum(x, -1) * -1 - 1], x).astype(np.int32).tobytes()
            codes.append(x)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(codes, pa.binary())], names=names)


def _blocks(codes: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, class, features) of the tokens of a batch, in blocks."""
    pad = np.full(3, _START, np.int64)
    part, docs, size = [], [], 0

    def block():
        flat = np.concatenate(part)
        doc = np.repeat(docs, [len(p) for p in part])
        for lo in range(3, len(flat), BLOCK):
            t = np.arange(lo, min(len(flat), lo + BLOCK))
            t = t[flat[t] != _START]
            yield doc[t], flat[t] % CLASSES, _features(flat[t - 1], flat[t - 2], flat[t - 3])

    for i, raw in enumerate(codes):
        x = np.frombuffer(raw, np.int32)
        part += [pad, x.astype(np.int64)]
        docs += [i, i]
        size += len(x)
        if size >= BLOCK:
            yield from block()
            part, docs, size = [], [], 0
    if part:
        yield from block()


def _features(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Buckets of the word before, the two before, and of those one and two words further back."""
    m = BUCKETS - 1
    mix = lambda x, k: ((x * k + (k >> 7)) >> 11) & m
    return np.stack([mix(a, 2654435761), mix(a * 1_000_003 + b, 2246822519), mix(b, 3266489917), mix(c, 668265263)])


def _log_softmax(weights: np.ndarray, prior: np.ndarray, features: np.ndarray) -> np.ndarray:
    z = np.take(weights, features[0], axis=0)
    for f in features[1:]:
        z += np.take(weights, f, axis=0)
    z += prior
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the classes for each feature bucket."""
    seen = np.zeros(BUCKETS * CLASSES)
    for batch in small(batches):
        for _, c, features in _blocks(batch.column("codes").to_pylist()):
            for f in features:
                np.add.at(seen, f * CLASSES + c, 1.0)
    yield _packed(seen)


def _expected(batches: Iterator[pa.RecordBatch], weights, prior: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Expected counts of the classes for each feature bucket; then, as one more number, the log10 probability of the classes."""
    sums, half = np.zeros(BUCKETS * CLASSES + 1), np.arange(CLASSES // 2)
    for batch in small(batches):
        part = np.zeros(BUCKETS * CLASSES // 2, np.complex64)  # two classes are one addition
        for _, c, features in _blocks(batch.column("codes").to_pylist()):
            log_p = _log_softmax(weights.value, prior, features)
            sums[-1] += log_p[np.arange(len(c)), c].sum(dtype=float) / math.log(10)
            p = np.exp(log_p).view(np.complex64).ravel()
            for f in features:
                np.add.at(part, (f[:, None] * (CLASSES // 2) + half).ravel(), p)
        sums[:-1] += part.view(np.float32)
    yield _packed(sums)


def _packed(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pack_array(sums.astype(np.float32))], pa.binary())], names=["sums"])


def _score(batches: Iterator[pa.RecordBatch], weights, prior: np.ndarray) -> Iterator[pa.RecordBatch]:
    """log10 of the probabilities of the classes are added to those of the words in them."""
    names = [c.split()[0] for c in _DOC.split(", ")][:-2]
    for batch in small(batches):
        model = batch.column("model").to_numpy().copy()
        for doc, c, features in _blocks(batch.column("codes").to_pylist()):
            log_p = _log_softmax(weights.value, prior, features)[np.arange(len(c)), c] / math.log(10)
            model += np.bincount(doc, log_p, len(model))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(model)], names=[*names, "model"])


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hold_out: int = 10, smooth: float = 50.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Tokens are the ASCII-lower-cased words and one end. Rows whose crc32(doc_id as text) is divisible by
    ``hold_out`` are scored only; the others are learnt from too. base_score is the log10 probability by
    counts alone, with 0.1 added for each known token and for one unknown; score is the model's, which
    shares it out over the same tokens. ``smooth`` is the weight of the classes' overall shares in a bucket.

    A null or empty text is the end alone. A null id is kept and scored, neither learnt from nor held
    out. Repeated rows are learnt from and scored each for itself. With nothing to learn from, N is 0
    and both scores are 0. An empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = lean(docs, id_col, text_col)
    found = docs.mapInArrow(lambda it: _count(it, hold_out), "word binary, c long, " + ", ".join(f"{k} long" for k in SKETCHES))
    counts = Table(found.groupBy("word").agg(*(F.sum(k).alias(k) for k in ("c", *SKETCHES))), "counts")
    frequent = counts.df.orderBy(F.desc("c"), "word").limit(max(VOCABULARY, CENTRED)).toArrow()
    words = frequent.column("word").to_pylist()
    tally = frequent.column("c").to_numpy().astype(np.int64)
    sketches = np.stack([frequent.column(k).to_numpy().astype(float) for k in SKETCHES], 1)
    centred = class_centres(tally[:CENTRED], sketches[:CENTRED])
    words, tally, sketches = words[:VOCABULARY], tally[:VOCABULARY], sketches[:VOCABULARY]
    codes = _codes(words, tally, _nearest(tally, sketches, *centred)).astype(np.int32)
    classed = Table(counts.df.mapInArrow(lambda it: _classed(it, *centred), "word binary, c long, code int"), "classed")
    counts.drop()

    of_class = classed.df.groupBy(F.col("code") % CLASSES).agg(F.sum("c"), F.count("*")).collect()
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, c, n in of_class:
        mass[k], kinds[k] = c, n
    total, distinct = int(mass.sum()), int(kinds.sum())
    held = np.where(np.append(mass[:_ONCE] > 0, True), mass + _SMOOTH, 1e-30)  # a class without words has no share
    prior = np.log(held / held.sum()).astype(np.float32)
    floor = _SMOOTH * (distinct + 1)
    # In the last class its words and one unknown share the probability; in the others each word has its share of the counts.
    once = mass[_ONCE] + _SMOOTH * (kinds[_ONCE] + 1)
    within = np.where(codes == _ONCE, (tally + _SMOOTH) / once, tally / np.maximum(1, mass[codes % CLASSES]))
    tables = spark.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, codes, np.log10((tally + _SMOOTH) / (total + floor)), np.log10(within)))
    coded = Table(docs.mapInArrow(lambda it: _code(it, tables), f"uid long, k long, word binary, times long, {_DOC}"), "coded")
    tables.destroy()

    # The other words: each one's count and code from the whole corpus.
    c, code = F.coalesce("c", F.lit(0)), F.coalesce("code", F.lit(_ONCE))
    share = lambda k: F.element_at(F.lit(np.maximum(1, mass).tolist()), k % CLASSES + 1)
    rest = coded.df.where("word is not null").select("uid", "k", "word", "times").join(classed.df, "word", "left").select("uid", "k", "times", c.alias("c"), code.alias("code"))
    rest = rest.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("c") + _SMOOTH) / (total + floor))).alias("more_base"),
        F.sum(F.col("times") * F.log10(F.when(F.col("code") == _ONCE, (F.col("c") + _SMOOTH) / once).otherwise(F.col("c") / share(F.col("code"))))).alias("more_model"),
        F.transform(F.sort_array(F.collect_list(F.struct("k", "code"))), lambda x: x["code"]).alias("found"),
    )
    add = lambda c: (F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c)
    whole = coded.df.where("word is null").drop("k", "word", "times").join(rest, "uid", "left").select("doc_id", "crc", "n_tokens", add("known"), add("base"), add("model"), "codes", "found")
    text = Table(whole.mapInArrow(_whole, _DOC), "text")
    coded.drop()
    classed.drop()

    # Each task hands on sums of one size, so their number is that of the cores, not of the input's blocks.
    learnt = text.df.where(F.col("crc") % hold_out != 0).select("codes").coalesce(4 * spark.sparkContext.defaultParallelism)
    size = BUCKETS * CLASSES
    fold = lambda f, n: fold_arrays(learnt.mapInArrow(f, "sums binary"), np.float32, np.add, np.zeros(n, np.float32))
    seen = fold(_observed, size).reshape(BUCKETS, CLASSES).astype(np.float64)
    share_of = smooth * np.exp(prior)
    # At weights of zero every history expects the overall shares.
    weights = _step(seen, seen.sum(1, keepdims=True) * np.exp(prior), share_of).astype(np.float32)
    reached, gain = -math.inf, math.inf
    while gain >= GAIN:
        sent = spark.sparkContext.broadcast(weights)
        sums = fold(lambda it, sent=sent: _expected(it, sent, prior), size + 1)
        now = float(sums[-1]) / max(1, total)
        reached, gain = now, now - reached
        weights = weights + _step(seen, sums[:-1].reshape(BUCKETS, CLASSES).astype(np.float64), share_of).astype(np.float32)
        sent.destroy()

    model = spark.sparkContext.broadcast(weights)
    scored = Table(text.df.mapInArrow(lambda it: _score(it, model, prior), _DOC.rsplit(", ", 1)[0]), "scored")
    text.drop()
    return scored.df.select(
        "doc_id",
        F.coalesce(F.col("crc") % hold_out == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        F.col("model").alias("score"),
    )


def _step(seen: np.ndarray, expected: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Along the gradient, seen less expected, scaled for each weight by its curvature; the features share it."""
    return np.clip((seen - expected) / (expected + share), -0.95, 4.0) * (2 / _FEATURES)
