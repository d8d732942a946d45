"""Substring deduplication by level-wise doubling: word windows repeated at one length alone go on.

The first level looks at short windows, half the length asked for. Of these only one in each stretch
is looked up: the window of least hash within every window of the full length. Equal full windows
choose equal short ones, so none is missed. Windows of twice that length (at most the full length)
are then formed only around short ones that occur in two documents or more, and so on from the full
length upwards until no window survives (:func:`levels`), or until the full length
(:func:`remove_repeats`), which decides what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table, WordHash, fold_arrays, lean, pack_array, shingles, small, split_by_ids, texts

#: Bits of the table of short windows seen in two documents or more: 8 MB at any input size. Where it
#: fills up, it lets more windows through to the exact second level; results don't change.
SEED_BITS = 1 << 26


def _least(seeds: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` seeds, the least."""
    out = seeds[: len(seeds) - width + 1].copy()
    for j in range(1, width):
        np.minimum(out, seeds[j : j + len(out)], out)
    return out


def _pairs(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), [len(p) for p in parts]))], names=["h", "doc_id"])


def _windows(batches: Iterator[pa.RecordBatch], length: int, seed: int, repeated) -> Iterator[pa.RecordBatch]:
    """Seeds of the documents, or with ``repeated`` given, the full windows whose seed is marked there."""
    cache = WordHash()
    for batch in small(batches):
        ids, parts = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            words = text.split()
            if doc_id is None or len(words) < length:
                continue
            w = cache.array(words)
            least = _least(shingles(w, seed), length - seed + 1)
            if repeated is None:
                h = np.unique(least)
            else:
                hit = _marked(repeated.value, least)
                if not hit.any():
                    continue
                h = np.unique(shingles(w, length)[hit])
            ids.append(doc_id)
            parts.append(h)
        if ids:
            yield _pairs(ids, parts)


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    k = (h & np.uint64(SEED_BITS - 1)).astype(np.int64)
    return (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(SEED_BITS // 8, np.uint8)
    for batch in batches:
        k = (batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(SEED_BITS - 1)).astype(np.int64)
        np.bitwise_or.at(bits, k >> 3, np.left_shift(1, k & 7).astype(np.uint8))
    if bits.any():
        yield pa.RecordBatch.from_arrays([pa.array([pack_array(bits)], pa.binary())], names=["bits"])


def _strip(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Drop the words covered by the windows listed in ``gone``."""
    cache = WordHash()
    for batch in small(batches):
        n, removed, kept = [], [], []
        lists = batch.column("gone").to_pylist() if "gone" in batch.schema.names else [None] * batch.num_rows
        for text, gone in zip(texts(batch), lists, strict=True):
            words = text.split()
            n.append(len(words))
            if gone:
                h = shingles(cache.array(words), length)
                drop = np.zeros(len(words) + 1, np.int64)
                at = np.flatnonzero(np.isin(h, np.array(gone, np.int64).view(np.uint64)))
                np.add.at(drop, at, 1)
                np.add.at(drop, at + length, -1)
                keep = np.cumsum(drop[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            removed.append(n[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def repeated_windows(docs: DataFrame, length: int) -> Table:
    """(h, doc_id, first_doc): each document's windows of ``length`` words that a smaller doc_id has too."""
    seed = max(1, (length + 1) // 2)
    spark = docs.sparkSession
    seeds = docs.mapInArrow(lambda it: _windows(it, length, seed, None), "h long, doc_id long")
    seeds = Table(seeds.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"), "seeds")
    bits = fold_arrays(seeds.df.mapInArrow(_mark, "bits binary"), np.uint8, np.bitwise_or, np.zeros(SEED_BITS // 8, np.uint8))
    seeds.drop()
    marked = spark.sparkContext.broadcast(bits)
    windows = Table(docs.mapInArrow(lambda it: _windows(it, length, seed, marked), "h long, doc_id long"), "windows")
    first = windows.df.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("hi")).where("first_doc < hi").select("h", "first_doc")
    found = Table(windows.df.join(first, "h").where("first_doc < doc_id"), "repeats")
    windows.drop()
    return found


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row of ``docs``.

    Removed is each word covered by a window of ``length`` words that also starts in a document of
    smaller doc_id; windows are judged on the texts as given. Words keep their case; kept_text joins
    the kept ones by one space, kept_sha256 is the digest of its UTF-8.

    A null or empty text has no words and keeps the empty string. A text shorter than ``length`` loses
    nothing. A null id is kept and loses nothing. Repeated rows of one id lose the same, and nothing
    to one another. An empty table gives none. Other columns are ignored.
    """
    docs = lean(docs, id_col, text_col)
    found = repeated_windows(docs, length)
    gone = Table(found.df.groupBy("doc_id").agg(F.collect_list("h").alias("gone")), "gone")
    found.drop()
    maybe, no = split_by_ids(docs, gone.df.select("doc_id"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    lost = maybe.join(gone.df, "doc_id", "left").mapInArrow(lambda it: _strip(it, length), schema)
    return no.mapInArrow(lambda it: _strip(it, length), schema).union(lost)


def _positions(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    cache = WordHash()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            h = shingles(cache.array(text.split()), length)
            if doc_id is not None and len(h):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), doc_id)), pa.array(np.arange(len(h))), pa.array(h.view(np.int64))], names=["doc_id", "pos", "h"])


def levels(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """(doc_id, pos, n_words): for each position where a window of ``length`` words starts that another
    document has too, the longest of the lengths ``length``, twice that, ... at which this still holds.

    Each level joins two adjacent survivors of the one before into one window of twice the length and
    keeps those that occur in two documents; it ends with the level that has no survivor. Null ids and
    texts take no part; an empty table gives none.
    """
    docs = lean(docs, id_col, text_col)
    found = repeated_windows(docs, length)
    ids = found.df.select("doc_id").union(found.df.select("first_doc")).distinct()
    at = split_by_ids(docs, ids)[0].join(ids, "doc_id", "left_semi").mapInArrow(lambda it: _positions(it, length), "doc_id long, pos long, h long")
    level, out, n = Table(_survivors(at), "level"), None, length
    found.drop()
    while not level.df.isEmpty():
        step = level.df.select("doc_id", "pos", F.lit(n).cast("long").alias("n_words"))
        out = step if out is None else out.union(step)
        right = level.df.select("doc_id", (F.col("pos") - n).alias("pos"), F.col("h").alias("g"))
        level, n = Table(_survivors(level.df.join(right, ["doc_id", "pos"]).select("doc_id", "pos", F.xxhash64("h", "g").alias("h"))), "level"), 2 * n
    if out is None:
        return level.df.select("doc_id", "pos", F.lit(0).cast("long").alias("n_words"))
    return out.groupBy("doc_id", "pos").agg(F.max("n_words").alias("n_words"))


def _survivors(windows: DataFrame) -> DataFrame:
    again = windows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
    return windows.join(again, "h", "left_semi")
