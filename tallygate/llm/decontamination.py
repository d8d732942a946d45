"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Each benchmark item is a set of word shingles. Items fall into partitions by size (powers of two); in
each an item is sketched by its least hashes, so many of them that a document holding the asked share
of the item's shingles must hold one of the sketch. So short items are found in documents of any
length, and none is missed. Each find is verified by the shingles themselves.

Items are the query set: they are collected in blocks of a fixed number of bytes, and each block is
searched for in all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHash, lean, shingle_set, small, texts

#: Bytes of item texts that are broadcast at a time. More items make more blocks, each one more pass.
BLOCK_BYTES = 16 << 20
_BITS = 1 << 22

_PAIRS = "doc_id long, item_id long, n_item_shingles long, n_shared long"


def word_shingles(words: list[bytes], k: int) -> set[bytes]:
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


class Index:
    """Sketches of a block of items, by size partition, and their shingles."""

    def __init__(self, items: list[tuple[int, bytes]], k: int, num: int, den: int):
        cache = WordHash()
        self.shingles: list[tuple[int, set[bytes]]] = []
        self.holders: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            words = text.lower().split()
            s = word_shingles(words, k)
            if not s:
                continue
            hashes = shingle_set(cache.array(words), k)
            self.shingles.append((item_id, s))
            top = (1 << len(s).bit_length()) - 1  # the largest size of the partition
            for h in hashes[: self.sketch(top, num, den)].tolist():
                self.holders[h].append(len(self.shingles) - 1)
        keys = np.array(sorted(self.holders), np.uint64)
        self.bits = np.zeros(_BITS, bool)
        self.bits[(keys & np.uint64(_BITS - 1)).astype(np.int64)] = True

    @staticmethod
    def sketch(size: int, num: int, den: int) -> int:
        """So many of a set's shingles that one is left when all but num/den of them are missing."""
        return size + num * size // -den + 1

    def candidates(self, hashes: np.ndarray) -> set[int]:
        hits = hashes[self.bits[(hashes & np.uint64(_BITS - 1)).astype(np.int64)]]
        return {i for h in hits.tolist() if h in self.holders for i in self.holders[h]}


def _search(batches: Iterator[pa.RecordBatch], index, k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    cache, at = WordHash(), index.value
    for batch in small(batches):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            words = text.lower().split()
            found = at.candidates(shingle_set(cache.array(words), k))
            if not found:
                continue
            own = word_shingles(words, k)
            for i in sorted(found):
                item_id, s = at.shingles[i]
                both = len(s & own)
                if den * both >= num * len(s):
                    rows.append((doc_id, item_id, len(s), both))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "n_item_shingles", "n_shared"])


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared) where a document holds at least the share ``threshold``
    (num, den) of a benchmark item's distinct shingles of ``words`` ASCII-lower-cased words.

    A text of fewer words has its whole sequence as its one shingle, so such an item is found only in
    documents with the same few words. Null and empty texts, on either side, match nothing. Null ids stay
    null. Repeated rows give repeated pairs; an empty table on either side none; other columns are ignored.
    """
    num, den = threshold
    spark = docs.sparkSession
    docs = lean(docs, id_col, text_col)
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        index = spark.sparkContext.broadcast(Index(list(zip(block.column("item_id").to_pylist(), texts(block), strict=True)), words, num, den))
        hits = docs.mapInArrow(lambda it, index=index: _search(it, index, words, num, den), _PAIRS)
        out = hits if out is None else out.union(hits)
    return spark.createDataFrame([], _PAIRS) if out is None else out
