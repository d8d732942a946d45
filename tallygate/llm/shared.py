"""What the text operators share: words, hashes, tables in the shared folder, folds and components.

Words are runs of bytes other than ASCII white space; ``bytes.split()`` yields exactly these.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Distinct words that a Python worker remembers the hashes of before it starts afresh.
WORD_CACHE = 300_000
#: Buckets for :func:`split_by_ids`: what is broadcast has this many rows of one long at most.
ID_BUCKETS = 1 << 20
#: While a table is written, its shuffle files go as soon as it is there.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that a Python worker is handed at a time, up to one row more. An executor and its workers keep
#: most of the memory that batches once took, so long texts and sets must not add up in one.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


class WordHash(dict):
    """word -> 64-bit hash, bounded: it forgets everything once full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word windows, in order; none if there are fewer words."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = hashes[:m] * _M1
    for j in range(1, k):
        h = (h ^ (h >> _S29)) * _M2 + hashes[j : j + m]
    h = (h ^ (h >> _S32)) * _M1
    return h ^ (h >> _S29)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles; the whole sequence is the one shingle of a shorter text."""
    return np.unique(shingles(hashes, min(k, len(hashes)))) if len(hashes) else np.empty(0, np.uint64)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of an Arrow batch as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.large_binary()).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what a task makes of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def lean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only doc_id (long) and text (string), so that further columns and their names play no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile hands Python workers batches of :data:`BATCH_BYTES`; a lower setting of the session's holds."""
    before = spark.conf.get(_BATCH)
    given = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if given > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


# --- tables in the shared folder -------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which every executor sees; one of our own only where none is set and the master is local."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("executors need a shared folder: set spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallygate-"))
        path = sc.getCheckpointDir()
    return path


class Table:
    """A table written as Parquet in the shared folder: it cuts lineage and survives lost executors.

    ``drop()`` removes what nothing reads any more; tables that a result still reads stay in the
    folder, as checkpoints do.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tables/{name}-{uuid.uuid4().hex}"
        self.schema = df.schema
        before = self.spark.conf.get(_CLEAN)
        self.spark.conf.set(_CLEAN, "true")
        try:
            with short_batches(self.spark):
                df.write.parquet(self.path)
        finally:
            self.spark.conf.set(_CLEAN, before)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# --- folds ------------------------------------------------------------------------------------


def pack_array(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def fold_arrays(df: DataFrame, dtype, add: Callable, zero: np.ndarray) -> np.ndarray:
    """Fold the arrays of a one-column table of :func:`pack_array` values, in a tree over the tasks.

    All arrays have the fixed length of ``zero``, so what reaches the driver doesn't grow.
    """
    with short_batches(df.sparkSession):
        rows = df.rdd  # planned here
    parts = rows.map(lambda r: np.frombuffer(zlib.decompress(r[0]), dtype)).mapPartitions(lambda it: _fold(it, add))
    depth = 1
    while parts.getNumPartitions() > 16**depth:
        depth += 1
    both = lambda a, b: b if a is None else a if b is None else add(a, b)
    total = parts.treeAggregate(None, both, both, depth + 1)
    return zero if total is None else add(zero, total)


def _fold(it: Iterator[np.ndarray], add: Callable) -> Iterator[np.ndarray]:
    total = next(it, None)
    if total is None:
        return
    for x in it:
        total = add(total, x)
    yield total


# --- ids and components -----------------------------------------------------------------------


def split_by_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows that may have one of the ids, rows that have none of them), without a shuffle of ``docs``.

    The ids are hashed to :data:`ID_BUCKETS` buckets and only the buckets in use are broadcast, so the
    size broadcast has a fixed bound. The caller joins the first part exactly; long texts that need
    no partner are not shuffled.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(ID_BUCKETS))
    used = F.broadcast(ids.select(bucket(F.col(ids.columns[0])).alias("__bucket")).distinct())
    on = bucket(docs[id_col]) == used["__bucket"]
    return docs.join(used, on, "left_semi"), docs.join(used, on, "left_anti")


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not among ``ids`` (one column); all columns as they were."""
    gone = ids.select(F.col(ids.columns[0]).cast("long").alias("__gone"))
    maybe, no = split_by_ids(docs, gone, id_col)
    return no.unionByName(maybe.join(gone, maybe[id_col].cast("long") == gone["__gone"], "left_anti"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node it is connected with.

    Alternating large-star and small-star steps: every step writes its links, now closer to stars,
    to the shared folder, until they no longer change. No list of neighbours is ever gathered; a
    node of very many links takes part through a minimum (summed before the shuffle) and a join that
    adaptive execution may split.
    """
    edges = Table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.df.union(edges.df.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = Table(large, "large")
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        told = Observation()
        small = Table(small.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
        large.drop()
        edges.drop()
        edges, same, before = small, before == told.get, told.get
        if same:
            stars = edges.df
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
