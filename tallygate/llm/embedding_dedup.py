"""Embedding near-duplicates: sorted projection passes, windows of neighbours, components, links counted.

Equal vectors are one class. In each pass the classes are sorted by concatenated random hashes; a hash is the number of
the coordinate that is largest in amount after a random rotation, with its sign, so vectors at a small angle often have it in
common. Each vector is compared with the next ``window`` ones by its cosine in double precision, and pairs that reach the
threshold join a component. The number of passes grows with the table so that a pair at the threshold meets with the
probability ``recall``; closer pairs meet oftener. A window ends where its task does, and every pass cuts elsewhere.

A bounded window doesn't see all of a large group. So within each component every pair is compared, in tiles of TILE x TILE
vectors that are tasks' work of their own, and only counts leave a tile, no pairs. n_links thus lacks no link inside a
component; a pair is lost only if no pass brought its two components together. The work on a component grows with the
square of its distinct vectors, as the number of its links does.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of different
lengths link with none of the other length. Rows are counted singly: equal vectors link with each other, also under one
vec_id. Null ids are never a component's least id unless it has no other. Further columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Table, components, partitions

#: Vectors on a side of a tile, passes whose vectors are shuffled at a time, rows of a task in a pass at most.
TILE, AT_ONCE, TASK_ROWS = 1024, 4, 32_768
_SEED = 11


def _rotation(dim: int, *number: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dim, *number]).standard_normal((dim, dim))


def hashes(v: np.ndarray, *number: int) -> np.ndarray:
    """A hash from 0 to 2 * dimension - 1 for each row; ``number`` tells which of the hashes."""
    turned = v @ _rotation(v.shape[1], *number)
    most = np.abs(turned).argmax(1)
    return 2 * most + (turned[np.arange(len(v)), most] < 0)


def meeting(dim: int, cosine: float, pairs: int = 2000, draws: int = 4) -> float:
    """The share of random pairs of that cosine with a hash in common, by simulation."""
    g = np.random.default_rng([_SEED, dim])
    x, y = unit(g.standard_normal((pairs, dim))), g.standard_normal((pairs, dim))
    if dim == 1:
        return 1.0
    y = unit(y - (y * x).sum(1)[:, None] * x)
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * y
    return float(np.mean([(hashes(x, 1 << 20, d) == hashes(y, 1 << 20, d)).mean() for d in range(draws)]))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def plan(n: int, dim: int, window: int, cosine: float, recall: float) -> tuple[int, int]:
    """(hashes in a key, passes) for n vectors: so many hashes that neighbours beyond them fill windows."""
    deep = max(0.0, math.log(max(n, 2) / window) / math.log(2 * dim))
    codes = min(math.ceil(deep) + 1, 62 // (2 * dim - 1).bit_length())
    p = meeting(dim, cosine) ** deep
    return codes, 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the least one that the pairs (i, j) connect it with."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        if (root[i] == least).all() and (root[j] == least).all():
            return root
        for side in (i, j):
            np.minimum.at(root, root[side], least)
            np.minimum.at(root, side, least)
        while (root[root] != root).any():
            root = root[root]


def _windows(window: int, cosine: float, kind: str) -> Callable:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, v = np.empty(0, np.int64), np.empty((0, 0))
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                dim = int(dims[lo])
                part = batch.slice(lo, hi - lo)
                if v.shape[1] != dim:
                    node, v = np.empty(0, np.int64), np.empty((0, dim))
                old = len(node)
                node = np.append(node, part.column("node").to_numpy())
                v = np.concatenate([v, unit(_matrix(part.column("v"), dim, kind))])
                i, j = [], []
                for at in range(0, len(node), window):
                    hit = v[at : at + window] @ v[at : at + 2 * window].T >= cosine
                    x, y = np.nonzero(hit)
                    near = (y > x) & (y - x <= window) & (y + at >= old)
                    i.append(x[near] + at)
                    j.append(y[near] + at)
                root = local_roots(len(node), np.concatenate(i), np.concatenate(j))
                linked = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(node[root[linked]]), pa.array(node[linked])], schema=schema)
                node, v = node[-window:], v[-window:]

    return run


def _keyed(passes: range, codes: dict[int, int], kind: str) -> Callable:
    names = ("pass", "dim", "key", "node", "v")
    schema = pa.schema(list(zip(names, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                v = unit(_matrix(part.column("v"), dim, kind))
                for p in passes:
                    key = np.zeros(len(v), np.int64)
                    for c in range(codes[dim]):
                        key = key * (2 * dim) + hashes(v, p, c)
                    same = [pa.array(np.full(len(v), x, np.int32)) for x in (p, dim)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(key), part.column("node"), part.column("v")], schema=schema)

    return run


def _tile_counts(cosine: float, kind: str) -> Callable:
    """Links of each vector of a tile with the other side's, weighted by the size of their classes."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            key = np.stack([rest.column(c).to_numpy() for c in ("root", "a", "b")])
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0).any(0)) + 1).tolist()]
            yield from map(one, (rest.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])))
            rest = rest.slice(cuts[-1])
        if rest is not None and rest.num_rows:
            yield one(rest)

    def one(group: pa.RecordBatch) -> pa.RecordBatch:
        node, size, tile = (group.column(c).to_numpy() for c in ("node", "size", "tile"))
        v = unit(_matrix(group.column("v"), int(group.column("dim")[0].as_py()), kind))
        left = tile == int(group.column("a")[0].as_py())
        right = left if left.all() else ~left
        hit = v[left] @ v[right].T >= cosine
        if left.all():
            np.fill_diagonal(hit, False)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(hit @ size)], schema=schema)
        return pa.RecordBatch.from_arrays([pa.array(np.append(node[left], node[right])), pa.array(np.append(hit @ size[right], hit.T @ size[left]))], schema=schema)

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = 0.95, window: int = 256) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each of the table's."""
    spark = df.sparkSession
    kind = "<f4" if "float" in dict(df.dtypes)[vector_col] else "<f8"
    v = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(sound, F.lit(False))
    rows = rows.select("vec_id", "v", *(F.when(valid, h).alias(c) for c, h in (("h1", F.xxhash64("v")), ("h2", F.xxhash64(F.reverse("v"), F.lit(_SEED))))))
    classes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("v").alias("v"))
    classes = Table(_packed(classes, kind).withColumn("node", F.monotonically_increasing_id()), "vectors")
    vectors = classes.df.select("node", "dim", "size", "v")
    plans = {r["dim"]: plan(r["count"], r["dim"], window, cosine, recall) for r in vectors.groupBy("dim").count().collect()}
    codes, passes, n = {d: c for d, (c, _) in plans.items()}, max((p for _, p in plans.values()), default=0), vectors.count()
    links = []
    for first in range(0, passes, AT_ONCE):
        now = range(first, min(first + AT_ONCE, passes))
        tasks = max(1, min(len(now) * n // (16 * window), max(partitions(spark), len(now) * n // TASK_ROWS)))
        keyed = vectors.select("node", "dim", "v").mapInArrow(_keyed(now, codes, kind), "pass int, dim int, key long, node long, v binary")
        order = ("pass", "dim", "key", "node")
        sorted_rows = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("dim", "node", "v")
        links.append(Table(sorted_rows.mapInArrow(_windows(window, cosine, kind), "a long, b long"), "near"))
    found = reduce(DataFrame.unionByName, (t.df for t in links)) if links else spark.createDataFrame([], "a long, b long")
    members = Table(components(found), "members")
    for t in links:
        t.drop()
    counts = _links_within(members.df, vectors, cosine, kind)
    info = classes.df.select("node", "h1", "h2", "least", "size").join(members.df, "node", "left").join(counts, "node", "left")
    of_root = info.where("root is not null").groupBy("root").agg(F.min("least").alias("component"))
    info = info.join(of_root, "root", "left").select(
        "h1", "h2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id"), F.lit(True).alias("sound")
    )
    out = rows.drop("v").join(Table(info, "links").df, ["h1", "h2"], "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _packed(classes: DataFrame, kind: str) -> DataFrame:
    """Vectors as bytes, with their length."""
    names = [c for c in classes.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, ends = v.values.to_numpy(zero_copy_only=False).astype(kind), v.offsets.to_numpy()
            made = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.diff(ends).astype(np.int32)), pa.array(made, pa.binary())], names=[*names, "dim", "v"])

    kept = ", ".join(f"{c} long" for c in names)
    return classes.mapInArrow(run, f"{kept}, dim int, v binary")


def _links_within(members: DataFrame, vectors: DataFrame, cosine: float, kind: str) -> DataFrame:
    """(node, links): for each member of a component, how many others of it reach the threshold, each as often as its class has rows."""
    by_root = Window.partitionBy("root")
    place = members.select("node", "root", F.floor((F.row_number().over(by_root.orderBy("node")) - 1) / TILE).cast("int").alias("tile"), F.count("*").over(by_root).alias("n"))
    pairs = place.select("node", "root", "tile", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / TILE).cast("int"))).alias("other"))
    pairs = pairs.select("node", "root", "tile", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    dealt = pairs.join(vectors, "node").repartition(partitions(members.sparkSession), "root", "a", "b").sortWithinPartitions("root", "a", "b", "node")
    return dealt.mapInArrow(_tile_counts(cosine, kind), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
