"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian over the statistics; its covariance is shrunk towards the pooled one and
that towards its diagonal. A document's score is the logistic of the difference of the log densities
and log priors, from Mahalanobis distances with Cholesky factors that are computed once. Means and
covariances come from sums of products that Spark adds up over all labelled rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Table, fold_arrays, lean, pack_array, small, texts

#: Statistics of a text, in this order; all are transformed to be roughly bell-shaped.
FEATURES = ("log_words", "word_bytes", "upper", "digit", "symbol", "punctuation", "distinct_words", "repeated_pairs", "repeated_lines", "line_words", "bars", "top_word", "bang")

_CLASS = np.zeros(256, np.int8)  # 1 upper, 2 digit, 3 symbol, 4 sentence mark, 5 bar, 6 exclamation or question mark, 7 white space
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"#$%&*<>@^~\\{}[]=+_", 3), (b".,;:'\"()-", 4), (b"|", 5), (b"!?", 6), (b"\t\n\v\f\r ", 7)):
    for _c in _chars:
        _CLASS[_c] = _k


def statistics(text: bytes) -> list[float]:
    """The features of a UTF-8 text; an empty one gives finite values too."""
    words = text.split()
    n = len(words)
    counts = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)
    chars = max(1, len(text) - int(counts[7]))
    share = lambda k: math.log((int(k) + 0.5) / (chars + 1))
    low = [w.lower() for w in words]
    tally: dict[bytes, int] = {}
    for w in low:
        tally[w] = tally.get(w, 0) + 1
    pairs = len(set(zip(low, low[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        math.log1p(n),
        math.log((chars + 1) / (n + 1)),
        share(counts[1]),
        share(counts[2]),
        share(counts[3]),
        share(counts[4]),
        math.log((len(tally) + 1) / (n + 1)) + 0.3 * math.log1p(n),
        math.log((max(0, n - 1 - pairs) + 0.5) / (n + 1)),
        math.log((len(lines) - len(set(lines)) + 0.5) / (len(lines) + 1)),
        math.log((n + 1) / (len(lines) + 1)),
        share(counts[5]),
        math.log((max(tally.values(), default=0) + 0.5) / (n + 1)),
        share(counts[6]),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        x = np.array([statistics(t) for t in texts(batch)]).reshape(-1, len(FEATURES))
        ids = batch.column("doc_id").to_pylist()
        crc = [None if i is None else zlib.crc32(str(i).encode()) for i in ids]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(crc, pa.int64()), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["doc_id", "crc", *FEATURES])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
        y = batch.column("y").to_numpy()
        for k in (0, 1):
            v = x[y == k]
            total[k] += np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array([pack_array(total)], pa.binary())], names=["moments"])


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians: means, inverse Cholesky factors of the covariances, and constants."""

    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray

    @classmethod
    def fit(cls, moments: np.ndarray, shrink: float, ridge: float) -> Discriminant | None:
        """From (count, sums, sums of products) of each class; None if a class has too few rows."""
        d = len(FEATURES)
        n = moments[:, 0]
        if n.min() < 2:
            return None
        means = moments[:, 1 : 1 + d] / n[:, None]
        spread = moments[:, 1 + d :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = spread.sum(0) / (n.sum() - 2)
        pooled = (1 - ridge) * pooled + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        own = (1 - shrink) * spread / (n - 1)[:, None, None] + shrink * pooled
        factors = np.linalg.cholesky(own)
        constants = np.log(n / n.sum()) - np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1)
        return cls(means, np.stack([np.linalg.inv(f) for f in factors]), constants)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        a, b = (c - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for m, w, c in zip(self.means, self.whiten, self.constants, strict=True))
        return b - a


def _score(batches: Iterator[pa.RecordBatch], model: Discriminant | None, prior: float, temper: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.column_stack([batch.column(f).to_numpy() for f in FEATURES])
        score = np.full(len(x), prior) if model is None else 1 / (1 + np.exp(-np.clip(model.log_odds(x) / temper, -500, 500)))
        crc = batch.column("crc")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), crc, pa.array(score)], names=["doc_id", "crc", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", hold_out: int = 4, remainder: int = 2, at: float = 0.7, shrink: float = 0.2, ridge: float = 0.1, temper: float = 1.0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    ``held_out`` rows, those whose crc32(doc_id as text) leaves ``remainder`` modulo ``hold_out``, lend no
    label. ``score`` rises with the odds that the label is 1; ``predicted`` is 1 from ``at`` on. Only the text
    is an input of a score. All other labelled rows are learnt from; labels are 0 or 1, others and null
    ones are passed over. A document with several labels counts once for each.

    A null or empty text is measured as a text without words. A null id is kept, isn't held out and
    lends no label. Where a class has fewer than two labelled rows, every score is the share of ones
    (0.5 without labels). Repeated rows give repeated rows, an empty table none; other columns are ignored.
    """
    docs = lean(docs, id_col, text_col)
    measured = Table(docs.mapInArrow(_measure, "doc_id long, crc long, " + ", ".join(f"{f} double" for f in FEATURES)), "statistics").df
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    rows = measured.where(F.col("crc") % hold_out != remainder).join(known, "doc_id").select("y", *FEATURES)
    d = len(FEATURES)
    zero = np.zeros(2 * (1 + d + d * d))
    moments = fold_arrays(rows.mapInArrow(_moments, "moments binary"), np.float64, np.add, zero).reshape(2, -1)
    n = moments[:, 0]
    model, prior = Discriminant.fit(moments, shrink, ridge), float(n[1] / n.sum()) if n.sum() else 0.5
    scored = measured.mapInArrow(lambda it: _score(it, model, prior, temper), "doc_id long, crc long, score double")
    held = F.coalesce(F.col("crc") % hold_out == remainder, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
