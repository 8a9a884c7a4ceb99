"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct lower-cased character n-grams (3 to 6 characters) hashed to
``2**BITS`` buckets.  The ratio of a bucket compares the share of toxic and of other training
texts that contain it, both smoothed towards its overall share, so rare n-grams stay near 0.
Features enter a logistic regression scaled by their ratios; all buckets do that ``min_texts`` texts hold
and that tell the two kinds apart surely (likelihood-ratio statistic of ``min_evidence`` or more).

The fit uses at most ``max_rows`` labelled texts, those with the smallest id hash (the documented
bound of the training sample); scoring covers every row and whole texts.  Their features stay
with the executors: each step of the fit is a job that adds up its gradient.

Null and empty texts have no features and score the intercept.  A repeated id takes the larger of
its labels and, to learn from, the first of its texts in order; labels other than 0 and 1, null among
them, are ignored, repeated rows score alike.  Without labels of both kinds the
model scores every text 0.  An empty table gives no rows.  Columns other than those named are
ignored, and ``drop_toxic`` passes all of them on unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctlens.llm.text import column, slices, texts_of
from acctlens.session import cut_lineage

BITS = 20
ORDERS = (3, 4, 5, 6)
_BASE = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)


def buckets(text: str, scratch: np.ndarray | None = None) -> np.ndarray:
    """The distinct buckets of a text's n-grams; ``scratch``: int32 of ``2**BITS``, any content."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    parts, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * _BASE + c[n - 1:] + np.uint32(1)
        if n in ORDERS:
            parts.append((h ^ (h >> np.uint32(15))) * _SPREAD >> np.uint32(32 - BITS))
    if not parts:
        return np.empty(0, np.int32)
    at = np.concatenate(parts).view(np.int32)
    if scratch is None:
        return np.unique(at)
    place = np.arange(len(at), dtype=np.int32)
    scratch[at] = place                                  # the last of equal buckets stays
    return at[scratch[at] == place]


@dataclass(frozen=True)
class Model:
    """Weights (already times the ratios) of the kept buckets, ascending, and the intercept."""
    kept: np.ndarray
    weight: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.kept] = self.weight
        return out


EMPTY = Model(np.empty(0, np.int32), np.empty(0, np.float32), float("-inf"))


def log_ratios(with_toxic: np.ndarray, with_other: np.ndarray, toxic: int, other: int, prior: float) -> np.ndarray:
    share = (with_toxic + with_other) / (toxic + other)
    return np.log((with_toxic + prior * share) / (toxic + prior)) - np.log((with_other + prior * share) / (other + prior))


def evidence(toxic: int, other: int) -> Column:
    """The likelihood-ratio statistic of each bucket's two-by-two table, over columns toxic, other."""
    n, both, total = toxic + other, F.col("toxic") + F.col("other"), F.lit(0.0)
    for seen, rows in ((F.col("toxic"), toxic), (F.col("other"), other)):
        for got, expected in ((seen, both * rows / n), (rows - seen, (n - both) * rows / n)):
            total = total + F.when(got > 0, got * F.log(got / expected)).otherwise(F.lit(0.0))
    return 2 * total


def pulled(lens: np.ndarray, cols: np.ndarray, w: np.ndarray, b: float, y: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Rows of ``lens`` entries of ``cols`` each, z = b plus a row's ``w``.  By column the sum of z over the rows
    that hold it, and the sum over all rows; with labels ``y``, of the logistic loss's slope instead of z."""
    z, some = np.full(len(lens), float(b)), np.flatnonzero(lens)
    if len(some):
        z[some] += np.add.reduceat(w[cols], (np.cumsum(lens) - lens)[some])
    g = z if y is None else 1 / (1 + np.exp(-z)) - y
    return np.bincount(cols, np.repeat(g, lens), len(w)), float(g.sum())


def descend(pull: Callable[[np.ndarray, float, bool], tuple[np.ndarray, float]], x: np.ndarray, n: int, share: float,
            l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of L2-penalised logistic regression on ``n`` rows, a ``share`` of them labelled 1, by
    accelerated gradient steps of fixed length; ``x[col]`` is the value of a feature wherever it occurs.
    ``pull(w, b, sloped)``: what ``pulled`` returns over all rows, with their labels if ``sloped``."""
    def back(w: np.ndarray, b: float, sloped: bool) -> tuple[np.ndarray, float]:
        g, total = pull(x * w, b, sloped)
        return x * g, total

    vw, vb, size = np.full(len(x), len(x) ** -0.5), 0.0, 1.0
    for _ in range(12):                                   # the largest curvature, by power iteration
        gw, gb = back(vw, vb, False)
        size = float(np.sqrt(gw @ gw + gb * gb))
        vw, vb = gw / size, gb / size
    rate = 1 / (0.25 * 1.1 * size / n + l2)
    w, b = np.zeros(len(x)), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    vw, vb, t = w, b, 1.0
    for _ in range(steps):
        gw, gb = back(vw, vb, True)
        nw, nb = vw - rate * (gw / n + l2 * vw), vb - rate * (gb / n)
        if (vw - nw) @ (nw - w) > 0:                       # the momentum points uphill
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return w, b


def fit_logistic(lens: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, n_cols: int,
                 l2: float, steps: int) -> tuple[np.ndarray, float]:
    """``descend`` on rows held in memory, ``lens`` entries of ``cols`` each."""
    return descend(lambda w, b, sloped: pulled(lens, cols, w, b, y if sloped else None), x[:n_cols], len(y), float(y.mean()), l2, steps)


def fit_rows(rows: DataFrame, x: np.ndarray, n: int, share: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """``descend`` on the table ``rows`` (some texts each: labels, lens and cols, int32 as bytes), which the
    executors hold: a step is one job, and the driver gets one vector of the features a task."""
    def arrays(r) -> tuple[np.ndarray, ...]:
        return tuple(np.frombuffer(r[c], np.int32) for c in ("labels", "lens", "cols"))

    held = rows.rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)

    def pull(w: np.ndarray, b: float, sloped: bool) -> tuple[np.ndarray, float]:
        def run(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, float]]:
            by_col, total = np.zeros(len(w)), 0.0
            for y, lens, cols in parts:
                got, here = pulled(lens, cols, w, b, y if sloped else None)
                by_col += got
                total += here
            yield by_col, total

        by_col, total = np.zeros(len(w)), 0.0
        for got, here in held.mapPartitions(run).collect():
            by_col += got
            total += here
        return by_col, total

    try:
        return descend(pull, x, n, share, l2, steps)
    finally:
        held.unpersist()


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = 20_000, prior: float = 2.0, min_texts: int = 4, min_evidence: float = 10.0,
        l2: float = 1e-6, steps: int = 150) -> Model:
    """Fit on the texts of ``df`` whose id is in ``labels`` (id, 0/1)."""
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label")))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)                 # the bounded sample
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = cut_lineage(texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
                         .repartition(16, "id"))
    kinds = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = kinds.get(1, 0), kinds.get(0, 0)
    if not toxic or not other:
        return EMPTY

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int32)
        scratch = np.empty(1 << BITS, np.int32)
        for b in slices(batches, "text"):
            for label, text in zip(column(b, "label").to_pylist(), texts_of(b, "text")):
                n[label, buckets(text, scratch)] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[1, at]), pa.array(n[0, at])],
                                         names=["bucket", "toxic", "other"])

    counted = (sample.mapInArrow(count, "bucket int, toxic int, other int").groupBy("bucket")
               .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
               .where(F.col("toxic") + F.col("other") >= min_texts).withColumn("sure", evidence(toxic, other))
               .where(F.col("sure") >= min_evidence).toPandas())               # 2**BITS rows at most
    counted = counted.sort_values("bucket")
    kept = counted["bucket"].to_numpy(np.int32)
    ratio = log_ratios(counted["toxic"].to_numpy(float), counted["other"].to_numpy(float), toxic, other, prior)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = np.empty(1 << BITS, np.int32)
        col = np.full(1 << BITS, -1, np.int32)
        col[kept] = np.arange(len(kept))
        for b in slices(batches, "text", 1 << 20):
            got = [col[buckets(t, scratch)] for t in texts_of(b, "text")]
            got = [np.sort(g[g >= 0]) for g in got]
            parts = column(b, "label").to_numpy().astype(np.int32), np.array([len(g) for g in got], np.int32), np.concatenate(got)
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in parts], names=["labels", "lens", "cols"])

    if len(kept) == 0:
        return Model(kept, np.empty(0, np.float32), float(np.log(toxic / other)))
    rows = cut_lineage(sample.select("label", "text").mapInArrow(project, "labels binary, lens binary, cols binary"))
    w, b = fit_rows(rows, ratio, toxic + other, toxic / (toxic + other), l2, steps)
    return Model(kept, (w * ratio).astype(np.float32), b)


def _scores(model: Model):
    weight = model.table()
    scratch = np.empty(1 << BITS, np.int32)

    def of(texts: list[str]) -> np.ndarray:
        z = np.array([weight[buckets(t, scratch)].sum(dtype=np.float64) for t in texts]) + model.intercept
        return np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))

    return of


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scores(model)
        for b in slices(batches, "text"):
            s = of(texts_of(b, "text"))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])

    return (df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, score double, predicted int"))


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score below 0.5, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _scores(model)
        for b in slices(batches, text_col):
            yield b.filter(pa.array(of(texts_of(b, text_col)) < 0.5))

    return df.mapInArrow(run, df.schema)
