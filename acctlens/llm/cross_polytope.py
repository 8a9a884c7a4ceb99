"""Approximate nearest neighbours by cross-polytope hashing.

A table rotates unit vectors by three rounds of random signs and fast Hadamard transforms (drawn
from a seed, so every task draws the same) and hashes a vector to the nearest signed axis of its
``bits``-sized leading coordinates.  A query looks into the buckets of its ``probes`` nearest signed
axes in every table (multiprobe).  Every row of a bucket is a candidate, and candidates are
reranked by the exact inner product of the original vectors in double precision.

Equal vectors are collapsed to one with its smallest ids (as many as can rank), so a vector that
a third of all rows share costs one.  A bucket's candidates and queries are dealt into blocks of at
most ``BLOCK`` rows and every pair of blocks is one group of a cogroup, so no task holds a whole hot
bucket; each group returns the best ``k`` of each of its queries only.

Vectors are hashed by their directions.  A long vector ranks high at a wide angle too, so it is put
into the buckets of several of its nearest axes: as many as the square of its length over a
reference length, all at most.  The reference is the smallest at which the rows have one axis each
on average (``reference_length``, from counts by length), so uneven lengths at most double the rows,
and a few very long vectors leave the others' share alone.

Queries that the buckets give fewer than ``k`` ids (or than all others), or fewer than ``ENOUGH * k``
candidates over all tables, are asked again against every row, by the same blocks.  This is decided
query by query from what its own buckets hold; no size of the table changes the method.

Vectors that are null, zero, of another length than the most common one, or that hold null or
non-finite components take no part.  Ties go to the smaller id; of repeated ids the first vector
in order counts.  Null ids take no part.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acctlens.llm.text import column
from acctlens.session import cut_lineage

BLOCK = 4096
ENOUGH = 50             # candidates a query must be given for each of its k, counted in every table


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of each row (length a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(unit: np.ndarray, table: int, seed: int) -> np.ndarray:
    """The table's pseudo-rotation: three rounds of random signs and Hadamard transforms."""
    d = 1 << max(0, int(unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), d))
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng([seed, table]).integers(0, 2, (3, d)) * 2 - 1
    for s in signs:
        x = hadamard(x * s)
    return x


def nearest_axes(x: np.ndarray, probes: int, axes: int) -> np.ndarray:
    """The ``probes`` nearest of the signed axes of the first ``axes`` coordinates, nearest first:
    axis i is 2i, its opposite 2i + 1."""
    x = x[:, :axes]
    both = np.stack([x, -x], axis=2).reshape(len(x), -1)
    probes = min(probes, both.shape[1])
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    top = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(np.take_along_axis(-both, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


def reference_length(bands: list[tuple[int, int, float]], most: int) -> float:
    """The length L at which min(``most``, (length / L)**2) is 1 on average, from (band, rows, mean
    square of the lengths over 4**band) of bands of lengths up to a factor of two."""
    bands = sorted(bands, reverse=True)
    top = bands[0][0]
    n, squares = sum(b[1] for b in bands), [b[1] * b[2] * 4.0 ** max(b[0] - top, -500) for b in bands]
    best, left = 0.0, n
    for i, (band, rows, _) in enumerate(bands):            # the bands before i have all ``most`` axes
        best = np.sqrt(sum(squares[i:]) / left)
        left -= most * rows
        if 2.0 ** max(band - top, -500) <= np.sqrt(most) * best or left <= 0:
            break
    return float(np.ldexp(best, top))


def directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; scaled by the largest component first, so no square overflows."""
    largest = np.abs(v).max(axis=1, keepdims=True)
    unit = v / largest
    norm = np.linalg.norm(unit, axis=1, keepdims=True)
    return unit / norm, (largest * norm)[:, 0]


def _matrix(arr: pa.Array) -> np.ndarray:
    return arr.values.to_numpy(zero_copy_only=False).reshape(len(arr), -1) if len(arr) else np.empty((0, 1))


def distinct_vectors(rows: DataFrame, n: int) -> DataFrame:
    """v, ids, key: one row per distinct vector, its ``n`` smallest ids in order and the smallest.
    Ids are ranked by (vector, salt), then by vector, so no array holds more than ``n``."""
    dealt = rows.select("vec_id", "v").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    for by in (("v", "salt"), ("v",)):
        dealt = dealt.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("at") <= n)
    return (dealt.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
            .withColumn("key", F.element_at("ids", 1)))


def search(df: DataFrame, query_filter, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
           tables: int = 12, probes: int = 8, axes: int = 64, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of every query (rows of ``df`` for
    which ``query_filter``, a condition on the column vec_id, holds); a query's own row is no candidate."""
    kind = "float" if dict(df.dtypes)[vector_col] == "array<float>" else "double"       # as stored: half the bytes to shuffle
    raw = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 + 0.0 is 0.0, so equal vectors group together
    raw = raw.where(good).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast(kind))).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = cut_lineage(raw)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == common["d"])
    distinct = cut_lineage(distinct_vectors(rows, k + 1))   # k, and one for the query itself
    asked = rows.where(query_filter).select(F.col("vec_id").alias("query_id"), "v")
    keyed = asked.join(distinct.select("v", "key"), "v").select("query_id", "key")       # a hot vector's queries: AQE splits
    keyed = cut_lineage(keyed)
    # lengths by powers of two: a few thousand bands at most, by the range of doubles
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    band = distinct.select("v", largest.alias("m")).select("v", F.floor(F.log2("m")).cast("int").alias("e")).select("e", F.aggregate(
        F.transform("v", lambda x: x.cast("double") / F.pow(F.lit(2.0), F.col("e"))), F.lit(0.0), lambda a, x: a + x * x).alias("s"))
    shift = F.floor(F.log2("s") / 2).cast("int")
    bands = band.select((F.col("e") + shift).alias("band"), (F.col("s") / F.pow(F.lit(4.0), shift)).alias("s")).groupBy("band").agg(
        F.count("*").alias("n"), F.avg("s").alias("s")).collect()
    reference = reference_length([tuple(b) for b in bands], 2 * axes)
    asks = cut_lineage(distinct.join(keyed.select("key").distinct(), "key", "left_semi"))

    def hashed(n_probes: int, candidate: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _matrix(column(b, "v")).astype(float)
                if len(v) == 0:
                    continue
                unit, length = directions(v)
                most = np.full(len(v), n_probes)
                if candidate:
                    with np.errstate(over="ignore"):
                        most = np.clip(np.round((length / reference) ** 2), 1, 2 * axes).astype(int)
                for t in range(tables):
                    axis = nearest_axes(rotate(unit, t, seed), int(most.max()), axes)
                    use = np.arange(axis.shape[1]) < most[:, None]
                    row = np.nonzero(use)[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), t * 4 * axes, np.int32) + axis[use].astype(np.int32)),
                         *(column(b, c).take(pa.array(row)) for c in ("key", "v"))], names=["bucket", "key", "v"])
        return run

    def rerank(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if len(queries) == 0 or len(candidates) == 0:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("key", "c", "score")})
        c, out, keys = np.array(candidates["v"].tolist(), float), [], candidates["key"].to_numpy()
        for at in range(0, len(queries), 512):
            part = queries.iloc[at: at + 512]
            asked = np.array(part["v"].tolist(), float)
            scores = asked @ c.T
            n = min(k + 1, len(keys))                       # the query's own vector may be one of them
            bound = -np.partition(-scores, n - 1, axis=1)[:, n - 1: n]
            q, j = np.nonzero(scores >= bound)              # ties with the last one stay
            # summed pair by pair, a pair's score is the same in every block
            exact = (asked[q] * c[j]).sum(axis=1)
            out.append(pd.DataFrame({"key": part["key"].to_numpy()[q], "c": keys[j], "score": exact}))
        got = pd.concat(out).sort_values(["key", "score", "c"], ascending=[True, False, True], kind="stable")
        got = got[got.groupby("key").cumcount() <= k]
        return got

    wide = f"bucket int, key long, v array<{kind}>"
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    def sizes_of(there: DataFrame) -> DataFrame:
        return cut_lineage(there.groupBy("bucket").agg(F.count("*").alias("n")))

    def best_of(here: DataFrame, there: DataFrame, sizes: DataFrame) -> DataFrame:
        """key, s, c, ids: the k + 1 best distinct vectors that share a bucket with each query vector."""
        # blocks: at most 4 * axes * tables buckets, so the counts are a small, bounded table
        counts = cut_lineage(sizes.join(here.groupBy("bucket").agg(F.count("*").alias("q")), "bucket"))
        counts = counts.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("tiles"), F.ceil(F.col("q") / BLOCK).cast("int").alias("groups"))
        there = (there.join(F.broadcast(counts), "bucket").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
                 .withColumn("grp", spread("groups")).select("bucket", "tile", "grp", "key", "v"))
        here = (here.join(F.broadcast(counts), "bucket").withColumn("grp", F.pmod(F.xxhash64("key"), F.col("groups")).cast("int"))
                .withColumn("tile", spread("tiles")).select("bucket", "tile", "grp", "key", "v"))
        near = here.groupBy("bucket", "tile", "grp").cogroup(there.groupBy("bucket", "tile", "grp")).applyInPandas(
            rerank, "key long, c long, score double")
        # the best distinct vectors of each query vector, then their ids
        found = near.groupBy("key", "c").agg(F.max("score").alias("score"))
        best = found.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "c"))), 1, k + 1).alias("best"))
        return cut_lineage(best.select("key", F.explode("best").alias("b")).select("key", "b.s", "b.c")
                           .join(distinct.select(F.col("key").alias("c"), "ids"), "c"))

    def whole(some: DataFrame) -> DataFrame:
        return some.select(F.lit(0).alias("bucket"), "key", "v")

    here, there = asks.select("key", "v").mapInArrow(hashed(probes, False), wide), distinct.select("key", "v").mapInArrow(hashed(1, True), wide)
    sizes = sizes_of(there)
    best = best_of(here, there, sizes)
    # one of the ids found may be the query itself
    got = best.groupBy("key").agg(F.sum(F.size("ids")).alias("n"))
    given = here.select("key", "bucket").join(F.broadcast(sizes), "bucket").groupBy("key").agg(F.sum("n").alias("given"))
    few = (F.coalesce("n", F.lit(0)) - 1 < min(k, common["n"] - 1)) | (F.coalesce("given", F.lit(0)) < ENOUGH * k)
    short = cut_lineage(asks.join(got, "key", "left").join(given, "key", "left").where(few).select("key", "v"))
    if not short.isEmpty():
        best = best.join(short.select("key"), "key", "left_anti").unionByName(best_of(whole(short), whole(distinct), sizes_of(whole(distinct))))
    best = best.groupBy("key").agg(F.collect_list(F.struct("s", "ids")).alias("best"))
    ranked = (keyed.join(best, "key")
              .select("query_id", F.explode(F.slice(F.array_sort(F.filter(F.flatten(F.transform("best", lambda b: F.transform(
                  b["ids"], lambda i: F.struct(b["s"].alias("s"), i.alias("vec_id"))))), lambda x: x["vec_id"] != F.col("query_id"))), 1, k)).alias("x"))
              .select("query_id", "x.vec_id", (-F.col("x.s")).alias("score")))
    order = F.row_number().over(_by_query())
    return ranked.select("query_id", order.cast("int").alias("rank"), "vec_id", "score")


def _by_query():
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
