"""Exact per-group median / quantile that never puts a huge group into one task.

Groups with at most ``cap`` rows use Spark's exact ``median`` aggregate (its buffer is
bounded by the group size).  A group above ``cap`` — e.g. one account holding a third of all
rows — is narrowed instead: a mergeable ``percentile_approx`` sketch over a fixed grid of
quantiles (bounded memory, partial aggregation, so skew-safe) brackets the two middle
ranks; one pass counts the rows below the bracket; the loop repeats on the rows inside the
bracket until they number at most ``cap`` or the bracket is one value; the middle ranks are then
selected exactly with a window over the bracket's distinct values and their counts.  Correctness never depends on the sketch: a bracket is accepted
only after counting confirms it holds both target ranks.  The result is the exact median
(mean of the two middle values for an even count), as NumPy's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

DEFAULT_CAP = 2_000_000
SKETCH_ACCURACY = 20_000
GRID = 1000
MAX_ROUNDS = 6


def group_median(df: DataFrame, key: str, value: str, out: str = "median",
                 cap: int = DEFAULT_CAP, max_group_size: int | None = None) -> DataFrame:
    """(key, out) for every key with at least one non-NULL value.  ``max_group_size``, when
    the caller already knows it, skips the job that looks for groups above ``cap``."""
    return group_quantile(df, key, value, 0.5, out, cap, max_group_size)


def group_quantile(df: DataFrame, key: str, value: str, q: float, out: str = "quantile",
                   cap: int = DEFAULT_CAP, max_group_size: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantile per key (NumPy's default): with pos = q·(n−1),
    v[floor(pos)] + (pos − floor(pos))·(v[ceil(pos)] − v[floor(pos)])."""
    v = df.select(key, value).where(F.col(value).isNotNull())
    if max_group_size is not None and max_group_size <= cap:
        return v.groupBy(key).agg(F.percentile(value, q).alias(out))
    counts = v.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    big = counts.where(F.col("__n") > cap)
    if big.isEmpty():
        return v.groupBy(key).agg(F.percentile(value, q).alias(out))
    from acctlens.session import cut_lineage
    big = cut_lineage(big)
    small_part = (v.join(big.select(key), key, "left_anti")
                  .groupBy(key).agg(F.percentile(value, q).alias(out)))
    return small_part.unionByName(_big_group_quantile(v, big, key, value, q, out, cap))


def small_group_mad(df: DataFrame, key: str, value: str, out: str = "mad") -> DataFrame:
    """(key, out): median(|v − median(v)|) of every key with a non-NULL value, where no group is above the cap:
    a group's values are gathered and sorted once, so the rows are read and shuffled once for both medians."""
    def middle(a: Column) -> Column:
        n = F.size(a)
        return 0.5 * F.get(a, F.floor((n - 1) / 2).cast("int")) + 0.5 * F.get(a, F.floor(n / 2).cast("int"))

    held = (df.select(key, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
            .groupBy(key).agg(F.sort_array(F.collect_list("__v")).alias("__v")))
    held = held.select(key, "__v", F.coalesce(middle(F.col("__v")), F.lit(0.0)).alias("__m"))      # never NULL
    return held.select(key, F.sort_array(F.transform("__v", lambda x: F.abs(x - F.col("__m")))).alias("__d")).select(
        key, middle(F.col("__d")).alias(out))


def global_quantile(df: DataFrame, value: str, q: float, cap: int = DEFAULT_CAP,
                    n_rows: int | None = None) -> float | None:
    """One exact quantile over the whole frame (same skew-safe path, one constant key).
    ``n_rows``, when known, decides the path without a counting job."""
    one = df.select(F.lit(0).alias("__k"), value)
    row = group_quantile(one, "__k", value, q, "__q", cap, n_rows).first()
    return None if row is None else row["__q"]


def _inside(rows: DataFrame, st: DataFrame, key: str) -> DataFrame:
    return (rows.join(st.select(key, "__lo", "__hi"), key)
            .where((F.col("__lo").isNull() | (F.col("__v") >= F.col("__lo")))
                   & (F.col("__hi").isNull() | (F.col("__v") <= F.col("__hi")))))


def _grid_at(idx: Column) -> Column:
    """Grid value at 0-based position ``idx``; the open end (NULL) at either extreme."""
    return F.when((idx <= 0) | (idx >= GRID), F.lit(None).cast("double")) \
        .otherwise(F.element_at(F.col("__g"), (idx + 1).cast("int")))


def _big_group_quantile(v: DataFrame, big: DataFrame, key: str, value: str, q: float, out: str,
                        cap: int) -> DataFrame:
    from acctlens.session import cut_lineage
    st = big.select(key, F.lit(None).cast("double").alias("__lo"), F.lit(None).cast("double").alias("__hi"),
                    F.lit(0).cast("long").alias("__below"),
                    (F.floor((F.col("__n") - 1) * q) + 1).cast("long").alias("__t1"),
                    (F.ceil((F.col("__n") - 1) * q) + 1).cast("long").alias("__t2"),
                    ((F.col("__n") - 1) * q - F.floor((F.col("__n") - 1) * q)).alias("__fr"))
    rows = v.join(big.select(key), key, "left_semi").select(key, F.col(value).cast("double").alias("__v"))
    eps = 1.0 / SKETCH_ACCURACY
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    for _ in range(MAX_ROUNDS):
        st = cut_lineage(st)
        inside = _inside(rows, st, key)
        sizes = cut_lineage(inside.groupBy(key).agg(F.count(F.lit(1)).alias("__m")))
        narrow = F.col("__lo").isNotNull() & (F.col("__lo") == F.col("__hi"))      # one value is left
        todo = st.join(sizes, key).where((F.col("__m") > cap) & ~narrow)
        if todo.isEmpty():
            break
        sk = (inside.join(todo.select(key), key, "left_semi").groupBy(key)
              .agg(F.percentile_approx("__v", grid, SKETCH_ACCURACY).alias("__g"))
              .join(todo.select(key, "__m", "__below", "__t1", "__t2"), key))
        q1 = (F.col("__t1") - F.col("__below") - 1) / F.col("__m") - 2 * eps
        q2 = (F.col("__t2") - F.col("__below")) / F.col("__m") + 2 * eps
        sk = cut_lineage(sk.select(key, _grid_at(F.floor(q1 * GRID) - 1).alias("__nlo"),
                                   _grid_at(F.ceil(q2 * GRID) + 1).alias("__nhi")))
        cnt = (inside.join(sk, key).groupBy(key).agg(
            F.count_if(F.col("__nlo").isNotNull() & (F.col("__v") < F.col("__nlo"))).alias("__add"),
            F.count_if((F.col("__nlo").isNull() | (F.col("__v") >= F.col("__nlo")))
                       & (F.col("__nhi").isNull() | (F.col("__v") <= F.col("__nhi")))).alias("__in")))
        upd = st.join(sk, key, "left").join(cnt, key, "left")
        ok = (F.col("__add").isNotNull() & (F.col("__below") + F.col("__add") < F.col("__t1"))
              & (F.col("__below") + F.col("__add") + F.col("__in") >= F.col("__t2")))
        st = upd.select(key,
                        F.when(ok, F.col("__nlo")).otherwise(F.col("__lo")).alias("__lo"),
                        F.when(ok, F.col("__nhi")).otherwise(F.col("__hi")).alias("__hi"),
                        F.when(ok, F.col("__below") + F.col("__add")).otherwise(F.col("__below")).alias("__below"),
                        "__t1", "__t2", "__fr")
    st = cut_lineage(st)
    inside = rows.join(st.select(key, "__lo", "__hi", "__below", "__t1", "__t2", "__fr"), key) \
        .where((F.col("__lo").isNull() | (F.col("__v") >= F.col("__lo")))
               & (F.col("__hi").isNull() | (F.col("__v") <= F.col("__hi"))))
    # equal values are one row with a count, so copies of the sought value never meet in a window
    held = ["__below", "__t1", "__t2", "__fr"]
    values = inside.groupBy(key, "__v", *held).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(key).orderBy("__v")
    ranked = values.withColumn("__to", F.sum("__c").over(w) + F.col("__below")).withColumn("__from", F.col("__to") - F.col("__c"))
    at = lambda t: F.min(F.when((F.col("__from") < F.col(t)) & (F.col(t) <= F.col("__to")), F.col("__v")))
    return (ranked.groupBy(key).agg(at("__t1").alias("__a"), at("__t2").alias("__b"), F.first("__fr").alias("__fr"))
            .select(key, (F.col("__a") + F.col("__fr") * (F.col("__b") - F.col("__a"))).alias(out)))
