"""Feature preparation.

``prepare`` turns the filtered sales frame into the model frame, one row per observation:

    account, period, weight, y, x0..x{c-1}, c0..c{m-1}, g

``y`` is the (log) target, ``x*`` the log continuous predictors, ``c*`` the one-hot encoded
categoricals kept as strings (they become indicator columns inside the Gram aggregation),
and ``g`` the *absorbed* categorical — the high-cardinality fixed effect (by default the
account) whose per-level intercepts are swept out with the within transformation instead
of becoming thousands of dummy columns.  Account, period and weight travel on the row, so
no positional alignment is ever needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acctlens.functions.columns import qcol
from acctlens.session import cut_lineage
from acctlens.settings import ModelSpec

# Phrases that callers match on.
NEGATIVE_TARGET = "Dependent variable contains negative values"
NEGATIVE_PREDICTOR = "Cannot log-transform negative values"


@dataclass(frozen=True)
class Design:
    """What the model frame holds; levels of the small categoricals are sorted."""
    continuous: tuple[str, ...]
    dummies: tuple[tuple[str, tuple], ...]     # (source column, sorted levels)
    absorbed: str | None
    target: str
    mean_y: float = 0.0                        # the moments are taken about these means
    mean_x: tuple[float, ...] = ()

    @property
    def n_cont(self) -> int:
        return len(self.continuous)

    @property
    def columns(self) -> list[tuple[str, int, object]]:
        """Dense design columns: ('x', i, None) or ('c', j, level)."""
        out: list[tuple[str, int, object]] = [("x", i, None) for i in range(self.n_cont)]
        for j, (_, levels) in enumerate(self.dummies):
            out += [("c", j, lv) for lv in levels]
        return out

    @property
    def p(self) -> int:
        return len(self.columns)

    def names(self) -> list[str]:
        out = [f"Log_{c}" for c in self.continuous]
        for col, levels in self.dummies:
            out += [f"{col}_{lv}" for lv in levels]
        return out


class NegativeValueError(ValueError):
    pass


def log_expr(c: Column, handle_zeros: str = "clip", clip_value: float = 1e-6,
             add_constant: float = 1.0) -> Column:
    """``clip`` → ln(max(v, clip)) (every value below the clip, not only zeros);
    ``add_constant`` → ln(v + 1).  NULL stays NULL (``greatest`` would skip it)."""
    if handle_zeros == "clip":
        return F.when(c.isNotNull(), F.ln(F.greatest(c.cast("double"), F.lit(clip_value))))
    return F.ln(c.cast("double") + F.lit(add_constant))


def negative_counts(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """One row: negative values of the target and, summed, of the continuous predictors."""
    neg = lambda c: F.count_if(qcol(c) < 0)
    return df.agg(neg(spec.dependent_var).alias("neg_target"),
                  sum((neg(c) for c in spec.continuous_vars), F.lit(0)).cast("long").alias("neg_predictors"))


def check_negatives(df: DataFrame, spec: ModelSpec) -> None:
    """Negative values have no logarithm."""
    _refuse_negatives(negative_counts(df, spec).first(), spec)


def _refuse_negatives(row, spec: ModelSpec) -> None:
    if spec.log_transform and row["neg_target"]:
        raise NegativeValueError(f"{NEGATIVE_TARGET}: '{spec.dependent_var}' has {row['neg_target']}")
    if row["neg_predictors"]:
        raise NegativeValueError(f"{NEGATIVE_PREDICTOR}: {row['neg_predictors']} among {', '.join(spec.continuous_vars)}")


def choose_absorbed(spec: ModelSpec, account: str | None, absorb: str | None = "auto") -> str | None:
    """The categorical swept out by the within transformation: the account when it is a
    predictor, otherwise the first categorical; ``absorb=None`` keeps every level as a dummy."""
    if absorb != "auto":
        return absorb
    if account in spec.categorical_vars:
        return account
    return spec.categorical_vars[0] if spec.categorical_vars else None


def dummy_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Column, level, is_baseline of every level of ``cols`` (the first of a column's levels)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("level")) for c in cols]))
    levels = df.select(pairs.alias("p")).select("p.*").distinct()
    return levels.withColumn("is_baseline", F.col("level").eqNullSafe(F.min("level").over(Window.partitionBy("column"))))


def _missing(c: Column, kind: str) -> Column:
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()


def prepare(df: DataFrame, spec: ModelSpec, account: str, period: str,
            weight: str | None = None, absorb: str | None = "auto",
            check: bool = True, written: bool = False) -> tuple[DataFrame, Design]:
    """Build the model frame and its design.

    With ``drop_na`` (default) rows missing the target or any predictor are dropped (R4);
    otherwise a missing log predictor is imputed with 0 after the log (R5).  Rows without a
    target are always dropped (no least-squares fit can use them).  NaN counts as missing.

    The source is read once: its few model columns are written as a narrow table, from which one
    aggregate gives the negative counts (R1) and the means that centre the moments, and one more
    the levels of the small categoricals.  ``written``: ``df`` is such a table already."""
    spec.check_columns(df)
    kinds = dict(df.dtypes)
    g = choose_absorbed(spec, account, absorb)
    small = [c for c in spec.categorical_vars if c != g]
    number = lambda c: F.when(~_missing(qcol(c), kinds[c]), qcol(c).cast("double"))
    cols = [qcol(account).alias("account"), qcol(period).alias("period"),
            (F.coalesce(number(weight), F.lit(1.0)) if weight else F.lit(1.0)).alias("weight"),
            number(spec.dependent_var).alias("raw_y"), (qcol(g) if g else F.lit("")).alias("g")]
    cols += [number(c).alias(f"raw_x{i}") for i, c in enumerate(spec.continuous_vars)]
    cols += [qcol(c).cast("string").alias(f"c{j}") for j, c in enumerate(small)]
    narrow = df.select(*cols) if written else cut_lineage(df.select(*cols))
    xs = [f"raw_x{i}" for i in range(len(spec.continuous_vars))]
    y = F.col("raw_y")
    out = narrow.where(y.isNotNull()).select(
        "account", "period", "weight", (log_expr(y, spec.handle_zeros, spec.clip_value) if spec.log_transform else y).alias("y"),
        *[log_expr(F.col(x), spec.handle_zeros, spec.clip_value).alias(x[4:]) for x in xs], *[f"c{j}" for j in range(len(small))], "g")
    logs = [x[4:] for x in xs]
    needed = logs + [f"c{j}" for j in range(len(small))] + (["g"] if g else [])
    out = out.dropna(subset=needed) if spec.drop_na and needed else out.fillna(0.0, subset=logs) if logs else out
    if check:
        _refuse_negatives(narrow.agg(F.count_if(y < 0).alias("neg_target"),
                                     sum((F.count_if(F.col(x) < 0) for x in xs), F.lit(0)).alias("neg_predictors")).first(), spec)
    means = out.agg(F.avg("y"), *[F.avg(x) for x in logs]).first()
    levels: dict[str, list] = {f"c{j}": [] for j in range(len(small))}
    if small:
        for r in dummy_table(out, list(levels)).collect():
            levels[r["column"]].append(r["level"])
    design = Design(tuple(spec.continuous_vars),
                    tuple((c, tuple(sorted(levels[f"c{j}"], key=lambda v: (v is None, v)))) for j, c in enumerate(small)),
                    g, spec.dependent_var, float(means[0] or 0.0), tuple(float(v or 0.0) for v in means[1:]))
    return out, design


def dropped_rows(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """R4 count: rows dropped for missing target or predictors (NULL or NaN), in one aggregate."""
    kinds = dict(df.dtypes)
    miss = F.lit(False)
    for c in spec.columns:
        miss = miss | _missing(qcol(c), kinds[c])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(miss).alias("n_dropped"))
