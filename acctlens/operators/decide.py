"""Choosing the density method, combining flags, metadata and the full chain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acctlens.operators import density as DN
from acctlens.operators import forest as FO
from acctlens.operators import hdbscan as HD
from acctlens.operators import residuals as RS
from acctlens.operators import validity as VA
from acctlens.session import cut_lineage
from acctlens.settings import DetectSpec


def choice(n_dbscan: Column, n_hdbscan: Column, available: Column, score_dbscan: Column, score_hdbscan: Column) -> Column:
    """D9 as a column.  With validity scores available: HDBSCAN if its score is defined and DBSCAN's
    isn't larger, else DBSCAN (also when neither is defined).  Without: HDBSCAN if it flagged
    anything, else DBSCAN."""
    by_score = score_hdbscan.isNotNull() & (score_dbscan.isNull() | (score_hdbscan >= score_dbscan))
    by_flags = F.coalesce(n_hdbscan, F.lit(0)) > 0
    return F.when(F.when(available, by_score).otherwise(by_flags), F.lit("HDBSCAN")).otherwise(F.lit("DBSCAN"))


def combine(density_flag: Column, forest_flag: Column, method: str,
            second: str = "iforest") -> tuple[Column, Column]:
    """flag = density OR forest; type both / <method>_only / iforest_only / normal."""
    d, f = density_flag == 1, forest_flag == 1
    flag = (d | f).cast("int")
    typ = (F.when(d & f, F.lit("both")).when(d, F.lit(f"{method.lower()}_only"))
           .when(f, F.lit(f"{second}_only")).otherwise(F.lit("normal")))
    return flag, typ


@dataclass
class Detection:
    accounts: DataFrame     # statistics + dbscan/hdbscan/iforest flags + outlier_flag + outlier_type
    metadata: DataFrame     # D11, one row
    method: str
    eps: float
    threshold: float


def detect(stats: DataFrame, spec: DetectSpec = DetectSpec(), hdbscan_flags: DataFrame | None = None) -> Detection:
    """Account statistics (A1–A7) → standardised features → DBSCAN noise, HDBSCAN noise,
    Isolation Forest → chosen density method (D9) → combined flag and type (D10).
    ``hdbscan_flags``: Account, hdbscan_cluster, hdbscan_outlier, where they are known already."""
    stats = cut_lineage(stats)
    feat = cut_lineage(RS.feature_matrix(stats))
    db = DN.dbscan(feat, spec.k_for_eps, spec.eps_percentile, spec.dbscan_min_samples)
    db_labels = cut_lineage(DN.cluster_labels(db))
    hd = cut_lineage(HD.hdbscan(feat, spec.hdbscan_min_cluster_size, spec.hdbscan_min_samples)
                     if hdbscan_flags is None else hdbscan_flags)
    fo, thr = FO.isolation_forest(feat, spec.contamination, spec.n_trees, spec.max_samples, spec.random_state)
    acc = cut_lineage(stats.join(db.flags.select("Account", "dbscan_outlier"), "Account").join(fo, "Account")
                      .join(hd.select("Account", "hdbscan_outlier"), "Account", "left"))
    hd_labels = hd.select("Account", F.col("hdbscan_cluster").alias("cluster"))
    scores = (None, None)
    if spec.use_validity:
        scores = VA.validity(feat, db_labels), VA.validity(feat, hd_labels)
    known = [F.lit(v).cast("double") for v in scores]
    method = acc.agg(choice(F.sum("dbscan_outlier"), F.sum("hdbscan_outlier"), F.lit(spec.use_validity), *known).alias("m")).first()["m"]
    dens = F.col("hdbscan_outlier") if method == "HDBSCAN" else F.col("dbscan_outlier")
    flag, typ = combine(dens, F.col("iforest_outlier"), method)
    acc = cut_lineage(acc.select("*", flag.alias("outlier_flag"), typ.alias("outlier_type")))
    clusters = db_labels.agg(F.count_distinct("cluster").alias("dbscan_clusters")).crossJoin(
        hd_labels.agg(F.count_distinct("cluster").alias("hdbscan_clusters")))          # one row each
    meta = metadata(acc, method, spec.contamination, db.eps, thr, scores).crossJoin(clusters)
    return Detection(acc, meta, method, db.eps, thr)


def metadata(acc: DataFrame, method: str, contamination: float, eps: float, thr: float,
             scores: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Chosen method, count per detector, combined count, settings, validity scores — one aggregate."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return acc.agg(
        F.lit(method).alias("density_method"),
        total("dbscan_outlier").alias("dbscan_outliers"), total("hdbscan_outlier").alias("hdbscan_outliers"),
        total("iforest_outlier").alias("iforest_outliers"), total("outlier_flag").alias("combined_outliers"),
        F.count(F.lit(1)).alias("n_accounts"),
        F.lit(float(contamination)).alias("contamination"), F.lit(float(eps)).alias("eps"),
        F.lit(float(thr)).alias("iforest_threshold"), F.lit(",".join(RS.FEATURES)).alias("feature_names"),
        F.lit(scores[0]).cast("double").alias("dbscan_validity"), F.lit(scores[1]).cast("double").alias("hdbscan_validity"))
