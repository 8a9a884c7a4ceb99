"""Session helpers.

On a cluster the session is created by the launcher; nothing here overrides settings that are
already present.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` (the shared folder the
cluster names) and only sets one when it is unset, as in local tests.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "acctlens", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benchmarks."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    conf["spark.driver.memory"] = os.environ.get("ACCTLENS_DRIVER_MEMORY", "16g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_SHIPPED: set = set()


def ship_code(spark: SparkSession) -> None:
    """Make ``acctlens`` importable in the Python workers that run the pandas functions
    (forest, HDBSCAN batches, corpus operators): zip the package once per application and hand it
    to ``SparkContext.addPyFile``, which distributes it with the job."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="acctlens-code-"), "acctlens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dp, dn, fn in os.walk(pkg_dir):
            dn[:] = [x for x in dn if x != "__pycache__"]
            for f in fn:
                if f.endswith(".py"):
                    full = os.path.join(dp, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a scratch one only where the session has none."""
    ship_code(spark)
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: lineage cuts need a folder on shared "
                               "storage that every executor and the driver can reach")
        d = tempfile.mkdtemp(prefix="acctlens-ckpt-")     # local mode only (tests, benchmarks)
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    One computation (an RDD checkpoint computes its plan twice unless cached), columnar and
    compressed, with file statistics for later scans; it lives on shared storage, so losing an
    executor afterwards never forces a recomputation of the lineage.  Never machine-local."""
    spark = df.sparkSession
    path = checkpoint_dir(spark).rstrip("/") + f"/acctlens-{uuid.uuid4().hex}"
    # a folder nobody else reads: tasks may commit straight into it (exports keep Spark's default)
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)   # known schema: no footer-reading job


_CUTS: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, deleted with the tables of its ``scratch_scope``."""
    path = checkpoint_dir(spark).rstrip("/") + f"/{uuid.uuid4().hex}-{name}"
    _CUTS.append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Delete, at the end, every table that ``cut_lineage`` wrote inside the block; results that are
    to outlive it must have been written elsewhere (or collected) by then."""
    first = len(_CUTS)
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _CUTS[first:]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        del _CUTS[first:]


# Per-key side tables (per account, per fold × account) are broadcast only below this many rows
# (~tens of MB); above it the join stays a shuffle join that AQE can split when a key is hot.
BROADCAST_MAX_ROWS = 1_000_000


def sized_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, n_rows: int | None = None) -> DataFrame:
    """Broadcast hint behind a proven size bound: the row count of an already materialised
    table (a cheap job, skipped when the caller knows it); beyond the bound the plain
    DataFrame is returned."""
    n = n_rows if n_rows is not None else small.limit(max_rows + 1).count()
    return F.broadcast(small) if n <= max_rows else small
