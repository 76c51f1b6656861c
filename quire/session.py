"""Session helpers and the shared scratch location.

Intermediate tables (rendered fixtures, packing block tables, stream
checkpoints) live under ``spark.checkpoint.dir``, the shared folder a cluster
names for lineage cuts.  A private folder is created only when the session has
none (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app: str = "quire", extra: dict | None = None,
                checkpoint_dir: str | None = None) -> SparkSession:
    """A session with the library's defaults.  ``checkpoint_dir`` (or
    ``QUIRE_CHECKPOINT_DIR``) names the scratch folder; on a cluster it must be
    one that the driver and all executors share."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
    checkpoint_dir = checkpoint_dir or os.environ.get("QUIRE_CHECKPOINT_DIR")
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; set a private one only if unset."""
    try:
        sc = spark.sparkContext
    except Exception:  # remote sessions expose no SparkContext: use the conf
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return root
    root = sc.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver "
                                   "and all executors share")
            root = tempfile.mkdtemp(prefix="quire-ckpt-")  # one machine: local is shared
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint root (never reused)."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/quire-{name}-{uuid.uuid4().hex[:12]}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def materialize(df, name: str = "stage"):
    """Write ``df`` as Parquet under the checkpoint root and read it back.

    Cuts lineage (recomputation after a lost executor starts here), and
    later passes get column pruning and predicate pushdown on the written
    table -- unlike an RDD checkpoint."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ensure_parallelism(df, min_partitions: int | None = None):
    """Spread a scan that yields fewer partitions than the cluster can run
    (e.g. one large row group).  Well-split inputs are returned unchanged, so
    on a cluster reading many files this adds no shuffle."""
    spark = df.sparkSession
    try:
        target = min_partitions or spark.sparkContext.defaultParallelism
        current = df.rdd.getNumPartitions()
    except Exception:  # sessions without RDD access: leave the scan as is
        return df
    if current < target:
        return df.repartition(target)
    return df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable by Python workers on every executor: zip the
    package and ``addPyFile`` it, once per application.  The zip is an
    ordinary driver-local file that Spark's file server hands to executors, so
    no shared or remote path is touched.  Operators that run Python call this
    themselves; callers need not."""
    import zipfile

    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # no SparkContext access (e.g. a remote session)
        return
    if app in _SHIPPED:
        return
    import quire
    pkg = os.path.dirname(os.path.abspath(quire.__file__))
    root = os.path.dirname(pkg)
    target = os.path.join(tempfile.mkdtemp(prefix="quire-zip-"), "quire.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(app)
