"""Session defaults and the shared work folder.

Intermediate tables (CSV round trips, model artifacts, checkpoints) go
under the folder the cluster names in ``spark.checkpoint.dir``.  Only when
that is unset (local tests) do we pick one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "riskloom", driver_memory: str | None = None) -> SparkSession:
    """Session for local runs and tests (on a cluster the platform's session is used).

    In local mode the driver JVM is also the executor, so ``driver_memory``
    is the heap every task shares; it only applies when this call starts the JVM.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        # broadcast only below a checked size; AQE re-plans from runtime stats
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spark_context(spark: SparkSession):
    """The SparkContext, or None for sessions without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - connect sessions raise here
        return None


def app_id(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def parallelism(spark: SparkSession) -> int:
    sc = spark_context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.default.parallelism", "0") or 0) or int(
        spark.conf.get("spark.sql.shuffle.partitions", "200"))


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local-cluster`` has executors of its own)."""
    return master == "local" or master.startswith("local[")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session.  Where it is unset, a local session
    (tests) gets a folder under the system's temp folder, registered as the checkpoint folder too;
    on a cluster that would be another disk for every executor, so we raise.
    """
    sc = spark_context(spark)
    d = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not d:
        if sc is None or not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="riskloom-")
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared work folder."""
    return os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``riskloom`` importable in Python workers (what ``--py-files`` does).

    Operators that run Python on executors (Arrow batches in ``mapInPandas``
    / ``applyInPandas``) call this once per application: the package is
    zipped on the driver and distributed by Spark's file server.
    """
    import zipfile

    key = app_id(spark)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="riskloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("riskloom", os.path.relpath(full, pkg_dir)))
    sc = spark_context(spark)
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(key)


def spread(df, factor: int = 2):
    """Give CPU-heavy per-row work (tokenising, chunking) at least ``factor`` x
    the cluster's cores in tasks.  Only inputs with fewer partitions than that
    (e.g. one large file) are round-robin repartitioned; a scan that already
    has many splits, the normal case at scale, is left untouched, and so is a
    stream, whose micro-batches have their own splits."""
    if df.isStreaming:
        return df
    target = factor * parallelism(df.sparkSession)
    try:
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view on connect sessions
        return df
    return df.repartition(target) if n < target else df
