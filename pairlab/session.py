"""Session construction and the shared scratch location.

Work that must cut lineage or round-trip through files uses the folder named by
``spark.checkpoint.dir``.  On a cluster that setting points at shared storage and is
only read here; a private folder is created only when it is unset (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "pairlab",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session; master and shuffle partitions are only set for local runs, a submit command
    brings its own."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.appName(app)
    if master or "PYSPARK_GATEWAY_PORT" not in os.environ:
        b = (b.master(master or f"local[{cpus}]")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2)))
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("PAIRLAB_DRIVER_MEMORY", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Return the cluster's shared scratch folder (``spark.checkpoint.dir``).

    Only when the setting is absent (local tests) a private folder is made and set,
    so that checkpoint() and file round trips have somewhere to go.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="pairlab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared scratch folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set = set()


def ensure_importable(spark: SparkSession) -> None:
    """Ship this package to the executors' Python workers (the ``--py-files`` step),
    once per SparkContext, so Arrow UDFs that reference it can be unpickled there.
    The archive is written to the shared scratch folder."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    target = scratch_path(spark, "pairlab-pyfiles") + ".zip"
    local = target[len("file:"):] if target.startswith("file:") else target
    if "://" in local:  # remote shared storage: stage locally, Spark distributes it
        local = os.path.join(tempfile.mkdtemp(prefix="pairlab-zip-"), "pairlab.zip")
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(local)
    _SHIPPED.add(key)
