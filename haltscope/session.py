"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

SESSION_DEFAULTS = {
    # Naive exchange-local timestamps are TIMESTAMP_NTZ; UTC keeps the few
    # TIMESTAMP (instant) columns free of daylight-saving jumps.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed streaming state survives executor loss and outgrows the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "haltscope", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the defaults this package expects."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needless where it is installed on all nodes; harmless there too.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-haltscope-"), "haltscope.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(home)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


_local_roots: dict[str, str] = {}


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder path (not created) for tables a job writes and reads back.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session without that setting (tests) falls back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        root = _local_roots.setdefault(app, tempfile.mkdtemp(prefix="spark-haltscope-"))
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
