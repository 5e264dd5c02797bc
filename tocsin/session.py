"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "tocsin", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with AQE on. ``master`` stays unset on a cluster (spark-submit names it)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship_package() -> None:
    """Send this package's state machines to the Python workers by value.

    They then run wherever the package is not installed, the stateful-streaming helper process included.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of ``spark.checkpoint.dir``.

    The cluster names a shared folder there. Only a session that runs in one process on one machine
    (``local[...]``) may leave it unset; it then uses a temporary folder. Elsewhere that would put
    each executor's part on its own disk, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tocsin-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, label: str):
    """Write ``df`` to the shared folder and read it back: survives executor loss, unlike a cache."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
