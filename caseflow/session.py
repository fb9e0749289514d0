"""Session defaults that matter for correctness (UTC, ANSI) and for scale (AQE)."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "caseflow", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every module assumes.

    On a cluster ``master`` stays ``None`` so spark-submit decides; local runs
    pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and scratch outputs: the cluster's
    ``spark.checkpoint.dir``. Where none is set, a local session (``local[N]``: one host,
    as in tests) uses a folder under its warehouse, which every task can reach; any other
    master raises. Never a machine-local temporary folder."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
        d = d or sc.getCheckpointDir()
    except Exception:  # noqa: BLE001 -- Spark Connect has no SparkContext
        pass
    if not d:
        master = sc.master if sc is not None else ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        d = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new, uniquely named folder under the shared folder; removed when the program ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/caseflow/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 -- the session has ended already; the cluster's own clean-up applies
        pass
