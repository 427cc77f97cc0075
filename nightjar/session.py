"""Spark session helpers.

Cluster settings (``spark.checkpoint.dir``, shuffle partitions, AQE) are read
from the session; we only fill in values that are unset, which is the case in
local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "nightjar") -> SparkSession:
    """Return the active session or build a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = SparkSession.builder.appName(app_name).master(master or f"local[{cpus}]")
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    b = b.config("spark.driver.memory", os.environ.get("NIGHTJAR_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Nothing changes where PYTHONPATH already leads there. On a cluster whose
    machines do not share that folder, submit the package with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in (env.get("PYTHONPATH", ""), os.environ.get("PYTHONPATH", "")) if p]
    if not any(root in p.split(os.pathsep) for p in known):
        env["PYTHONPATH"] = os.pathsep.join([root, *known[:1]])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is used when set. Where it is unset, a local
    master (tests) gets a scratch folder; on a cluster that would be a folder
    of one machine, so the call raises instead.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="nightjar-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def ensure_utc(spark: SparkSession) -> None:
    """Streaming watermarks need TIMESTAMP (not NTZ); we cast under UTC."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def partitions_for(df, target_bytes: int = 128 * 1024 * 1024, rows: int | None = None) -> int:
    """Partition count for an explicit repartition of ``df``: about
    ``target_bytes`` per partition, at least the cluster's default parallelism.

    With ``rows`` (a measured count) the size is rows times the width of the
    schema. Without it Catalyst's estimate is used, which is good for scans but
    can be inflated by orders of magnitude above joins: give ``rows`` there."""
    from nightjar.functions.joins import estimated_bytes
    floor = max(1, df.sparkSession.sparkContext.defaultParallelism)
    if rows is not None:
        size = rows * (16 + df._jdf.schema().defaultSize())
    else:
        size = estimated_bytes(df)
        size = None if size is None or size > 1 << 55 else size     # RDD-backed frames: no estimate
    return floor if size is None else int(max(floor, -(-size // target_bytes)))


class shuffle_partitions:
    """Context manager: use ``n`` shuffle partitions for the actions run inside
    (iterative operators execute their rounds eagerly), then restore."""

    def __init__(self, spark, n: int):
        self.spark, self.n, self.old = spark, int(n), None

    def __enter__(self):
        self.old = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(self.n))
        return self

    def __exit__(self, *exc):
        self.spark.conf.set("spark.sql.shuffle.partitions", self.old)
        return False


class file_per_task:
    """Context manager: actions run inside read each file in a task of its own
    (larger files in more), instead of as many as make up a task's bytes. Lists
    of few values shrink so much in a file that its bytes tell little of its rows."""

    KEY = "spark.sql.files.openCostInBytes"

    def __init__(self, spark):
        self.spark, self.old = spark, None

    def __enter__(self):
        self.old = self.spark.conf.get(self.KEY)
        self.spark.conf.set(self.KEY, self.spark.conf.get("spark.sql.files.maxPartitionBytes"))
        return self

    def __exit__(self, *exc):
        self.spark.conf.set(self.KEY, self.old)
        return False
