"""Session settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings every job relies on. AQE coalesces small shuffle partitions, splits skewed join
#: partitions and splits skewed rebalance partitions; UTC makes day boundaries reproducible.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Recording the Python call site of every column expression makes building a plan slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str = "tremorlake",
    master: str | None = None,
    hive: bool = False,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the engine's settings; ``settings`` wins over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if hive:
        builder = builder.enableHiveSupport()
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A session that names none gets a local folder if its master is ``local[...]``, as on a laptop or
    in a test; on a cluster, whose executors would not share that folder, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.tremorlake.localScratch", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{master}: set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tremorlake-")
        spark.conf.set("spark.tremorlake.localScratch", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared scratch folder that no other run uses."""
    return f"{scratch_root(spark)}/tremorlake/{label}-{uuid.uuid4().hex}"
