"""Session settings and lineage cuts shared by every plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every plan here relies on: UTC day buckets, runtime re-planning,
# and splitting of skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


#: Folders of local sessions in which ``spark.checkpoint.dir`` is unset, by application.
_LOCAL_DIRS: dict[str, str] = {}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options on an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hammertrail")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local run, where
    that option is unset and driver and executors share one disk, gets a
    folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    # The option cannot be set on a running session, so the folder is kept here.
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="hammertrail-")
    return _LOCAL_DIRS[context.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written copy.

    The copy survives the loss of executors and keeps the plan of an
    iterative job from growing round by round.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input and is never broadcast.

    Spark broadcasts by the compressed size of a side. The rows of ids and hashes that it collects for that in the driver
    take about seven times as much, and the joins of a union collect theirs at once.
    """
    return df.hint("merge")
