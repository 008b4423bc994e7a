"""Session building, runtime settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every query here relies on. All are runtime SQL settings, so they can
# also be applied to a session somebody else has built.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A task that writes a few folders keeps their files open instead of sorting all its rows by folder.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
    # Code beyond this size is not compiled by the Java machine; wide projections are then better made in several parts.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Streams keep their state on disk instead of in the heap, and write down what a batch has changed.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Counting the rows of the state would look each one up before it is written.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build(master: str | None = None, name: str = "opswell", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a run on this machine alone gets a fresh folder; on a cluster
    that would be a folder of the driver's machine, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df, codec=None):
    """The rows written once to the shared folder and read back.

    For rows that are costly to make and are needed several times: later steps
    read only the columns they use, and a lost executor does not bring back the
    work before this point.
    """
    spark = df.sparkSession
    path = scratch(spark, "settled")
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def spread(df):
    """Rows over all cores where the source has fewer splits than there are cores.

    For costly work on each row of a small file. A large source has more splits
    than cores; then the rows stay where they are and nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
