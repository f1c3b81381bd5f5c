"""Session settings the jobs rely on. All of them are runtime SQL settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Wall-clock columns are TIMESTAMP_NTZ and instants are formatted in UTC, so the
# session zone must not move with the machine. Skewed join keys are split at run
# time, also where the split costs an extra exchange.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "townhall", cores: str = "*", shuffle: int = 8, checkpoints: str | None = None) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder if checkpoints is None else SparkSession.builder.config("spark.checkpoint.dir", checkpoints)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Recording the call site of every expression makes wide plans slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def settle(df: DataFrame, by: list[str] | None = None, root: str | None = None) -> DataFrame:
    """Write an intermediate result that several outputs share to the checkpoint folder and read it back.

    The table survives lost executors and cuts the lineage, and its size is known to the
    plans that read it, so small ones are broadcast and hot keys of large ones are split.
    ``by`` names columns whose values get folders of their own, so that readers can skip the others. Inside ``scratch``
    the table goes when the block ends, unless ``root`` names another folder for it.
    """
    root = root or outer(df.sparkSession)
    path = f"{root}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCRATCH: list[str] = []


def outer(spark: SparkSession) -> str:
    """The folder ``settle`` writes to here: a ``root`` for tables that outlive a ``scratch`` block opened next."""
    return _SCRATCH[-1] if _SCRATCH else checkpoint_dir(spark)


def forget(df: DataFrame) -> None:
    """Remove a table that ``settle`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder below the checkpoint folder for the tables that ``settle`` writes inside the block; it is removed at the end.

    What leaves the block must have been written elsewhere before.
    """
    folder = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _SCRATCH.append(folder)
    try:
        yield folder
    finally:
        _SCRATCH.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A local session that names none, as in tests, gets a temporary folder of its own; a cluster is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all machines share")
    folder = tempfile.mkdtemp(prefix="townhall-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder
