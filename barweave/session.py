"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: set[tuple[str, str]] = set()


def configure(spark: SparkSession) -> SparkSession:
    """UTC time and adaptive execution; everything else stays as the cluster set it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def local(cpus: int = 8, shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    return configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("barweave")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )


def checkpoint_ready(spark: SparkSession) -> None:
    """Make sure reliable checkpoints have a home.

    The cluster names a shared folder in ``spark.checkpoint.dir``. A machine-local folder is only
    acceptable when driver and executors are the same process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)


def stored(df: DataFrame) -> DataFrame:
    """The frame written once below the checkpoint folder and read back: lineage ends there, a lost executor
    loses nothing, and later jobs read only the columns they need."""
    path = scratch(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, which every executor can reach; it goes when the application ends."""
    checkpoint_ready(spark)
    sc = spark.sparkContext
    root = f"{sc.getCheckpointDir()}/barweave"
    if (sc.applicationId, root) not in _ROOTS:
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS.add((sc.applicationId, root))
    return f"{root}/{name}-{uuid.uuid4().hex}"
