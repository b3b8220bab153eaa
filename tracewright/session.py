"""Session helpers: table loading, session building and lineage cuts in the shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, object]] = []  # (file system, path) of each table that cut wrote
_own: list[str] = []


def build_session(app: str = "tracewright", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A local session that names none (as in tests) gets a temporary folder; a cluster must name
    one, as a folder of one machine would lose what the others wrote.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = have.get() if have.isDefined() else None
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tracewright-"))
        at = _own[0]
    return at


def cut(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that iterative plans stay short, survives lost executors, and gives the
    optimizer a measured size, by which it chooses between a broadcast and a shuffled join.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"tw-{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not _written:
        atexit.register(clear_cuts)  # after Spark's own exit handler, so that it runs before it
    _written.append((p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p))
    return spark.read.schema(df.schema).parquet(path)


def clear_cuts() -> None:
    """Delete what ``cut`` wrote. Runs at exit; a long session may call it once its results are stored."""
    while _written:
        files, path = _written.pop()
        try:
            files.delete(path, True)
        except Exception:  # the JVM is gone; its folder is the cluster's to clear
            pass
