"""Sessions, the folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sievebench")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one on a local master and an error on any other."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        there = spark.sparkContext.getCheckpointDir()
        if there is None:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievebench-"))
            there = spark.sparkContext.getCheckpointDir()
        folder = there
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str = "table", old: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: no recomputation, and it survives lost executors.

    ``old``, a table of an earlier round that nothing needs any more, is deleted when the new one is there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    if old is not None:
        discard(old)
    return table


def files_of(table: DataFrame) -> list[str]:
    """The parquet files of a table that ``materialise`` wrote."""
    place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.shared_path)
    found = place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().endswith(".parquet"))


def opened(file: str):
    """A file of the shared folder for reading in a task."""
    if file.startswith("file:") or "://" not in file:
        return fs.LocalFileSystem().open_input_file("/" + file.removeprefix("file:").lstrip("/"))
    system, path = fs.FileSystem.from_uri(file.replace("s3a://", "s3://", 1))
    return system.open_input_file(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote; other tables are left alone."""
    path = getattr(table, "shared_path", None)
    if path:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_utf8(column: str):
    """Text as bytes, so that a malformed string cannot stop a Python worker."""
    return F.col(column).cast("binary")
