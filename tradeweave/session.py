"""Spark session defaults, and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app_name: str = "tradeweave", memory: str = "16g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package wherever the driver was started from.

    Functions that Arrow runs are pickled by name.  Spark sends the archive to
    each executor itself; it is a few hundred kilobytes of source.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tradeweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tradeweave-source-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, source.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._tradeweave_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a local-mode session may fall back to a private temporary folder: on a
    cluster such a folder would be lost with the machine that holds it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    private = tempfile.mkdtemp(prefix="tradeweave-")
    atexit.register(shutil.rmtree, private, ignore_errors=True)
    sc.setCheckpointDir(private)
    return sc.getCheckpointDir()


#: Bytes that a byte of a table's files may take once its rows are read and listed: names and ids repeat, and files spell them once.
ROWS_PER_FILE_BYTE = 40.0
#: How stored tables are compressed: about half the bytes of Spark's default codec for names and ids.
TABLE_CODEC = "zstd"
_FILE_FACTOR = "spark.sql.sources.fileCompressionFactor"


def expect_compressed_files(spark: SparkSession) -> None:
    """Tell the planner that files are much smaller than their rows, unless the session already says more.

    It broadcasts by the size of files.  A few megabytes of them may be millions of rows, which
    the driver would gather and hash; adaptive execution still broadcasts what turns out to be small.
    """
    if float(spark.conf.get(_FILE_FACTOR)) < ROWS_PER_FILE_BYTE:
        spark.conf.set(_FILE_FACTOR, str(ROWS_PER_FILE_BYTE))


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return a scan of what was written.

    This is how lineage is cut: the files outlive any executor, and their size
    lets the planner choose joins from facts.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=TABLE_CODEC)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tradeweave-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path of this application in the shared folder."""
    return f"{_application_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_tables(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function like ``write_table`` whose tables are deleted when the block ends."""
    folder = new_folder(spark, name)

    def write(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path, compression=TABLE_CODEC)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield write
    finally:
        delete_folder(spark, folder)


def _folder(spark: SparkSession, folder: str):
    """The folder as a Hadoop path, and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if there is one, in whatever store its path names."""
    path, store = _folder(spark, folder)
    store.delete(path, True)


def make_folder(spark: SparkSession, folder: str) -> None:
    path, store = _folder(spark, folder)
    store.mkdirs(path)


def rename_folder(spark: SparkSession, folder: str, target: str) -> None:
    path, store = _folder(spark, folder)
    if not store.rename(path, _folder(spark, target)[0]):
        raise OSError(f"cannot rename {folder} to {target}")


def folder_names(spark: SparkSession, folder: str) -> list[str] | None:
    """Names of what is in a folder, or None if there is no such folder."""
    path, store = _folder(spark, folder)
    return sorted(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else None


def remove_written(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder, when it is done."""
    delete_folder(spark, _application_dir(spark))
