"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str | int = "*", app: str = "veritrail") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    parallelism = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parallelism))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.sources.fileCompressionFactor", "4.0")  # files unpack; broadcast by what they hold
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; their Python workers import it."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="veritrail-package-"), "veritrail.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as target:
        for folder, _, files in os.walk(root):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    target.write(path, os.path.join("veritrail", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.append(application)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    Only a session on one machine (tests, a laptop) that names none gets a local folder; a cluster must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        given = context._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="veritrail-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_path(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder name for one run of a job; it is removed when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    hadoop_path, files = _files(spark, path)
    files.deleteOnExit(hadoop_path)
    return path


def _files(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop_path, files = _files(spark, path)
    return files.exists(hadoop_path) and files.getFileStatus(hadoop_path).isDirectory()


def read_folder(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that a stream writes under ``path``; without rows where no batch has come yet."""
    hadoop_path, files = _files(spark, path)
    files.mkdirs(hadoop_path)
    return spark.read.schema(schema).parquet(path)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once for several readers,
    with no lineage to repeat when an executor is lost."""
    path = work_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Job:
    """The intermediate tables of one run, in a folder of their own in the shared folder.

    ``keep`` writes a table and reads it back, ``drop`` removes one that is no longer read, and ``finish``
    writes the result beside the folder, removes the folder and gives the result back.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.purpose = spark, purpose
        self.folder = work_path(spark, purpose)

    def keep(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = _files(self.spark, f"{self.folder}/{name}")
            files.delete(path, True)

    def finish(self, df: DataFrame) -> DataFrame:
        result = written(df, f"{self.purpose}-result")
        path, files = _files(self.spark, self.folder)
        files.delete(path, True)
        return result
