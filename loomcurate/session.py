"""Session helpers that hold for every operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder stands in for it if the executors
    are threads of this machine; on a cluster, where such a folder would be another one on each machine, this raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/loomcurate-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _file_system(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of the JVM."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, there = _file_system(spark, path)
    files.deleteOnExit(there)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so a lost executor costs no recomputation.

    drop_written() removes the table as soon as nothing reads it any more; the end of the application removes the rest.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove a table that written() made and that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        files, there = _file_system(spark, file.partition("/part-")[0])
        files.delete(there, True)
