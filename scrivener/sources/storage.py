"""Files between the steps of a query: in the folder that all executors share."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. Where it is unset, a session in one machine gets a temporary folder;
    on a cluster, whose executors would each write to a disk of their own, that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scrivener-"))
    return sc._jsc.sc().getCheckpointDir().get()


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/scrivener-files/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once and read back: its rows stay what they are, whatever is lost."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def renamed(spark: SparkSession, path: str, to: str) -> bool:
    """Rename a complete folder into place, in one step where the file system can; False, with the folder
    deleted, if another was there before it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(files.makeQualified(hadoop.Path(path)), files.makeQualified(hadoop.Path(to)), spark._sc._gateway.new_array(hadoop.Options.Rename, 0))
        return True
    except Py4JJavaError:
        there = fs.exists(hadoop.Path(to))
        fs.delete(hadoop.Path(path), True)
        if not there:
            raise
        return False
