"""Tables in the folder that the driver and all executors share: they cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a URI without a final slash.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the
    session is local (tests) a temporary folder is made and kept for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='chainloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return (root if "://" in root else f"file://{root}").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/chainloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again, so what follows doesn't depend on
    shuffle files of executors that may be lost."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _folders[found] = path
    return found


_folders: WeakKeyDictionary = WeakKeyDictionary()  # of tables that ``written`` has made


def forget(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``written`` has made and that nothing reads any more."""
    for df in tables:
        if path := _folders.pop(df, None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
