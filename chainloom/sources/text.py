"""Delimited text series: label first, then the values, split at white space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_labelled(spark: SparkSession, path: str, stable: bool = True) -> DataFrame:
    """(series_id, label, x) of every line that isn't blank. Ids are hashes of the file's name, the line and its count
    among equal lines of the file, so they don't depend on how files are split; with ``stable=False`` they
    are only unique, and nothing is shuffled."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("file")).filter("line <> ''")
    if stable:
        same = F.row_number().over(Window.partitionBy("file", "line").orderBy("line"))
        lines = lines.withColumn("series_id", F.xxhash64("file", "line", same))
    else:
        lines = lines.withColumn("series_id", F.monotonically_increasing_id())
    rows = lines.withColumn("cells", F.transform(F.split("line", r"\s+"), lambda c: c.cast("double")))
    return rows.select("series_id", F.element_at("cells", 1).cast("int").alias("label"), F.slice("cells", 2, F.size("cells") - 1).alias("x"))


def read_splits(spark: SparkSession, train: str, validation: str, test: str) -> dict[str, DataFrame]:
    return {name: read_labelled(spark, path) for name, path in (("train", train), ("validation", validation), ("test", test))}


def write_labelled(series: DataFrame, path: str) -> None:
    """One line for each series: the label and the values, separated by spaces."""
    cells = F.concat(F.array(F.col("label").cast("double")), F.col("x"))
    series.select(F.concat_ws(" ", F.transform(cells, lambda v: v.cast("string"))).alias("value")).write.text(path)
