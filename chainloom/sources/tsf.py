"""TSF files: ``#`` comments, ``@`` attributes, then lines ``name:start:comma-separated values``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsf(spark: SparkSession, path: str) -> DataFrame:
    """(series_name, start_ts, frequency, x); missing values (``?``) are null elements."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    frequency = lines.filter(F.col("line").startswith("@frequency")).select("file", F.element_at(F.split("line", r"\s+"), 2).alias("frequency"))
    data = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("@"))
    parts = [F.get(F.split("line", ":", 3), k) for k in range(3)]  # lines without colons give nulls
    values = F.transform(F.split(parts[2], ","), lambda v: F.when(F.trim(v) == "?", None).otherwise(F.trim(v)).cast("double"))
    start = F.to_timestamp_ntz(parts[1], F.lit("yyyy-MM-dd HH-mm-ss"))
    rows = data.select("file", parts[0].alias("series_name"), start.alias("start_ts"), values.alias("x"))
    return rows.join(frequency, "file", "left").drop("file")


# Frequency names of the TSF format and their steps.
STEPS = {
    "secondly": "1 second", "4_seconds": "4 second", "minutely": "1 minute", "10_minutes": "10 minute", "15_minutes": "15 minute", "half_hourly": "30 minute",
    "hourly": "1 hour", "daily": "1 day", "weekly": "7 day", "monthly": "1 month", "quarterly": "3 month", "yearly": "1 year",
}


def exploded(series: DataFrame) -> DataFrame:
    """(series_name, ts, v): one row for each value, by the frequency's step (days if the file names none).
    A frequency that isn't known fails the query."""
    long = series.select("series_name", "start_ts", "frequency", F.posexplode("x").alias("i", "v"))
    known = F.col("frequency").isNull() | (F.col("frequency") == "daily")
    ts = F.when(known, F.timestamp_add("DAY", F.col("i"), F.col("start_ts")))
    for name, step in STEPS.items():
        n, unit = step.split()
        ts = ts.when(F.col("frequency") == name, F.timestamp_add(unit.upper(), F.col("i") * int(n), F.col("start_ts")))
    failed = F.raise_error(F.concat(F.lit("the frequency isn't known: "), F.col("frequency"))).cast("timestamp_ntz")
    return long.select("series_name", ts.otherwise(failed).alias("ts"), "v")
