"""Shared helpers: table access, Arrow row mapping, bit maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.shared import forget, new_folder, shared_root, written  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def map_rows(df: DataFrame, make: Callable[[list[list]], dict[str, list]], schema: str, max_rows: int = 2000) -> DataFrame:
    """``mapInArrow`` with Python lists by column: ``make`` gets the columns of up to
    ``max_rows`` rows and returns the output columns by name."""
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max_rows):
                part = batch.slice(at, max_rows)
                made = make([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def bit_map(hashes: DataFrame, n_bits: int) -> np.ndarray:
    """``n_bits`` bits as uint32 words, set where a hash (the one bigint column) falls modulo
    ``n_bits``. Its size doesn't depend on the table; at most ``n_bits / 32`` rows reach the driver."""
    bit = F.pmod(F.col(hashes.columns[0]), F.lit(n_bits))
    rows = hashes.select((bit / 32).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int")).alias("b"))
    rows = rows.groupBy("word").agg(F.bit_or("b").alias("b")).filter("word IS NOT NULL").toPandas()
    words = np.zeros(n_bits // 32, np.uint32)
    words[rows["word"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return words


def sized_bit_map(hashes: DataFrame, most_bits: int = 1 << 26) -> np.ndarray:
    """A bit map of 16 bits or more for each row of ``hashes``, within 2**18 and ``most_bits``."""
    wanted = 16 * hashes.count()
    return bit_map(hashes, min(max(1 << 18, 1 << max(wanted - 1, 1).bit_length()), most_bits))


def in_bit_map(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the int64 hashes have their bit set."""
    bit = hashes % (32 * len(words))
    return (words[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
