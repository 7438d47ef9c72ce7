"""What pairs of series take on disk."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chainloom.operators import overlap
from chainloom.plans import models

DISTINCT, TIMES, LENGTH = 1009, 6, 16


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """A table that repeats its series with shifted ids."""
    folder, random = tmp_path_factory.mktemp("copies"), np.random.default_rng(5)
    values = list(np.tile(random.normal(0, 0.1, (DISTINCT, LENGTH)), (TIMES, 1)))
    label = pa.array(np.arange(len(values)) % 10, pa.int32())
    pq.write_table(pa.table({"vec_id": np.arange(len(values)), "embedding": pa.array(values, pa.list_(pa.float32())), "label": label}), folder / "embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name, places, of", [("overlap_matrix", 5, lambda o: o), ("rlf_kernel", 8, lambda o: 2 ** (o / np.log(10)))])
def test_pairs_of_copies_are_short_on_disk(spark, copies, tmp_path, name, places, of):
    models.QUERIES[name](spark, copies).write.parquet(str(tmp_path / "out"))
    q, i, found = (c.to_numpy() for c in pq.read_table(tmp_path / "out").columns)
    x = np.array([r.x for r in models._unit(spark, copies).orderBy("series_id").collect()])
    assert len(found) == len(set(zip(q, i))) == len(x) * len(x[::20]) and not (q % 20).any()
    assert all(np.abs(found[q == k] - of(np.log(np.abs(np.cos(np.pi / 2 * (x[k] - x[i[q == k]])))).sum(axis=1))).max() < 10.0**-places for k in range(0, len(x), 20))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "out").glob("*.parquet")]
    assert sum(m.row_group(g).column(2).total_compressed_size for m in files for g in range(m.num_row_groups)) < 4 * len(found)  # 8 bytes a row where copies are strewn


def scratch(spark):
    spark._jvm.System.gc()
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()))


@pytest.mark.parametrize("kind", [overlap.overlaps, overlap.nearest])
def test_series_are_shuffled_once_and_not_for_each_block_of_queries(spark, kind):
    x = np.random.default_rng(7).random((3000, 64))
    s = spark.createDataFrame(spark.sparkContext.parallelize([(k, v.tolist()) for k, v in enumerate(x)], 4), "series_id long, x array<double>")
    before = scratch(spark)
    found = kind(s, s.filter("series_id % 20 = 0"), overlap.log_overlap, block=4, broadcast_bytes=0)
    assert found.toArrow().num_rows == (450_000 if kind is overlap.overlaps else 150)
    assert scratch(spark) - before < 3 * x.nbytes  # there are 38 blocks of queries
