"""Centroid clustering: exact integer k-means whose assignments search an annulus.

Centroids are sorted by norm. The distance of a vector to the centroid of nearest norm bounds
the distance to its nearest one from above; by the triangle inequality every centroid
within that bound, ties included, has a norm within the bound of the vector's own. Two
binary searches give that run of centroids, and only those are compared, by exact integer
distances. Limits are widened by more than rounding can shift them, so no tie is lost.

Vectors become integers floor(scale * x) once, in a table in the shared folder that all rounds
read. A round is a scan without a shuffle of vectors: a task adds up its own vectors by
cluster, and Spark adds up the tasks' sums. The driver sees k centroids of d components, nothing
that grows with the table. A lost task reads its rows of the table again.

Defined results: vectors that are null, of another size, or with a null or non-finite component are
left out; repeated rows count as often as they come; rows of one id are told apart by their
components where the start is chosen; a null id hashes like an empty string; fewer
vectors than centroids give as many centroids as vectors; an empty table gives an empty
one; components beyond 2**27 after scaling fail the query, since distances would leave 64
bits; other columns are ignored and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import written

LARGEST, ROWS = 1 << 27, 4096


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(vec_id, v ARRAY<INT>) of the rows that hold ``size`` finite components."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(c.cast("double") * scale)
    fits = F.forall(x, lambda c: F.abs(c.cast("double") * scale) < LARGEST)
    checked = F.when(fits, F.transform(x, lambda c: whole(c).cast("int"))).otherwise(F.raise_error(F.lit("a component is too large for exact 64-bit distances")).cast("array<int>"))
    return df.filter((F.size(x) == size) & finite).select(F.col(id_col).cast("long").alias("vec_id"), checked.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of least hash of ``seed:id``, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


class Annulus:
    """Nearest centroids under squared Euclidean distance; of equal ones that of smaller number."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids**2).sum(axis=1)
        self.order = np.lexsort((np.arange(len(centroids)), squares))  # numbers by norm
        self.sorted, self.squares = centroids[self.order], squares[self.order]
        self.norms = np.sqrt(self.squares.astype(float))
        self.compared = 0  # distances that were worked out, for measurements

    def _distances(self, vectors: np.ndarray, squares: np.ndarray, at) -> np.ndarray:
        """Of rows to the centroid at one place of the order, or to one each."""
        c = self.sorted[at]
        dot = (vectors * c).sum(axis=1) if c.ndim == 2 else vectors @ c
        self.compared += len(vectors)
        return squares - 2 * dot + self.squares[at]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of int64 rows."""
        squares = (vectors**2).sum(axis=1)
        norms = np.sqrt(squares.astype(float))
        right = np.clip(np.searchsorted(self.norms, norms), 0, len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        close = np.where(np.abs(self.norms[left] - norms) <= np.abs(self.norms[right] - norms), left, right)
        best, number = self._distances(vectors, squares, close), self.order[close]
        reach = np.sqrt(best.astype(float))
        slack = 1e-9 * (norms + reach + 1)
        low, high = np.searchsorted(self.norms, norms - reach - slack), np.searchsorted(self.norms, norms + reach + slack, "right")
        for at in range(int(low.min()), int(high.max())) if len(vectors) else ():
            rows = np.flatnonzero((low <= at) & (at < high) & (close != at) & (np.abs(self.norms[at] - norms) <= reach + slack))
            if not len(rows):
                continue
            some = slice(None) if len(rows) == len(vectors) else rows
            d, n = self._distances(vectors[some], squares[some], at), self.order[at]
            better = (d < best[some]) | ((d == best[some]) & (n < number[some]))
            rows = rows[better]
            best[rows], number[rows], reach[rows] = d[better], n, np.sqrt(d[better].astype(float))  # the annulus shrinks
        return number, best


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and int64 vectors of up to ``ROWS`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part.column(0), part.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, size)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, inertia, sums) of the clusters that have vectors."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, inertia, sums = Annulus(centroids), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for _, v in blocks(batches, size):
            number, d = search.nearest(v)
            counts += np.bincount(number, minlength=k)
            np.add.at(inertia, number, d)
            by = np.argsort(number, kind="stable")
            held, starts = np.unique(number[by], return_index=True)
            sums[held] += np.add.reduceat(v[by], starts, axis=0) if len(held) else 0
        held = np.flatnonzero(counts)
        table = np.c_[counts, inertia, sums][held]  # a row for each cluster
        names, width = np.repeat(held.astype(np.int32), size + 2), np.tile(np.arange(size + 2, dtype=np.int32), len(held))
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(width), pa.array(table.ravel())], names=["cluster", "at", "s"])

    totals = vectors.mapInArrow(run, "cluster int, at int, s long").groupBy("cluster", "at").agg(F.sum("s").alias("s"))
    found = np.zeros((k, size + 2), object)
    for r in totals.collect():  # k (size + 2) numbers at most
        found[r.cluster, r.at] = r.s
    return [(c, n, inertia, sums) for c, (n, inertia, *sums) in enumerate(found.tolist()) if n]


def fitted(vectors: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after ``rounds`` of assignment and componentwise floor(sum / count); empty ones stay."""
    now = start.copy()
    for _ in range(rounds):
        for cluster, n, _, sums in cluster_sums(vectors, now):
            now[cluster] = [s // n for s in sums]
    return now


def clustered(df: DataFrame, k: int, rounds: int, seed: int, size: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray, DataFrame]:
    """The integer vectors (vec_id, v), the final centroids, and (vec_id, cluster, distance) of every vector."""
    vectors = written(integer_vectors(df, id_col, vector_col, size, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors, np.zeros((0, size), np.int64), vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    centroids = fitted(vectors, centroids, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(centroids)
        for ids, v in blocks(batches, size):
            number, d = search.nearest(v)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return vectors, centroids, vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def picked(cluster: Column, values: list, kind: str) -> Column:
    """The entry of a list of one value for each cluster."""
    return F.array(*[F.lit(v).cast(kind) for v in values])[cluster] if values else F.lit(None).cast(kind)


def op12_centroid_clusters(embeddings: DataFrame) -> DataFrame:
    vectors, centroids, found = clustered(embeddings, k=40, rounds=5, seed=2, size=64)
    inertia = [0] * len(centroids)
    for cluster, _, sum_of, _ in cluster_sums(vectors, centroids) if len(centroids) else ():
        inertia[cluster] = sum_of
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    c = F.col("cluster")
    return found.select("vec_id", "cluster", "distance", picked(c, inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), picked(c, digests, "string").alias("centroid_sha256"))


def _rounds_sql(rounds: int) -> str:
    out = []
    for r in range(rounds + 1):
        out.append(f"""d{r} AS MATERIALIZED (SELECT v.rid, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM v JOIN c{r} c USING (t) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            out.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.t, coalesce(m.x, c.x) AS x FROM c{r} c
LEFT JOIN (SELECT cluster, t, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM a{r} JOIN v USING (rid) GROUP BY ALL) m USING (cluster, t))""")
    return ",\n".join(out)


ORACLE_SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT rid, unnest(range(64)) AS t, floor(unnest(embedding)::DOUBLE * 256)::BIGINT AS x FROM kept),
c0 AS MATERIALIZED (SELECT rid AS cluster, t, x FROM v WHERE rid < 40),
{_rounds_sql(5)},
i AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a5 GROUP BY cluster),
h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY t)) AS centroid_sha256 FROM c5 GROUP BY cluster)
SELECT kept.vec_id, CAST(a5.cluster AS INTEGER) AS cluster, a5.distance, i.cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM i) AS inertia, h.centroid_sha256
FROM a5 JOIN kept USING (rid) JOIN i USING (cluster) JOIN h USING (cluster)"""
