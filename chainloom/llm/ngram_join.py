"""N-gram Jaccard join: MinHash banding, then exact Jaccard on the full n-gram sets.

Texts are sets of 64-bit hashes of five lower-case words in a row (of all words, if
there are fewer). ``BANDS`` bands of ``ROWS`` rows find a pair of similarity 0.8 with
probability 1 - (1 - 0.8**8)**32 > 0.997, and one of 0.3 with less than 0.003.

1. One pass writes, for each row, a 128-bit key of its set and its band hashes.
   Copies meet in one row for each set (a sum in the tasks comes first), so a group of
   exact copies never grows beyond one row.
2. Sets that share a band hash are joined to the least set of that bucket, and
   connected components of these edges are the candidate groups. Pairs aren't listed.
3. The n-grams of candidates are dealt by group, once for each set and task; a group of
   more than ``BLOCK`` sets (or ``BLOCK_GRAMS`` n-grams) is cut into blocks by size of set, and
   each pair of blocks is a cell of its own, so that a cell fits in bounded memory. Groups of more
   than ``SMALL_BLOCK`` sets are cut into up to ``SPREAD`` blocks for the sake of balance. A set goes
   only to cells whose other block holds sizes from 4/5 to 5/4 of its own: no other set can reach
   the similarity. A cell counts the intersections of all
   its pairs by products of 0/1 matrices and gives one row for each set: its number of
   links and a spanning tree of them. All pairs of a candidate group are verified,
   so within a group no link is lost. A group of m different texts of like size sends each about
   m / ``BLOCK`` times, a chain of texts that grow only as often as such sizes fill blocks.
4. Classes are the components of verified links, named by their least document id.

Defined results: null texts are empty; texts without words are copies of each other
and link to nothing else; repeated rows are copies; rows with a null id take part and
don't name a class unless all its ids are null; an empty table gives an empty table;
other columns are ignored by ``joined`` and kept by ``representatives``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.llm.common import _arrow_schema, forget, in_bit_map, map_rows, sized_bit_map, text_or_empty, written
from chainloom.llm.components import components

WORDS, BANDS, ROWS = 5, 32, 8
NUMERATOR, DENOMINATOR = 4, 5  # similarity 0.8 as a fraction, compared in whole numbers
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
SMALL_BLOCK, SPREAD = 128, 16
REACH = math.ceil(1e9 * math.log(DENOMINATOR / NUMERATOR)) + 2  # between logarithms of sizes in 1e-9; the margin only adds pairs to verify
MOST_MAPPED = 1 << 22
_STEP = 4096

_rng = np.random.default_rng(20240229)
_MIX = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASHES = _rng.integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_MIX = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def grams(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams."""
    words = text.lower().encode().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    if not n:
        return h
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _MIX[k]
    return np.unique(_mixed(total))


def set_key(sorted_grams: np.ndarray) -> bytes:
    return hashlib.blake2b(sorted_grams.tobytes(), digest_size=16).digest()


def band_hashes(sorted_grams: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sorted_grams), _STEP):
        np.minimum(least, (sorted_grams[at : at + _STEP] * _HASHES).min(axis=1), out=least)
    return _mixed((_mixed(least).reshape(BANDS, ROWS) * _BAND_MIX).sum(axis=1, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def text_hashes(text) -> list:
    """128 bits of a text, as two columns."""
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(7), text).alias("text_b")]


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, set_key, node, n_grams, bands, text_a, text_b) of every row; ``node`` is the first half of the key."""

    def make(columns):
        sets = [grams(t) for t in columns[1]]
        keys = [set_key(s) for s in sets]
        return {
            "doc_id": columns[0], "set_key": keys, "node": [int.from_bytes(k[:8], "little", signed=True) for k in keys],
            "n_grams": [len(s) for s in sets], "bands": [band_hashes(s) if len(s) else [] for s in sets], "text_a": columns[2], "text_b": columns[3],
        }

    rows = docs.select(F.col(id_col).cast("long"), text_or_empty(text_col), *text_hashes(text_or_empty(text_col)))
    return map_rows(rows, make, "doc_id long, set_key binary, node long, n_grams long, bands array<long>, text_a long, text_b long", max_rows=500)


def candidate_groups(sets: DataFrame) -> DataFrame:
    """(node, component) of the sets that share a band hash with another one."""
    banded = sets.select("node", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most")
    edges = banded.join(written(buckets.select("bucket", "least"), "buckets"), "bucket").select(F.col("node").alias("u"), F.col("least").alias("v"))
    return components(edges.filter("u <> v"))


def placed(found: DataFrame) -> DataFrame:
    """``found`` (set_key, n_grams, component, ...) with the number of blocks of its group, its own block, and the
    first and last block that hold sizes it may link to. Blocks follow the order of sizes and are filled alike.
    The windows run over the distinct sizes of a group, which the longest text bounds, not over its sets."""
    by_size = Window.partitionBy("component").orderBy("n_grams")
    group, earlier = Window.partitionBy("component"), by_size.rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy("component").orderBy(F.round(1e9 * F.log("n_grams")).cast("long")).rangeBetween(-REACH, REACH)
    sizes = found.groupBy("component", "n_grams").agg(F.count("*").alias("m"))
    sizes = sizes.withColumn("weight", F.greatest(F.lit(1 / BLOCK), F.col("n_grams") / BLOCK_GRAMS))
    sizes = sizes.withColumns({
        "of_group": F.sum("m").over(group), "total": F.sum(F.col("m") * F.col("weight")).over(group),
        "before": F.coalesce(F.sum(F.col("m") * F.col("weight")).over(earlier), F.lit(0.0)),
    })
    spread = F.least(F.lit(SPREAD), F.ceil(F.col("of_group") / SMALL_BLOCK))
    sizes = sizes.withColumn("n_blocks", F.greatest(F.lit(1), spread, F.ceil("total")).cast("int"))

    def block(place):
        at = (F.col("before") + place * F.col("weight")) * F.col("n_blocks") / F.col("total")
        return F.least(F.floor(at), F.col("n_blocks") - 1).cast("int")

    sizes = sizes.withColumns({"first_near": F.min(block(F.lit(0))).over(near), "last_near": F.max(block(F.col("m") - 1)).over(near)})
    own = block(F.pmod(F.xxhash64("set_key"), F.col("m")))
    return found.join(sizes, ["component", "n_grams"]).select(*found.columns, "n_blocks", own.alias("block"), "first_near", "last_near")


CELL_SCHEMA = "component long, n_blocks int, set_key binary, node long, root long, links long"


def _links(sets: list[np.ndarray], sizes: np.ndarray, left: int) -> tuple[np.ndarray, list[int]]:
    """Of each set: how many documents of other sets it links to, and the root of its tree.
    ``left``: pairs are between the first ``left`` sets and the others, or all pairs if it is 0."""
    n = len(sets)
    grams_of = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(grams_of, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows, cols = (slice(0, left), slice(left, n)) if left else (slice(0, n), slice(0, n))
    common = np.zeros((rows.stop - rows.start, cols.stop - cols.start), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, _STEP):
        a, b = np.searchsorted(column, [at, at + _STEP])
        x = np.zeros((n, min(_STEP, width - at)), np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        common += x[rows] @ x[cols].T
    length = np.array([len(s) for s in sets], np.int64)
    both = length[rows, None] + length[None, cols] - common.astype(np.int64)
    linked = DENOMINATOR * common.astype(np.int64) >= NUMERATOR * both
    if not left:
        np.fill_diagonal(linked, False)
    counts = np.zeros(n, np.int64)
    counts[rows] = linked @ sizes[cols]
    if left:
        counts[cols] = sizes[rows] @ linked
    return counts, _roots(linked, n, left)


def _roots(linked: np.ndarray, n: int, left: int) -> list[int]:
    root = [-1] * n
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start], todo = start, [start]
        while todo:
            i = todo.pop()
            if left:
                near = np.flatnonzero(linked[i]) + left if i < left else np.flatnonzero(linked[:, i - left])
            else:
                near = np.flatnonzero(linked[i])
            for j in near.tolist():
                if root[j] < 0:
                    root[j] = start
                    todo.append(j)
    return root


def verified(candidates: DataFrame) -> DataFrame:
    """``candidates``: component, n_blocks, block, first_near, last_near, set_key, node, size, grams. One row for each set and cell."""
    cells = candidates.withColumn("other", F.explode(F.sequence("first_near", "last_near")))
    cells = cells.select("component", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "n_blocks", "set_key", "node", "size", "grams")
    n_tasks = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.expr("bigint(p) * n_blocks - bigint(p) * (p - 1) div 2 + q - p")  # of the cell in its group: cells of one group go to tasks in turn
    task = F.pmod(F.pmod(F.xxhash64("component"), F.lit(n_tasks)) + number, F.lit(n_tasks)).cast("int")
    dealt = cells.repartitionById(n_tasks, task).sortWithinPartitions("component", "p", "q", "block", "set_key")
    out = _arrow_schema(candidates.sparkSession, CELL_SCHEMA)

    def finish(cell: tuple, rows: list[tuple]) -> pa.RecordBatch:
        sets, sizes = [np.frombuffer(r[4], np.uint64) for r in rows], np.array([r[3] for r in rows], np.int64)
        left = sum(r[0] == cell[1] for r in rows) if cell[1] != cell[2] else 0
        if len(rows) < 2 or cell[1] != cell[2] and left in (0, len(rows)):
            counts, root = np.zeros(len(rows), np.int64), list(range(len(rows)))
        else:
            counts, root = _links(sets, sizes, left)
        columns = [[cell[0]] * len(rows), [cell[3]] * len(rows), [r[1] for r in rows], [r[2] for r in rows], [rows[k][2] for k in root], counts]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, done = None, [], []
        for batch in batches:
            for component, p, q, block, n_blocks, key, node, size, g in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != (component, p, q, n_blocks):
                    if rows:
                        done.append(finish(cell, rows))
                        if len(done) >= 500:
                            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                            done = []
                    cell, rows = (component, p, q, n_blocks), []
                if not rows or rows[-1][1] != key:  # sorted: the rows of one set from several tasks come one after another
                    rows.append((block, key, node, size, g))
        if rows:
            done.append(finish(cell, rows))
        yield from pa.Table.from_batches(done, schema=out).combine_chunks().to_batches()

    return dealt.mapInArrow(run, CELL_SCHEMA)


def candidate_grams(docs: DataFrame, id_col: str, text_col: str, found: DataFrame) -> DataFrame:
    """``found`` (one row for each candidate set) with the n-grams of its document of least id.

    Texts stay where they are read: a bit map of the wanted ids tells the tasks which rows
    may be wanted, and only the n-grams of those are shuffled, each set once for a task.
    Beyond ``MOST_MAPPED`` sets the bit map would say too little; the texts then meet the
    wanted ids by a shuffle.
    """
    text, doc_id = text_or_empty(text_col), F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id).alias("id_hash"), text.alias("text"))
    if found.count() > MOST_MAPPED:
        ids = found.select("least_id").distinct()
        rows, wanted = rows.join(ids.hint("merge"), rows["doc_id"].eqNullSafe(ids["least_id"]), "left_semi"), None
    else:
        wanted = docs.sparkSession.sparkContext.broadcast(sized_bit_map(found.select(F.xxhash64("least_id"))))
    seen: set[bytes] = set()  # of one task: each starts with its own copy

    def make(columns):
        out = {"doc_id": [], "key": [], "grams": []}
        hit = range(len(columns[0])) if wanted is None else np.flatnonzero(in_bit_map(wanted.value, np.array(columns[1], np.int64)))
        for i in hit:
            doc, g = columns[0][i], grams(columns[2][i])
            key = set_key(g)
            name = key + repr(doc).encode()
            if name not in seen:
                seen.add(name)
                for k, v in zip(out, (doc, key, g.tobytes())):
                    out[k].append(v)
        return out

    made = map_rows(rows, make, "doc_id long, key binary, grams binary", max_rows=500)
    same = (F.col("key") == F.col("set_key")) & F.col("doc_id").eqNullSafe(F.col("least_id"))
    return made.join(found, same).select("component", "n_blocks", "block", "first_near", "last_near", "set_key", "node", "size", "grams")


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of every row: the least id of its class, and the number
    of other documents at similarity 0.8 or more, copies included."""
    return classified(docs, id_col, text_col).select("doc_id", "class_id", "n_links")


def classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, class_id, n_links, class_key, text_a, text_b): ``class_key`` tells apart classes whose ids don't."""
    rows = written(signed(docs, id_col, text_col), "signed")
    sets = rows.groupBy("set_key").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("size"), F.first("node").alias("node"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    sets = written(sets, "sets")
    groups = candidate_groups(sets)
    found = written(placed(sets.drop("bands").join(groups, "node")), "candidates")
    candidates = candidate_grams(docs, id_col, text_col, found)
    cells = written(verified(candidates), "cells")
    whole = cells.filter("n_blocks = 1").select("set_key", F.col("root").alias("class_root"), "links")
    cut = cells.filter("n_blocks > 1")
    trees = components(cut.select(F.col("node").alias("u"), F.col("root").alias("v")))
    of_cut = cut.groupBy("set_key", "node").agg(F.sum("links").alias("links")).join(trees, "node").select("set_key", F.col("component").alias("class_root"), "links")
    classes = sets.select("set_key", "least_id", "size").join(whole.unionByName(of_cut), "set_key")
    named = classes.groupBy("class_root").agg(F.min("least_id").alias("class_id"))
    classes = written(classes.join(named, "class_root").select("set_key", "class_id", "class_root", "links"), "classes")
    every = sets.select("set_key", "node", "least_id", "size").join(classes, "set_key", "left")
    n_links = F.col("size") - 1 + F.coalesce("links", F.lit(0))
    every = written(every.select("set_key", F.when(F.col("links").isNull(), F.col("least_id")).otherwise(F.col("class_id")).alias("class_id"), n_links.alias("n_links"), F.coalesce("class_root", "node").alias("class_key")), "every")
    forget(sets, found, cells, classes)
    return rows.select("doc_id", "set_key", "text_a", "text_b").join(every, "set_key").select("doc_id", "class_id", "n_links", "class_key", "text_a", "text_b")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class, of the id that names it, with the same columns. Rows are told
    apart by id and text: an id, or no id, may name several classes."""
    naming = classified(docs, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    copies = naming.groupBy("class_key", "doc_id", "text_a", "text_b").agg(F.count("*").alias("n_rows"))
    kept = copies.groupBy("class_key").agg(F.min(F.struct("text_a", "text_b", "doc_id", "n_rows")).alias("k"))
    kept = written(kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_a").alias("kept_a"), F.col("k.text_b").alias("kept_b"), "k.n_rows"), "kept")
    a, b = text_hashes(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    same = docs[id_col].cast("long").eqNullSafe(kept["kept_id"]) & (a == kept["kept_a"]) & (b == kept["kept_b"])
    # about as many ids as documents: a join by shuffle at every size, whatever Spark would broadcast of a small input
    rows = docs.join(kept.hint("merge"), same, "left_semi")
    if kept.filter("n_rows > 1").isEmpty():
        return rows
    text = text_or_empty(text_col)
    marked = rows.withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(7), text)})
    return marked.dropDuplicates([id_col, "__a", "__b"]).drop("__a", "__b")  # equal rows of one id


def op1_ngram_join(docs: DataFrame) -> DataFrame:
    return joined(docs)
