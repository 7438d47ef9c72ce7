"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target from its weight (targets stop at ``max_repeats`` times
the source's size; the excess goes to the others by weight until none is above).
A target is met by complete epochs of the source first; the rest is a weighted
sample without replacement: documents in the order of their exponential keys
``-ln(u) / quality``, summed up to the rest of the budget. Of the document on the
border the budget takes only the words that are left, so each source meets its
target to less than one word; ``mixture``, which gives whole texts alone, takes it
or not, whichever is nearer.

No source is gathered in one task. Keys fall into ``floor(BINS * ln(key))``, whose
sums by (source, bin) find the bin that the border lies in; only that bin of each
source is sorted, with one row for all rows of one id and text. ``u`` comes from a hash of id, text and seed, so reruns agree.

Quality weights are the share of distinct words in a text, at least 0.05.

Defined results: null texts have size 0 and are taken 0 times; null sources are a
source, last in order; equal keys are ordered by id and text hash; a source of
size 0 has target 0; an empty table gives an empty table; repeated rows are rows
of their own; columns other than id, source and text are ignored by ``mixed`` and
go along by ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.llm.common import map_rows, text_or_empty, written

BINS = 2048
LEAST_QUALITY = 0.05
MAX_REPEATS = 3
WEIGHTS = (5.0, 2.0, 1.0)
COPIES_AT_ONCE = 10_000
SIZES_SCHEMA = "doc_id long, source string, text_hash long, size long, quality double"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Size and quality weight of every text."""

    def make(columns):
        ids, sources, hashes, texts = columns
        words = [t.encode().split() for t in texts]
        return {
            "doc_id": ids, "source": sources, "text_hash": hashes,
            "size": [len(w) for w in words],
            "quality": [max(LEAST_QUALITY, len(set(w)) / len(w)) if w else LEAST_QUALITY for w in words],
        }

    text = text_or_empty(text_col)
    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.xxhash64(text), text), make, SIZES_SCHEMA)


def targets(sizes: list[int], weights: list[float], total: float, max_repeats: float = MAX_REPEATS) -> list[float]:
    """Shares of ``total`` by weight, none above ``max_repeats`` times its size; the excess goes to the rest by weight."""
    found = [0.0] * len(sizes)
    free, left = [i for i in range(len(sizes)) if sizes[i] > 0], float(min(total, max_repeats * sum(sizes)))
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit >= max_repeats * sizes[i]]
        for i in full or free:
            found[i] = float(max_repeats * sizes[i]) if full else weights[i] * unit
        if not full:
            break
        left -= sum(found[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return found


def source_plan(sizes: DataFrame, weights=WEIGHTS, share: float = 1.0) -> DataFrame:
    """(source, source_size, target, epochs, rest): one row for each source, from one row for each on the driver."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    n = [int(r.n) for r in rows]
    found = targets(n, [weights[i % len(weights)] for i in range(len(n))], share * sum(n))
    plan = []
    for r, size, target in zip(rows, n, found):
        epochs = int(target // size) if size else 0
        plan.append((r.source, size, target, epochs, int(round(target - epochs * size)) if size else 0))
    return sizes.sparkSession.createDataFrame(plan, "source string, source_size long, target double, epochs long, rest long")


def keyed(sizes: DataFrame, seed: int) -> DataFrame:
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    key = -F.log(uniform) / F.col("quality")
    return sizes.withColumn("key", key).withColumn("bin", F.floor(F.log("key") * BINS).cast("long"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.0, seed: int = 42) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, taken) of every row."""
    sizes = keyed(written(sized(docs, id_col, text_col, source_col), "sizes"), seed)
    return taken(sizes, source_plan(sizes, weights, share))


def taken(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    by_source = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = sizes.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))  # a bounded number of bins a source
    reached = bins.withColumn("upto", F.sum("bin_size").over(by_source))
    border = (
        reached.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("bin_size") < F.col("rest")))
        .select("s", F.col("bin").alias("border"), (F.col("rest") - F.col("upto") + F.col("bin_size")).alias("left"))
    )
    cut = plan.join(border.withColumnRenamed("s", "b"), F.col("source").eqNullSafe(F.col("b")), "left").drop("b").withColumnRenamed("source", "s")
    rows = sizes.join(written(cut, "cuts"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    columns = ["doc_id", "source", "text_hash", "size", "source_size", "target"]
    alike = rows.filter(F.col("bin") == F.col("border")).groupBy(*columns, "epochs", "left", "bin", "key").agg(F.count("*").alias("n"))
    within = Window.partitionBy("source", "bin").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_border = alike.withColumn("before", F.sum(F.col("size") * F.col("n")).over(within) - F.col("size") * F.col("n"))
    # back to one row for each row: in runs of copies, which are dealt anew, so that many copies aren't one task's
    runs = at_border.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPIES_AT_ONCE)))).repartition("text_hash", "first")
    copies = runs.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + COPIES_AT_ONCE, F.col("n")) - 1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before") - F.col("copy") * F.col("size")))
    others = rows.filter(F.col("border").isNull() | F.col("bin").isNull() | (F.col("bin") != F.col("border")))
    whole = F.when(F.col("bin") < F.col("border"), F.col("size")).otherwise(F.lit(0))
    made = lambda df, extra: df.select(*columns, (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))
    return made(others, whole).unionByName(made(copies, part))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.0, seed: int = 42) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row with the whole text for each time that a
    document is taken, where at least half of it counts as taken. Rows that agree in id,
    source and text stand for what was taken of all of them."""
    found = mixed(docs, id_col, text_col, source_col, weights, share, seed)
    found = written(found.groupBy("doc_id", "source", "text_hash", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("n_rows")), "taken")
    rows = docs
    if not found.filter("n_rows > 1").isEmpty():
        rows = docs.dropDuplicates([id_col, source_col, text_col])
    found = found.withColumn("times", F.floor(F.try_divide("taken", "size") + 0.5).cast("int")).filter("times > 0")
    same = (
        rows[id_col].cast("long").eqNullSafe(found["doc_id"])
        & rows[source_col].cast("string").eqNullSafe(found["source"])
        & (F.xxhash64(F.coalesce(rows[text_col].cast("string"), F.lit(""))) == found["text_hash"])
    )
    times = F.explode(F.array_repeat(F.lit(1), found["times"]))
    return rows.join(found, same).select(*[rows[c] for c in rows.columns], times.alias("__time")).drop("__time")


def op2_mixture(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
