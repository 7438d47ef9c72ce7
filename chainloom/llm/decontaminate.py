"""Benchmark decontamination by template canonicalisation.

Words lose case and outer signs; numbers, units after numbers and names (capitalised
words inside a sentence) become typed placeholders, whose values are kept as slots.
Windows of ``WINDOW`` canonical words (or of all words of a shorter item, ``LEAST_ITEM``
at least) with at least ``LEAST_LITERAL`` literal words are hashed on both sides and
hash-joined. An item without such a window takes the shortest longer ones that have
enough literal words, up to ``LONGEST_WINDOW``. Every window is hashed a second time on its words alone (lower case, without
signs, no placeholders), so a copy in other case or with other punctuation, where other
words look like names, and a window with few literals still match word for word. Along one
alignment of a document with an item, each slot value of the item must stand for one
value of the document (two values may get the same new one); then the question has been
copied or given other parameters, otherwise its template only looks alike. A document
is contaminated by an item if consistent alignments or literal matches cover at least
``LEAST_COVER`` of all the item's windows, or of those with enough literal words, or if
one alignment holds ``LEAST_RUN`` or more words of the item word for word.

What isn't found, by intent: copies of less than half an item that are shorter than
``LEAST_RUN`` words, items of fewer than ``LEAST_ITEM`` words (``short_items`` counts
them), items reworded so that no window of ``WINDOW`` words is left, and other
parameters of items without ``LEAST_LITERAL`` literal words in ``LONGEST_WINDOW`` words.

Documents are read once: a bit map (``sized_bit_map``: 16 bits for a window, 8 MB at most)
of the benchmark's window hashes goes to the tasks, and only windows that it
knows leave them, so the shuffle holds a small share of the windows. The join after it
is exact; a window of a hot passage is split by Spark's skew join.

Defined results: null texts are empty and clean; items with fewer than ``LEAST_ITEM``
words can't be told from ordinary text and match nothing; repeated items count each;
rows of the same id are told apart by their texts; a null id gives a row with a null
id; empty tables give an empty table; other columns are ignored by ``matches`` and kept
by ``clean``.
"""

from __future__ import annotations

import re
from itertools import chain, compress

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import in_bit_map, map_rows, sized_bit_map, text_or_empty, written

WINDOW, LEAST_ITEM, LEAST_LITERAL, LEAST_COVER, LEAST_RUN = 8, 5, 4, 0.5, 13
LONGEST_WINDOW = 24  # of the templates of items that are dense with placeholders
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡«»¿–—‘’‚“”„…"
_NO_SIGNS = str.maketrans("", "", SIGNS)
# Common units and their short forms.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons tonne tonnes lb lbs pound pounds oz ounce ounces"
    " ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months"
    " year years km/h mph c f k celsius fahrenheit kelvin j kj cal kcal w kw v a hz khz mhz ghz pa kpa bar percent dollar dollars usd euro euros"
    " eur cent cents degree degrees byte bytes kb mb gb tb".split()
)
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:%|st|nd|rd|th)?").fullmatch
LITERAL_MASK = np.uint64(~np.uint64(15))
CAPITAL, IS_NUMBER, ENDS, UNIT = (np.uint64(1 << k) for k in range(4))
_rng = np.random.default_rng(77)
_MIX = _rng.integers(1, 1 << 63, LONGEST_WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NUM, _NAME, _UNIT = (np.uint64(xxhash.xxh64_intdigest(x) & ~15) for x in (b"<number>", b"<name>", b"<unit>"))


class Words(dict):
    """Word to its hash with flags in the low four bits; 0 for words of signs alone. Bounded memory."""

    MEMORY = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.MEMORY:
            self.clear()
        bare, found = word.strip(SIGNS), 0
        if bare:
            low, first = bare.lower(), bare[0]
            found = (xxhash.xxh64_intdigest(low if low.isalnum() else low.translate(_NO_SIGNS)) & ~15) or 16
            if first.isupper():
                found |= len(bare) == 1 or not bare.isupper()
            elif first.isdecimal() and NUMBER(bare):
                found |= 2
            found |= 4 * (word[-1] in ".!?:") | 8 * (low in UNITS)
        self[word] = found
        return found


_words = Words()


def canonical(text: str) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Hashes of the canonical words, which of them are placeholders, the words as they stand,
    and the hashes of all words without placeholders."""
    return canonical_all([text])[:4]


def canonical_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """``canonical`` of all texts one after another, and the number of the text that each word is of."""
    lists = [t.split() for t in texts]
    words, text = list(chain.from_iterable(lists)), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    real = h != 0
    if not real.all():
        words, text, h = list(compress(words, real)), text[real], h[real]
    if not len(h):
        return h, np.zeros(0, bool), words, h, text
    first = np.r_[True, text[1:] != text[:-1]]
    begins = first | np.r_[True, (h[:-1] & ENDS) > 0]
    number = (h & IS_NUMBER) > 0
    unit = ((h & UNIT) > 0) & np.r_[False, number[:-1]] & ~first
    name = ((h & CAPITAL) > 0) & ~begins & ~number & ~unit
    bare = h & LITERAL_MASK
    h = bare.copy()
    h[number], h[unit], h[name] = _NUM, _UNIT, _NAME
    return h, number | unit | name, words, bare, text


def window_hashes(h: np.ndarray, slots: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that have enough literal words."""
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    held = np.r_[0, np.cumsum(slots)]
    starts = np.flatnonzero(size - (held[size:] - held[:-size]) >= min(LEAST_LITERAL, size))
    return starts, _mixed(h, size)[starts]


def literal_hashes(bare: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows, of their words without placeholders."""
    return _mixed(bare, size, 64) if len(bare) >= size else np.zeros(0, np.uint64)


def _mixed(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    n = len(h) - size + 1
    total = np.full(n, size + salt, np.uint64)
    for k in range(size):
        total += h[k : k + n] * _MIX[k]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(29))


def slot_values(words: list[str], slots: np.ndarray, start: int, size: int) -> list[str]:
    return [words[i].strip(SIGNS).lower() for i in range(start, start + size) if slots[i]]


def item_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, size, at, n_windows, n_filled, literal, filled, hash, item_slots): of each window of each item
    a literal row, and a row of its template if it is ``filled`` with enough literal words."""

    def make(columns):
        out = {k: [] for k in ("item_id", "size", "at", "n_windows", "n_filled", "literal", "filled", "hash", "item_slots")}
        for item, text in zip(*columns):
            h, slots, words, bare = canonical(text)
            size = min(WINDOW, len(h))
            if size < LEAST_ITEM:
                continue
            longer = next((n for n in range(size, min(len(h), LONGEST_WINDOW) + 1) if len(window_hashes(h, slots, n)[0])), size)
            starts, hashes = window_hashes(h, slots, longer)
            every, filled = literal_hashes(bare, size).view(np.int64).tolist(), set(starts.tolist())
            found = [(longer, s, False, True, x, slot_values(words, slots, s, longer)) for s, x in zip(starts.tolist(), hashes.view(np.int64).tolist())]
            found += [(size, s, True, s in filled, x, []) for s, x in enumerate(every)]
            for n, s, literal, full, x, values in found:
                for k, v in zip(out, (item, n, s, len(every), len(starts), literal, full, x, values)):
                    out[k].append(v)
        return out

    schema = "item_id long, size int, at int, n_windows int, n_filled int, literal boolean, filled boolean, hash long, item_slots array<string>"
    return map_rows(benchmark.select(F.col(id_col).cast("long"), text_or_empty(text_col)), make, schema)


def document_windows(docs: DataFrame, id_col: str, text_col: str, windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, doc_at, hash, doc_slots) of the windows that the bit map knows."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(sized_bit_map(windows.select("hash")))
    sizes = [(r.size, r.literal) for r in windows.select("size", "literal").distinct().collect()]  # within LEAST_ITEM and LONGEST_WINDOW

    def make(columns):
        out = {k: [] for k in ("doc_id", "text_hash", "doc_at", "hash", "doc_slots")}
        h, slots, words, bare, of = canonical_all(columns[2])
        begin = np.searchsorted(of, np.arange(len(columns[2])))
        for size, literal in sizes:
            if literal:
                hashes = literal_hashes(bare, size)
                starts = np.arange(len(hashes))
            else:
                starts, hashes = window_hashes(h, slots, size)
            hit = np.flatnonzero(in_bit_map(known.value, hashes.view(np.int64)))
            hit = hit[of[starts[hit]] == of[starts[hit] + size - 1]]  # not across two texts
            for s, x, row in zip(starts[hit].tolist(), hashes[hit].view(np.int64).tolist(), of[starts[hit]].tolist()):
                values = [] if literal else slot_values(words, slots, s, size)
                for k, v in zip(out, (columns[0][row], columns[1][row], s - int(begin[row]), x, values)):
                    out[k].append(v)
        return out

    text = text_or_empty(text_col)
    return map_rows(docs.select(F.col(id_col).cast("long"), F.xxhash64(text), text), make, "doc_id long, text_hash long, doc_at int, hash long, doc_slots array<string>", max_rows=300)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_cover: float = LEAST_COVER, least_run: int = LEAST_RUN) -> DataFrame:
    """(doc_id, text_hash, item_id, cover, same_slots): the items that contaminate each document."""
    items = written(item_windows(benchmark, item_col, item_text_col), "items")
    found = document_windows(docs, id_col, text_col, items).join(items, "hash")
    found = found.filter(F.size("doc_slots") == F.size("item_slots"))
    item = ("doc_id", "text_hash", "item_id", "n_windows", "n_filled")
    aligned = found.groupBy(*item, "literal", (F.col("doc_at") - F.col("at")).alias("shift")).agg(
        F.collect_set(F.struct("at", "filled")).alias("at"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))))).alias("pairs")
    )  # at most the windows of one item; literal rows have no pairs
    one_value = F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))) == F.size("pairs")
    good = aligned.filter(one_value).withColumn("same", F.forall("pairs", lambda p: p["i"] == p["d"]))
    run = F.when(F.col("literal"), F.size("at"))  # so many windows of one alignment, word for word
    covered = good.select(*item, "same", run.alias("run"), F.inline("at"))
    covered = covered.groupBy(*item).agg(
        F.count_distinct("at").alias("n"), F.count_distinct(F.when(F.col("filled"), F.col("at"))).alias("filled"), F.bool_or("same").alias("same_slots"), F.max("run").alias("run")
    )
    cover = F.greatest(F.col("n") / F.col("n_windows"), F.try_divide("filled", "n_filled"))
    enough = (F.col("cover") >= least_cover) | (F.col("run") >= least_run - WINDOW + 1)
    return covered.withColumn("cover", cover).filter(enough).select("doc_id", "text_hash", "item_id", "cover", "same_slots")


def short_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id) of the items that are too short to match anything."""

    def make(columns):
        return {"item_id": [i for i, t in zip(*columns) if len(canonical(t)[0]) < LEAST_ITEM]}

    return map_rows(benchmark.select(F.col(id_col).cast("long"), text_or_empty(text_col)), make, "item_id long")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with the same columns."""
    bad = written(matches(docs, benchmark, id_col, text_col, **columns).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct(), "contaminated")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.join(bad, docs[id_col].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(text) == bad["bad_hash"]), "left_anti")


def op6_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document."""
    found = matches(docs, benchmark)
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.round(F.max("cover"), 6).alias("cover"), F.bool_or("same_slots").alias("same_slots"))
