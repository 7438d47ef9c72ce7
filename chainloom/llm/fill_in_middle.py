"""Fill-in-middle transformation: two cuts at unit borders found by overlapping chunks.

A border lies between two neighbouring characters for which a predicate holds, so a text
can be looked at in chunks of ``CHUNK`` characters, each with one character of the next:
no chunk depends on another. Pass one counts the borders of every chunk; prefix sums
of these counts say which chunk owns the border of a given rank; pass two scans
the one or two owning chunks again for the places. Scratch memory is a chunk's, whatever the
length of the text.

A text is one value of one row, so its chunks are met in the task that reads the row; nothing is
shuffled, and rows are the parallel axis of the cluster.

Defined results: a null text is an empty one, which is plain with no units; a null id
hashes like an empty string and comes back null; equal rows give equal results; an
empty table gives an empty one; other columns are ignored and may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import map_rows, text_or_empty

CHUNK = 1 << 16
SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
Border = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Whether a unit ends between two neighbouring code points.
BORDERS: dict[str, Border] = {
    "line": lambda left, right: left == 10,
    "word": lambda left, right: (left <= 32) & (right > 32),
    "character": lambda left, right: np.ones(len(left), bool),
}


def chunk_of(codes: np.ndarray, k: int, size: int) -> np.ndarray:
    """Chunk k, with the character after it."""
    return codes[k * size : (k + 1) * size + 1]


def border_counts(codes: np.ndarray, border: Border, size: int) -> np.ndarray:
    """Borders of each chunk; the last character of all has no neighbour."""
    pairs = (chunk_of(codes, k, size) for k in range(-(-max(len(codes) - 1, 0) // size)))
    return np.array([np.count_nonzero(border(c[:-1], c[1:])) for c in pairs], np.int64)


def cut_places(codes: np.ndarray, counts: np.ndarray, ranks: list[int], border: Border, size: int) -> list[int]:
    """Characters before the end of the unit of each rank (0: none, all units: all)."""
    upto, places = np.cumsum(counts), {0: 0, int(counts.sum()) + 1: len(codes)}
    for r in sorted(set(ranks) - places.keys()):
        k = int(np.searchsorted(upto, r))  # the first chunk that reaches the rank
        c = chunk_of(codes, k, size)
        places[r] = k * size + 1 + int(np.flatnonzero(border(c[:-1], c[1:]))[r - 1 - (upto[k] - counts[k])])
    return [places[r] for r in ranks]


def cuts(text: str, draws: tuple[int, int], border: Border, size: int = CHUNK) -> tuple[int, int, int]:
    """(units, characters before the first cut, before the second): cuts at the ranks draw % (units + 1)."""
    if not text:
        return 0, 0, 0
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    counts = border_counts(codes, border, size)
    n = int(counts.sum()) + 1
    return n, *cut_places(codes, counts, sorted(h % (n + 1) for h in draws), border, size)


def draws(seed: int, id_col: str, n: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers: 8-digit groups of the hexadecimal SHA-256 of ``seed:id``."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = "line", id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = SENTINELS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    ``form`` is psm or spm (which part comes first) or plain: for an empty text, one that holds a
    sentinel, and what ``percent`` leaves out. ``output`` is the whole transformed text.
    """
    p, s, m = sentinels
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    h1, h2, h3, h4 = draws(seed, "doc_id")
    held = F.contains("text", F.lit(p)) | F.contains("text", F.lit(s)) | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | held | (h3 % 100 >= percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    border = BORDERS[unit]

    def make(columns):
        out = {k: [] for k in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")}
        for doc_id, text, first, second, form in zip(*columns):
            n, a, b = cuts(text, (first, second), border, chunk)
            before, middle, after = text[:a], text[a:b], text[b:]
            made = {"plain": lambda: text, "psm": lambda: p + before + s + after + m + middle, "spm": lambda: s + after + p + before + m + middle}[form]()
            sizes = (None, None) if form == "plain" else (a, b - a)
            for k, v in zip(out, (doc_id, n, form, *sizes, made)):
                out[k].append(v)
        return out

    return map_rows(rows.select("doc_id", "text", h1, h2, form), make, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string", max_rows=500)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of a form was made of. No sentinel begins within another one or with
    another one's end, so the three that were put in are the only ones."""
    parts = F.split(output, "|".join(re.escape(x) for x in sentinels), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op13_fill_in_middle(docs: DataFrame) -> DataFrame:
    made = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, length(text) - length(replace(text, chr(10), '')) + (text <> '' AND right(text, 1) <> chr(10))::INT AS n,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM l),
p AS (SELECT *, CASE WHEN a = 0 THEN '' WHEN a = n THEN text ELSE array_to_string(lines[1:a], chr(10)) || chr(10) END AS pre,
  CASE WHEN b = 0 THEN '' WHEN b = n THEN text ELSE array_to_string(lines[1:b], chr(10)) || chr(10) END AS upto FROM c),
q AS (SELECT doc_id, n, text, plain, h4, pre, substr(upto, length(pre) + 1) AS mid, substr(text, length(upto) + 1) AS suf FROM p)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
  sha256(CASE WHEN plain THEN text WHEN h4 % 100 < 50 THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM q"""
