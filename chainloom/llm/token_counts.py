"""Token counts: the exact token count of every prefix of a text.

For a byte-fallback BPE model the pieces of a text follow from a dynamic program
over prefixes: the last piece of prefix ``i`` is the one suffix piece ``t`` that
the merge rules keep apart from the last piece of prefix ``i - len(t)``, and the
count is that prefix's count plus one. A sequence of pieces is what the merges
give if and only if each two neighbours stay apart, since the first merge across
a border would take place in those two alone as well.

Texts are cut where no piece of the vocabulary reaches across: before a word mark
(the mark of a space), at line ends, and between a letter and a sign that follows
no letter in any piece. Counts of the parts add up, and parts seen before come
from a bounded memory.

``prefix_counts`` keeps, for each document, one signed byte for each prefix (the
change of the count), compressed. ``count_at`` and ``longest_within`` answer
questions on truncation and budgets from it without encoding again.

Defined results: null text counts as empty (0 tokens); repeated rows give
repeated results; an empty table gives an empty table; other columns are ignored
and never clash, since only the named ones are read.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import map_rows, text_or_empty

MARK = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, prefix_steps binary"


class PrefixCounter:
    """The dynamic program for one model file, with memories of bounded size."""

    MEMORY = 1_000_000
    REMEMBERED_LENGTH = 48

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("this model has pieces that hold a word mark after another character")
        held = {c for p in self.score for c in p}
        breaks = "".join(c for c in "\n\t\r" if c not in held)
        letter = re.compile(r"[^\W\d_]").match
        after = "".join(sorted({y for p in self.score for x, y in zip(p, p[1:]) if letter(x) and not letter(y)}))
        stop = re.escape(breaks)
        other, word = rf"(?:(?![{MARK}{stop}])[\W\d_])*", r"[^\W\d_]*"
        more = f"(?:[{re.escape(after)}]{other}{word})*" if after else ""
        self.parts = re.compile((f"[{stop}]|" if stop else "") + f"{MARK}*{other}{word}{more}", re.S).findall
        self.steps_of: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}
        self.pieces = [p for p in self.score if self.merged(p) == [p]]
        self.numbers = {p: i for i, p in enumerate(self.pieces)}
        self.suffixes = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            self.suffixes.add_word(p, (i, len(p)))
        self.suffixes.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for short strings: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stays_apart(self, a: int, b: int) -> bool:
        """Of two pieces by number."""
        if len(self.apart) > self.MEMORY:
            self.apart.clear()
        left, right = self.pieces[a], self.pieces[b]
        known = self.apart[a << 32 | b] = self.merged(left + right) == [left, right]
        return known

    def _number(self, t: str) -> int:
        """Single characters that aren't pieces get numbers as they are met."""
        if t not in self.numbers:
            self.numbers[t] = len(self.pieces)
            self.pieces.append(t)
        return self.numbers[t]

    def steps(self, part: str) -> bytes:
        """For each prefix of a part, the change of its token count, as a signed byte."""
        n = len(part)
        last, count, done = [-1] * (n + 1), [0] * (n + 1), 0
        known, test = self.apart.get, self._stays_apart
        for end, (number, size) in self.suffixes.iter(part):
            if end < done:
                continue
            while done < end:  # characters without a piece of their own
                done += 1
                last[done] = self._number(part[done - 1])
                count[done] = count[done - 1] + len(part[done - 1].encode())
            before = done + 1 - size
            if before:
                fits = known(last[before] << 32 | number)
                if fits is None:
                    fits = test(last[before], number)
                if not fits:
                    continue
            done += 1
            last[done] = number
            count[done] = count[before] + 1
        while done < n:
            done += 1
            count[done] = count[done - 1] + len(part[done - 1].encode())
        out = bytes([(y - x) & 255 for x, y in zip(count, count[1:])])
        if n <= self.REMEMBERED_LENGTH:
            if len(self.steps_of) > self.MEMORY:
                self.steps_of.clear()
            self.steps_of[part] = out
        return out

    def prefix_steps(self, text: str) -> bytes:
        """One byte for each character of the text; the first also holds the word mark set before it."""
        if not text:
            return b""
        known, new = self.steps_of.get, self.steps
        all_steps = b"".join([known(p) or new(p) for p in self.parts(MARK + text.replace(" ", MARK)) if p])
        first = int.from_bytes(all_steps[:1], signed=True) + int.from_bytes(all_steps[1:2], signed=True)
        return first.to_bytes(1, signed=True) + all_steps[2:]


_counters: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _counters:
        _counters[model_file] = PrefixCounter(model_file)
    return _counters[model_file]


def prefix_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, prefix_steps) of every row, whole texts, no shuffle."""

    def make(columns):
        c, pack = counter(model_file), zstandard.ZstdCompressor(level=1).compress
        ids, texts = columns
        steps = [c.prefix_steps(t) for t in texts]
        return {
            "doc_id": ids,
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps],
            "prefix_steps": [pack(s) for s in steps],
        }

    return map_rows(docs.select(F.col(id_col).cast("long"), text_or_empty(text_col)), make, SCHEMA)


def counts(prefix_steps: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... characters."""
    steps = np.frombuffer(zstandard.ZstdDecompressor().decompress(prefix_steps), np.int8)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def count_at(stored: DataFrame, n_chars: int) -> DataFrame:
    """(doc_id, n_tokens_at): tokens of the first ``n_chars`` characters (of all, if there are fewer)."""

    def make(columns):
        return {"doc_id": columns[0], "n_tokens_at": [int((c := counts(s))[min(n_chars, len(c) - 1)]) for s in columns[1]]}

    return map_rows(stored.select("doc_id", "prefix_steps"), make, "doc_id long, n_tokens_at long")


def longest_within(stored: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_chars): characters of the longest prefix that takes at most ``budget`` tokens."""

    def make(columns):
        return {"doc_id": columns[0], "n_chars": [int(np.flatnonzero(counts(s) <= budget)[-1]) if budget >= 0 else None for s in columns[1]]}

    return map_rows(stored.select("doc_id", "prefix_steps"), make, "doc_id long, n_chars long")


def op9_token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    found = prefix_counts(docs, model_file)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "prefix_steps")
