"""Token-ID / binary output: shards of separately compressed id arrays under one dictionary.

A store is a folder of shard files, a dictionary file and a table of shards. A
zstandard dictionary is trained on serialized id arrays of a bounded sample
(``DICTIONARY_DOCS`` documents, ``WINDOWS`` windows of ``WINDOW_IDS`` ids each);
each document is one frame, so that a single short document is read by one seek
and one small decompression.

Shard file, little-endian:
    8 bytes magic, 32 bytes SHA-256 of the dictionary, then the frames;
    index: for each document int64 id, uint8 has-id, uint64 offset, uint64 length, uint64 ids;
    trailer: uint64 documents, uint64 index offset, 8 bytes magic.

Documents are dealt by ranges of (id, text), so a hot id is split by its texts,
sorted within the range, encoded and written in the same task; shards roll over
at ``SHARD_BYTES``. A shard has a name of its own for each attempt and appears by one rename, and
the table of shards is committed by Spark, so lost, late and repeated tasks leave no partial result.

Defined results: null texts are empty (one end id); a null id sorts first and comes
back null; rows with the same id follow each other by a hash of the text, then by text; an empty table gives
a store without documents; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.llm.common import map_rows, new_folder, text_or_empty

MAGIC = b"CLTOKEN1"
ENTRY = np.dtype([("id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("length", "<u8"), ("n_ids", "<u8")])
SHARD_BYTES = 64 << 20
DICTIONARY_DOCS, WINDOWS, WINDOW_IDS, DICTIONARY_BYTES = 1024, 4, 1024, 64 << 10
SHARDS_SCHEMA = "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long, least_id long, greatest_id long"

#: A text is odd if a space stands before other white space or at the end, or if it holds the mark.
MARK = "\0"
ODD = r"\x00| ([\s\v\x{1c}-\x{1f}\x{85}\p{Z}]|\z)"
#: Marks go between a letter and a sign or digit after it, and round a line end between two signs.
BORDERS = ((r"(\p{L})([^\p{L} ])", "\\1\0\\2"), (r"(\pP|\pS|\pN)\n(\pL|\pP|\pS|\pN)", "\\1\0\n\0\\2"))
SLICE_BYTES, WORDS_AT_ONCE = 2 << 20, 4096


class Generations:
    """Ids by word, in two dictionaries of bounded size: when the young one is full it
    becomes the old one, and a word that is met again moves back. Frequent words stay."""

    SIZE = 200_000  # words in each, about 40 MB
    LONGEST = 48

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def found(self, words: list[str], encode) -> list[bytes]:
        """``encode`` gets the words that aren't known and returns the ids of each."""
        out = list(map(self.young.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        asked = [words[k] for k in missing]
        met = list(map(self.old.get, asked))
        made = iter(encode([w for w, ids in zip(asked, met) if ids is None]))
        met = [next(made) if ids is None else ids for ids in met]
        for k, ids in zip(missing, met):
            out[k] = ids
        short = {w: ids for w, ids in zip(asked, met) if len(w) <= self.LONGEST}
        if len(self.young) + len(short) > self.SIZE:
            self.young, self.old = {}, self.young
        self.young |= short if len(short) <= self.SIZE else dict(islice(short.items(), self.SIZE))
        return out


class ByteBpeEncoder:
    """Ids of a byte-level BPE tokenizer file for whole columns of texts.

    The tokenizer's own splitting always cuts before a space that no white space follows,
    after a run of letters, and round a single line end between signs; its ids depend
    on the parts alone. So where all spaces of a text are such ones, the text is cut there,
    each different part goes to the library once for a slice of about ``SLICE_BYTES`` (or
    comes from ``Generations``), and the ids of the texts are gathered with numpy. Other
    texts, and those that hold an added token, go to the library whole.
    """

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        space = self.library.encode(" ", add_special_tokens=False).tokens[0]
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
        self.opens[[i for t, i in vocabulary.items() if t[0] == space]] = True
        self.memory = Generations()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Of those that begin with a space, the one in them, many go as one text, whose ids part where a space begins."""
        spaced = [k for k, p in enumerate(parts) if len(p) > 1 and p[0] == " "]
        found = dict(zip(spaced, self._spaced([parts[k] for k in spaced])))
        rest = iter(self._whole([p for k, p in enumerate(parts) if k not in found]))
        return [found[k] if k in found else next(rest) for k in range(len(parts))]

    def _spaced(self, parts: list[str]) -> list[bytes]:
        found = []
        for at in range(0, len(parts), WORDS_AT_ONCE):
            some = parts[at : at + WORDS_AT_ONCE]
            ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(some):
                raise ValueError("the tokenizer doesn't cut before spaces")
            data, ends = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            found += [data[a:b] for a, b in zip(ends, ends[1:])]
        return found

    def encoded(self, texts: pa.Array, end: bytes) -> Iterator[bytes]:
        """The ids of each text, ended by ``end``, as little-endian uint32 bytes. No text may be null."""
        sizes, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < len(texts):
            done = int(sizes[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + SLICE_BYTES)))
            yield from self._slice(texts.slice(at, to - at), end)
            at = to

    def _slice(self, texts: pa.Array, end: bytes) -> list[bytes]:
        odd = pc.match_substring_regex(texts, ODD)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        if not pc.any(odd).as_py():
            return self._cut(texts, end)
        whole, cut = iter(self._whole(texts.filter(odd).to_pylist())), iter(self._cut(texts.filter(pc.invert(odd)), end))
        return [next(whole) + end if o else next(cut) for o in odd.to_pylist()]

    def _cut(self, texts: pa.Array, end: bytes) -> list[bytes]:
        if not len(texts):
            return []
        for pattern, marked in BORDERS:
            texts = pc.replace_substring_regex(texts, pattern, marked)
        lists = pc.split_pattern(pc.replace_substring(texts, " ", MARK + " "), MARK)
        borders = lists.offsets.to_numpy()
        parts = lists.values.slice(borders[0], borders[-1] - borders[0]).dictionary_encode()
        known, numbers = self.memory.found(parts.dictionary.to_numpy(zero_copy_only=False).tolist(), self._parts), parts.indices.to_numpy()
        ids, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        shares = sizes[numbers]
        made = np.r_[0, np.cumsum(shares)]
        data = ids[np.repeat((np.cumsum(sizes) - sizes)[numbers] - made[:-1], shares) + np.arange(made[-1])].tobytes()
        ends = (4 * made[borders - borders[0]]).tolist()
        return [data[a:b] + end for a, b in zip(ends, ends[1:])]


_encoders: dict[str, ByteBpeEncoder] = {}


def encoder(tokenizer_file: str) -> ByteBpeEncoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = ByteBpeEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def train_dictionary(docs: DataFrame, tokenizer_file: str, end_id: int, sample_docs: int = DICTIONARY_DOCS) -> bytes:
    """Trained on windows of about ``sample_docs`` documents (twice as many at most), the first ones
    by a hash of the id, then of the text; empty where they are too few."""
    share = sample_docs / max(docs.count(), 1)
    place = F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(1 << 30))
    chosen = docs.filter(place <= int(min(share, 1) * (1 << 30))).orderBy(place, "id", F.xxhash64("text")).limit(2 * sample_docs)

    def windows(columns):
        found, end = [], struct.pack("<I", end_id)
        for ids in encoder(tokenizer_file).encoded(pa.array(columns[0], pa.string()), end):
            size = 4 * WINDOW_IDS
            starts = sorted({min(len(ids) * k // WINDOWS // 4 * 4, max(0, len(ids) - size)) for k in range(WINDOWS)})
            found += [ids[s : s + size] for s in starts]
        return {"ids": found}

    samples = [bytes(r.ids) for r in map_rows(chosen.select("text"), windows, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples for a dictionary
        return b""


class ShardWriter:
    def __init__(self, folder: str, part: int, seq: int, dictionary: bytes):
        self.fs, root = filesystem(folder)
        # a second attempt at a task writes files of its own; the table of shards names those of the one that counts
        self.part, self.seq, self.path = part, seq, f"{root}/shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.bin"
        self.scratch = f"{self.path}.part"
        self.out = self.fs.open_output_stream(self.scratch)
        self.out.write(head := MAGIC + hashlib.sha256(dictionary).digest())
        self.at, self.entries, self.n_tokens = len(head), [], 0

    def add(self, doc_id: int | None, frame: bytes, n_ids: int) -> None:
        self.out.write(frame)
        self.entries.append((doc_id or 0, doc_id is not None, self.at, len(frame), n_ids))
        self.at += len(frame)
        self.n_tokens += n_ids

    def close(self) -> tuple:
        index = np.array(self.entries, ENTRY).tobytes()
        self.out.write(index + struct.pack("<QQ", len(self.entries), self.at) + MAGIC)
        self.out.close()
        self.fs.move(self.scratch, self.path)
        ids = [e[0] for e in self.entries if e[1]]
        return self.part, self.seq, self.path.rpartition("/")[2], len(self.entries), self.n_tokens, self.at + len(index) + 24, min(ids, default=None), max(ids, default=None)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_store(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes every row's ids, each array ended by ``end_id``, in ascending id order; returns ``folder``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    dictionary = train_dictionary(rows, tokenizer_file, end_id)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.zdict") as out:
        out.write(dictionary)
    end = struct.pack("<I", end_id)
    names = [c.split()[0] for c in SHARDS_SCHEMA.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, shard = TaskContext.get().partitionId(), 0, None
        enc, pack = encoder(tokenizer_file), compressor(dictionary).compress
        done = []
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encoded(batch.column(1), end)):
                shard = shard or ShardWriter(folder, part, seq, dictionary)
                shard.add(doc_id, pack(ids), len(ids) // 4)
                if shard.at >= SHARD_BYTES:
                    done.append(shard.close())
                    seq, shard = seq + 1, None
        if shard:
            done.append(shard.close())
        yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema=shards_schema)

    from chainloom.llm.common import _arrow_schema

    shards_schema = _arrow_schema(spark, SHARDS_SCHEMA)
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    ordered.mapInArrow(write, SHARDS_SCHEMA).write.mode("overwrite").parquet(f"{folder}/shards")
    return folder


def read_store(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, frame_bytes[, ids]) of every document, from the files.
    ``start`` counts the ids of all documents before it."""
    shards = spark.read.parquet(f"{folder}/shards")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    placed = shards.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    tasks = max(1, min(shards.count(), 8 * spark.sparkContext.defaultParallelism))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, frame_bytes long" + ", ids binary" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        with fs.open_input_stream(f"{root}/dictionary.zdict") as f:
            dictionary = f.read()
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                yield from read_shard(fs, f"{root}/{path}", start, dictionary)

    def read_shard(fs, path: str, start: int, dictionary: bytes) -> Iterator[pa.RecordBatch]:
        unpack = decompressor(dictionary).decompress
        with fs.open_input_file(path) as f:
            if f.read(40) != MAGIC + hashlib.sha256(dictionary).digest():
                raise ValueError(f"{path} wasn't written with this store's dictionary")
            f.seek(f.size() - 24)
            n, at, magic = struct.unpack("<QQ8s", f.read(24))
            if magic != MAGIC:
                raise ValueError(f"{path} has no trailer")
            f.seek(at)
            index = np.frombuffer(f.read(n * ENTRY.itemsize), ENTRY)
            f.seek(40)
            for k in range(0, n, 1000):
                some = index[k : k + 1000]
                frames = f.read(int(some["length"].sum()))
                places = some["offset"] - some["offset"][0] if len(some) else []
                ids = [unpack(frames[int(p) : int(p + s)]) for p, s in zip(places, some["length"])]
                sizes = some["n_ids"].astype(np.int64)
                if [len(x) // 4 for x in ids] != sizes.tolist():
                    raise ValueError(f"{path}: a frame's length differs from the index")
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                made = {
                    "doc_id": pa.array(some["id"].astype(np.int64), mask=some["has_id"] == 0),
                    "start": pa.array(starts),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    "frame_bytes": pa.array(some["length"].astype(np.int64)),
                }
                yield pa.RecordBatch.from_pydict(made | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    return placed.repartition(tasks, "path").mapInArrow(read, schema)


def read_document(folder: str, path: str, number: int) -> np.ndarray:
    """Ids of the document at one place of a shard: reads the index and its frame alone."""
    return _frames(folder, path, lambda index: [number])[0]


def find_document(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """Ids of every document of an id, in the order of the store. Of the files, only the
    shards whose range holds the id are opened, and of these the index and the frames."""
    shards = spark.read.parquet(f"{folder}/shards").filter(F.lit(doc_id).between(F.col("least_id"), F.col("greatest_id")))
    places = shards.orderBy("part", "seq").select("path").collect()  # one, or more where an id was split
    return [x for r in places for x in _frames(folder, r.path, lambda index: np.flatnonzero((index["id"] == doc_id) & (index["has_id"] > 0)))]


def _frames(folder: str, path: str, choose) -> list[np.ndarray]:
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/dictionary.zdict") as f:
        unpack = decompressor(f.read()).decompress
    with fs.open_input_file(f"{root}/{path}") as f:
        f.seek(f.size() - 24)
        n, at, _ = struct.unpack("<QQ8s", f.read(24))
        f.seek(at)
        index, found = np.frombuffer(f.read(n * ENTRY.itemsize), ENTRY), []
        for k in choose(index):
            if not 0 <= k < n:
                raise IndexError(k)
            f.seek(int(index[k]["offset"]))
            found.append(np.frombuffer(unpack(f.read(int(index[k]["length"]))), "<u4"))
        return found


def op5_token_store(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    spark = docs.sparkSession
    folder = write_store(docs, new_folder(spark, "tokens"), tokenizer_file, end_id=0)
    return read_store(spark, folder)
