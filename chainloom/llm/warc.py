"""WARC archives in zstandard: one frame for each record, dictionary in a leading skippable frame.

Writing: of pages with equal payloads of at least ``LEAST_SHARED`` bytes the one
with the smallest id becomes a response and the others revisits of it; all other
pages are responses. Equal payloads are found by their SHA-256: one small row for
each digest goes through a shuffle, and the tasks that read the pages write the
shards; only where very many digests are repeated, the copies' payloads are shuffled. A shard appears by one rename and the table of
shards is committed by Spark, so repeated or lost tasks leave no partial result.

Reading: each task reads shards (at most ``SHARD_BYTES`` and one record), loads
the dictionary from the leading skippable frame, finds frames by their block
headers, decodes one record a frame and validates version line, header fields,
Content-Length, record end and, for responses, the payload digest. A fault raises
``ValueError`` with the file and the place.

Defined results: null payloads are empty; empty payloads are responses; pages with
a null id are revisits if a page with an id has their payload, else responses, and
come back with a null id; full copies of a response's row (same id and payload)
are responses too; null URLs give no target field; line ends and other control
characters in URLs are written percent-encoded; an empty table gives no shard; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm.common import _arrow_schema, in_bit_map, new_folder, sized_bit_map, text_or_empty, written
from chainloom.llm.token_store import filesystem

DICTIONARY_MAGIC = 0x184D2A5D
LEAST_SHARED = 100
BROADCAST_DIGESTS = 100_000  # of about 80 bytes
SHARD_BYTES = 32 << 20
DICTIONARY_PAGES, DICTIONARY_BYTES, SAMPLE_BYTES = 512, 64 << 10, 16 << 10
CAPTURED = "2024-01-01T00:00:00Z"
RECORDS_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has no block, only the digest and length of what it stands for."""
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_name(page_id, digest)), ("WARC-Date", CAPTURED)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload))]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_name(refers_to, digest)), ("X-Refers-To-Page-ID", refers_to)]
    block = b"" if revisit else payload
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, where: str = "") -> tuple:
    """The columns of ``RECORDS_SCHEMA`` and the payload (None for revisits) of one record."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    needed = {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "x-payload-length", "content-length"}
    if not blank or version != "WARC/1.1" or needed - fields.keys():
        raise ValueError(f"{where}: not a WARC 1.1 record with the fields {sorted(needed)}")
    n, kind, digest = int(fields["content-length"]), fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"{where}: Content-Length is {n}, the block has {len(rest) - 4} bytes")
    payload, length = rest[:n], int(fields["x-payload-length"])
    if kind == "response" and (length != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{where}: the payload differs from its digest or length")
    if kind not in ("response", "revisit") or kind == "revisit" and (n or "x-refers-to-page-id" not in fields):
        raise ValueError(f"{where}: a record of type {kind} that isn't complete")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("x-page-id"), fields.get("warc-target-uri"), length, digest, kind, number("x-refers-to-page-id"), payload if kind == "response" else None


def frame_end(data: memoryview, at: int) -> int:
    """Where the zstandard frame at ``at`` ends, from its header and block headers."""
    head = bytes(data[at : at + 18])
    end = at + zstandard.frame_header_size(head)
    while True:
        block = int.from_bytes(data[end : end + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        end += 3 + (1 if kind == 1 else size)
        if end > len(data) or kind == 3:
            raise ValueError(f"the frame at byte {at} is broken")
        if last:
            return end + 4 * zstandard.get_frame_parameters(head).has_checksum


def read_archive(data: bytes, where: str = "") -> Iterator[tuple]:
    """Records of one archive, as ``parse_record`` gives them."""
    view, at, dictionary = memoryview(data), 0, None
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & ~15 == 0x184D2A50:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if at == 0 and magic == DICTIONARY_MAGIC:
                dictionary = bytes(view[8 : 8 + size])
                if dictionary[:4] == zstandard.FRAME_HEADER:
                    dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
            at += 8 + size
            continue
        if at == 0 or dictionary is not None:
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress
            dictionary = None
        end = frame_end(view, at)
        if end > len(view):
            raise ValueError(f"{where}: the frame at byte {at} ends after the file")
        yield parse_record(unpack(bytes(view[at:end])), f"{where} at byte {at}")
        at = end


def train_dictionary(pages: DataFrame) -> bytes:
    """Trained on the heads of about ``DICTIONARY_PAGES`` pages chosen by a hash; empty if they are too few."""
    share = min(1.0, DICTIONARY_PAGES / max(pages.count(), 1))
    chosen = pages.filter(F.pmod(F.xxhash64(F.lit(7), "page_id", "url"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    heads = chosen.select(F.substring(F.col("payload"), 1, SAMPLE_BYTES).alias("head"), F.xxhash64(F.lit(7), "page_id", "url").alias("h"))
    samples = [bytes(r.head) for r in heads.orderBy("h", "head").limit(2 * DICTIONARY_PAGES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _placed(digest: DataFrame, shared: DataFrame) -> DataFrame:
    """Every page with the record that it revisits. Payloads stay where they are: the digests of repeated
    payloads go to the tasks, up to ``BROADCAST_DIGESTS``; beyond it a bit map of them does, and only the
    pages that it knows, which are copies but for a few, are shuffled."""
    same = F.col("digest") == F.col("shared_digest")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    made = ["page_id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to")]
    if shared.count() <= BROADCAST_DIGESTS:
        return digest.join(F.broadcast(shared), same, "left").select(made)
    known = digest.sparkSession.sparkContext.broadcast(sized_bit_map(shared.select(F.xxhash64("shared_digest"))))
    hashed = digest.withColumn("digest_hash", F.xxhash64("digest"))

    def only(met: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bit_map(known.value, batch.column(4).to_numpy()) == met))

        return hashed.mapInArrow(run, hashed.schema)

    copies = only(True).join(shared.hint("merge"), same, "left")
    return copies.select(made).unionByName(only(False).select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to")))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Writes a record for every page, and a table of shards; returns ``folder``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).cast("binary").alias("payload"))
    digest = rows.withColumn("digest", F.sha2("payload", 256))
    shared = digest.filter(F.octet_length("payload") >= LEAST_SHARED).groupBy(F.col("digest").alias("shared_digest")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    shared = written(shared.filter(F.col("n") > 1).drop("n"), "shared")
    placed = _placed(digest, shared)
    dictionary = train_dictionary(rows)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    schema = "path string, n_records long, n_bytes long"
    made = _arrow_schema(pages.sparkSession, schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True).compress
        part, done, out = TaskContext.get().partitionId(), [], None

        def close():
            out.close()
            fs.move(scratch, f"{root}/{name}")
            done.append((name, n, size))

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c for c in batch.columns)):
                if out is None:
                    # a second attempt at a task, whose rows may come in another order, writes files of its own
                    name, n, size = f"pages-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.warc.zst", 0, 8 + len(dictionary)
                    scratch = f"{root}/{name}.part"
                    out = fs.open_output_stream(scratch, compression=None)
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                frame = pack(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= SHARD_BYTES:
                    close()
                    out = None
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], f.type) for i, f in enumerate(made)], schema=made)

    placed.mapInArrow(write, schema).write.mode("overwrite").parquet(f"{folder}/shards")
    return folder


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """A row for every record of the folder's archives, validated."""
    shards = spark.read.parquet(f"{folder}/shards").select("path")
    tasks = max(1, min(shards.count(), 8 * spark.sparkContext.defaultParallelism))
    schema = RECORDS_SCHEMA + ", payload binary" * with_payload
    names = [x.split()[0] for x in schema.split(", ")]
    made = _arrow_schema(spark, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{path}", compression=None) as f:
                    data = f.read()
                rows = []
                for found in read_archive(data, path):
                    rows.append(found[: len(names)])
                    if len(rows) == 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(made)], schema=made)

    return shards.repartition(tasks, "path").mapInArrow(read, schema)


def op8_warc(pages: DataFrame) -> DataFrame:
    folder = write_archives(pages, new_folder(pages.sparkSession, "warc"))
    return read_archives(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
         octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes
  FROM pages
), g AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100
  GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
