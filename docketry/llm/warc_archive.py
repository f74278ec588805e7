"""WARC archives compressed record by record with a dictionary that each archive carries.

A writer task holds an archive's records, lightly compressed, until they are enough; it trains a
Zstandard dictionary on records taken evenly from the whole archive, and writes a skippable frame
that holds the dictionary, then one frame a record. A record can be read
by seeking to its frame with only the archive's own dictionary. Archives go to the folder that the
cluster shares, under a name of the task's attempt; only archives that a finished task has listed
count, so a task that is lost and runs again leaves nothing twice.

Equal payloads: the digests alone are grouped to find the smallest page_id of each payload that
occurs more than once. Digests of very many pages, of which there is a bounded number, are broadcast
to the pages; the others join them by a shuffle in which no digest has many rows.

Defined results: null html is an empty payload; a null url writes no target line. A null page_id
takes part as the largest id: such a row is a revisit where its payload has another row with an id,
else a response. Rows that repeat the smallest page_id of a payload are all responses. An empty
table writes no archive and gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._shared import HOT_KEYS, HOT_ROWS, shared_path, written

#: Raw bytes of an archive, of the records a dictionary is trained on (about), and of a dictionary.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 128 << 20, 4 << 20, 64 << 10
LEVEL = 3
#: Tasks that read archives, at most; up to there each has an archive of its own.
READ_TASKS = 20_000
#: Fixed values of the format: the magic number of a dictionary's skippable frame, and the date of records whose table has none.
DICTIONARY_MAGIC = 0x184D2A5D
NO_DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries its payload's digest and length but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {NO_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); a response's payload is measured, not believed."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    number = lambda urn: int(urn[10:-1]) if urn[10:-1] else None
    page_id, digest = number(fields["WARC-Record-ID"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return page_id, said, digest, "revisit", number(fields["WARC-Refers-To"])
    if len(payload) != said or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"record of page {page_id} is damaged")
    return page_id, len(payload), digest, "response", None


def train_dictionary(samples: list[bytes]):
    """A Zstandard dictionary of the records; of too few to train on, their bytes themselves."""
    import zstandard

    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, f=18, accel=4)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """One archive at `path`; its records wait, lightly compressed, until it is closed."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        import zstandard

        self.fs, self.path = fs, path
        self.light, self.waiting = zstandard.ZstdCompressor(level=1), []
        self.size = 0

    def add(self, record: bytes) -> None:
        self.size += len(record)
        self.waiting.append(self.light.compress(record))

    def close(self) -> int:
        import zstandard

        plain = zstandard.ZstdDecompressor()
        every = -(-self.size // SAMPLE_BYTES)  # evenly over the archive
        dictionary = train_dictionary([plain.decompress(x) for x in self.waiting[::every]])
        raw = dictionary.as_bytes()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        with self.fs.open_output_stream(self.path) as out:
            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
            for x in self.waiting:
                out.write(packer.compress(plain.decompress(x)))
        return len(self.waiting)


def read_records(stream) -> Iterator[bytes]:
    """The records of an archive, frame by frame, with its own dictionary."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    raw = stream.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    frame, got, rest = unpacker.decompressobj(), [], b""
    while rest or (rest := stream.read(1 << 20)):
        got.append(frame.decompress(rest))
        rest = b""
        if frame.eof:
            rest = frame.unused_data
            yield b"".join(got)
            frame, got = unpacker.decompressobj(), []


def with_responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the smallest page_id of an equal payload, if that is another row."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    often = slim.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 AND first_id IS NOT NULL")
    often, hot = written(often, "warc-equal"), f"n > {max(HOT_ROWS, pages.count() // HOT_KEYS)}"
    few = often.where(hot).select("digest", F.col("first_id").alias("hot_id"))  # at most HOT_KEYS rows
    found = slim.join(F.broadcast(few), "digest", "left")
    apart = F.when(F.col("hot_id").isNull(), F.col("digest")).otherwise(F.encode(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "UTF-8"))  # no digest: spreads the hot rows
    found = found.withColumn("sought", apart).join(often.where(f"NOT ({hot})").select(F.col("digest").alias("sought"), F.col("first_id").alias("cold_id")), "sought", "left")
    first = F.coalesce("hot_id", "cold_id")
    return found.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(first), first).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes a record per page under `folder`; returns the finished archives: path, records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        writer, done = None, {"path": [], "records": []}

        def close() -> None:
            done["path"].append(writer.path)
            done["records"].append(writer.close())

        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                writer = writer or ArchiveWriter(fs, f"{root}/{uuid.uuid4().hex}.warc.zst")
                writer.add(record_bytes(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py()))
                if writer.size >= ARCHIVE_BYTES:
                    close()
                    writer = None
        if writer:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array(done["path"], pa.string()), "records": pa.array(done["records"], pa.int64())})

    return written(with_responses(pages, least_bytes).mapInArrow(write, "path string, records long"), "warc-list")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the listed archives."""
    names = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with fs.open_input_stream(path) as stream:
                    for raw in read_records(stream):
                        rows.append(parse_record(raw))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    tasks = max(1, min(READ_TASKS, archives.count()))
    return archives.repartition(tasks).mapInArrow(read, names)  # a number of its own, which is not made smaller


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    folder = shared_path(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    return read_archives(write_archives(pages, folder, least_bytes), folder)
