"""WARC archives of Zstandard frames, one for each record, with a shared dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself plain
or a Zstandard frame; each record is one frame with content size and checksum. The writer trains
the dictionary of an archive on at most ``SAMPLE_BYTES`` of its first records. The reader loads the
dictionary, decodes frame by frame and validates the version line, the fields, both lengths, the
record's end and the payload's digest; anything else raises ``WarcError`` with path and offset.

Of pages with equal payloads of at least ``REVISIT_BYTES``, that with the largest id is a response
and the others are revisits without payload. Repeated rows of that id are all responses. A page
with a null id revisits if its payload has a response with an id, and is a response otherwise. A
null html is an empty payload, a null url has no target field. Control characters in a url are
percent-encoded. Other input columns are ignored.

Archives go to a folder that all executors share, under names no other task attempt uses; the
manifest, written as a table, names those of the attempts that counted, and only those are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.session import materialize

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
READ_BYTES = 1 << 20
FEED_BYTES = 16 << 10
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the formats.
SKIPPABLE_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"
END = b"\r\n\r\n"


class WarcError(ValueError):
    """A malformed archive or record."""


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to=None, payload_bytes: int | None = None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose block is the HTTP header alone."""
    revisit = refers_to is not None
    size = len(payload) if payload_bytes is None else payload_bytes
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if not revisit:
        block += payload
    name = lambda x: f"<{ID_PREFIX}{'' if x is None else x}>"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + END


def _page_number(value: str) -> int | None:
    m = re.fullmatch(rf"<{ID_PREFIX}(-?\d*)>", value)
    if not m:
        raise WarcError(f"unknown record id {value!r}")
    return int(m[1]) if m[1] else None


def _fields(lines: list[str]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not re.fullmatch(r"\d+", value):
        raise WarcError(f"bad Content-Length {value!r}")
    return int(value)


def parse_record(data: bytes) -> dict:
    """Validates one decoded record."""
    head, sep, rest = data.partition(END)
    if not sep:
        raise WarcError("the header does not end")
    try:
        lines = head.decode().split("\r\n")
    except UnicodeDecodeError as e:
        raise WarcError("the header is not UTF-8") from e
    if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError(f"bad version line {lines[0][:80]!r}")
    fields = _fields(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest"):
        if name not in fields:
            raise WarcError(f"no {name}")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"unexpected record type {kind!r}")
    n = _length(fields)
    if len(rest) != n + len(END) or rest[n:] != END:
        raise WarcError(f"Content-Length {n}, but the block and its end have {len(rest)} bytes")
    http, sep, payload = rest[:n].partition(END)
    if not sep:
        raise WarcError("the HTTP header does not end")
    http_lines = http.decode("latin-1").split("\r\n")
    if not http_lines[0].startswith("HTTP/1."):
        raise WarcError("bad HTTP status line")
    size = _length(_fields(http_lines[1:]))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if not re.fullmatch("[0-9a-f]{40}", digest):
        raise WarcError(f"bad digest {digest!r}")
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise WarcError("the payload does not match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise WarcError("a revisit with a payload or without a target")
    return {
        "page_id": _page_number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_number(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


class ArchiveWriter:
    """Writes records as frames after the dictionary's skippable frame."""

    def __init__(self, stream, dictionary: bytes):
        self.stream = stream
        self.size = self.records = 0
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True
        )
        self._put(SKIPPABLE_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES, empty if the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def read_archive(stream):
    """Yields (offset, decoded record) of an open archive."""
    buffer, at, base = b"", 0, 0

    def fill(n: int) -> bool:
        nonlocal buffer, at, base
        while len(buffer) - at < n:
            more = stream.read(READ_BYTES)
            if not more:
                return False
            base += at
            buffer, at = buffer[at:] + more, 0
        return True

    if not fill(8) or buffer[:4] != SKIPPABLE_MAGIC:
        raise WarcError("the archive does not begin with a dictionary frame")
    n = int.from_bytes(buffer[4:8], "little")
    if not fill(8 + n):
        raise WarcError("the dictionary frame is cut short")
    raw, at = buffer[8 : 8 + n], 8 + n
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    shared = zstandard.ZstdCompressionDict(raw) if raw else None
    decompressor = zstandard.ZstdDecompressor(dict_data=shared)
    while fill(1):
        offset = base + at
        fill(18)
        try:
            if buffer[at : at + 4] != FRAME_MAGIC:
                raise WarcError("no frame begins here")
            frame = zstandard.get_frame_parameters(buffer[at : at + 18])
            if frame.dict_id and frame.dict_id != (shared.dict_id() if shared else 0):
                raise WarcError(f"the frame needs dictionary {frame.dict_id}")
            decoder, parts = decompressor.decompressobj(), []
            while not decoder.eof:
                if not fill(1):
                    raise WarcError("the frame is cut short")
                piece = buffer[at : at + FEED_BYTES]
                parts.append(decoder.decompress(piece))
                at += len(piece) - len(decoder.unused_data)
            data = b"".join(parts)
            if frame.content_size not in (len(data), zstandard.CONTENTSIZE_UNKNOWN):
                raise WarcError(f"the frame announces {frame.content_size} bytes and has {len(data)}")
        except (WarcError, zstandard.ZstdError) as e:
            raise WarcError(f"frame at byte {offset}: {e}") from e
        yield offset, data


MANIFEST_DDL = "path string, records long, bytes long"
RECORD = [
    ("page_id", pa.int64()),
    ("url", pa.string()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("record_type", pa.string()),
    ("refers_to", pa.int64()),
]
RECORD_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _write(folder, archive_bytes):
    def records(batches):
        for batch in batches:
            for row in zip(*[c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns)]):
                page_id, url, payload, digest, size, refers_to = row
                yield record_bytes(page_id, url, payload.as_py() if refers_to is None else b"", digest, refers_to, size)

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        source, samples, held = records(batches), [], 0
        for r in source:
            samples.append(r)
            held += len(r)
            if held >= SAMPLE_BYTES:
                break
        if not samples:
            return
        dictionary = train_dictionary([s[: 128 << 10] for s in samples])
        writer = name = None
        done = []

        def chained():
            yield from samples
            yield from source

        for r in chained():
            if writer is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                writer = ArchiveWriter(fs.open_output_stream(f"{path}/{name}"), dictionary)
            writer.add(r)
            if writer.size >= archive_bytes:
                writer.stream.close()
                done.append((f"{folder}/{name}", writer.records, writer.size))
                writer = None
        if writer is not None:
            writer.stream.close()
            done.append((f"{folder}/{name}", writer.records, writer.size))
        paths, counts, sizes = zip(*done)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"]
        )

    return run


def _read(with_payload):
    schema = pa.schema(RECORD + ([("payload", pa.binary())] if with_payload else []))

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with fs.open_input_stream(path) as stream:
                    for offset, data in read_archive(stream):
                        try:
                            row = parse_record(data)
                        except WarcError as e:
                            raise WarcError(f"{uri}, record at byte {offset}: {e}") from e
                        if with_payload:
                            held += len(data)
                        else:
                            del row["payload"]
                        rows.append(row)
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def revisit_plan(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages(page_id, url, html)`` with payload, digest, size and the id it refers to, or null."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size")
    )
    repeated = (
        rows.filter(F.col("size") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1 AND keeper IS NOT NULL")
        .select("digest", "keeper")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives under ``folder`` (a URI that all executors reach); returns the manifest."""
    return materialize(revisit_plan(pages).mapInArrow(_write(folder, archive_bytes), MANIFEST_DDL), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives that ``manifest(path)`` names, each archive decoded by one task."""
    spark = manifest.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ddl = RECORD_DDL + (", payload binary" if with_payload else "")
    return manifest.select("path").repartition(parts, "path").mapInArrow(_read(with_payload), ddl)
