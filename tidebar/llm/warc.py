"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a footer in a skippable frame lists each frame's sizes (the public seekable
format), and an index row maps each record to its frame and the place inside it, so one record is read by one frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.store import new_folder, small, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
#: Another kind of skippable frame, before the seek table: the bundle's own index.
INDEX_FRAME = 0x184D2A50
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 1000
#: Uncompressed bytes of a frame and of a bundle, at which the next one begins.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 32 << 20

INDEX = "path string, page_id long, frame int, start int, length int"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if ":/" not in folder:
        raise ValueError(f"{folder!r} needs a scheme, as file:// or hdfs://")
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), urlsplit(folder).path
    return pafs.FileSystem.from_uri(folder)


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit names the page that holds its payload and has no block."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI: " + "".join(x for x in url or "" if x not in "\r\n"), "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers by lower-case name, and its block under the empty name."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    out = {k.lower(): v for k, v in fields.items()}
    return out | {"": rest[: int(out["content-length"])]}


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", a, b) for a, b in sizes)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)


def index_frame(records: list[tuple[int | None, int, int, int]]) -> bytes:
    body = json.dumps(records).encode()
    return struct.pack("<II", INDEX_FRAME, len(body) + 4) + body + struct.pack("<I", len(body))


class BundleFile:
    """A bundle opened for reading by ranges: its footer, its index, and single frames."""

    def __init__(self, folder: str, name: str) -> None:
        fs, base = _open(folder)
        self.file = fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{name}: no seek table")
        self.end = size - 17 - 8 * frames
        self.frames: list[tuple[int, int, int]] = []  # offset, compressed and uncompressed size
        at, table = 0, self.file.read_at(8 * frames, size - 9 - 8 * frames)
        for k in range(frames):
            packed, plain = struct.unpack_from("<II", table, 8 * k)
            self.frames.append((at, packed, plain))
            at += packed

    def index(self) -> list[tuple[int | None, int, int, int]]:
        """(record, frame, start, length) of every record, from the frame before the seek table."""
        size = struct.unpack("<I", self.file.read_at(4, self.end - 4))[0]
        return [tuple(x) for x in json.loads(self.file.read_at(size, self.end - 4 - size))]

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)


class _Bundle:
    """Writes one bundle; nothing is visible under its name before close()."""

    def __init__(self, folder: str) -> None:
        self.fs, base = _open(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"  # a retried task writes other names; only listed ones are read
        self.out = self.fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.sizes: list[tuple[int, int]] = []
        self.frame, self.total = bytearray(), 0
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, raw: bytes) -> tuple[int, int]:
        at = len(self.sizes), len(self.frame)
        self.frame += raw
        self.total += len(raw)
        if len(self.frame) >= FRAME_BYTES:
            self.flush()
        return at

    def flush(self) -> None:
        if self.frame:
            packed = self.packer.compress(bytes(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), len(self.frame)))
            self.frame = bytearray()

    def close(self, records: list[tuple[int | None, int, int, int]]) -> None:
        self.flush()
        self.out.write(index_frame(records))
        self.out.write(seek_table(self.sizes))
        self.out.close()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []

        def done() -> pa.RecordBatch:
            bundle.close([(r["page_id"], r["frame"], r["start"], r["length"]) for r in rows])
            return pa.RecordBatch.from_pylist([{"path": bundle.name} | r for r in rows], schema=schema)

        schema = pa.schema([("path", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("start", pa.int32()), ("length", pa.int32())])
        for batch in batches:
            for r in batch.to_pylist():
                bundle = bundle or _Bundle(folder)
                raw = record(r["page_id"], r["url"], r["kind"], r["payload"] or b"", r["size"], r["digest"], r["refers_to"])
                frame, start = bundle.add(raw)
                rows.append({"page_id": r["page_id"], "frame": frame, "start": start, "length": len(raw)})
                if bundle.total >= BUNDLE_BYTES:
                    yield done()
                    bundle, rows = None, []
        if bundle:
            yield done()

    return run


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for every row into bundles in folder, and returns the written index: path, page_id, frame, start, length.

    Payload: the html in UTF-8 (null: empty). Payloads are equal if their sizes and SHA-256 are (the digest written is SHA-1). Among equal payloads of at least 1000 bytes the largest id is the response
    and the others revisit it; all shorter ones, and rows of that same id, are responses. Null ids are smaller than any
    and are kept as null. Empty tables give an empty index and no file. A group of copies is met by counting with
    map-side combining and a join that adaptive execution can split.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    base = base.withColumns({"size": F.length("payload").cast("long"), "digest": F.sha1("payload"), "same": F.sha2("payload", 256)})
    first = base.where(F.col("size") >= REVISIT_BYTES).groupBy("same", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = small(written(first, "copies"))
    rows = base.join(first, ["same", "size"], "left")  # payloads move only where the groups of copies are too many to broadcast
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select(
        "page_id", "url", "size", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, F.col("first")).alias("refers_to"),
    )
    fs, base_path = _open(folder)
    fs.create_dir(base_path, recursive=True)
    return written(rows.mapInArrow(_writer(folder), INDEX), "warc-index")


def read_bundles(spark, folder: str, index: DataFrame, take=None) -> DataFrame:
    """Reads records back: of each bundle the footer, then, by ranges of the file, the frames of the records, one at a time.

    Returns page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload (null for a revisit). take:
    a condition on index rows; frames that hold none of the asked records are not read. An empty index, or a condition that
    no record meets, gives no rows.
    """
    per = index if take is None else index.where(take)
    spots = F.lit(None).cast("array<struct<frame:int,start:int,length:int>>") if take is None else F.collect_list(F.struct("frame", "start", "length"))  # of one bundle
    per = per.groupBy("path").agg(F.count("*").alias("n"), *([] if take is None else [spots.alias("records")]))
    rows = per.select("path", spots.alias("records") if take is None else "records")
    rows = rows.repartition("path")  # bundles are opened by name, so that each row is one bundle's work
    return rows.mapInArrow(_reader(folder), "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, asked in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                bundle = BundleFile(folder, name)
                held, plain, out, size = -1, b"", [], 0
                places = [x[1:] for x in bundle.index()] if asked is None else [(r["frame"], r["start"], r["length"]) for r in asked]
                for frame, start, length in sorted(places):
                    if frame != held:
                        held, plain = frame, bundle.frame(frame)
                    x = parse(plain[start : start + length])
                    own = x["warc-type"] == "response"
                    out.append({
                        "page_id": number(x["warc-record-id"]), "url": x["warc-target-uri"], "record_type": x["warc-type"], "payload_bytes": len(x[""]) if own else int(x["x-payload-length"]),
                        "payload_digest": hashlib.sha1(x[""]).hexdigest() if own else x["warc-payload-digest"].removeprefix("sha1:"), "refers_to": None if own else number(x["warc-refers-to"]), "payload": x[""] if own else None,
                    })
                    size += length
                    if size >= 4 * FRAME_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def archive_and_read(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes pages to bundles in the shared folder and reads them all back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    index = write_bundles(pages, folder, **columns)
    return read_bundles(spark, folder, index)
