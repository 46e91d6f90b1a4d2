"""WARC records in seekable Zstandard bundles.

Every task writes bundles: records go into frames of about FRAME_BYTES that are compressed
independently, and a footer (the seek table of the public seekable format, in a skippable
frame) gives every frame's sizes. An index table maps each record to its bundle, frame and
offset within the frame, so one record is read by one seek and one small decompression.

Of records with equal payloads of at least `least` bytes the one with the largest page_id
is a response and the others revisit it. Who refers to whom is found from digests alone;
only pages that revisit are looked up by id when records are written.

A file is named anew by every attempt of a task and only named in the index when the
attempt ends well, so lost executors leave unused files at most. Bundles go to the shared
folder by a file system that the workers open themselves.

A record's id is unique: a response is named by its page and payload, and every other
record (revisits, repeated rows, payloads below `least`) by its place. A revisit names its
response's page, and its record too unless that is a repeated row.

A null html is an empty payload, a null url an empty one; a url with white space or control
characters is kept beside its escaped form. Pages with a null id revisit a page with an id
if one has their payload, else each is a response. Ties: repeated rows of the largest id are
a response each. Payloads of any length are one record in one frame. An empty table gives
an archive without bundles. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm._spark import new_path, prepare, saved, sized

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
# Fixed values of the seekable format: the skippable frame's magic number, the footer's, and the size of the footer.
SKIPPABLE, SEEKABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1, 9

#: What a header's line can't hold, or not at its ends.
_UNSAFE = re.compile(r"[\s\x00-\x1f\x7f]+")
#: Pages that don't stand by themselves up to which they are broadcast.
BROADCAST_PAGES = 200_000

INDEX = "page_id long, record_id string, bundle string, frame int, frame_offset long, record_bytes long"


class Archive(NamedTuple):
    """Where the bundles are, and the index table of their records."""

    path: str
    index: DataFrame


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def named(page_id: int | None, sha1: str) -> str:
    """The record id of the only response of a page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}>"


def record(rid: str, page_id: int | None, url: str, payload: bytes, refers_to: int | None, original: str | None, date: str) -> bytes:
    """A record's bytes; a revisit (one that refers to a page) has the payload's HTTP header alone. original: the record that it refers to, if its id is known."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}"]
    escaped = _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    head += [f"WARC-Target-URI: {escaped}"] + ([f"WARC-Page-URL: {json.dumps(url)}"] if escaped != url else [])
    head += [] if page_id is None else [f"WARC-Page-ID: {page_id}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
        head += [f"WARC-Refers-To: {original}"] if original else []
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """A bundle that is being written to an open file."""

    def __init__(self, file):
        self.file, self.sizes, self.pending = file, [], bytearray()
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.written = self.records = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """The frame and the offset in it that the data goes to."""
        self.records += 1
        if self.pending and len(self.pending) + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.sizes), len(self.pending)
        self.pending += data
        return place

    def flush(self) -> None:
        if self.pending:
            frame = self.compressor.compress(bytes(self.pending))
            self.file.write(frame)
            self.sizes.append((len(frame), len(self.pending)))
            self.written += len(frame)
            self.pending.clear()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.file.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """Of each frame: where it begins, its compressed size and its full size."""
    end = file.seek(0, 2)
    file.seek(end - FOOTER)
    n, flags, magic = struct.unpack("<IBI", file.read(FOOTER))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    file.seek(end - FOOTER - 8 * n)
    raw, frames, at = file.read(8 * n), [], 0
    for packed, full in struct.iter_unpack("<II", raw):
        frames.append((at, packed, full))
        at += packed
    return frames


def frame(file, entry: tuple[int, int, int]) -> bytes:
    file.seek(entry[0])
    return zstandard.ZstdDecompressor().decompress(file.read(entry[1]), max_output_size=entry[2]) if entry[2] else b""


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The header and block of the record at an offset of a frame, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    begin = end + 4
    stop = begin + int(head["Content-Length"])
    return head, data[begin:stop], stop + 4


def write_archives(pages: DataFrame, path: str | None = None, least: int = 0, date: str = "2024-01-01T00:00:00Z", id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> Archive:
    """Writes every page as a record; the index has a row for each."""
    from pyarrow import fs

    spark = prepare(pages.sparkSession)
    path = path or new_path(spark, "warc")
    payload = F.coalesce(F.col(html_column), F.lit(""))
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), payload.alias("html"))
    known = rows.select("page_id", F.sha1(F.encode("html", "utf-8")).alias("sha1"), F.octet_length("html").alias("bytes")).where(F.col("bytes") >= least)
    known = saved(known, "payloads")
    each = known.groupBy("sha1", "bytes", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = each.groupBy("sha1", "bytes").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("rows")).where("rows > 1").select("sha1", "bytes", "top.*")
    first = first.select("sha1", "bytes", F.col("page_id").alias("refers_to"), (F.col("n") == 1).alias("single"))
    # What isn't the only response of its page and payload: revisits, and repeated rows.
    other = each.join(first, ["sha1", "bytes"]).where("NOT page_id <=> refers_to OR n > 1")
    other = other.select(F.col("page_id").alias("id"), F.unhex("sha1").alias("of"), F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")).alias("refers_to"), "single")
    other = saved(other, "others")
    rows = rows.select("*", F.unhex(F.sha1(F.encode("html", "utf-8"))).alias("digest"))
    rows = rows.join(sized(other, BROADCAST_PAGES), rows["page_id"].eqNullSafe(other["id"]) & (rows["digest"] == other["of"]), "left")
    rows = rows.select("page_id", "url", "html", "refers_to", F.hex("digest").alias("sha1"), ((F.octet_length("html") < least) | F.col("of").isNotNull()).alias("by_place"), "single")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        bundle, name, out = None, "", []
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("record_bytes", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page, url, html, refers, sha1, by_place, single in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if bundle is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        bundle = Bundle(system.open_output_stream(f"{folder}/{name}", compression=None))
                    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'place:{name}:{bundle.records}')}>" if by_place else named(page, sha1)
                    data = record(rid, page, url, html.encode(), refers, named(refers, sha1) if single and refers is not None else None, date)
                    out.append((page, rid, name, *bundle.add(data), len(data)))
                    if bundle.written > BUNDLE_BYTES:
                        bundle.close()
                        bundle = None
        if bundle is not None:
            bundle.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return Archive(path, saved(rows.mapInArrow(write, INDEX), "warc-index"))


def read_archives(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record of every bundle, read frame by frame: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to, bundle, frame, frame_offset."""
    from pyarrow import fs

    path = archive.path
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{folder}/{name}") as file:
                    for number, entry in enumerate(seek_table(file)):
                        data, at, out = frame(file, entry), 0, []
                        while at < len(data):
                            head, block, after = parse(data, at)
                            http, _, payload = block.partition(b"\r\n\r\n")
                            size, sha1 = int(http.rsplit(b"Content-Length: ", 1)[1]), head["WARC-Payload-Digest"][5:]
                            response = head["WARC-Type"] == "response"
                            if response and (len(payload), digest(payload)) != (size, sha1):
                                raise ValueError(f"damaged record in {name}, frame {number}")
                            page, refers = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page")
                            url = json.loads(head["WARC-Page-URL"]) if "WARC-Page-URL" in head else head["WARC-Target-URI"]
                            out.append((page and int(page), url, payload if response else None, size, sha1, head["WARC-Type"], refers and int(refers), name, number, at))
                            at = after
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    bundles = archive.index.select("bundle").distinct()
    bundles = bundles.repartition(max(1, bundles.count()))  # a task for each
    return bundles.mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, frame_offset long")


def read_record(archive: Archive, bundle: str, number: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: a seek, one frame, an offset in it."""
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(archive.path)
    with system.open_input_file(f"{folder}/{bundle}") as file:
        return parse(frame(file, seek_table(file)[number]), offset)[:2]
