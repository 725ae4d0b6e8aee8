"""WARC archives as seekable Zstandard bundles.

A page becomes a WARC record. Records are grouped into independent Zstandard frames; a bundle is a run of
frames, a skippable frame that maps record identifiers to (frame, offset inside the frame, length), and a
skippable frame with the seek table (compressed and plain size of each frame, footer magic), as in the public
seekable format. A record is read by one seek: footer, seek table, its frame, its offset.

Pages with equal payloads (SHA-256 of the whole payload, and at least ``revisit_from`` bytes) are written once: the one with
the smallest identifier is the response, the others are revisit records with the profile of identical payload
digests, which hold the HTTP header but no payload. Only (identifier, digest) rows are grouped; a payload is
shuffled once, by page.

Bundles are written by the tasks into the shared folder under fresh names, and a task reports the names it
wrote. The report is a Spark table, so only the bundles of tasks that were committed are ever read; a lost
executor leaves at most files that nobody refers to.

Defined cases: a null payload is empty; a null url gives no target field, and line breaks in it are percent-encoded;
a page without identifier is never the response of others that have one, and of pages without any all are
responses; rows that repeat the smallest identifier and its payload are all responses; an empty table gives an
archive without bundles; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm.common import ref, shuffle_partitions, stored
from cleanloom.session import scratch_path

FRAME_BYTES = 256 << 10  # plain bytes after which a frame is closed
BUNDLE_BYTES = 64 << 20  # compressed bytes after which a bundle is closed
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the WARC and of the seekable Zstandard format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE_INDEX, SKIPPABLE_SEEK_TABLE, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
INDEX = "record_id string, path string, frame int, offset long, length long"


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else int(page_id)}>"


def _page_id(text: str):
    number = text.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- one record
def encode_record(page_id, url: str | None, payload: bytes, revisit: bool, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
              ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a position and the position after it."""
    if not data.startswith(VERSION, at):
        raise ValueError("no WARC record here")
    end = data.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in data[at + len(VERSION):end].decode().split("\r\n"))
    start, size = end + 4, int(fields["Content-Length"])
    header_end = data.index(b"\r\n\r\n", start) + 4
    http = dict(line.split(": ", 1) for line in data[start:header_end - 4].decode().split("\r\n")[1:])
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else data[header_end:start + size]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (digest_of(payload) != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
    return {"page_id": _page_id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload,
            "payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": _page_id(fields["WARC-Refers-To"]) if revisit else None}, start + size + 4


# ---------------------------------------------------------------- one bundle
class BundleWriter:
    """Frames go out as they fill up; sizes and record places are kept until the footer."""

    def __init__(self, stream):
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=LEVEL)
        self.frames, self.places, self.pending, self.filled, self.written = [], [], [], 0, 0

    def add(self, name: str, record: bytes) -> None:
        self.places.append((name, len(self.frames), self.filled, len(record)))
        self.pending.append(record)
        self.filled += len(record)
        if self.filled >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        packed = self.packer.compress(b"".join(self.pending))
        self.stream.write(packed)
        self.frames.append((len(packed), self.filled))
        self.written += len(packed)
        self.pending, self.filled = [], 0

    def finish(self) -> None:
        if self.pending:
            self._close_frame()
        index = self.packer.compress(json.dumps(self.places).encode())
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        for magic, content in ((SKIPPABLE_INDEX, index), (SKIPPABLE_SEEK_TABLE, table)):
            self.stream.write(struct.pack("<II", magic, len(content)) + content)


class BundleReader:
    """Random access by the footer; frames are read one at a time."""

    def __init__(self, path: str):
        system, name = fs.FileSystem.from_uri(path)
        self.file, size = system.open_input_file(name), system.get_file_info(name).size
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, number: int) -> bytes:
        packed, plain = self.sizes[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, self.starts[number]), max_output_size=plain)

    def places(self) -> list:
        magic, size = struct.unpack("<II", self.file.read_at(8, self.starts[-1]))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no record index")
        return json.loads(zstandard.ZstdDecompressor().decompress(self.file.read_at(size, self.starts[-1] + 8)))


# ---------------------------------------------------------------- Spark jobs
def _tagged(pages: DataFrame, id_col: str, url_col: str, payload_col: str, revisit_from: int) -> DataFrame:
    """(page_id, url, payload, revisit, refers_to); page rows meet only the few rows of their own revisits."""
    payload = F.coalesce(ref(payload_col), F.lit("")).cast("binary")
    rows = pages.select(ref(id_col).cast("long").alias("page_id"), ref(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("same"))
    keys = rows.filter(F.octet_length("payload") >= revisit_from).select("page_id", "same")
    firsts = stored(keys.groupBy("same").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
                    .filter("n > 1 AND refers_to IS NOT NULL").drop("n"), "firsts")
    again = (keys.join(firsts, "same").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
             .withColumnsRenamed({"page_id": "again_id", "same": "again_same"}))
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("same") == F.col("again_same")), "left").select(
        "page_id", "url", "payload", F.col("refers_to").isNotNull().alias("revisit"), "refers_to")


def write_bundles(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """Write the archive; returns its manifest (path, records, bytes)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def run(batches):
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        writer = name = None

        def finished():
            writer.finish()
            size = writer.stream.tell()
            writer.stream.close()
            return pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(writer.places)], "bytes": [size]})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(system.open_output_stream(f"{base}/{name}", compression=None))
                page, first = (None if pd.isna(v) else int(v) for v in (row.page_id, row.refers_to))
                writer.add(record_id(page), encode_record(page, row.url, bytes(row.payload), bool(row.revisit), first))
                if writer.written >= BUNDLE_BYTES:
                    yield finished()
                    writer = None
        if writer is not None:
            yield finished()

    return stored(_tagged(pages, id_col, url_col, payload_col, revisit_from).mapInPandas(run, MANIFEST), "manifest")


def _frames_of(manifest: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for path in batch["path"]:
                count = len(BundleReader(path).sizes)
                yield pd.DataFrame({"path": [path] * count, "frame": range(count)})

    frames = manifest.select("path").mapInPandas(run, "path string, frame int")
    return frames.repartition(shuffle_partitions(manifest.sparkSession), "path", "frame")


def _frame(records: list[dict]) -> pd.DataFrame:
    table = pd.DataFrame(records, columns=[c.split()[0] for c in RECORD.split(", ")])
    return table.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def read_bundles(manifest: DataFrame) -> DataFrame:
    """All records of the archive; payloads are checked against their digests."""
    def run(batches):
        for batch in batches:
            for path, frames in batch.groupby("path")["frame"]:
                reader = BundleReader(path)
                for number in sorted(frames):
                    data, at, records = reader.frame(number), 0, []
                    while at < len(data):
                        record, at = decode_record(data, at)
                        records.append(record)
                    yield _frame(records)

    return _frames_of(manifest).mapInPandas(run, RECORD)


def record_index(manifest: DataFrame) -> DataFrame:
    """(record_id, path, frame, offset, length) of all records, from the bundles' own index frames."""
    def run(batches):
        for batch in batches:
            for path in batch["path"]:
                places = pd.DataFrame(BundleReader(path).places(), columns=["record_id", "frame", "offset", "length"])
                yield places.assign(path=path)[["record_id", "path", "frame", "offset", "length"]]

    return manifest.select("path").mapInPandas(run, INDEX)


def fetch(places: DataFrame) -> DataFrame:
    """The records at the given places (rows of :func:`record_index`), each by one seek into its bundle."""
    def run(batches):
        for batch in batches:
            for path, rows in batch.groupby("path"):
                reader = BundleReader(path)
                for number, wanted in rows.groupby("frame"):
                    data = reader.frame(int(number))
                    yield _frame([decode_record(data, int(at))[0] for at in wanted["offset"]])

    return places.mapInPandas(run, RECORD)
