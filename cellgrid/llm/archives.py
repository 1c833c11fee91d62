"""Legacy ARC archives and their conversion to WARC.

ARC files start with a filedesc record whose header line's version (1 or 2)
says which fields the header lines have; each record is a header line, the
declared number of bytes, and a line feed.  The converter parses them record
by record, never by searching in the content, and writes a WARC/1.1 record for
each: a record id made from the content's place, the date from the 14-digit
stamp, the type, block length and SHA-1 digests.  Of records with equal
payloads of at least MIN_REVISIT bytes the one with the greatest key is the
response; the others are revisits that refer to it.

Archives are gzip files of one member a record, in files of at most about
FILE_BYTES; each conversion task reads about one file, and the digests found
when the records were indexed are not computed again.  What a lost attempt
leaves is not in the manifest and never read.

Defined cases: null payloads are empty; a null url is "unknown:"; null keys
sort first; equal keys are ordered by their place in the archives; an empty
table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, new_path, save
from .files import create, open_stream

MIN_REVISIT = 1000
FILE_BYTES = 32 << 20
KEY_HEADER = "X-Page-Id"

#: The fields of ARC header lines, by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}

MANIFEST = "path string, records long"
MANIFEST_SCHEMA = pa.schema([("path", pa.string()), ("records", pa.int64())])


class Members:
    """Writes records as gzip members to files that roll over at FILE_BYTES."""

    def __init__(self, out: str, suffix: str, head=None):
        self.out, self.suffix, self.head = out, suffix, head
        self.sink, self.done = None, []

    def add(self, record: bytes) -> int:
        """Writes a record and returns its offset in the file."""
        if self.sink and self.at > FILE_BYTES:
            self.close()
        if not self.sink:
            self.path = f"{self.out}/{TaskContext.get().partitionId() if TaskContext.get() else 0:06d}-{uuid.uuid4().hex}.{self.suffix}"
            self.sink, self.at, self.n = create(self.path), 0, 0
            if self.head:
                self._member(self.head(self.path.rpartition("/")[2]))
        at = self.at
        self._member(record)
        self.n += 1
        return at

    def _member(self, data: bytes) -> None:
        packed = gzip.compress(data, 6, mtime=0)
        self.sink.write(packed)
        self.at += len(packed)

    def close(self) -> None:
        if self.sink:
            self.sink.close()
            self.done.append({"path": self.path, "records": self.n})
            self.sink = None

    def manifest(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_pylist(self.done, schema=MANIFEST_SCHEMA)


class Unpacked(io.RawIOBase):
    """The content of a file of gzip members as one stream, read in blocks."""

    def __init__(self, path: str):
        self.file, self.rest, self.inflate = open_stream(path), b"", None

    def readable(self) -> bool:
        return True

    def readinto(self, to) -> int:
        while True:
            self.rest = self.rest or self.file.read(1 << 18)
            if not self.rest:
                return 0
            self.inflate = self.inflate or zlib.decompressobj(31)
            data = self.inflate.decompress(self.rest, len(to))
            self.rest = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, None
            if data:
                to[: len(data)] = data
                return len(data)


def unpacked(path: str) -> io.BufferedReader:
    return io.BufferedReader(Unpacked(path), 1 << 18)


# ARC


def arc_head(name: str, version: int, date: str) -> bytes:
    fields = " ".join(ARC_FIELDS[version])
    body = f"{version} 0 cellgrid\n{fields}\n\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    return f"{line} {len(body)}\n".encode() + body if version == 1 else f"{line} 200 - - 0 {name} {len(body)}\n".encode() + body


def arc_record(url: str | None, date: str, block: bytes, version: int = 1, code: str = "200") -> bytes:
    safe = quote(url or "unknown:", safe=":/?#[]@!$&'()*+,;=%~") or "unknown:"
    line = f"{safe} 0.0.0.0 {date} text/html"
    more = f" {code} - - 0 -" if version == 2 else ""
    return f"{line}{more} {len(block)}\n".encode() + block + b"\n"


def read_arc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record after the filedesc record."""
    fields = None
    while line := stream.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if fields is None:
            # The first record's own line ends in its length under either version; its body names the version.
            body = stream.read(int(values[-1]))
            version = int(body.split(b" ", 1)[0])
            if not values[0].startswith("filedesc:") or version not in ARC_FIELDS:
                raise ValueError(f"not an ARC file: {line[:80]!r}")
            fields = ARC_FIELDS[version]
            continue
        if len(values) != len(fields):
            raise ValueError(f"a header line of {len(values)} fields, not {len(fields)}: {line[:200]!r}")
        content = stream.read(int(values[-1]))
        if len(content) != int(values[-1]):
            raise ValueError("the archive ends within a record")
        yield dict(zip(fields, values)), content


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head and payload of an HTTP response; a block that is none is all payload."""
    if block.startswith(b"HTTP/"):
        head, gap, body = block.partition(b"\r\n\r\n")
        if gap:
            return head + gap, body
    return b"", block


def key_of(head: bytes) -> int | None:
    m = re.search(rb"\r\n" + KEY_HEADER.encode() + rb": (-?\d+)\r\n", head)
    return int(m[1]) if m else None


def write_arcs(pages: DataFrame, out: str, version: int = 1, date: str = "20080102030405", key_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write pages as ARC files of either version; returns the manifest (path, records) as a saved table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Members(out, "arc.gz", lambda name: arc_head(name, version, date))
        for batch in batches:
            for key, url, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                named = f"{KEY_HEADER}: {key}\r\n" if key is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}\r\n".encode()
                files.add(arc_record(url, date, head + (payload.as_py() or b""), version))
        yield files.manifest()

    rows = pages.select(F.col(key_col).cast("long"), F.col(url_col), F.col(payload_col).cast("binary"))
    return save(rows.mapInArrow(run, MANIFEST), "arcs")


# WARC


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'cellgrid:' + ':'.join(map(str, parts)))}>"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def warc_head(name: str) -> bytes:
    body = b"software: cellgrid\r\nformat: WARC File Format 1.1\r\n"
    return warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("info", name), "WARC-Date": "2008-01-02T03:04:05Z", "WARC-Filename": name, "Content-Type": "application/warc-fields"}, body)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name] = value.strip()
        yield headers, stream.read(int(headers["Content-Length"]))


def warc_date(stamp: str) -> str:
    """ISO form of a 14-digit (or shorter, cut at the right) ARC date."""
    filled = stamp + "00000101000000"[len(stamp) :]
    return datetime.strptime(filled, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _files(manifest: DataFrame) -> DataFrame:
    """(path) of a manifest, about one in each partition; paths stay rows, however many there are."""
    return manifest.select("path").repartition(max(1, manifest.count()))


def arc_index(manifest: DataFrame) -> DataFrame:
    """(path, number, key, length, digest) of every record in the ARC files, saved."""
    schema = pa.schema([("path", pa.string()), ("number", pa.int64()), ("key", pa.int64()), ("length", pa.int64()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for n, (_, block) in enumerate(read_arc(unpacked(path))):
                    head, payload = split_http(block)
                    rows.append({"path": path, "number": n, "key": key_of(head), "length": len(payload), "digest": hashlib.sha1(payload).digest()})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return save(_files(manifest).mapInArrow(run, "path string, number long, key long, length long, digest binary"), "index")


def decide(index: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(path, marks): for each file its records by number, (digest, and where it is a revisit the place and key it refers to), saved.

    The greatest of a digest is aggregated before the shuffle; the narrow rows
    of a digest that very many records share are split by skew handling.
    """
    large = index.where(F.col("length") >= min_revisit)
    best = large.groupBy("digest", "length").agg(F.max(F.struct("key", "path", "number")).alias("best"), F.count("*").alias("n")).where("n > 1")
    best = save(best.select("digest", "length", "best"), "best")
    place = F.struct("key", "path", "number")
    again = (F.col("length") >= min_revisit) & ~place.eqNullSafe(F.col("best"))
    to = F.when(F.col("best").isNotNull() & again, F.struct(F.col("best.path").alias("path"), F.col("best.number").alias("number"), F.col("best.key").alias("key")))
    marks = index.join(best, ["digest", "length"], "left").select("path", F.struct("number", "digest", to.alias("to")).alias("mark"))
    out = save(marks.groupBy("path").agg(F.array_sort(F.collect_list("mark")).alias("marks")), "marks")  # bounded by FILE_BYTES
    drop_saved(best)
    return out


def convert(arcs: DataFrame, out: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the ARC files of a manifest as WARC files; returns their manifest (path, records), saved."""
    index = arc_index(arcs)
    marks = decide(index, min_revisit)
    work = _files(arcs).join(marks, "path", "left").repartition(max(1, arcs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Members(out, "warc.gz", warc_head)
        for batch in batches:
            for path, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                marks = found.as_py() or []
                for n, (fields, block) in enumerate(read_arc(unpacked(path))):
                    head, payload = split_http(block)
                    digest, to = marks[n]["digest"], marks[n]["to"]
                    headers = {
                        "WARC-Type": "revisit" if to else "response", "WARC-Record-ID": record_id(path, n), "WARC-Date": warc_date(fields["Archive-date"]),
                        "WARC-Target-URI": fields["URL"], "WARC-IP-Address": fields["IP-address"], "Content-Type": "application/http;msgtype=response" if head else fields["Content-type"],
                        "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(), "X-Payload-Length": str(len(payload)),
                    }
                    if to:
                        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(to["path"], to["number"])}
                        if to["key"] is not None:
                            headers["X-Refers-To-Page"] = str(to["key"])
                        block = head
                    headers["WARC-Block-Digest"] = _digest(block)
                    files.add(warc_record(headers, block))
        yield files.manifest()

    warcs = save(work.mapInArrow(run, MANIFEST), "warcs")
    drop_saved(index, marks)
    return warcs


def read(warcs: DataFrame) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, url, date) of every response and revisit.

    A response's length and digest are those of the payload read; they must
    agree with what its header says, as must the block's digest.
    """
    fields = [("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("date", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for headers, block in read_warc(unpacked(path)):
                    if headers["WARC-Type"] not in ("response", "revisit"):
                        continue
                    if _digest(block) != headers["WARC-Block-Digest"]:
                        raise ValueError(f"a block of {path} has changed")
                    head, payload = split_http(block)
                    size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"]
                    if headers["WARC-Type"] == "response" and (len(payload), _digest(payload)) != (size, digest):
                        raise ValueError(f"a payload of {path} has changed")
                    to = headers.get("X-Refers-To-Page")
                    rows.append({"key": key_of(head), "payload_bytes": size, "payload_digest": base64.b32decode(digest[5:]).hex(), "record_type": headers["WARC-Type"], "refers_to": int(to) if to is not None else None, "url": headers["WARC-Target-URI"], "date": headers["WARC-Date"]})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _files(warcs).mapInArrow(run, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string")


def round_trip(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages as ARC files, converted to WARC files and read back."""
    spark = pages.sparkSession
    arcs = write_arcs(pages, new_path(spark, "arc"), version)
    return read(convert(arcs, new_path(spark, "warc")))
