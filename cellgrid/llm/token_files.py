"""Token-id files with Elias-Fano document boundaries.

A shard holds the ids of consecutive documents (by id) as one array of 16- or
32-bit little-endian integers, then the Elias-Fano code of the documents' ends
in that array, then that of their ids, then a JSON footer.  Shards are listed
in a manifest; one that a lost attempt left behind is not listed and never read.

Defined cases: null texts are empty and have the end id alone; documents with
a null id come first; repeated rows are all written, ordered by text where ids
tie; an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, save
from .elias_fano import EliasFano
from .files import create, open_read
from .tokens import encoder

MAGIC = b"CGTOKEN1"
#: Ids read from a shard at once.
READ_IDS = 1 << 20


def write(docs: DataFrame, tokenizer: str, out: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards under `out`; returns the manifest (part, path, n_docs, n_ids) as a saved table."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        wide = "<u4" if max(enc.vocabulary, end_id + 1) > 1 << 16 else "<u2"
        ends, ids, nulls, total = [], [], 0, 0
        path = f"{out}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
        sink = None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(enc.encode(text.as_py() or ""), "<u4")
                sink = sink or create(path)
                sink.write(np.append(data, np.uint32(end_id)).astype(wide).tobytes())
                total += len(data) + 1
                ends.append(total)
                nulls += doc is None
                if doc is not None:
                    ids.append(doc)
        if not sink:
            return
        first = ids[0] if ids else 0
        codes = [EliasFano.of(np.array(ends, dtype=np.uint64)).to_bytes(), EliasFano.of(np.array([d - first for d in ids], dtype=np.uint64)).to_bytes()]
        footer = json.dumps({"type": wide, "n_docs": len(ends), "n_ids": total, "n_null": nulls, "first_id": first, "codes": [len(c) for c in codes]}).encode()
        for x in (*codes, footer, struct.pack("<Q", len(footer)), MAGIC):
            sink.write(x)
        sink.close()
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "path": path, "n_docs": len(ends), "n_ids": total}], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return save(rows.mapInArrow(shard, "part int, path string, n_docs long, n_ids long"), "manifest")


class Shard:
    """Random access to a shard: offsets by select, ids by range."""

    def __init__(self, path: str):
        self.file = open_read(path)
        size = self.file.size()
        self.file.seek(size - 16)
        (n,), magic = struct.unpack("<Q", self.file.read(8)), self.file.read(8)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.file.seek(size - 16 - n)
        self.about = json.loads(self.file.read(n))
        a, b = self.about["codes"]
        self.file.seek(size - 16 - n - a - b)
        self.ends, self.ids = EliasFano.from_bytes(self.file.read(a)), EliasFano.from_bytes(self.file.read(b))
        self.width = np.dtype(self.about["type"]).itemsize

    def span(self, i: int) -> tuple[int, int]:
        """Where document i of the shard starts and ends in its id array."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def read(self, start: int, end: int) -> np.ndarray:
        self.file.seek(start * self.width)
        return np.frombuffer(self.file.read((end - start) * self.width), self.about["type"]).astype("<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start, ids) of each document, read in blocks."""
        n, nulls, first = self.about["n_docs"], self.about["n_null"], self.about["first_id"]
        at = start = 0
        while at < n:
            ends = self.ends.range(at, min(n, at + 4096)).astype(np.int64)
            take = max(1, int(np.searchsorted(ends, start + READ_IDS, side="right")))
            block, cuts = self.read(start, int(ends[take - 1])), ends[:take]
            ids = self.ids.range(max(0, at - nulls), max(0, at + take - nulls))
            ids = [None] * (take - len(ids)) + [first + int(x) for x in ids]
            for doc, a, b in zip(ids, [start, *cuts[:-1].tolist()], cuts.tolist()):
                yield doc, a, block[a - start : b - start]
            at, start = at + take, int(cuts[-1])


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts over all shards."""
    spark: SparkSession = manifest.sparkSession
    shards = sorted(manifest.select("part", "path", "n_ids").collect())  # a row for each file
    base, listed = 0, []
    for _, path, n in shards:
        listed.append((path, base))
        base += n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, before = listed[k]
                found = []
                for doc, start, ids in Shard(path).documents():
                    found.append({"doc_id": doc, "start": before + start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())})
                    if len(found) == 5000:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found = []
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return spark.range(0, len(listed), 1, max(1, len(listed))).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the documents' token files to the shared folder and read them back."""
    return read(write(docs, tokenizer, new_path(docs.sparkSession, "tokens"), end_id))
