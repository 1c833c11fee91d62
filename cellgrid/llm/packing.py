"""Shortest-pack-first histogram packing of documents into sequences of fixed length.

Documents are cut into full sequences and a rest.  The histogram of piece
lengths (at most max_len entries) is packed on the driver: lengths longest
first, each into the pack with the least tokens that still has room; packs of the same content are
one pattern with a count.  Pieces are then joined to the patterns by their
rank within their length.

Ranks are dealt per (length, salt), with offsets from the counts, so that one
frequent length does not meet in one task.

Defined cases: a null text is empty and has the end id alone; documents of
any length are cut; repeated rows are packed like any others; ties are ordered
by id, start and text checksum; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small
from .tokens import encoder

MAX_LEN = 4096
#: Pieces of one length that one task ranks, about.
RANK_ROWS = 100_000

PIECE = "row long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut each document's ids at multiples of max_len. with_ids: also the ids, little-endian."""
    fields = [("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * max_len
        for batch in batches:
            out = defaultdict(list)
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = enc.encode(text.as_py() or "") + end
                for at in range(0, len(data), step):
                    part = data[at : at + step]
                    for name, value in zip(schema.names, (row, doc, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4, part)):
                        out[name].append(value)
            if out:
                yield pa.RecordBatch.from_pydict(dict(out), schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECE + ", ids binary" * with_ids)


def pack_histogram(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (piece lengths in order) with counts that use up the histogram."""
    room: dict[int, list[list]] = defaultdict(list)  # room left -> [pattern, count]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        space = max_len
        while left:
            while space >= length and not room.get(space):
                space -= 1
            if space < length:
                room[max_len - length].append([(length,), left])
                break
            pattern, count = room[space].pop()
            n = min(left, count)
            if count > n:
                room[space].append([pattern, count - n])
            room[space - length].append([(*pattern, length), n])
            left -= n
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in room.values():
        for pattern, count in packs:
            merged[pattern] += count
    return sorted(merged.items(), key=lambda p: (-sum(p[0]), p[0]))


def slots(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, past last rank, first sequence, offset): a piece of that length and rank r is in sequence first + r - first rank."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, count in pack_histogram(histogram, max_len):
        at = 0
        for length in pattern:
            out.append((length, used[length], used[length] + count, sequence, at))
            used[length] += count
            at += length
        sequence += count
    return out


def pack(cut: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Adds sequence_id and offset to pieces that have the columns of PIECE."""
    spark = cut.sparkSession
    cut = save(cut, "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most max_len lengths
    places = slots(histogram, max_len)
    salts = -(-max(histogram.values(), default=1) // RANK_ROWS) * 8
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(salts)).cast("int"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "row")
    ranked = salted.withColumn("in_salt", F.row_number().over(order) - 1)
    counts = save(salted.groupBy("length", "salt").count(), "salts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = ranked.join(small(offsets, counts.count()), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("in_salt"))
    at = spark.createDataFrame(places, "length int, lo long, hi long, sequence long, offset int")
    placed = ranked.join(small(at, len(places)), "length").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(*[c for c in cut.columns], (F.col("sequence") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def sequences(packed: DataFrame, max_len: int = MAX_LEN, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pieces that hold their ids: each sequence's ids in order, padded to max_len unless a power of two long."""
    total = F.sum("length").cast("long")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    size = F.col("n_tokens")
    pad = F.when(size.bitwiseAND(size - 1) == 0, 0).otherwise(max_len - size)
    one = F.lit(int(pad_id).to_bytes(4, "little"))
    out = packed.groupBy("sequence_id").agg(total.alias("n_tokens"), joined.alias("ids"))
    return out.withColumn("ids", F.concat("ids", F.aggregate(F.array_repeat(one, pad.cast("int")), F.lit(b""), lambda s, x: F.concat(s, x))))
