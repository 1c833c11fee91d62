"""SimHash near-duplicates by Golay-code fuzzy hashing.

The 64 bits of a fingerprint are cut into three segments of at most 23 bits.
The binary Golay code of length 23 is perfect: every word lies within three
bits of exactly one of its 4096 codewords.  Decoding a segment and its 23
neighbours at one bit gives one to six codeword indices; segments that differ
in at most two bits share one, as a word between them decodes alike for both.
Two differing bits leave at least one of the three segments equal (pigeonhole),
so fingerprints within two bits agree in (the bits of some segment, an index
of the next one).  They are joined on these keys and verified by their bits.

A key that very many fingerprints share is not joined with itself: its
fingerprints are tied to all words at one bit instead.  Two fingerprints are
within two bits just if they share such a word, so a star around the least of
each gives the same components without all pairs.

Defined cases: a null or empty text has fingerprint zero; copies of a
fingerprint are one node; repeated rows give one row each with the same
component; rows with a null id have their component by the others' ids, or
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.sources.shared import unused

from .common import NARROW_ROWS, Scratch, drop_saved, save, small
from .components import components, linked

#: Bits of the three segments, low ones first.
SEGMENTS = (22, 21, 21)
#: A key of more fingerprints than this is taken apart by neighbour words instead of pairs.
PAIRS_UP_TO = 32
#: Shingles hashed at once, for long texts.
BLOCK = 1 << 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        total += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def majority(hashes: np.ndarray) -> int:
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each k-word shingle of a text in UTF-8, A-Z taken as a-z, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, "<u8")
    if len(words) <= k:
        return np.array([xxh64_intdigest(b" ".join(words), seed)], "<u8")
    return np.fromiter((xxh64_intdigest(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(k)))), "<u8", len(words) - k + 1)


@lru_cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Indices of each 23-bit word as (8388608, 6) int16, and how many of them it has."""
    poly = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
    message = np.arange(1 << 12, dtype=np.int64) << 11
    rest = message.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (poly << (bit - 11)), rest)
    code = message | rest
    bits = [1 << i for i in range(23)]
    errors = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]), *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    index = np.zeros(1 << 23, dtype=np.int16)
    for e in errors:
        index[code ^ e] = np.arange(1 << 12, dtype=np.int16)
    return index, np.array(bits, dtype=np.int64)


def golay_indices(words: np.ndarray) -> list[list[int]]:
    """The one to six codeword indices of each 23-bit word."""
    index, bits = golay_tables()
    near = np.concatenate([index[words][:, None], index[words[:, None] ^ bits[None, :]]], axis=1)
    return [sorted(set(row)) for row in near.tolist()]


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint as a signed 64-bit integer; saved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(shingle_hashes(t.as_py() or b"", shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return save(rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long"), "fingerprints")


def keys(nodes: DataFrame) -> DataFrame:
    """(key, v, fp): three times one to six keys for each fp; keys of different v differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                v, fp = batch.column(0).to_numpy()[at : at + 4096], batch.column(1).to_numpy()[at : at + 4096]
                u = fp.view(np.uint64)
                cut, low = [], 0
                for n in SEGMENTS:
                    cut.append((u >> np.uint64(low) & np.uint64((1 << n) - 1)).astype(np.int64))
                    low += n
                out, who = [], []
                for k in range(3):
                    same = cut[k] | k << 22 | v.astype(np.int64) << 24
                    for i, near in enumerate(golay_indices(cut[(k + 1) % 3])):
                        out += [int(same[i]) << 12 | x for x in near]
                        who += [i] * len(near)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(v[who]), pa.array(fp[who])], names=["key", "v", "fp"])

    return nodes.select("v", "fp").mapInArrow(run, "key long, v int, fp long")


def links(nodes: DataFrame, bits: int = 2, hold: Scratch | None = None) -> DataFrame:
    """Edges (v, a, b) between distinct fingerprints (v, fp) of one kind v that give the components of all pairs within two bits."""
    if bits > 2:
        raise ValueError("the keys find differences of up to two bits")
    save = (hold or Scratch(nodes.sparkSession)).save
    keyed = save(keys(nodes), "keys")
    size = save(keyed.groupBy("key").count().where("count > 1"), "sizes")
    lists = keyed.join(size.where(F.col("count") <= PAIRS_UP_TO), "key").groupBy("key", "v").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    each = lists.select("v", "fps", F.posexplode("fps").alias("i", "a"))
    pairs = each.select("v", "a", F.explode(F.slice("fps", F.col("i") + 2, F.lit(PAIRS_UP_TO))).alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    hot = keyed.join(size.where(F.col("count") > PAIRS_UP_TO), "key").select("v", "fp").distinct()
    masks = [0, *((1 << i) - (1 << 64) * (i == 63) for i in range(64))]
    around = save(hot.select("v", "fp", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("fp").bitwiseXOR(m))).alias("word")), "around")
    least = around.groupBy("v", "word").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(least, ["v", "word"]).select("v", F.col("fp").alias("a"), F.col("least").alias("b")).where("a <> b")
    if bits < 2:
        stars = stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fp, component (smallest id that links reach, its own included)."""
    prints = fingerprints(docs, shingle, id_col, text_col)
    nodes = save(prints.groupBy("fp").agg(F.min("id").alias("least_id")).withColumn("v", F.lit(0)), "nodes")
    parts = components(links(nodes, bits).select("a", "b"))
    rooted = save(nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component"))
    known = save(rooted.join(least, "root").select("fp", "component"), "known")
    return prints.join(known, "fp").select(F.col("id").alias(id_col), "fp", "component")


#: Jaccard similarity of the shingles from which near_copies() links.
JACCARD = 0.8
NEAR_BITS, FEW = 24, 16
#: Hash values by which shingles are counted, 64 times at most 65,536.
SKETCH = 1 << 20
#: Pairs that are verified together, about.
PAIRS_A_PART = 20_000


def _verified(pairs: DataFrame, places: DataFrame, rows: DataFrame, repeated: bool, shingle: int, hold: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes at places (node, node_id, node_h) of rows (id, h, text binary) whose shingle sets have a similarity of JACCARD, saved.

    Pairs are dealt into parts of about PAIRS_A_PART by b, those of a b with
    very many pairs over several; each part gets the text of each of its nodes
    once, and a task holds the sets of one part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sets, jobs = None, {}, []

        def near() -> pa.RecordBatch:
            found = [], []
            for node, others in jobs:
                own = sets[node]
                for b in others:
                    if len(np.intersect1d(own, sets[b], assume_unique=True)) >= (len(own) + len(sets[b])) * (JACCARD / (1 + JACCARD)) - 1e-9:
                        found[0].append(node), found[1].append(b)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

        for batch in batches:
            for k, node, others, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if k != part:
                    yield near()
                    part, sets, jobs = k, {}, []
                sets[node] = np.unique(shingle_hashes(text.as_py() or b"", shingle))
                if others:
                    jobs.append((node, others))
        yield near()

    pairs = hold.save(pairs.distinct(), "pairs")
    # Few bytes can be much work here, so the number of parts does not follow from their size.
    parts = max(-(-pairs.count() // PAIRS_A_PART), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") * 4 / PAIRS_A_PART).alias("salts"))
    part = F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("salts"))), F.lit(parts)).alias("part")
    dealt = hold.save(pairs.join(many, "b").select("a", "b", part), "dealt")
    lists = dealt.groupBy("part", F.col("a").alias("node")).agg(F.collect_list("b").alias("others"))  # within a part
    every = lists.union(dealt.select("part", "b", F.array().cast("array<bigint>"))).groupBy("part", "node").agg(F.flatten(F.collect_set("others")).alias("others"))
    jobs = hold.save(every.join(places, "node"), "jobs")
    texts = rows.join(small(jobs, jobs.count()), F.col("id").eqNullSafe(F.col("node_id")) & (F.col("h") == F.col("node_h"))).select("part", "node", "others", "text")
    texts = texts.dropDuplicates(["part", "node"]) if repeated else texts
    out = hold.save(texts.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "a long, b long"), "verified")
    drop_saved(pairs, dealt, jobs)
    hold.sweep()
    return out


def _levels(rows: DataFrame, shingle: int) -> np.ndarray:
    """How common the shingles of each of SKETCH hash values are, against the mean: half powers of two.

    All shingles of all rows (id, h, text binary) count.  Shingles share values,
    so this only orders them: any order gives the same pairs.
    """
    block = SKETCH // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(total, (np.unique(shingle_hashes(t.as_py() or b"", shingle)) % np.uint64(SKETCH)).astype(np.int64), 1)
        for k in range(64):
            part = total[k * block : (k + 1) * block]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([part[at].astype("<i8").tobytes()], pa.binary())], names=["k", "at", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                totals.setdefault(k, np.zeros(block, np.int64))[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
        for k, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total.tobytes()], pa.binary())], names=["k", "n"])

    total = np.zeros(SKETCH, np.int64)
    found = rows.select("text").mapInArrow(count, "k long, at binary, n binary").repartition(16, "k").mapInArrow(add, "k long, n binary")
    for k, n in found.toLocalIterator():  # 64 rows
        total[k * block : (k + 1) * block] = np.frombuffer(n, np.int64)
    return (2 * np.log2(np.maximum(1, total / (1 + total.mean())))).astype(np.uint8)


def near_copies(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", left_over: int | None = None) -> DataFrame:
    """docs less all but the first, by id, of each group of near copies.

    Texts are linked if their sets of five-word shingles have a Jaccard
    similarity of JACCARD.  Texts of equal sets are one node.  Nodes whose
    SimHashes of the shingles differ in at most two bits come first, found by
    Golay indices as in near_duplicates() and verified by the sets.  At that
    similarity about 10 bits differ, so the search then goes on: linked texts
    share one of the first n - ceil(JACCARD n) + 1 of their n shingles in one
    order of all (prefix filter), rare ones first, see _levels().  The first
    that they share has no shared one before it, so what is left from there on
    in both has to be enough.  Of the pairs that share one, those whose
    SimHashes differ in more than NEAR_BITS are left out unless one is of
    fewer than FEW shingles: more than 24 bits differ for one linked pair in a
    million.  The others are verified by the sets.  Nodes of a key are compared
    with leaders first, see linked().

    Defined cases: null, empty and wordless texts have one and the same empty
    set, so the first of them stays; a null id comes first; rows of equal id
    and text are copies of which one stays; texts of any length are compared
    whole; an empty table gives no rows; other columns are kept whatever their
    names.
    """
    hold = Scratch(docs.sparkSession)
    # A row is known by its id and the hash of its text.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("text"))
    levels = _levels(rows, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or b"", shingle)) for t in batch.column(2)]
            sizes = np.array([len(x) for x in sets], np.int32)
            orders = [np.argsort(levels[(x % np.uint64(SKETCH)).astype(np.int64)], kind="stable") for x in sets]
            starts = [x[at[: len(x) - int(np.ceil(JACCARD * len(x) - 1e-9)) + 1]].view(np.int64) for x, at in zip(sets, orders)]
            whole = [md5(x.tobytes()).digest() for x in sets]
            prints = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole, pa.binary()), pa.array(sizes), pa.array(prints), pa.array(starts, pa.list_(pa.int64()))], names=["id", "h", "whole", "n", "fp", "prefix"])

    sets = hold.save(rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, h long, whole binary, n int, fp long, prefix array<long>"), "prefixes")
    least = sets.groupBy("whole").agg(F.min(F.struct("id", "h")).alias("best"), F.count("*").alias("rows"))
    nodes = hold.save(least.withColumn("node", F.monotonically_increasing_id()), "nodes")
    own = sets.join(nodes.select("whole", "best", "node"), "whole").where(F.struct("id", "h").eqNullSafe(F.col("best")))
    own = hold.save(own.select("node", "n", "fp", "prefix"), "own")
    # Prefixes are in `own` from here on.
    narrow = hold.save(sets.select("id", "h", "whole"), "sets")
    hold.drop(narrow, nodes, own)
    sets = narrow
    again = _repeated(sets)
    places = nodes.select("node", F.col("best.id").alias("node_id"), F.col("best.h").alias("node_h"))
    verify = lambda pairs: _verified(pairs, places, rows, again, shingle, hold)
    prints = hold.save(own.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    first = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    alike = links(prints.select("fp", F.lit(0).alias("v")), hold=hold).select("a", "b").join(first("a"), "a").join(first("b"), "b")
    same = own.join(prints, "fp").where(F.col("node") != F.col("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    close = verify(same.union(alike.select(F.least("first_a", "first_b"), F.greatest("first_a", "first_b"))))
    hold.drop(sets, nodes, own, close)
    keyed = own.select("node", F.posexplode("prefix").alias("at", "key"))
    sizes = hold.save(keyed.groupBy("key").count().where("count > 1").select("key"), "sizes")
    shared = hold.save(keyed.join(small(sizes, sizes.count(), NARROW_ROWS), "key").join(own.drop("prefix"), "node").select("key", "node", "n", "fp", "at"), "shared")
    hold.drop(sets, nodes, close, shared)
    need = (F.col("n") + F.col("n_b")) * (JACCARD / (1 + JACCARD)) - 1e-9
    near = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b")) >= need
    near = near & ((F.least("n", "n_b") < FEW) | (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= NEAR_BITS))
    parts = linked(shared, near, verify, hold, left_over, close)
    grouped = nodes.join(parts, "node", "left").select("whole", "best", "rows", F.coalesce("root", "node").alias("root"))
    heads = grouped.groupBy("root").agg(F.min("best").alias("head"), F.sum("rows").alias("rows")).where("rows > 1").select("root", "head")
    several = hold.save(grouped.join(heads, "root").select("whole", "head"), "several")
    gone = sets.join(several, "whole").where(~F.struct("id", "h").eqNullSafe(F.col("head")))
    gone = hold.save(gone.select("id", "h").distinct(), "gone")
    hold.drop(gone)
    key, h = unused(docs, "key", "h")
    out = docs.join(small(gone.withColumnsRenamed({"id": key, "h": h}), gone.count()), F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(h)), "left_anti")
    return out.dropDuplicates([id_col, text_col]) if again else out


def _repeated(sets: DataFrame) -> bool:
    """Whether rows of equal id and text occur."""
    return not sets.groupBy("id", "h").count().where("count > 1").isEmpty()
