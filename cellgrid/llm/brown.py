"""Brown class-based bigram language model with exchange clustering.

Words and their counts are gathered from all training texts.  The bigrams of
the SEED_WORDS most frequent words start the classes: on the driver, words are
exchanged between classes while the bigram likelihood of the classes grows.
Every other word of the vocabulary is then moved, in one distributed exchange
step, to the class under which the neighbours it has in the corpus are
likeliest.  Transitions between classes, and each word's share of its class,
give the probability of a token; it is mixed with the word's own share of all
tokens.  Unknown words are a class that singletons stand for (Good-Turing);
its mass is shared by as many words as Chao's estimate says are unseen.

The vocabulary is kept in shards of sorted hashes in the shared folder.  A
worker goes through them one at a time for each block of tokens and keeps
those used last, up to CACHE_BYTES; memory is bounded for any vocabulary.  Hashes are of 64 bits; words of equal hash are found when
the shards are written, and another seed is taken.

Defined cases: a null text is empty and has its end alone; rows with a null id
are training rows; repeated rows count as often as they stand; with no
training row the vocabulary is empty and all tokens are unknown; other columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, save
from .files import create, open_read

CLASSES, SEED_WORDS, SWEEPS = 32, 1000, 8
#: Beside the classes: words without a class, the end of a text, unknown words.
REST, END, UNKNOWN = CLASSES, CLASSES + 1, CLASSES + 2
STATES = CLASSES + 3
END_ID, UNKNOWN_ID = 0xFFFFFFFE, 0xFFFFFFFF
#: Share of the class model in the mixture.
MIX = 0.8
#: Shards of up to so many bytes together stay in a worker's memory, those used last.
CACHE_BYTES = 128 << 20
#: Words counted before they are passed on, and tokens handled at once.
COUNTED_WORDS, BLOCK_TOKENS = 200_000, 500_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: ASCII letters and white space only


def hashes(words: list[bytes], seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


class Shards:
    """Sorted keys with columns, in files: rows (path, n, first, last), ordered by their keys."""

    def __init__(self, rows: list[tuple], dtypes: tuple[str, ...]):
        self.rows, self.dtypes = sorted(rows, key=lambda r: r[2]), dtypes
        self.base = np.concatenate([[0], np.cumsum([r[1] for r in self.rows])]).astype(np.int64)

    def load(self, k: int) -> list[np.ndarray]:
        path, n = self.rows[k][:2]
        return _held(path, n, self.dtypes)

    def take(self, keys: np.ndarray) -> list[np.ndarray]:
        """For sorted distinct keys: the row number of each (-1: none) and its columns (0: none)."""
        out = [np.full(len(keys), -1, np.int64), *(np.zeros(len(keys), t) for t in self.dtypes[1:])]
        for k, (_, n, first, last) in enumerate(self.rows):
            a, b = np.searchsorted(keys, np.array(first, keys.dtype)), np.searchsorted(keys, np.array(last, keys.dtype), side="right")
            if a == b:
                continue
            held, *columns = self.load(k)
            at = np.minimum(np.searchsorted(held, keys[a:b]), n - 1)
            hit = held[at] == keys[a:b]
            out[0][a:b][hit] = at[hit] + self.base[k]
            for o, c in zip(out[1:], columns):
                o[a:b][hit] = c[at[hit]]
        return out


def _load(path: str, n: int, dtypes: tuple[str, ...]) -> list[np.ndarray]:
    with open_read(path) as f:
        return [np.frombuffer(f.read(n * np.dtype(t).itemsize), t) for t in dtypes]


#: Shards that this worker has in memory, those used last at the end.
_HELD: OrderedDict[str, list[np.ndarray]] = OrderedDict()


def _held(path: str, n: int, dtypes: tuple[str, ...]) -> list[np.ndarray]:
    if path in _HELD:
        _HELD.move_to_end(path)
        return _HELD[path]
    _HELD[path] = found = _load(path, n, dtypes)
    while len(_HELD) > 1 and sum(c.nbytes for x in _HELD.values() for c in x) > CACHE_BYTES:
        _HELD.popitem(last=False)
    return found


SHARD = "path string, n long, first decimal(20,0), last decimal(20,0), clash boolean"


def write_shards(rows: DataFrame, dtypes: tuple[str, ...], label: str) -> tuple[Shards, bool]:
    """Write rows (key, columns...), sorted by key over the partitions, as shard files. Also: whether a key came twice."""
    out = new_path(rows.sparkSession, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.ascontiguousarray(c.to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64).astype(t) for c, t in zip(b.columns, dtypes)] for b in batches if len(b)]
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        path = f"{out}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        with create(path) as f:
            for c in columns:
                f.write(c.tobytes())
        k = columns[0]
        yield pa.RecordBatch.from_pylist([{"path": path, "n": len(k), "first": int(k[0]), "last": int(k[-1]), "clash": bool((k[1:] == k[:-1]).any())}], schema=pa.schema([("path", pa.string()), ("n", pa.int64()), ("first", pa.decimal128(20, 0)), ("last", pa.decimal128(20, 0)), ("clash", pa.bool_())]))

    found = save(rows.mapInArrow(run, SHARD), label).collect()  # a row for each shard file
    return Shards([(r["path"], r["n"], int(r["first"]), int(r["last"])) for r in found], dtypes), any(r["clash"] for r in found)


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """(word, h, n) over docs (text binary), saved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(counts: Counter) -> pa.RecordBatch:
            words = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(hashes(words, seed).view(np.int64)), pa.array(list(counts.values()), pa.int64())], names=["word", "h", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) > COUNTED_WORDS:
                    yield passed(counts)
                    counts = Counter()
        yield passed(counts)

    return save(docs.mapInArrow(run, "word binary, h long, n long").groupBy("word", "h").agg(F.sum("n").alias("n")), "counts")


def vocabulary(docs: DataFrame) -> tuple[Shards, int, DataFrame]:
    """Shards (h, n) of the training words, the seed of the hashes, and the counts."""
    for seed in range(42, 50):
        counts = count_words(docs, seed)
        # Hashes are ordered as unsigned: with the top bit flipped, signed order is that.
        ranged = counts.select("h", "n").repartitionByRange(F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
        shards, clash = write_shards(ranged, ("<u8", "<i8"), "vocabulary")
        if not clash:
            return shards, seed, counts
    raise RuntimeError("words of equal hash under eight seeds")


def encode(docs: DataFrame, shards: Shards, seed: int, tokens: int, ends: int) -> DataFrame:
    """Rows (id, held_out, text) as (id, held_out, n_tokens, n_known, base_score, ids), saved. tokens: N, ends: training rows."""
    distinct = int(shards.base[-1]) + (ends > 0)
    if distinct >= END_ID:
        raise OverflowError(f"{distinct} words do not fit 32-bit numbers")
    bottom = np.log10(tokens + distinct + 1)

    def block(kind: pa.DataType, ids: list, held: list, lists: list[list[bytes]]) -> pa.RecordBatch:
        schema = pa.schema([("id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("ids", pa.binary())])
        place: dict[bytes, int] = {}
        for ws in lists:
            for w in ws:
                place.setdefault(w, len(place))
        h = hashes(list(place), seed)
        order = np.argsort(h)
        number, n = shards.take(h[order])
        wid, c = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        wid[order], c[order] = number, n
        wid = np.where(wid < 0, UNKNOWN_ID, wid).astype("<u4")
        base = np.log10(c + 1.0) - bottom
        end = np.log10(ends + 1.0) - bottom
        out = {k: [] for k in schema.names}
        for i, hold, ws in zip(ids, held, lists):
            at = np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))
            for k, v in zip(schema.names, (i, hold, len(ws) + 1, int((c[at] > 0).sum()) + (ends > 0), float(base[at].sum() + end), np.append(wid[at], np.uint32(END_ID)).astype("<u4").tobytes())):
                out[k].append(v)
        return pa.RecordBatch.from_pydict(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, lists, size = [], [], [], 0
            for i, hold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids.append(i), held.append(hold), lists.append(words_of(text.as_py()))
                size += len(lists[-1])
                if size > BLOCK_TOKENS:
                    yield block(batch.schema.field(0).type, ids, held, lists)
                    ids, held, lists, size = [], [], [], 0
            if ids:
                yield block(batch.schema.field(0).type, ids, held, lists)

    return save(docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, ids binary"), "tokens")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Blocks of token ids; each text ends in END_ID."""
    for batch in batches:
        parts, size = [], 0
        for x in batch.column(0):
            parts.append(x.as_buffer())
            size += len(parts[-1]) // 4
            if size > BLOCK_TOKENS:
                yield np.frombuffer(b"".join(parts), "<u4")
                parts, size = [], 0
        if parts:
            yield np.frombuffer(b"".join(parts), "<u4")


def _counted(codes: np.ndarray, names: list[str]) -> pa.RecordBatch:
    code, n = np.unique(codes, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=names)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words by exchange on their bigram counts (n x n), words in order of frequency."""
    n = len(bigrams)
    of = np.arange(n) % classes
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    right, left = bigrams @ member, bigrams.T @ member  # counts of a word before and after the words of each class
    between = member.T @ right
    self_n = np.diag(bigrams)
    xlogx = lambda x: np.where(x > 0.5, x * np.log(np.maximum(x, 1)), 0.0)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, r, c, s = of[w], right[w].copy(), left[w].copy(), self_n[w]
            # The word is taken out of its class; neighbours in that class do not count the word itself.
            r[a] -= s
            c[a] -= s
            between[a] -= right[w]
            between[:, a] -= left[w]
            between[a, a] += s
            rows, cols = between.sum(1), between.sum(0)
            # What row b and column b gain when the word joins class b.
            grown_row, grown_col = between + r[None, :], between + c[:, None]
            gain = (xlogx(grown_row) - xlogx(between)).sum(1) + (xlogx(grown_col) - xlogx(between)).sum(0)
            d = np.diag(between)
            gain += xlogx(d + r + c + s) - xlogx(d + r) - xlogx(d + c) + xlogx(d)
            gain -= xlogx(rows + r.sum() + s) - xlogx(rows) + xlogx(cols + c.sum() + s) - xlogx(cols)
            b = int(np.argmax(gain))
            between[b] += r
            between[:, b] += c
            between[b, b] += s
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if not moved:
            break
    return of


def seed_classes(train: DataFrame, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words `top` (sorted ids), and the smoothed log transitions between classes."""
    n = len(top)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _streams(batches):
            at = np.searchsorted(top, ids)
            hit = top[np.minimum(at, n - 1)] == ids
            both = hit[:-1] & hit[1:]
            yield _counted(at[:-1][both].astype(np.int64) * n + at[1:][both], ["code", "n"])

    bigrams = np.zeros(n * n)
    if n:
        for r in train.mapInArrow(pairs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():  # at most SEED_WORDS squared
            bigrams[r["code"]] = r["n"]
    bigrams = bigrams.reshape(n, n)
    # The words come in the order of their ids; the exchange takes the frequent ones first.
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = exchange(bigrams[np.ix_(order, order)])
    member = np.zeros((n, CLASSES))
    member[np.arange(n), of] = 1
    return of, member.T @ bigrams @ member + 0.5


def assign(train: DataFrame, top: np.ndarray, of: np.ndarray, between: np.ndarray) -> DataFrame:
    """(wid, class) of every other training word with a neighbour among the seed words."""
    n = len(top)
    after, before = np.log(between / between.sum(1, keepdims=True)), np.log(between / between.sum(0, keepdims=True))
    weights = np.vstack([after.T, before])  # by neighbour: its class following, then preceding; columns: the word's class

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _streams(batches):
            at = np.minimum(np.searchsorted(top, ids), n - 1)
            hit = top[at] == ids
            word = ~hit & (ids < END_ID)
            w1 = word[:-1] & hit[1:]
            w2 = word[1:] & hit[:-1]
            codes = np.concatenate([ids[:-1][w1].astype(np.int64) * (2 * CLASSES) + of[at[1:][w1]], ids[1:][w2].astype(np.int64) * (2 * CLASSES) + CLASSES + of[at[:-1][w2]]])
            code, k = np.unique(codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code // (2 * CLASSES)), pa.array((code % (2 * CLASSES)).astype(np.int32)), pa.array(k)], names=["wid", "ctx", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1)
            flat = found.flatten()
            ctx, k = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            ends = found.offsets.to_numpy() - found.offsets[0].as_py()
            best = np.empty(len(batch), np.int32)
            for a in range(0, len(batch), 20_000):
                b = min(len(batch), a + 20_000)
                lo, hi = ends[a], ends[b]
                best[a:b] = np.add.reduceat(weights[ctx[lo:hi]] * k[lo:hi, None], ends[a:b] - lo).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best)], names=["wid", "class"])

    each = train.mapInArrow(contexts, "wid long, ctx int, n long").repartition("wid").groupBy("wid", "ctx").agg(F.sum("n").alias("n"))
    gathered = each.groupBy("wid").agg(F.collect_list(F.struct("ctx", "n")).alias("found"))  # at most 2 CLASSES entries
    return gathered.mapInArrow(choose, "wid long, class int")


def numbered(shards: Shards, counts: DataFrame) -> DataFrame:
    """(wid, n) of every vocabulary word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                _, n = shards.load(k)
                for a in range(0, len(n), 100_000):
                    part = n[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part), dtype=np.int64) + a + int(shards.base[k])), pa.array(part)], names=["wid", "n"])

    return counts.sparkSession.range(0, len(shards.rows), 1, max(1, len(shards.rows))).mapInArrow(run, "wid long, n long")


class Lookup:
    """State (class) and count of token ids."""

    def __init__(self, shards: Shards, ends: int):
        self.shards, self.ends = shards, ends

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, back = np.unique(ids, return_inverse=True)
        number, count, state = self.shards.take(keys.astype(np.uint64))
        state = np.where(number < 0, UNKNOWN, state.astype(np.int64))
        state[keys == END_ID] = END
        count[keys == END_ID] = self.ends
        return state[back], count[back]


def transitions(train: DataFrame, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Counts of state pairs, and of states that a singleton follows; a text starts after END."""
    size = STATES * STATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + STATES, np.int64)
        for ids in _streams(batches):
            state, count = lookup(ids)
            last = np.concatenate([[END], state[:-1]])  # blocks begin with a text
            total[:size] += np.bincount(last * STATES + state, minlength=size)
            total[size:] += np.bincount(last[(count == 1) & (state != END)], minlength=STATES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    found = np.zeros(size + STATES)
    for r in train.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most STATES squared
        found[r["code"]] = r["n"]
    return found[:size].reshape(STATES, STATES), found[size:]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows whose `held` is false; by default those of
    held_out().
    """
    rows = docs.select(F.col(id_col).alias("id"), (held_out(F.col(id_col)) if held is None else held).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    training = rows.where(~F.col("held_out"))
    shards, seed, counts = vocabulary(training.select("text"))
    totals = counts.agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("one"), F.sum((F.col("n") == 2).cast("long")).alias("two")).first()
    ends = training.count()
    tokens = (totals["n"] or 0) + ends
    coded = encode(rows, shards, seed, tokens, ends)
    train = coded.where(~F.col("held_out")).select("ids")
    words = save(numbered(shards, counts), "words")
    frequent = words.orderBy(F.desc("n"), "wid").limit(SEED_WORDS).select("wid").collect()
    top = np.array(sorted(r["wid"] for r in frequent), dtype=np.int64)
    if len(top):
        of, between = seed_classes(train, top)
        seeds = docs.sparkSession.createDataFrame([(int(w), int(c)) for w, c in zip(top, of)], "wid long, class int")
        assigned = assign(train, top, of, between).union(seeds)
        words = words.join(save(assigned, "classes"), "wid", "left")
    else:
        words = words.withColumn("class", F.lit(REST))
    model, _ = write_shards(words.select("wid", "n", F.coalesce("class", F.lit(REST)).cast("long").alias("class")).repartitionByRange("wid"), ("<u8", "<i8", "<u1"), "model")
    lookup = Lookup(model, ends)
    pairs, single = transitions(train, lookup)
    into = pairs.sum(0)
    # A state's row with what singletons say of unknown words, smoothed by half a count.
    row = pairs + 0.5
    row[:, UNKNOWN] += single
    log_row = row / row.sum(1, keepdims=True)
    one, two = totals["one"] or 0, totals["two"] or 0
    unseen = max(1.0, one * (one - 1) / (2 * (two + 1)))
    p_unknown = (one + 1) / (tokens + one + 2)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema.fields[:-1]) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            parts, size, first = [], 0, 0
            for i, x in enumerate(batch.column(batch.num_columns - 1)):
                parts.append(x.as_buffer())
                size += len(parts[-1]) // 4
                if size <= BLOCK_TOKENS and i + 1 < len(batch):
                    continue
                state, count = lookup(np.frombuffer(b"".join(parts), "<u4"))
                last = np.concatenate([[END], state[:-1]])
                known = count > 0
                emit = np.where(known, count / np.maximum(into[state], 1), 1 / unseen)
                alone = np.where(known, (1 - p_unknown) * count / max(tokens, 1), p_unknown / unseen)
                logs = np.log10(MIX * log_row[last, state] * emit + (1 - MIX) * alone)
                starts = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])[:-1]])
                out.append(np.add.reduceat(logs, starts))
                parts, size, first = [], 0, i + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*batch.schema.names[:-1], "score"])

    out = coded.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
