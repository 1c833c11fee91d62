"""Fuzzy line dedup (native DataFrame plan).

Lines are normalised: lower case, digits as 0, other ASCII signs as blanks; each
letter of a script written without blanks is a word.  Equal normalised lines
are one node.  A node of MIN_WORDS words or more has a 64-bit SimHash of its
words with the next ones, so that the same words in another order are told
apart; the words are exploded once, and one aggregation gives both the counts
of the hashes' bits, in 16-bit fields of sixteen integers, and the sums of the
words' hashes in sixteen blocks into which the words are dealt by hash.

Pigeonhole blocks are of two kinds.  Two of the four blocks of the fingerprint
are equal if two bits or fewer differ.  Edits of a few words change the blocks
of those words alone, so one of the blocks of words stays equal while many
more bits of the fingerprint may differ; how many blocks there are follows
from the number of words, and small blocks count two at a time, so a block's
use depends on its words and not on the corpus.  Nodes that share a block are
compared by their fingerprints (BITS), their lengths, how often they have each
letter, which the edit distance bounds, and then by the edit similarity of the
normalised lines, 1 - levenshtein / longer length >= 0.8, in characters; upper
bounds from the lines' words settle most similar pairs.  Of each connected group
the first occurrence, by document id and line number, is kept.

Nodes that share a block are compared with leaders first; see linked().

Defined cases: null or empty texts stay as they are; blank lines are kept;
lines of fewer than MIN_WORDS words are kept, or with `short` grouped by their
normalised form (by themselves if they are signs alone); rows of equal id and
text are one document and treated alike; a null id sorts first; lines of any
length are compared whole; an empty table gives no rows; other columns keep
their values whatever their names, but for n_lines and n_removed.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate, combinations, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.sources.shared import unused

from .common import NARROW_ROWS, WORD_GAP, Scratch, at_once, drop_saved, small
from .components import linked

MIN_WORDS, SIMILARITY = 5, 0.8
#: Lines whose fingerprints differ in more bits are not compared.
BITS = 24
#: Bits of each of the four blocks of a fingerprint, two of which make a key.
BLOCK_BITS = 16
#: Blocks of words: (number, from words, to words).  The ranges overlap by more than lengths of similar lines differ.
WORD_BLOCKS = ((16, 80, None), (8, 24, 110), (4, 0, 32))
#: Words that a block needs to be a key of its own; lines of fewer words than PAIRED also take the four blocks two at a time.
BLOCK_WORDS, PAIRED = 3, 16
#: Words whose sums one row holds: fields of 16 bits, block sums of 40 bits and counts of 11.
CHUNK = 2_000
#: Words ahead among which a word is looked for, when two lines are gone through side by side.
WINDOW = 12
#: Nodes whose keys are counted in one task.
KEYED_ROWS = 50_000
#: Share of words in common from which on that is tried; under it nearly no pair is settled so.
IN_STEP_FROM = 0.8
#: Letters counted by themselves; all other characters are one kind more.
LETTERS = "etaoinsrhldugwy"
#: Letters of scripts written without blanks; each is a word.
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"
#: Characters among which all those letters are; quicker to look for.
_MAYBE_UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u19e0-\u19ff\u2e80-\u31ff\u3200-\u9fff\ua9e0-\uaa7f\uf900-\ufaff\uff00-\uffef\U00010000-\U0003ffff]"
#: WORD_GAP within a line, as sets of single characters, which Java looks up in one table; but for single blanks, which stay as they are.
_GAPS = [rf"\x{k:02X}" for k in range(128) if re.fullmatch(WORD_GAP, chr(k)) and chr(k) not in "\n "]
LINE_GAP = rf"[{''.join(_GAPS)}][ {''.join(_GAPS)}]*| [ {''.join(_GAPS)}]+"
_FIELDS, _SUM, _COUNT_AT = 0x0001000100010001, (1 << 40) - 1, 52


def normalised(text: Column, unspaced: Column) -> Column:
    """The text with its lines normalised but for blanks at their ends.  unspaced: whether there can be letters of scripts without blanks."""
    apart = F.when(unspaced, F.regexp_replace(text, UNSPACED, " $1 ")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(F.lower(apart), "[123456789]", "0"), LINE_GAP, " ")


def _row_id(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def occurrences(docs: DataFrame, hold: Scratch, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """(id, rid, line, p, n, c, norm, k1, k2) of every line that counts, saved; rid stands for the document's row, (k1, k2) for the normalised line of n words and c characters."""
    text = F.col(text_col)
    unspaced = (F.octet_length(text) > F.length(text)) & text.rlike("[\u0e00-\U0010ffff]") & text.rlike(_MAYBE_UNSPACED)
    rows = docs.select(F.col(id_col).alias("id"), at_once(_row_id(id_col, text_col)).alias("rid"), text.alias("text"), F.split(normalised(text, unspaced), "\n", -1).alias("words"))
    # Only lines without words are looked at as they were.
    raw = F.when(F.array_contains("words", "") | F.array_contains("words", " "), F.split("text", "\n", -1)).otherwise(F.array().cast("array<string>"))
    rows = rows.select("id", "rid", raw.alias("raw"), "words")
    rows = rows.select("id", "rid", F.posexplode(F.arrays_zip("raw", "words")).alias("line", "x"))
    # A line of signs alone has no words; it is itself its form.
    rows = rows.select("id", "rid", "line", F.monotonically_increasing_id().alias("p"), F.trim("x.words").alias("words"), F.col("x.raw").alias("raw"))
    form = F.when(F.col("words") != "", F.col("words")).otherwise(F.trim(F.translate("raw", "\t\r\f\x0b", "    ")))
    n = F.when(F.col("words") == "", 0).otherwise(F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    rows = rows.select("id", "rid", "line", "p", n.alias("n"), form.alias("norm")).where((F.col("norm") != "") if short else (F.col("n") >= MIN_WORDS))
    return hold.save(rows.withColumns({"c": F.length("norm"), "k1": F.xxhash64("norm"), "k2": F.xxhash64(F.lit(7), "norm")}), "lines", "zstd")


def distinct_lines(found: DataFrame, hold: Scratch) -> DataFrame:
    """(k1, k2, node, n, c, times) of each normalised line, saved: node is the p of one occurrence."""
    nodes = found.groupBy("k1", "k2").agg(F.min("p").alias("node"), F.min("n").alias("n"), F.min("c").alias("c"), F.count("*").alias("times"))
    return hold.save(nodes, "nodes")


def _fingerprint(n: Column, sums: list[Column]) -> Column:
    # Adding 2^14 - 1 - n div 2 sets a field's bit 14 just if it holds over n div 2, that is over half of n.
    half = (F.lit((1 << 14) - 1) - F.shiftright(n, 1)).cast("long")
    spread = half + F.shiftleft(half, 16) + F.shiftleft(half, 32) + F.shiftleft(half, 48)
    fp = F.lit(0).cast("long")
    for k, s in enumerate(sums):
        fp = fp.bitwiseOR(F.shiftleft(F.shiftrightunsigned(s + spread, 14).bitwiseAND(F.lit(_FIELDS)), k))
    return fp


def _words(lines: DataFrame, *keep: str | Column) -> DataFrame:
    """The kept columns and (at, h, pair) of each word: its place, its hash, and that of the word and the next one."""
    words = F.split("norm", " ", -1)
    rows = lines.select(*keep, words.alias("w")).select(*keep, F.posexplode(F.arrays_zip("w", F.slice("w", 2, F.size("w")).alias("next"))).alias("at", "x"))
    return rows.select(*keep, "at", F.xxhash64("x.w").alias("h"), F.xxhash64("x.w", F.coalesce("x.next", F.lit(""))).alias("pair"))


def _word_sums(words: DataFrame, *by: str) -> DataFrame:
    """n, s0 to s15 and b0 to b15 of each of `by`: words, counted bits, and blocks' counts and sums of hashes."""
    h, pair = F.col("h"), F.col("pair")
    own = F.shiftrightunsigned(h, 24) + F.lit(1 << _COUNT_AT)
    bits = [F.sum(F.shiftrightunsigned(pair, k).bitwiseAND(F.lit(_FIELDS))).alias(f"s{k}") for k in range(16)]
    blocks = [F.sum(F.when(h.bitwiseAND(F.lit(15)) == k, own).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(16)]
    return words.groupBy(*by).agg(F.count("*").cast("int").alias("n"), *bits, *blocks)


def _block_keys(n: Column, counts: list[Column], sums: list[Column]) -> list[Column]:
    """A key for each block of words that a line of n words has, else null."""
    keys = []
    for blocks, least, most in WORD_BLOCKS:
        c = [sum(counts[k + blocks :: blocks], counts[k]) for k in range(blocks)]
        s = [sum(sums[k + blocks :: blocks], sums[k]).bitwiseAND(F.lit(_SUM)) for k in range(blocks)]
        fits = (n >= least) & (n < most) if most else n >= least
        keys += [F.when(fits & (c[k] >= BLOCK_WORDS), F.xxhash64(F.lit(blocks), F.lit(k), c[k], s[k])) for k in range(blocks)]
    # The last ones, of few words, two at a time.
    return keys + [F.when(n < PAIRED, F.xxhash64(F.lit(2), F.lit(i), F.lit(j), c[i], s[i], c[j], s[j])) for i, j in combinations(range(blocks), 2)]


def _bit_keys(fp: Column) -> list[Column]:
    cut = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for at in range(0, 64, BLOCK_BITS)]
    return [F.xxhash64(F.lit(1), F.lit(i), F.lit(j), cut[i], cut[j]) for i, j in combinations(range(len(cut)), 2)]


def fingerprints(found: DataFrame, nodes: DataFrame, hold: Scratch) -> DataFrame:
    """(node, fp, c, keys) of the nodes of MIN_WORDS words or more, saved; c: characters of the normalised line."""
    longest = nodes.agg(F.max("n")).first()[0] or 0
    some = found.where(F.col("n") >= MIN_WORDS)
    one = some.where(F.col("n") <= CHUNK).select("p", "norm").join(nodes.where(F.col("n") >= MIN_WORDS).select(F.col("node").alias("p"), "c").hint("shuffle_hash"), "p")
    # The lines are dealt out by p already, so the wide rows of sums are not moved.
    one = _word_sums(_words(one, "p", "c"), "p", "c")
    counts = [F.shiftrightunsigned(f"b{k}", _COUNT_AT) for k in range(16)]
    sums = [F.col(f"b{k}").bitwiseAND(F.lit((1 << _COUNT_AT) - 1)) for k in range(16)]
    out = one.select(F.col("p").alias("node"), "n", "c", _fingerprint(F.col("n"), [F.col(f"s{k}") for k in range(16)]).alias("fp"), F.array(*counts).alias("counts"), F.array(*sums).alias("sums"))
    if longest > CHUNK:
        # Longer lines are summed up in parts.
        parts = some.where(F.col("n") > CHUNK).join(nodes.select(F.col("node").alias("p")), "p", "left_semi")
        parts = _words(parts, "p", "c").withColumn("part", F.floor(F.col("at") / CHUNK))
        bits = [F.shiftrightunsigned(f"s{b % 16}", b // 16 * 16).bitwiseAND(F.lit(0xFFFF)) for b in range(64)]
        fields = _word_sums(parts, "p", "c", "part").select("p", "c", "n", F.posexplode(F.array(*bits, *counts, *[s.bitwiseAND(F.lit(_SUM)) for s in sums])).alias("at", "v"))
        whole = fields.groupBy("p", "c", "at").agg(F.sum("n").cast("int").alias("n"), F.sum("v").alias("v")).groupBy("p", "c", "n").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("all"))
        fp = F.aggregate(F.slice("all", 1, 64), F.lit(0).cast("long"), lambda f, x: F.when(x["v"] * 2 > F.col("n"), f.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["at"]))).otherwise(f))
        out = out.union(whole.select(F.col("p").alias("node"), "n", "c", fp.alias("fp"), F.slice("all.v", 65, 16).alias("counts"), F.slice("all.v", 81, 16).alias("sums")))
    counts, sums = ([F.col(name)[k] for k in range(16)] for name in ("counts", "sums"))
    keys = F.array_compact(F.array(*_bit_keys(F.col("fp")), *_block_keys(F.col("n"), counts, sums)))
    return hold.save(out.select("node", "fp", "c", keys.alias("keys")), "prints")


def _narrow(df: DataFrame) -> DataFrame:
    """A saved table of few columns, broadcast if it is counted to be within NARROW_ROWS."""
    return small(df, df.count(), NARROW_ROWS)


def _letters(norm: Column, c: Column) -> list[Column]:
    """h0 to h3: how often a line of c characters has each of LETTERS and all others, in fields of 16 bits; more count as 65,535."""
    # Each letter is taken out of what the ones before have left, so less and less is gone through.
    left = list(accumulate(LETTERS, lambda rest, x: F.replace(rest, F.lit(x), F.lit("")), initial=norm))
    own = [F.octet_length(a) - F.octet_length(b) for a, b in pairwise(left)]
    counts = [F.least(n, F.lit(0xFFFF)).cast("long") for n in (*own, c - sum(own[1:], own[0]))]
    return [sum((F.shiftleft(n, 16 * i) for i, n in enumerate(counts[at + 1 : at + 4], 1)), counts[at]).alias(f"h{at // 4}") for at in range(0, 16, 4)]


def _letters_differ(most: Column) -> Column:
    """Whether the letters of two lines show that more than `most` edits lie between them.

    An edit takes away one character at most and brings one at most, so the
    distance is at least the greater of what is missing on either side, which
    is half of all differences and that of the lengths.
    """
    field = lambda h, i: F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(0xFFFF))
    apart = [F.abs(field(f"h{k}", i) - field(f"h{k}_b", i)) for k in range(4) for i in range(4)]
    return sum(apart, F.abs(F.col("c") - F.col("c_b"))) > 2 * most


def _equal_ends(v: Column, w: Column) -> tuple[Column, Column]:
    """How many words are equal at the start of both lines, and at their end among the others."""

    def equal(first: Column, second: Column) -> Column:
        at = F.array_position(F.zip_with(first, second, lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        return F.when(at > 0, at - 1).otherwise(F.size(first))

    head = equal(v, w)
    return head, F.least(equal(F.reverse(v), F.reverse(w)), F.least(F.size(v), F.size(w)) - head)


def _between(words: Column, head: Column, tail: Column) -> Column:
    """The line without its first and last words, a blank ahead of each that is left.

    What two lines have in common at their ends does not change their edit
    distance; nor does a blank ahead of both.
    """
    left = F.size(words) - head - tail
    return F.when(left > 0, F.concat(F.lit(" "), F.array_join(F.slice(words, head + 1, left), " "))).otherwise("")


def _at_most(x: Column, y: Column, v: Column, w: Column) -> Column:
    """A number that the edit distance of x and y does not exceed, from their words v and w.

    Words that stand side by side are replaced one by one, or all between the
    equal words at the start and those at the end at once.
    """
    singly = F.aggregate(F.zip_with(v, w, lambda a, b: F.when(a == b, 0).otherwise(F.greatest(F.length(a), F.length(b)))), F.lit(0), lambda s, d: s + d)
    head, tail = _equal_ends(v, w)
    length = lambda words: F.length(F.concat_ws(" ", words))
    shared = length(F.slice(v, F.lit(1), head)) + length(F.slice(F.reverse(v), F.lit(1), tail))
    return F.least(F.when(F.size(v) == F.size(w), singly), F.greatest(F.length(x), F.length(y)) - shared)


def _in_step(v: Column, w: Column) -> Column:
    """A number that the edit distance of two lines does not exceed, from their words v and w gone through side by side.

    A word of v that comes next in w costs nothing.  Else it is looked for,
    with the word after it, among the next WINDOW words of w.  Between two such
    places the words of one side are replaced by those of the other.
    """
    wide = lambda words: F.length(F.array_join(words, " ")) + F.least(F.size(words), F.lit(1))
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("own"), F.lit(0).alias("cost"))

    def step(s: Column, x: Column) -> Column:
        here, gap = F.get(w, s["at"] - 1).eqNullSafe(x["word"]), F.length(x["word"]) + 1
        ahead = F.slice(w, s["at"], F.lit(WINDOW + 1))
        places = F.zip_with(ahead, F.slice(ahead, 2, F.lit(WINDOW)), lambda a, b: (a == x["word"]) & b.eqNullSafe(x["next"]))
        found = F.when(here, 1).otherwise(F.array_position(places, F.lit(True)).cast("int"))

        def on(n: Column) -> Column:
            met = F.struct((s["at"] + n).alias("at"), F.lit(0).alias("own"), (s["cost"] + F.greatest(s["own"], wide(F.slice(w, s["at"], n - 1)))).alias("cost"))
            return F.when(n > 0, met).otherwise(F.struct(s["at"].alias("at"), (s["own"] + gap).alias("own"), s["cost"].alias("cost")))

        return F.element_at(F.transform(F.array(found), on), 1)

    each = F.zip_with(v, F.slice(v, 2, F.size(v)), lambda a, b: F.struct(a.alias("word"), b.alias("next")))
    return F.aggregate(each, start, step, lambda s: s["cost"] + F.greatest(s["own"], wide(F.slice(w, s["at"], F.size(w)))))


def verify(pairs: DataFrame, found: DataFrame, hold: Scratch, failed: list[DataFrame] | None = None) -> DataFrame:
    """The pairs (a, b) of enough edit similarity, saved; those in the tables of failed are not compared again, and a table of those that fail now is added."""
    pairs = pairs.distinct()
    if failed:
        pairs = pairs.join(reduce(DataFrame.union, failed), ["a", "b"], "left_anti")
    pairs = hold.save(pairs, "pairs")
    involved = hold.save(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "p"), "involved")
    texts = hold.save(found.join(_narrow(involved), "p", "left_semi").select("p", "norm"), "texts")
    both = pairs.join(texts.select(F.col("p").alias("a"), F.col("norm").alias("x")), "a").join(texts.select(F.col("p").alias("b"), F.col("norm").alias("y")), "b")
    # Few bytes can be much work here, so the number of parts does not follow from their size.
    both = both.select("a", "b", "x", "y").repartition(4 * both.sparkSession.sparkContext.defaultParallelism, "a", "b")
    most = F.floor(F.greatest(F.length("x"), F.length("y")) * (1 - SIMILARITY) + 1e-9).cast("int")
    both = both.select("a", "b", "x", "y", most.alias("most"), F.split("x", " ", -1).alias("v"), F.split("y", " ", -1).alias("w"))
    # The bounds are for lines with most words in common, and that of words side by side for nearly all; for others they would be lost work.
    common, least = F.size(F.array_intersect("v", "w")), F.least(F.size(F.array_distinct("v")), F.size(F.array_distinct("w")))
    both = both.select("*", at_once(common / least).alias("share"))
    near = _at_most(F.col("x"), F.col("y"), F.col("v"), F.col("w")) <= F.col("most")
    near = near | (F.col("share") >= IN_STEP_FROM) & (_in_step(F.col("v"), F.col("w")) <= F.col("most"))
    # What the bounds leave open is computed.
    ends = _equal_ends(F.col("v"), F.col("w"))
    inner = F.call_function("levenshtein", *[_between(F.col(c), *ends) for c in "vw"], F.col("most")) >= 0
    near = F.when(F.col("share") >= 0.5, near | inner).otherwise(F.expr("levenshtein(x, y, most) >= 0"))
    told = hold.save(both.select("a", "b", near.alias("near")), "verified")
    if failed is not None:
        failed.append(hold.save(told.where("not near").select("a", "b"), "failed"))
    out = told.where("near").select("a", "b")
    out._saved_path = told._saved_path
    drop_saved(pairs, involved, texts)
    return out


def similar(found: DataFrame, prints: DataFrame, hold: Scratch, left_over: int | None = None) -> DataFrame:
    """(node, root) of the components of all similar nodes that share a key; prints are deleted once they are not needed."""
    keyed = prints.select("node", "fp", "c", F.explode("keys").alias("key"))
    # Nearly all keys are alone, so counting them ahead of the shuffle would be lost work; counts of few keys at a time are quicker.
    parts = max(4 * prints.sparkSession.sparkContext.defaultParallelism, prints.count() // KEYED_ROWS)
    sizes = hold.save(keyed.select("key").repartition(parts, "key").groupBy("key").count().where("count > 1").select("key"), "sizes")
    rows = hold.save(keyed.join(_narrow(sizes), "key"), "sharing")
    drop_saved(sizes, prints)
    hold.sweep()
    # Few lines share a key, so their texts are looked up once.
    involved = hold.save(rows.select(F.col("node").alias("p")).distinct(), "involved")
    texts = hold.save(found.where(F.col("n") >= MIN_WORDS).join(_narrow(involved), "p", "left_semi").select("p", "c", "norm"), "texts", "zstd")
    letters = texts.select(F.col("p").alias("node"), *_letters(F.col("norm"), F.col("c")))
    shared = hold.save(rows.join(letters, "node"), "shared")
    drop_saved(rows, involved)
    longer, shorter = F.greatest("c", "c_b"), F.least("c", "c_b")
    most = F.floor(longer * (1 - SIMILARITY) + 1e-9)
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= BITS) & (shorter >= longer - most) & ~_letters_differ(most)
    failed: list[DataFrame] = []
    out = linked(shared, near, lambda pairs: verify(pairs, texts, hold, failed), hold, left_over)
    drop_saved(texts, *failed)
    return out


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """(rid, id, removed): the numbers of the lines that go from each document that loses any, saved."""
    hold = Scratch(docs.sparkSession)
    found = occurrences(docs, hold, id_col, text_col, short)
    nodes = distinct_lines(found, hold)
    prints = fingerprints(found, nodes, hold)
    hold.drop(found, nodes, prints)
    parts = similar(found, prints, hold)
    grouped = nodes.join(parts, "node", "left").where(F.col("root").isNotNull() | (F.col("times") > 1))
    grouped = hold.save(grouped.select("k1", "k2", F.coalesce("root", "node").alias("root")), "grouped")
    hold.drop(found, grouped, parts)
    members = hold.save(found.join(_narrow(grouped), ["k1", "k2"]).select("id", "rid", "line", "root"), "members")
    place = F.struct("id", "rid", "line")
    heads = hold.save(members.groupBy("root").agg(F.min(place).alias("head")), "heads")
    gone = members.join(_narrow(heads), "root").where(~place.eqNullSafe(F.col("head")))
    out = hold.save(gone.groupBy("rid", "id").agg(F.array_sort(F.collect_set("line")).alias("removed")), "removed")
    hold.drop(out)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """docs with duplicate lines taken out of the text, and the columns n_lines, n_removed (of the text before) in place of any so named.

    short: lines of fewer than MIN_WORDS words that are alike once normalised are duplicates too.
    """
    docs = docs.drop("n_lines", "n_removed")
    own, rid, key, removed = unused(docs, "own", "rid", "key", "removed")
    gone = duplicates(docs, id_col, text_col, short)
    size = gone.agg(F.sum(F.size("removed") + 8)).first()[0] or 0
    gone = gone.withColumnsRenamed({"rid": rid, "id": key, "removed": removed})
    gone = F.broadcast(gone) if size <= 4 * NARROW_ROWS else gone
    text, lines = F.col(text_col), F.split(text_col, "\n", -1)
    kept = F.concat_ws("\n", F.filter(lines, lambda line, i: ~F.array_contains(removed, i)))
    out = docs.withColumn(own, _row_id(id_col, text_col))
    out = out.join(gone, (F.col(own) == F.col(rid)) & F.col(id_col).eqNullSafe(F.col(key)), "left")
    return out.select(
        *[F.when(F.col(removed).isNull(), text).otherwise(kept).alias(c) if c == text_col else out[c] for c in docs.columns],
        F.when(text.isNull() | (text == ""), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"),
    )
