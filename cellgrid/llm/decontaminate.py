"""Benchmark decontamination by a distributed positional inverted index (native DataFrame plan).

The postings (term, id, h, pos) of the training words that test items have are
stored once; h, the hash of the text, and the id stand for a row.  Everything
after reads postings alone.  For each window of an item the two rarest terms,
by their posting counts over the corpus, lead: the rarest one's list and the
next one's are intersected at adjusted offsets (pos - q, q being the place in
the item), and what both give is joined with the postings of all the item's
terms in the rows found.  Runs of matching places long enough for a window are
the exact occurrences.

The join on (term) is made from the few leading terms' side; lists of frequent
terms lie in many partitions, in the order of the rows, so none is in one
task.  No array of words is moved: rows of the index are numbers.

Defined cases: null or wordless texts have no words and no hits; rows of equal
id and text have one result each, the same; items with a null item_id or no
words never occur; repeated items count once per item_id; ties between terms
are ordered by their place; texts of any length are indexed whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.sources.shared import unused

from .common import Scratch, at_once, small, words_of

WINDOW = 13
#: The term number of a row's length: one posting a row, at the place after its last word.
LENGTH = 0


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct items (item, words) that have a word."""
    out = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words"))
    return out.where(F.col("item").isNotNull() & (F.size("words") > 0)).distinct()


def number_terms(places: DataFrame, hold: Scratch) -> DataFrame:
    """(word, term): a number from 1 for each distinct word of the column `word`, saved; the empty word is LENGTH."""
    words = places.select("word").where("word <> ''").distinct()
    numbers = words.select("word", (F.monotonically_increasing_id() + 1).alias("term"))
    return hold.save(numbers.union(places.sparkSession.createDataFrame([("", LENGTH)], "word string, term long")), "terms")


def postings(docs: DataFrame, terms: DataFrame, hold: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, id, h, pos) of the given words in docs, and a posting of LENGTH for each row; saved."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), at_once(F.xxhash64(text)).alias("h"), F.array_append(words_of(text), "").alias("words"))
    each = rows.select("id", "h", F.posexplode("words").alias("pos", "word"))
    return hold.save(each.join(small(terms, terms.count()), "word").select("term", "id", "h", "pos"), "postings", "zstd")


def item_places(items: DataFrame, terms: DataFrame, hold: Scratch) -> DataFrame:
    """(item, entry, m, q, term) of each place q of each item, saved; entry tells texts of one item apart."""
    each = items.select("item", F.xxhash64("words").alias("entry"), F.size("words").alias("m"), F.posexplode("words").alias("q", "word"))
    return hold.save(each.join(small(terms, terms.count()), "word").drop("word"), "places")


def leaders(places: DataFrame, counts: DataFrame, n_terms: int, window: int) -> DataFrame:
    """(item, entry, m, q, term, q2, term2): the places of the two rarest terms of each window; the second is null in windows of one word."""
    need = F.least(F.lit(window), F.col("m"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - window + 1), F.least(F.col("q"), F.greatest(F.lit(0), F.col("m") - window)))
    each = places.join(small(counts, n_terms), "term").withColumn("start", F.explode(starts))
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("count", "q", "term"))), 1, 2)  # at most `window` places
    found = each.groupBy("item", "entry", "m", "start").agg(rarest.alias("r"), F.count("*").alias("found"))
    # A term that the corpus lacks rules its windows out.
    found = found.where(F.col("found") == need)
    return found.select("item", "entry", "m", F.col("r")[0]["q"].alias("q"), F.col("r")[0]["term"].alias("term"), F.get("r", F.lit(1))["q"].alias("q2"), F.get("r", F.lit(1))["term"].alias("term2")).distinct()


def _same_row(a: str = "", b: str = "_b") -> Column:
    return F.col(f"id{a}").eqNullSafe(F.col(f"id{b}")) & (F.col(f"h{a}") == F.col(f"h{b}"))


def phrase_matches(index: DataFrame, items: DataFrame, terms: DataFrame, hold: Scratch, window: int = WINDOW) -> DataFrame:
    """Stretches (id, h, item, lo, hi, item_lo) that occurring windows cover, saved."""
    n_terms = terms.count()
    places = item_places(items, terms, hold)
    counts = hold.save(index.where(F.col("term") != LENGTH).groupBy("term").count(), "counts")
    lead = hold.save(leaders(places, counts, n_terms, window), "leaders")
    needed = hold.save(lead.select("term").union(lead.select("term2")).where("term IS NOT NULL").distinct(), "needed")
    lists = hold.save(index.join(small(needed, n_terms), "term"), "lists")
    n_lead = lead.count()

    # The rarest lists at the offsets of their items, met by the next ones.
    first = lists.join(small(lead, n_lead), "term").select("id", "h", "item", "entry", "m", "q2", "term2", (F.col("pos") - F.col("q")).alias("at"))
    second = lists.select(F.col("term").alias("term_b"), F.col("id").alias("id_b"), F.col("h").alias("h_b"), F.col("pos").alias("pos_b"))
    both = first.where("term2 IS NOT NULL").join(second, (F.col("term2") == F.col("term_b")) & _same_row() & (F.col("at") + F.col("q2") == F.col("pos_b")))
    diagonals = both.select("id", "h", "item", "entry", "m", "at").union(first.where("term2 IS NULL").select("id", "h", "item", "entry", "m", "at"))
    diagonals = hold.save(diagonals.distinct(), "diagonals")

    # All terms of the items found, in the rows found.
    rows = hold.save(diagonals.select(F.col("id").alias("id_b"), F.col("h").alias("h_b")).distinct(), "rows")
    near = hold.save(index.join(small(rows, rows.count()), _same_row(), "left_semi"), "near")
    expected = diagonals.join(small(places.drop("m"), places.count()), ["item", "entry"]).withColumn("pos", F.col("at") + F.col("q"))
    near = near.select(F.col("term").alias("term_b"), F.col("id").alias("id_b"), F.col("h").alias("h_b"), F.col("pos").alias("pos_b")).distinct()
    equal = expected.join(near, (F.col("term") == F.col("term_b")) & _same_row() & (F.col("pos") == F.col("pos_b")))
    run = F.col("q") - F.row_number().over(Window.partitionBy("id", "h", "item", "entry", "at").orderBy("q"))
    runs = equal.select("id", "h", "item", "entry", "m", "at", "q", run.alias("run")).groupBy("id", "h", "item", "entry", "m", "at", "run")
    runs = runs.agg(F.min("q").alias("item_lo"), F.max("q").alias("item_hi"), F.count("*").alias("n")).where(F.col("n") >= F.least(F.lit(window), F.col("m")))
    out = hold.save(runs.select("id", "h", "item", (F.col("at") + F.col("item_lo")).alias("lo"), (F.col("at") + F.col("item_hi")).alias("hi"), "item_lo"), "matches")
    return out


def proximity_matches(docs: DataFrame, terms: list[str], within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows and spans (id, h, lo, hi) that hold all the given terms, start and end in one of them, are at most `within` words long and hold no such span but their own.

    For each posting of one of the terms the nearest one before it of each
    other term is kept by a running window over the row's postings.
    """
    hold = Scratch(docs.sparkSession)
    terms = list(dict.fromkeys(terms))
    wanted = number_terms(docs.sparkSession.createDataFrame([(t,) for t in terms], "word string"), hold)
    numbers = {r["word"]: r["term"] for r in wanted.collect()}  # the given terms
    index = postings(docs, wanted, hold, id_col, text_col).where(F.col("term") != LENGTH)
    so_far = Window.partitionBy("id", "h").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("term") == numbers[t], F.col("pos"))).over(so_far) for t in terms]
    spans = index.distinct().select("id", "h", "pos", F.array(*last).alias("last"))
    spans = spans.where(~F.exists("last", lambda x: x.isNull())).select("id", "h", F.array_min("last").alias("lo"), F.col("pos").alias("hi"))
    shortest = spans.groupBy("id", "h", "lo").agg(F.min("hi").alias("hi"))
    out = hold.save(shortest.where(F.col("hi") - F.col("lo") < within), "spans")
    hold.drop(out)
    return out


def _hits(docs: DataFrame, items: DataFrame, hold: Scratch, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, h, n_words) of every row, and (id, h, n_hit, items) of the rows with hits, saved."""
    wanted = hold.save(item_words(items), "items")
    terms = number_terms(wanted.select(F.explode("words").alias("word")), hold)
    index = postings(docs, terms, hold, id_col, text_col)
    rows = hold.save(index.where(F.col("term") == LENGTH).select("id", "h", F.col("pos").cast("long").alias("n_words")), "lengths")
    matches = phrase_matches(index, wanted, terms, hold, window)
    covered = matches.select("id", "h", F.explode(F.sequence("lo", "hi")).alias("pos")).distinct().groupBy("id", "h").agg(F.count("*").alias("n_hit"))
    named = matches.select("id", "h", F.col("item").cast("string").alias("item")).distinct().groupBy("id", "h").agg(F.array_sort(F.collect_list("item")).alias("items"))
    named = named.withColumnsRenamed({"id": "id_b", "h": "h_b"})
    found = hold.save(covered.join(named, _same_row()).select("id", "h", "n_hit", "items"), "hits")
    hold.drop(rows, found)
    return rows, found


def _judged(rows: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(id, h, n_words, n_hit, items, contaminated) of every row."""
    found = found.withColumnsRenamed({"id": "id_b", "h": "h_b"})
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    out = rows.join(small(found, found.count()), _same_row(), "left")
    return out.select("id", "h", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (n_hit * 100 >= percent * F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_hit, items (sorted ids as strings), contaminated."""
    rows, found = _hits(docs, items, Scratch(docs.sparkSession), window, id_col, text_col)
    return _judged(rows, found, percent).drop("h").withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the contaminated rows, with all their columns."""
    hold = Scratch(docs.sparkSession)
    rows, found = _hits(docs, items, hold, window, id_col, text_col)
    gone = hold.save(_judged(rows, found, percent).where("contaminated").select("id", "h").distinct(), "gone")
    hold.drop(gone)
    key, h = unused(docs, "key", "h")
    gone = small(gone.withColumnsRenamed({"id": key, "h": h}), gone.count())
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(h)), "left_anti")
