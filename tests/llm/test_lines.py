import numpy as np
import pytest

from cellgrid.llm import lines
from cellgrid.llm.common import Scratch, table

from . import brute


def near(rng, text, n):
    w = text.split()
    for i in rng.integers(0, len(w), n):
        w[i] = f"z{rng.integers(0, 99)}"
    return " ".join(w)


def texts(seed, n=15):
    rng = np.random.default_rng(seed)
    base = [" ".join(f"a{x}bc" for x in rng.integers(0, 400, int(rng.integers(6, 60)))) for _ in range(n)]
    return base + [near(rng, base[int(i)], 1) for i in rng.integers(0, n, 30)] + [near(rng, max(base, key=len), 1) for _ in range(40)]


def steps(spark, d, short=False):
    hold = Scratch(spark)
    found = lines.occurrences(d, hold, short=short)
    nodes = lines.distinct_lines(found, hold)
    return hold, found, nodes, lines.fingerprints(found, nodes, hold)


def norms(found, nodes):
    return {r["node"]: r["norm"] for r in nodes.select(nodes["node"].alias("p"), "node").join(found.select("p", "norm"), "p").collect()}


@pytest.mark.parametrize("left_over", [None, 0])
def test_groups_equal_brute_force(spark, docs, left_over):
    """All pairs that share a key and are near by fingerprint and edit similarity, and their components."""
    hold, found, nodes, prints = steps(spark, docs(texts(3)))
    rows = norms(found, nodes)
    p = {r["node"]: (r["fp"] & (1 << 64) - 1, set(r["keys"])) for r in prints.collect()}
    assert p.keys() == rows.keys()
    pairs = [(a, b) for a in rows for b in rows if a < b and p[a][1] & p[b][1] and (p[a][0] ^ p[b][0]).bit_count() <= lines.BITS]
    pairs = brute.alike(pairs, rows)
    assert max(sum(k in x[1] for x in p.values()) for _, keys in p.values() for k in keys) > 40
    want = brute.union(pairs, rows)
    got = {r["node"]: r["root"] for r in lines.similar(found, prints, hold, left_over).collect()}
    assert {n: got.get(n, n) for n in rows} == want


def test_fingerprint_is_the_majority(spark, docs):
    from pyspark.sql import functions as F

    _, found, nodes, prints = steps(spark, docs(["a b c d e f a a", "x y z x y z q"]))
    got = {r["node"]: r["fp"] & (1 << 64) - 1 for r in prints.collect()}
    for node, norm in norms(found, nodes).items():
        w = norm.split()
        h = [r[0] for r in spark.createDataFrame(list(zip(w, [*w[1:], ""])), "w string, x string").select(F.xxhash64("w", "x")).collect()]
        assert got[node] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(w))


def test_fingerprint_over_parts(spark, docs, monkeypatch):
    def prints():
        _, found, nodes, got = steps(spark, docs(texts(1)))
        at = norms(found, nodes)
        return {at[r["node"]]: (r["fp"], r["c"], sorted(r["keys"])) for r in got.collect()}

    whole = prints()
    monkeypatch.setattr(lines, "CHUNK", 7)
    assert prints() == whole


def test_recall_of_edit_similarity(spark, docs):
    """Against brute force on edit similarity alone: at least 0.9 of the pairs of all lengths, and no other links."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9))))

    def edited(text):
        w = text.split()
        for _ in range(int(rng.integers(1, len(w) // 6 + 2))):
            at, kind = int(rng.integers(0, len(w))), rng.integers(0, 3)
            w[at : at + (kind != 1)] = [] if kind == 2 else [word()]
        return " ".join(w)

    base = [" ".join(word() for _ in range(n)) for n in (6, 7, 8, 9, 10, 12, 14, 19, 24, 30, 50, 79, 82, 100, 115, 150) for _ in range(3)]
    hold, found, nodes, prints = steps(spark, docs(base + [edited(t) for t in base for _ in range(2)]))
    rows = norms(found, nodes)
    pairs = brute.alike([(a, b) for a in rows for b in rows if a < b], rows)
    got = {r["node"]: r["root"] for r in lines.similar(found, prints, hold).collect()}
    joined = [(a, b) for a, b in pairs if a in got and got[a] == got.get(b)]
    assert len(pairs) > 60 and len(joined) >= 0.9 * len(pairs)
    want = brute.union(pairs, rows)
    assert all(want[n] == want[root] for n, root in got.items())


def test_recall_on_the_tables(spark, data):
    """All pairs of lines of the smallest table that share two words in a row are looked at by brute force."""
    hold, found, nodes, prints = steps(spark, table(spark, data, "documents"))
    rows = {n: t for n, t in norms(found, nodes).items() if len(t) < 1000}
    by = {}
    for n, t in rows.items():
        w = t.split()
        for pair in set(zip(w, w[1:])):
            by.setdefault(pair, []).append(n)
    pairs = {(a, b) for x in by.values() if len(x) < 30 for a in x for b in x if a < b}
    pairs = brute.alike(pairs, rows)
    got = {r["node"]: r["root"] for r in lines.similar(found, prints, hold).collect()}
    assert len(pairs) > 10 and sum(a in got and got[a] == got.get(b) for a, b in pairs) >= 0.9 * len(pairs)


def test_first_occurrence_stays(spark, docs):
    a, b = "the first line has quite a few words in it", "another line of words that is not like it"
    close = a + "!"
    d = docs([f"{a}\n{b}", f"x y\n{close}\n\n{b}\nx y", None, "", f"{a}\n{a}", "x y", a], ids=[4, 5, 6, 7, 3, 8, 8])
    out = lines.dedup_lines(d)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr)
    assert rows == sorted([(4, b, 2, 1), (5, "x y\n\nx y", 5, 2), (6, None, 0, 0), (7, "", 0, 0), (3, a, 2, 1), (8, "x y", 1, 0), (8, "", 1, 1)], key=repr)
    assert lines.dedup_lines(docs([])).count() == 0


def test_columns_of_any_name_keep_their_values(spark, docs):
    from pyspark.sql import functions as F

    a = "the first line has quite a few words in it"
    names = ("own", "_own", "_rid", "_id", "_removed", "removed", "_key")
    d = docs([a, a + "\nx"]).drop("removed").select("*", *[F.lit(5).alias(c) for c in names])
    rows = lines.dedup_lines(d).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == {0: a, 1: "x"} and all(r[c] == 5 for r in rows for c in names)


def test_repeated_rows_and_nulls(spark, docs):
    a = "the first line has quite a few words in it"
    d = docs([a, a, a + "\nx y", None, None, a], ids=[2, 2, 3, None, None, None])
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(d).collect()), key=repr)
    # The null id comes first, so the line of its document stays.
    assert got == sorted([(2, "", 1), (2, "", 1), (3, "x y", 1), (None, None, 0), (None, None, 0), (None, a, 0)], key=repr)


def test_long_lines(spark, docs):
    rng = np.random.default_rng(5)
    w = ["".join(chr(97 + int(x)) for x in row) for row in rng.integers(0, 26, (4_000, 5))]
    other = w.copy()
    other[2_000] = "changed"
    rows = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs([" ".join(w), " ".join(["more", "words"] * 30 + other), " ".join(reversed(w))])).collect()}
    assert rows == {0: 0, 1: 1, 2: 0}


def test_short_and_unspaced_lines(spark, docs):
    long = "東京都は日本の首都であり世界で最も人口の多い都市の一つです"
    d = docs(["All rights reserved.\n---\n \nLes.\n" + long, "les\nall rights reserved\n***\n \n---\n" + long.replace("最", "極"), "Les."])
    rows = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(d, short=True).collect()}
    assert rows == {0: ("All rights reserved.\n---\n \nLes.\n" + long, 0), 1: ("***\n ", 4), 2: ("", 1)}
    kept = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(d).collect()}
    assert kept == {0: 0, 1: 1, 2: 0}


def test_bound_of_lines_side_by_side(spark):
    """Never under the edit distance, and close to it where words here and there are edited."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 6))))
    rows = []
    for n in [1, 2, 5, 20, 60, 200] * 12:
        w = [word() for _ in range(n)]
        other = list(w)
        for _ in range(int(rng.integers(0, n // 6 + 2))):
            at, kind = int(rng.integers(0, len(other) + 1)), rng.integers(0, 3)
            other[at : at + (kind != 1)] = [] if kind == 2 and len(other) > 1 else [word()]
        rows.append((" ".join(w), " ".join(other)))
    d = spark.createDataFrame(rows, "x string, y string")
    bound = lines._in_step(F.split("x", " ", -1), F.split("y", " ", -1))
    got = d.select(F.levenshtein("x", "y").alias("d"), bound.alias("most")).collect()
    assert all(r["most"] >= r["d"] for r in got) and sum(r["most"] for r in got) <= 1.3 * sum(r["d"] for r in got)


def test_pairs_that_fail_are_compared_once(spark, docs):
    hold, found, nodes, _ = steps(spark, docs(["one two three four five six", "one two three four five sir", "seven eight nine ten eleven twelve"]))
    at = {text: node for node, text in norms(found, nodes).items()}
    a, b, c = at["one two three four five six"], at["one two three four five sir"], at["seven eight nine ten eleven twelve"]
    pairs = spark.createDataFrame([(a, b), (a, c), (a, c)], "a long, b long")
    failed = []
    assert [tuple(r) for r in lines.verify(pairs, found, hold, failed).collect()] == [(a, b)]
    assert lines.verify(pairs.where(f"b = {c}"), found, hold, failed).isEmpty()
    assert [[tuple(r) for r in f.collect()] for f in failed] == [[(a, c)], []]


def test_failed_pairs_are_left_out_by_one_join(spark, docs, monkeypatch):
    """However many tables of failed pairs there are, no row of pairs goes through more than one join with them."""
    hold, found, nodes, _ = steps(spark, docs(["one two three four five six", "one two three four five sir", "seven eight nine ten eleven twelve"]))
    a, b, c = sorted(norms(found, nodes))
    pairs = spark.createDataFrame([(a, b), (a, c), (b, c)], "a long, b long")
    failed, plans, save = [hold.save(pairs.where(f"b = {c}").limit(0), "failed") for _ in range(3)], [], hold.save
    monkeypatch.setattr(hold, "save", lambda df, label, codec=None: (label == "pairs" and plans.append(df._jdf.queryExecution().analyzed().toString()), save(df, label, codec))[1])
    lines.verify(pairs, found, hold, failed)
    assert [p.count("LeftAnti") for p in plans] == [1] and len(failed) == 4


def test_words_of_pairs_are_not_shuffled(spark, docs, monkeypatch):
    """Pairs are dealt out with their two lines, which are cut into words only then."""
    hold, found, nodes, _ = steps(spark, docs(["one two three four five six", "one two three four five sir"]))
    a, b = sorted(norms(found, nodes))
    plans, save = [], hold.save
    monkeypatch.setattr(hold, "save", lambda df, label, codec=None: (label == "verified" and plans.append(df._jdf.queryExecution().optimizedPlan().toString()), save(df, label, codec))[1])
    assert lines.verify(spark.createDataFrame([(a, b)], "a long, b long"), found, hold).count() == 1
    above, _, below = plans[0].partition("RepartitionByExpression")
    assert below and "split(" in above and "split(" not in below


def test_letters_never_rule_out_a_similar_pair(spark):
    """What the letters show is never more than the edit distance, and it tells lines of other words apart."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = []
    for n in [1, 5, 30, 200] * 30:
        x = "".join(rng.choice(list("etaoinzx\u00e9\u6771 0"), n))
        y = list(x)
        for _ in range(int(rng.integers(0, n // 3 + 2))):
            at, kind = int(rng.integers(0, len(y) + 1)), rng.integers(0, 3)
            y[at : at + (kind != 1)] = [] if kind == 2 else [str(rng.choice(list("etaoinzx\u00e9\u6771 0")))]
        rows.append((x, "".join(y)))
    rows += [("a" * 70_000, "a" * 70_001), ("seven eight nine ten", "kkkkk bbbbb mmmm jjj")]
    d = spark.createDataFrame(rows, "x string, y string").withColumns({"c": F.length("x"), "c_b": F.length("y"), "d": F.when(F.length("x") > 1000, 1).otherwise(F.levenshtein("x", "y"))})
    d = d.select("*", *lines._letters(F.col("x"), F.col("c")), *[h.alias(f"h{k}_b") for k, h in enumerate(lines._letters(F.col("y"), F.col("c_b")))])
    got = d.select(lines._letters_differ(F.col("d")).alias("no"), lines._letters_differ(F.lit(9)).alias("nine"), "x").collect()
    assert not any(r["no"] for r in got) and got[-1]["nine"]


def test_single_blanks_are_not_replaced():
    """Most gaps are one blank, which stays as it is; all others become one, as by WORD_GAP within a line."""
    import re

    assert re.findall(lines.LINE_GAP, "one two, three  four five-six\nseven. eight") == [", ", "  ", "-", ". "]
    rng = np.random.default_rng(9)
    plain = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
    for _ in range(500):
        text = "".join(rng.choice([*map(chr, range(128)), *" " * 60, *"\né東 " * 5], 60))
        assert re.sub(lines.LINE_GAP, " ", text) == re.sub(plain, " ", text)


def test_letters_are_taken_out_one_after_another(spark):
    """Each of LETTERS is looked for in what the ones before have left, and counted right."""
    from pyspark.sql import functions as F

    text = "the first line of words été 東 zz wwyg"
    d = spark.createDataFrame([(text,)], "x string").select(*lines._letters(F.col("x"), F.length("x")))
    got = [d.first()[k // 4] >> 16 * (k % 4) & 0xFFFF for k in range(16)]
    own = [text.count(x) for x in lines.LETTERS]
    assert got == [*own, len(text) - sum(own)]
    assert "replace(replace(" in d._jdf.queryExecution().analyzed().toString()


def test_equal_ends_do_not_change_the_distance(spark):
    """Lines without the words that they have in common at their ends have the same edit distance, and most are much shorter."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    word = lambda: str(rng.choice(["a", "b", "ab", "ba", "abc", "\u00e9a"]))
    rows = [("a b", "a b"), ("a b", "a c b"), ("a", "a a"), ("a b a", "a"), ("a", "b"), ("ab c", "a b c")]
    for n in [1, 2, 3, 8, 30] * 20:
        w = [word() for _ in range(n)]
        at, to = sorted(map(int, rng.integers(0, n + 1, 2)))
        other = w[:at] + [word() for _ in range(int(rng.integers(0, 4)))] + w[to:]
        rows.append((" ".join(w), " ".join(other or ["b"])))
    v, w = F.split("x", " ", -1), F.split("y", " ", -1)
    ends = lines._equal_ends(v, w)
    d = spark.createDataFrame(rows, "x string, y string").select("x", "y", lines._between(v, *ends).alias("v"), lines._between(w, *ends).alias("w"))
    got = d.select(F.levenshtein("x", "y").alias("d"), F.levenshtein("v", "w").alias("inner"), F.length("x").alias("n"), F.length("v").alias("left")).collect()
    assert all(r["d"] == r["inner"] for r in got) and sum(r["left"] for r in got) < 0.7 * sum(r["n"] for r in got)


def test_distances_are_computed_once_and_between_equal_ends(spark, docs, monkeypatch):
    """Of lines with words in common no second, narrower distance is computed, and none of whole lines; keys are not counted ahead of their shuffle."""
    hold, found, nodes, prints = steps(spark, docs(["one two three four five six", "one two three four five sir", "six five four nine ten one"]))
    plans, save = {}, hold.save
    monkeypatch.setattr(hold, "save", lambda df, label, codec=None: (plans.setdefault(label, df._jdf.queryExecution()), save(df, label, codec))[1])
    got = {r["node"]: r["root"] for r in lines.similar(found, prints, hold).collect()}
    assert len(got) == 2 and len(set(got.values())) == 1
    verified = plans["verified"].analyzed().toString()
    assert " div 3" not in verified and verified.count("levenshtein(x") == 1 and verified.count("levenshtein(") == 2
    counted = plans["sizes"].sparkPlan().toString()
    assert counted.index("HashAggregate") < counted.index("Generate") and "REPARTITION" in counted
