import math

from cellgrid.llm import quality
from cellgrid.llm.common import table
from cellgrid.llm.entry import QUERIES

from . import brute


def test_base_columns(spark, data):
    docs = {r["doc_id"]: r["text"] for r in table(spark, data, "documents").collect()}
    rows = QUERIES["op3_quality_rules"](spark, data).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in rows} == {d: brute.base_quality(t) for d, t in docs.items()}
    assert all(not r["kept"] for r in rows if r["base_failed"])


def test_measure_of_odd_texts():
    for t in (None, "", " \n\n", "a", "a b c a b c a b c", "é# x\né# x\n\x0b y", "a b c", "x " * 100):
        m = quality.measure(t)[0]
        assert (*m, m[0] < 50 or 100 * m[4] > 50 * m[0]) == brute.base_quality(t)


def test_binomial_tail():
    for k, n, p in ((0, 10, 0.1), (3, 20, 0.2), (5, 5, 0.5)):
        assert math.isclose(quality.binomial_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_admission_bounds_the_loss():
    assert quality.admitted([0, 0, 98], 0.03, 0.05) == 0 and quality.admitted([0, 0, 100], 0.03, 0.05) == 2  # 0.97^98 > 0.05 > 0.97^100
    assert quality.admitted([2, 50, 1000], 0.03, 0.05) == 1 and quality.admitted([0], 0.03, 0.05) == 0


def test_kept_equals_brute_force(spark, docs):
    """All of the verdict by loops, on texts for which cutoffs exist."""
    import random
    from collections import Counter

    rng = random.Random(7)
    texts, good = [], []
    for i in range(700):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.choice([30, 60, 80, 120]))]
        bad = i % 5 == 0
        signs = rng.randrange(20, 60) if bad else rng.randrange(0, 8)
        for k in rng.sample(range(len(w)), min(signs, len(w))):
            w[k] += rng.choice("#%&")
        texts.append(" ".join(w))
        good.append(int(not bad))
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(good) if i % 10], "doc_id long, quality int")
    got = {r["doc_id"]: (r["base_failed"], r["kept"], sorted(r["rejected_by"])) for r in quality.judge(docs(texts), labels).collect()}
    from pyspark.sql import functions as F

    half = {r[0]: r[1] for r in spark.range(700).select("id", F.pmod(F.xxhash64("id"), F.lit(2))).collect()}
    x = [quality.measure(t)[1] for t in texts]
    failed = [brute.base_quality(t)[5] for t in texts]
    known = [i for i in range(700) if i % 10 and not failed[i]]
    fit, test = ([i for i in known if half[i] == h] for h in (0, 1))
    share = {g: sum(good[i] == g for i in fit) for g in (0, 1)}
    cuts, left, used, n = [quality.TOP] * 6, set(fit), 0, sum(good[i] for i in test)
    best_cuts = list(cuts)
    while True:
        gains = []
        for r in range(6):
            for c in range(quality.TOP - 1, -1, -1):
                new = [i for i in left if x[i][r] > c]
                gains.append((sum(not good[i] for i in new) / share[0] - quality.PRICE * sum(good[i] for i in new) / share[1], r, c))
        gain, r, c = max(gains, key=lambda g: round(g[0], 9))
        if gain <= 1e-9:
            break
        cuts[r] = min(cuts[r], c)
        left = {i for i in left if x[i][r] <= c}
        lost = sum(good[i] and any(m > k for m, k in zip(x[i], cuts)) for i in test)
        if sum(math.comb(n, k) * 0.03**k * 0.97 ** (n - k) for k in range(lost + 1)) > 0.05:
            break
        best_cuts, used = list(cuts), used + 1
    why = {i: sorted(rule for rule, m, k in zip(quality.RULES, x[i], best_cuts) if m > k) for i in range(700)}
    assert used and got == {i: (failed[i], not failed[i] and not why[i], why[i]) for i in range(700)}
    assert Counter(bool(w) for w in why.values())[True] > 80


def test_edge_cases(spark, docs):
    good = " ".join(f"w{i}" for i in range(60))
    labels = spark.createDataFrame([(0, 1, 5), (0, 0, 5), (None, 1, 5), (2, None, 5)], "doc_id long, quality int, score int")
    got = {r["doc_id"]: r for r in quality.judge(docs([good, None, "", good, good], ids=[0, 1, 2, 3, 3]), labels).collect()}
    assert got[0]["kept"] and got[3]["kept"] and not got[1]["kept"] and got[1]["n_words"] == 0
    assert quality.judge(docs([]), labels).count() == 0
    assert quality.judge(docs([good]), labels.where("false")).first()["kept"]
    long = quality.judge(docs([good + " " + "# " * 200_000]), labels.where("false")).first()
    assert long["n_symbols"] == 200_000 and long["base_failed"]
