import pytest
from pyspark.sql import functions as F

from cellgrid import group_counts, group_ids, group_update, group_values, indices_by_field, indices_by_id, iterate_groups, with_row_index

ROWS = [(0, "foo", 2, 0.5, 15), (1, "bar", 3, 1.5, 15), (2, "baz", 2, 2.5, 30), (3, "bat", 3, 3.5, 30), (4, "bet", 4, 4.5, 15), (5, "bot", 4, 5.5, 30)]
SCHEMA = "row_idx long, field string, a int, b float, c int"


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def found(df, *keys):
    return {tuple(r[k] for k in keys): r["indices"] for r in df.collect()}


def test_one_and_two_fields(table):
    assert found(indices_by_field(table, "a"), "a") == {(2,): [0, 2], (3,): [1, 3], (4,): [4, 5]}
    want = {(2, 15): [0], (2, 30): [2], (3, 15): [1], (3, 30): [3], (4, 15): [4], (4, 30): [5]}
    assert found(indices_by_field(table, ["a", "c"]), "a", "c") == want
    assert found(indices_by_field(table, ("a", "c")), "a", "c") == want
    assert dict(iterate_groups(table, "a")) == {2: [0, 2], 3: [1, 3], 4: [4, 5]}
    assert dict(iterate_groups(table, ["a"])) == {(2,): [0, 2], (3,): [1, 3], (4,): [4, 5]}


def test_single_group_keeps_every_row(spark):
    df = spark.createDataFrame([(i, 1) for i in range(3)], "row_idx long, k int")
    assert found(indices_by_field(df, "k"), "k") == {(1,): [0, 1, 2]}


def test_null_nan_and_strings(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, nan, "x"), (1, None, "x"), (2, nan, None), (3, None, None)], "row_idx long, k double, s string")
    assert sorted(r["indices"] for r in indices_by_field(df, "k").collect()) == [[0, 2], [1, 3]]
    assert found(indices_by_field(df, "s"), "s") == {("x",): [0, 1], (None,): [2, 3]}
    assert group_ids(df, "s").count() == 4


def test_index_type_and_bad_fields(table):
    assert dict(indices_by_field(table, "a", indices_type="int").dtypes)["indices"] == "array<int>"
    for fields in ("nope", [], ["a", "nope"]):
        with pytest.raises(ValueError):
            indices_by_field(table, fields)


def test_ids_values_counts(table):
    ids = group_ids(table, ["a", "c"])
    assert {(r["a"], r["c"]): r["group_id"] for r in ids.collect()} == {(2, 15): 0, (2, 30): 1, (3, 15): 2, (3, 30): 3, (4, 15): 4, (4, 30): 5}
    assert found(indices_by_id(ids), "group_id") == {(i,): [j] for i, j in enumerate((0, 2, 1, 3, 4, 5))}
    assert {r["a"] for r in group_values(table, "a").collect()} == {2, 3, 4}
    assert {r["n_rows"] for r in group_counts(table, "a").collect()} == {2}


def test_update(table):
    got = group_update(table, "a", b=F.max("b"), n=F.count("*")).orderBy("row_idx").collect()
    assert [r["b"] for r in got] == [2.5, 3.5, 2.5, 3.5, 5.5, 5.5] and {r["n"] for r in got} == {2}


def test_every_row_in_one_group(spark):
    df = with_row_index(spark.range(1000, numPartitions=7).select((F.col("id") % 13).alias("k")))
    assert sorted(i for r in indices_by_field(df, "k").collect() for i in r["indices"]) == list(range(1000))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert indices_by_field(df, "a").count() == 0 and group_ids(df, "a").count() == 0 and with_row_index(df, "n").count() == 0


def test_long_form_and_clashing_names(spark):
    from pyspark.sql import functions as F

    from cellgrid import group_ids, group_positions, group_update, indices_by_field, with_row_index

    names = ("part", "base", "place", "first", "key_a", "new_m", "mono", "offset", "group", "_part", "_k_a")
    df = spark.createDataFrame([(i, i % 3 if i % 7 else None, i % 2) for i in range(100)], "row_idx long, a long, b long").repartition(5).select("*", *[F.lit(9).alias(c) for c in names])
    want = {(r["a"], k): i for r in indices_by_field(df, "a").collect() for k, i in enumerate(r["indices"])}
    assert {(r["a"], r["ordinal"]): r["row_idx"] for r in group_positions(df, "a").collect()} == want
    ids = group_ids(df, "a").collect()
    assert {(r["a"], r["group_id"]) for r in ids} == {(None, 0), (0, 1), (1, 2), (2, 3)} and all(r[c] == 9 for r in ids for c in names)
    changed = group_update(df, "a", m=F.max("row_idx")).collect()
    assert len(changed) == 100 and all(r[c] == 9 for r in changed for c in names) and {r["m"] for r in changed if r["a"] is None} == {98}
    numbered = with_row_index(df.drop("row_idx").coalesce(1)).collect()
    assert sorted(r["row_idx"] for r in numbered) == list(range(100)) and all(r["part"] == 9 for r in numbered)
