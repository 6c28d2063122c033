from knotwork.operators import joins


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_both_sides_of_the_bound_give_the_same_rows(spark, monkeypatch):
    left = spark.createDataFrame([("hot", i) for i in range(400)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "key string, n int").repartition(5)
    right = spark.createDataFrame([("hot", "x"), *[(f"k{i}", str(i)) for i in range(0, 50, 2)]], "key string, v string")
    for how in ("left", "inner"):
        small = _rows(joins.lookup_join(left, right, "key", how).select("key", "n", "v"))
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
        large = _rows(joins.lookup_join(left, right, "key", how).select("key", "n", "v"))
        monkeypatch.undo()
        assert small == large and len(small) == (451 if how == "left" else 425)


def test_hot_keys_are_found(spark):
    df = spark.createDataFrame([("hot",)] * 300 + [("warm",)] * 30 + [(f"k{i}",) for i in range(500)] + [(None,)] * 99, "key string").repartition(4)
    assert {r["key"] for r in joins.hot_keys(df, "key", 0.02).collect()} == {"hot", "warm"}
    assert joins.hot_keys(df.where("false"), "key").collect() == []
