from pyspark.sql import functions as F

from pupilage.operators import keyed


def test_lookup_equals_a_left_join(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HEAVY_SHARE", 0.3)
    keys = ["hot"] * 400 + ["warm"] * 50 + ["absent"] * 30 + [None] * 40 + [f"k{i}" for i in range(60)] + ["twice", "twice"]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i bigint, k string").repartition(5)
    right = spark.createDataFrame([("hot", 1, "a"), ("warm", 2, None), ("twice", 3, "c"), (None, 4, "d")] + [(f"k{i}", i, "x") for i in range(30)], "k string, v int, w string")
    found = sorted(keyed.lookup(left, right, "k", "i").collect(), key=lambda r: r["i"])
    expected = sorted(left.join(right, "k", "left").select("i", "k", "v", "w").collect(), key=lambda r: r["i"])
    assert found == expected


def test_heavy_keys_hold_a_share_of_a_partition(spark, monkeypatch):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [("a",)] * 60 + [("b",)] * 30 + [(f"k{i}",) for i in range(5) for _ in range(2)] + [("once",), (None,), (None,)]
    df = spark.createDataFrame(rows, "k string")
    for share in (0.5, 2.0, 0.01):
        monkeypatch.setattr(keyed, "HEAVY_SHARE", share)
        bar = share * 100 / parts
        assert {r["k"] for r in keyed.heavy_keys(df, "k").collect()} == {k for k, n in [("a", 60), ("b", 30), *((f"k{i}", 2) for i in range(5))] if n > bar}
    assert keyed.heavy_keys(df.filter("k = 'once'"), "k").isEmpty()


def test_rows_of_one_key_are_spread(spark):
    left = spark.createDataFrame([(i, "hot" if i % 10 else f"k{i}") for i in range(20_000)], "i bigint, k string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        right = spark.createDataFrame([("hot", 7), ("k10", 8)], "k string, v int")
        sizes = keyed.lookup(left, right, "k", "i").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(r["n"] for r in sizes) < 6_000
