from collections import Counter

from pyspark.sql import functions as F

from tierpick.operators import skew


def hot_rows(spark):
    """A third of the rows have one key, and many have one order value."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias(
            "k"),
        F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") * 7 % 1000).alias("a"),
        F.col("id").alias("b"),
    )


def test_split_hot_keeps_every_row_once(spark):
    df = hot_rows(spark)
    parts = skew.split_hot(df, ["k"], ["b"], max_rows=100)
    assert parts.drop("part").exceptAll(df).count() == 0 and parts.count() == 3000
    sizes = Counter((r["k"], r["part"]) for r in parts.collect())
    assert all(part == 0 for k, part in sizes if k != "hot")
    assert len([1 for k, _ in sizes if k == "hot"]) == 10
    assert max(sizes.values()) < 160


def test_split_hot_leaves_the_rows_where_they_are(spark):
    df = spark.range(50).select((F.col("id") % 3).alias("k"), "id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = skew.split_hot(df, ["k"], ["id"], max_rows=10)._jdf.queryExecution()
        assert "SortMergeJoin" not in plan.executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_split_hot_with_null_keys(spark):
    df = spark.range(50).select(F.lit(None).cast("string").alias("k"), "id")
    parts = skew.split_hot(df, ["k"], ["id"], max_rows=10)
    assert parts.count() == 50 and parts.select("part").distinct().count() > 1


def test_bounded_lists(spark):
    df = hot_rows(spark)
    lists = skew.bounded_lists(df, ["k"], ["b"], F.col("b"), "bs", max_rows=100).collect()
    assert max(len(r["bs"]) for r in lists) < 160
    assert all(r["bs"] == sorted(r["bs"]) for r in lists)
    flat = sorted(b for r in lists if r["k"] == "hot" for b in r["bs"])
    assert flat == list(range(0, 3000, 3))
    assert Counter(r["k"] for r in lists)["k7"] == 1


def test_number_rows(spark):
    df = hot_rows(spark).repartition(5)
    found = skew.number_rows(df, ["a", "b"]).orderBy("id").collect()
    assert [r["id"] for r in found] == list(range(1, 3001))
    assert [(r["a"], r["b"]) for r in found] == sorted((r["a"], r["b"]) for r in found)


def test_number_rows_replaces_id_and_takes_nothing(spark):
    df = spark.range(3).select("id", (10 - F.col("id")).alias("o"))
    assert [r["o"] for r in skew.number_rows(df, ["o"]).orderBy("id").collect()] == [8, 9, 10]
    assert skew.number_rows(df.where("o > 99"), ["o"]).count() == 0


def test_placed_gives_the_same_at_any_size(spark):
    df = hot_rows(spark).repartition(5)
    found = skew.placed(df, ["k"], ["a", "b"]).collect()
    assert len(found) == 3000
    for key in ("hot", "k7"):
        own = sorted((r["a"], r["b"]) for r in found if r["k"] == key)
        assert own == [(r["a"], r["b"]) for r in sorted(
            (r for r in found if r["k"] == key), key=lambda r: r["place"])]
        assert sorted(r["place"] for r in found if r["k"] == key) == list(range(len(own)))


def test_numbers_of_mixed_columns_without_a_written_copy(spark):
    import pathlib

    from tierpick.session import shared_dir

    def folders():
        return {p.name for p in pathlib.Path(shared_dir(spark), "tierpick").glob("numbered-*")}

    before = folders()
    df = spark.range(4000).select(
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("n"), F.col("id") % 11)).alias("s"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3 / 2).otherwise(F.lit(float("nan"))).alias("x"),
        F.when(F.col("id") % 2 > 0, F.timestamp_seconds(F.col("id") * 1000)).alias("t"),
        F.col("id").alias("b"), (F.col("id") % 2 == 0).alias("even")).repartition(6)
    order = ["s", "x", "t", "b"]
    numbered = skew.number_rows(df, order, partitions=9)
    found = {r["b"]: r["id"] for r in numbered.collect()}
    want = {r["b"]: n for n, r in enumerate(df.orderBy(*order).collect(), 1)}
    assert found == want and folders() == before
    # The same frame computed again, and dealt to another number of tasks.
    assert {r["b"]: r["id"] for r in numbered.repartition(2).collect()} == want
    for written in (False, True):
        again = skew.number_rows(df, order, partitions=3, written=written)
        assert {r["b"]: r["id"] for r in again.collect()} == want


def test_numbers_in_the_order_of_nested_columns(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 9 > 0, F.struct(
            (F.col("id") % 5).alias("n"), F.struct((F.col("id") % 3).cast("string").alias("s"))
            .alias("in"))).alias("pos"),
        F.array(F.col("id") % 4, F.when(F.col("id") % 2 > 0, F.col("id"))).alias("list"), "id")
    order = ["pos", "list", "id"]
    found = [r["id"] for r in skew.number_rows(df, order, out="n", partitions=7).orderBy("n").collect()]
    assert found == [r["id"] for r in df.orderBy(*order).collect()]


def test_numbers_spread_over_tasks(spark):
    df = spark.range(20_000).withColumn("a", F.lit(0))
    numbered = skew.number_rows(df, ["a", "id"], out="n", partitions=8)
    sizes = [r["count"] for r in numbered.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5000
