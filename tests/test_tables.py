import base64
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tierpick.sources import tables


def test_scan_pushes_the_equality_and_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", (F.col("id") % 2).alias("m"), F.lit(1).alias("x")).write.parquet(path)
    found = tables.scan(spark, path, ("id",), ("m", 1))
    assert sorted(r["id"] for r in found.collect()) == [1, 3, 5, 7, 9]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(m,1)" in plan and "x:int" not in plan


def test_scan_of_an_absent_table(spark, tmp_path):
    assert tables.read_board(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.scan(spark, str(tmp_path / "none"))


def test_replace_by_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(5), path)
    tables.replace_table(spark.range(0), path)
    assert tables.read_table(spark, path).count() == 0


def test_board_rows(rows):
    players = rows("id long, name string, home boolean, hppg double, otshga double, Scored int",
                   (30, "c", True, 0.1, 0.1, None), (10, "a", True, 0.1, 0.1, None))
    out = tables.board_rows(players, "2025-01-01", ["name"])
    assert sorted(out.columns) == ["date", "id", "name", "player_id"]
    assert [(r["id"], r["player_id"]) for r in out.orderBy("id").collect()] == [(1, 10), (2, 30)]


def test_versions(spark, tmp_path, rows):
    path, schema = str(tmp_path / "h"), "n int"
    assert tables.read_version(spark, path, schema).count() == 0
    tables.write_version(rows(schema, (1,)), path, "2025-01-01")
    tables.write_version(rows(schema, (2,)), path, "2025-01-02")
    tables.write_version(rows(schema, (3,)), path, "2025-01-02")
    assert [r["n"] for r in tables.read_version(spark, path, schema).collect()] == [3]
    before = tables.read_version(spark, path, schema, before="2025-01-02")
    assert [r["n"] for r in before.collect()] == [1]


def test_metric_is_kept_without_a_new_one(spark, tmp_path, rows):
    path = str(tmp_path / "m")
    metric = rows("id string, total long", ("current_pick_accuracy", 3))
    tables.write_metric(metric, path)
    tables.write_metric(metric.limit(0), path)
    assert tables.read_table(spark, path).first()["total"] == 3


def archive_rows(rows, *values):
    df = rows("date string, id long, scored int", *values)
    return df.withColumn("date", F.col("date").cast("date"))


def test_archive_rewrites_only_its_dates(spark, tmp_path, rows):
    path = str(tmp_path / "a")
    tables.archive(archive_rows(
        rows, ("2025-01-01", 1, None), ("2025-01-02", 2, None), ("2025-01-03", 3, None)), path)
    old = tables.read_archive(spark, path)
    dates = old.where("id < 3").select("date")
    # One date changes, one loses all rows, one is not touched.
    changed = old.where("id = 1").withColumn("scored", F.lit(1))
    tables.rewrite_dates(changed, dates, path)
    found = {(str(r["date"]), r["id"], r["scored"]) for r in
             tables.read_archive(spark, path).collect()}
    assert found == {("2025-01-01", 1, 1), ("2025-01-03", 3, None)}
    one = tables.read_archive(spark, path, "2025-01-03")
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(date" in one._jdf.queryExecution().executedPlan().toString()


def test_a_large_date_gets_several_files(spark, tmp_path):
    path = tmp_path / "a"
    df = spark.range(100).select(F.lit("2025-01-01").cast("date").alias("date"), "id")
    # Spark would join partitions as small as these.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.archive(df, str(path), rows_per_file=10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(path.glob("date=2025-01-01/*.parquet"))) > 1
    assert tables.read_archive(spark, str(path)).count() == 100


def test_training_csv(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text(
        "date,name,gpg,hgpg,five_gpg,tgpg,otga,hppg,otshga,home,scored,tims\n"
        "2025-10-07,A,0.5,1,1,1,1,1,1,1,1,2\n2025-10-07,12,abc,1,1,1,1,1,1,1,1,\n"
        "2025-10-08,C,0.5,1,1,1,1,1,1,1,,1\n")
    df = tables.read_training(spark, str(path))
    assert dict(df.dtypes)["gpg"] == "double" and dict(df.dtypes)["name"] == "string"
    assert [r["gpg"] for r in df.orderBy("name").collect()] == [None, 0.5, 0.5]
    assert [r["name"] for r in tables.complete_rows(df).collect()] == ["A"]


def test_compressed_extract(spark, rows):
    data = [{"id": 1, "name": "é"}, {"id": 2}]
    body = base64.b64encode(gzip.compress(json.dumps(data).encode())).decode()
    out = tables.land_extract(rows("entries string", (body,)), "id bigint, name string")
    assert {(r["id"], r["name"]) for r in out.collect()} == {(1, "é"), (2, None)}


def test_aligned_fields(rows):
    older, newest = rows("b int, x int", (1, 9)), rows("a string, b int", ("p", 2))
    out = tables.align_fields(older, newest)
    assert out.columns == ["a", "b"]
    assert {tuple(r) for r in out.collect()} == {(None, 1), ("p", 2)}


def test_ledger_takes_a_day_once(spark, tmp_path, rows):
    path, schema = str(tmp_path / "l"), "Date string, Name string"
    empty = rows(schema)
    day = rows(schema, ("2025-01-01", "a"), ("2025-01-01", "b"))
    tables.append_ledger(day, empty, path)
    for more in (day, rows(schema, ("2025-01-02", "c"))):
        ledger = spark.read.schema(schema).option("header", True).csv(path)
        tables.append_ledger(more, ledger, path)
    found = spark.read.schema(schema).option("header", True).csv(path)
    assert sorted(r["Name"] for r in found.collect()) == ["a", "b", "c"]


class Failing:
    """A frame whose write fails after some files have been written."""

    def __init__(self, spark):
        fail = F.when(F.col("id") > 700, F.raise_error(F.lit("lost"))).otherwise(F.lit(0))
        self.frame = spark.range(0, 1000, 1, 8).select("id", fail.cast("int").alias("x"))


def test_a_write_that_fails_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(5).selectExpr("id", "1 AS x"), path)
    with pytest.raises(Exception, match="lost"):
        tables.replace_table(Failing(spark).frame, path)
    assert tables.read_table(spark, path).count() == 5
    assert len(list((tmp_path / "t").glob("version-*"))) == 2  # the failed one lies beside it
    tables.replace_table(spark.range(7).selectExpr("id", "1 AS x"), path)
    assert tables.read_table(spark, path).count() == 7
    assert len(list((tmp_path / "t").glob("version-*"))) == 2  # and goes with the next commit


def test_a_half_written_state_of_a_day_is_none(spark, tmp_path, rows):
    path = str(tmp_path / "h")
    tables.write_version(rows("id long, x int", (1, 1)), path, "2025-01-01")
    with pytest.raises(Exception, match="lost"):
        tables.write_version(Failing(spark).frame, path, "2025-01-02")
    assert tables.read_version(spark, path, "id long, x int").count() == 1


def test_a_commit_cut_off_is_passed_over(spark, tmp_path, rows):
    path = tmp_path / "t"
    tables.replace_table(rows("n int", (1,)), str(path))
    (path / "_commits" / "000000002").write_text('{"folder": "ver')
    assert [r["n"] for r in tables.read_table(spark, str(path)).collect()] == [1]
    tables.replace_table(rows("n int", (3,)), str(path))
    assert [r["n"] for r in tables.read_table(spark, str(path)).collect()] == [3]


def test_old_versions_go_after_the_stated_number(spark, tmp_path, rows):
    path = tmp_path / "h"
    for day in range(1, 13):
        for n in (day, -day):  # the second run of a day replaces the first
            tables.write_version(rows("n int", (n,)), str(path), f"2025-01-{day:02d}", keep=4)
    assert len(list(path.glob("version-*"))) == 4
    read = lambda before: [r["n"] for r in tables.read_version(
        spark, str(path), "n int", before).collect()]
    assert read(None) == [-12] and read("2025-01-10") == [-9] and read("2025-01-09") == []


def test_a_table_can_be_replaced_by_rows_of_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(10), path)
    for _ in range(5):
        tables.replace_table(tables.read_table(spark, path).selectExpr("id + 1 AS id"), path)
    assert tables.read_table(spark, path).agg(F.sum("id")).first()[0] == 95
    assert len(list((tmp_path / "t").glob("version-*"))) == 3


def test_of_two_jobs_at_once_the_second_fails(spark, tmp_path, rows, monkeypatch):
    from tierpick.sources import versions

    path = str(tmp_path / "t")
    tables.replace_table(rows("n int", (1,)), path)
    monkeypatch.setattr(versions, "_last_number", lambda *_: 0)  # began before the other's commit
    with pytest.raises(Exception, match="exist"):
        tables.replace_table(rows("n int", (2,)), path)
    assert [r["n"] for r in tables.read_table(spark, path).collect()] == [1]


def test_what_a_job_stages_is_removed_at_its_end(spark):
    import pathlib

    from tierpick.session import scratch, shared_dir, stage

    def folders():
        return {p.name for p in pathlib.Path(shared_dir(spark), "tierpick").glob("scoped-*")}

    kept = stage(spark.range(3), "scoped-out")
    with pytest.raises(ZeroDivisionError):
        with scratch(spark):
            assert stage(spark.range(4), "scoped-in").count() == 4
            with scratch(spark):
                stage(spark.range(1), "scoped-inner")
            assert len(folders()) == 2
            1 / 0
    assert len(folders()) == 1 and kept.count() == 3


def test_board_rows_are_computed_for_one_written_copy(spark, rows, monkeypatch):
    from tierpick.operators import skew

    copies, real = [], skew.stage
    monkeypatch.setattr(skew, "stage", lambda df, name: copies.append(df.columns) or real(df, name))
    monkeypatch.setattr(skew, "_splitters", None)  # no job of its own for them
    players = rows("player_id long, stat float, home int, hppg double",
                   (7, 0.5, 1, 0.1), (8, 0.5, 0, 0.2), (9, 0.1, 1, None))
    board = tables.board_rows(players, "2025-01-02", ["stat", "home"])
    assert copies == [["player_id", "stat", "home", "date", "_at"]]  # home is hidden, but sorted by
    assert [(r["id"], r["player_id"]) for r in board.orderBy("id").collect()] == [
        (1, 9), (2, 8), (3, 7)]
    assert board.columns == ["player_id", "stat", "date", "id"]
    past = tables.history_rows(rows("date string, tims int", ("b", 1), ("a", 2)), ["date"])
    assert [tuple(r) for r in past.orderBy("id").collect()] == [("a", 2, 1), ("b", 1, 2)]
