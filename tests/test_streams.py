import datetime
import decimal
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tierpick.operators.history import fill_outcomes
from tierpick.sources import versions
from tierpick.streaming import board, outcomes

SCHEMA = "game long, at int, status string, away int, home int"


def run_changes(spark, rows, tmp_path, arrivals, **kw):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    for values in arrivals:
        df = rows(SCHEMA, *values)
        df.write.mode("append").parquet(landing)
        board.change_stream(
            board.poll(spark, landing, df.schema), out, str(tmp_path / "cp"), "game", ["at"],
            ["away", "home"], F.floor(F.col("at") / 10), available_now=True, **kw,
        ).awaitTermination()
    found = board.read_changes(spark, out, df.schema).orderBy("at").collect()
    return out, [(r["game"], r["at"]) for r in found]


ARRIVALS = [
    [(1, 1, "LIVE", 0, 0), (1, 2, "LIVE", 0, 0), (2, 3, "LIVE", 1, 0), (1, 4, "FINAL", 0, 1)],
    [(1, 21, "FINAL", 0, 1), (2, 22, "LIVE", 1, 0), (2, 23, "LIVE", 1, 1)],
    [(2, 41, "LIVE", 1, 1), (1, 42, "FINAL", 1, 1)],
]


def test_state_is_carried_between_batches(spark, rows, tmp_path):
    _, found = run_changes(spark, rows, tmp_path, ARRIVALS)
    assert found == [(1, 1), (2, 3), (1, 4), (2, 23), (1, 42)]


def test_finished_games_leave_the_state(spark, rows, tmp_path):
    _, found = run_changes(spark, rows, tmp_path, ARRIVALS, done=F.col("status") == "FINAL")
    assert found == [(1, 1), (2, 3), (1, 4), (1, 21), (2, 23), (1, 42)]


def test_detail_is_asked_for_changed_games_only(spark, rows, tmp_path):
    asked = []

    def detail(keys):
        asked.append(sorted(r["game"] for r in keys.collect()))
        return keys.select("game", F.lit(len(asked)).alias("version"))

    out, _ = run_changes(spark, rows, tmp_path, ARRIVALS, detail=detail)
    assert asked == [[1, 2], [2], [1]]
    now = board.read_detail(spark, out, "game", "bigint", "game bigint, version int")
    assert {(r["game"], r["version"]) for r in now.collect()} == {(1, 3), (2, 2)}


def test_outcomes_arrive_late(spark, rows, tmp_path):
    history, landing = str(tmp_path / "h"), str(tmp_path / "l")

    def dated(ddl, *values):
        return rows(ddl, *values).withColumn("date", F.col("date").cast("date"))

    past = dated("date string, player_id bigint, tims int, Scored int",
                 ("2025-01-01", 1, 1, None), ("2025-01-01", 2, 2, None), ("2025-01-02", 3, 1, None))
    versions.commit(past, history)
    arrivals = [[("2025-01-01", 2, 0)], [("2025-01-01", 1, 1), ("2025-01-05", 3, 1)]]
    everything = None
    for values in arrivals:
        late = dated("date string, id bigint, scored int", *values)
        everything = late if everything is None else everything.unionByName(late)
        late.write.mode("append").parquet(landing)
        outcomes.outcome_stream(
            board.poll(spark, landing, late.schema), history, "2025-01-03",
            str(tmp_path / "cp"), available_now=True).awaitTermination()
    now = versions.read(spark, history)
    twin = fill_outcomes(past, everything, "2025-01-03")
    assert now.exceptAll(twin.select(*now.columns)).count() == 0 and now.count() == 3
    assert {r["player_id"]: r["Scored"] for r in now.collect()} == {1: 1, 2: 0, 3: None}


def test_a_date_in_two_batches_keeps_both(spark, rows, tmp_path):
    landing, path = str(tmp_path / "l"), str(tmp_path / "a")
    for values in ([("2025-01-01", 1, 5)], [("2025-01-01", 2, 6), ("2025-01-02", 1, 7)],
                   [("2025-01-01", 1, 8)]):
        df = rows("date string, id long, v int", *values).withColumn(
            "date", F.col("date").cast("date"))
        df.write.mode("append").parquet(landing)
        outcomes.archive_stream(
            board.poll(spark, landing, df.schema), path, str(tmp_path / "cp"),
            available_now=True).awaitTermination()
    assert {(str(r["date"]), r["id"], r["v"]) for r in spark.read.parquet(path).collect()} == {
        ("2025-01-01", 1, 8), ("2025-01-01", 2, 6), ("2025-01-02", 1, 7)}


def test_an_archived_batch_is_staged_once(spark, rows, tmp_path, monkeypatch):
    staged, real = [], outcomes.stage
    monkeypatch.setattr(outcomes, "stage", lambda df, name: staged.append(name) or real(df, name))
    landing, path = str(tmp_path / "l"), str(tmp_path / "a")
    df = rows("date string, id long, v int", ("2025-01-01", 1, 5), ("2025-01-01", None, 6)
              ).withColumn("date", F.col("date").cast("date"))
    df.write.parquet(landing)
    for checkpoint in ("c", "d"):
        outcomes.archive_stream(
            board.poll(spark, landing, df.schema), path, str(tmp_path / checkpoint),
            available_now=True).awaitTermination()
    assert staged == ["arrived", "arrived"]
    assert {(r["id"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, 5), (None, 6)}


def test_changes_of_null_keys_and_slices(rows):
    from tierpick.operators.live import changes

    df = rows("k string, at int, v int", (None, 1, 0), (None, 2, 0), (None, 3, 1), ("a", 1, 0))
    found = changes(df, "k", ["at"], ["v"], F.lit(None).cast("int"))
    assert {(r["k"], r["at"]) for r in found.collect()} == {(None, 1), (None, 3), ("a", 1)}


def follow(spark, landing, out, checkpoint, **kw):
    schema = spark.read.parquet(landing).schema
    query = board.change_stream(
        board.poll(spark, landing, schema), out, checkpoint, "game", ["at"], ["away", "home"],
        F.floor(F.col("at") / 10), available_now=True, **kw)
    query.awaitTermination()
    return query


def test_a_batch_writes_the_keys_it_touches(spark, rows, tmp_path):
    landing, out, checkpoint = (str(tmp_path / p) for p in ("l", "o", "c"))
    detail = lambda keys: keys.selectExpr("game", "game * 2 AS twice")
    rows(SCHEMA, *[(g, 1, "LIVE", 0, 0) for g in range(400)]).write.parquet(landing)
    follow(spark, landing, out, checkpoint, detail=detail)
    rows(SCHEMA, (7, 11, "LIVE", 1, 0), (8, 12, "LIVE", 0, 0)).write.mode("append").parquet(landing)
    query = follow(spark, landing, out, checkpoint, detail=detail)
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsUpdated"] for s in state) == 2
    assert "RocksDB" in str(state[0]["customMetrics"]) or any(
        "rocksdb" in name for name in state[0]["customMetrics"])
    assert spark.read.parquet(f"{out}/changes/epoch=1").count() == 1
    assert spark.read.parquet(f"{out}/detail/epoch=1").count() == 1
    now = board.read_detail(spark, out, "game", "bigint", "game bigint, twice bigint")
    assert now.count() == 400
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith(
        "HDFSBackedStateStoreProvider")


def test_columns_pass_through_the_state_packed_and_exact(spark, rows, tmp_path, monkeypatch):
    seen, real = [], board._follow
    monkeypatch.setattr(board, "_follow", lambda *args: seen.append(args[0]) or real(*args))
    schema = """game long, at timestamp, away int, home int, day date, big long, price decimal(20,3),
                raw binary, tags array<string>, place struct<x: double, at: timestamp>, share double"""
    at = [datetime.datetime(2025, 1, 1, 12, 0, 0, n) for n in range(1, 5)]
    day, cent = datetime.date(1969, 12, 31), decimal.Decimal("12345678901234567.125")
    values = [(1, at[1], 0, 0, day, 2**60 + 1, cent, bytearray(b"\0x"), ["a", None], (1.5, at[0]), 0.5),
              (1, at[0], 0, 0, None, None, None, None, None, None, float("nan")),
              (None, None, 0, None, day, -2**60 - 1, cent, bytearray(), [], (None, None), None),
              (None, at[2], 1, None, None, 7, None, None, None, None, 1.0)]
    landing, out, checkpoint = (str(tmp_path / p) for p in ("l", "o", "c"))
    rows(schema, *values).coalesce(1).write.parquet(landing)
    board.change_stream(
        board.poll(spark, landing, rows(schema).schema), out, checkpoint, "game", ["at"],
        ["away", "home"], F.lit(0), available_now=True).awaitTermination()
    found = board.read_changes(spark, out, rows(schema).schema)
    wanted = rows(schema, (*values[1][:-1], None), *values[2:])  # NaN counts as null
    assert found.count() == 3 and found.exceptAll(wanted).count() == 0
    assert seen == [["_row"]]  # a key's cost doesn't grow with the columns


def test_changes_of_a_busy_key_equal_those_of_the_batch(spark, rows, tmp_path):
    from tierpick.operators.live import changes

    rng = random.Random(5)
    landing, out, checkpoint = (str(tmp_path / p) for p in ("l", "o", "c"))
    values = [(rng.choice([1, 1, 1, 1, 2, 3, None]), at, "LIVE", rng.choice([0, 0, 0, 1, None]), 0)
              for at in range(900)]
    for part in (values[:300], values[300:310], values[310:]):
        part = rng.sample(part, len(part))
        rows(SCHEMA, *part).repartition(3).write.mode("append").parquet(landing)
        follow(spark, landing, out, checkpoint)
    found = board.read_changes(spark, out, rows(SCHEMA).schema)
    twin = changes(rows(SCHEMA, *values), "game", ["at"], ["away", "home"],
                   F.floor(F.col("at") / 10))
    assert found.count() == twin.count() > 200
    assert found.exceptAll(twin).count() == 0


class State:
    """What a key's state offers to the function that follows it."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.timer = None, False, False, None

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.timer = ms


def test_a_game_without_snapshots_leaves_the_state_after_a_while(spark, tmp_path):
    state, run = State(), board._follow(["at"], ["_t0"], 5000)

    def reported(*ats, done=False):
        frame = pd.DataFrame({"at": ats, "_t0": ats, "_score": "0", "_done": done})
        return [at for found in run((1,), iter([frame]), state) for at in found["at"]]

    assert reported(2, 1) == [1] and state.timer == 5000
    assert reported(3) == [] and state.get == (3, "0")
    state.hasTimedOut = True
    assert list(run((1,), iter([]), state)) == [] and not state.exists
    state.hasTimedOut = False
    assert reported(9) == [9]
    assert reported(10, done=True) == [] and not state.exists
    with pytest.raises(ValueError):
        board.change_stream(spark.range(1), str(tmp_path), str(tmp_path), "id", ["id"], ["id"],
                            F.lit(0), available_now=True, expire_ms=1)


HISTORY = "date string, player_id bigint, tims int, Scored int"
OUTCOME = "date string, id bigint, scored int"


def outcomes_of(spark, tmp_path, late, checkpoint):
    landing = str(tmp_path / "landing")
    late.write.mode("append").parquet(landing)
    outcomes.outcome_stream(
        board.poll(spark, landing, late.schema), str(tmp_path / "h"), "2025-01-09",
        str(tmp_path / checkpoint), available_now=True).awaitTermination()


def dates_of(df):
    return df.withColumn("date", F.col("date").cast("date"))


def test_a_new_checkpoint_goes_on_from_the_history(spark, rows, tmp_path):
    history = str(tmp_path / "h")
    versions.commit(dates_of(rows(HISTORY, *[
        (f"2025-01-0{d}", d, 1, None) for d in (2, 3, 4, 5)])), history)
    for day, checkpoint in ((2, "a"), (3, "a"), (4, "b"), (5, "b")):
        late = dates_of(rows(OUTCOME, (f"2025-01-0{day}", day, 1)))
        outcomes_of(spark, tmp_path, late, checkpoint)
    now = versions.read(spark, history)
    assert {r["player_id"]: r["Scored"] for r in now.collect()} == {2: 1, 3: 1, 4: 1, 5: 1}


def test_outcomes_of_days_that_have_left_are_reported(spark, rows, tmp_path):
    history = str(tmp_path / "h")
    versions.commit(dates_of(rows(HISTORY, ("2025-01-02", 1, 1, None))), history)
    late = dates_of(rows(OUTCOME, ("2025-01-01", 1, 1), ("2025-01-02", 1, 0), ("2025-01-02", 1, 0)))
    outcomes_of(spark, tmp_path, late, "a")
    outcomes_of(spark, tmp_path, late.where("date = date '2025-01-02'"), "a")  # nothing new
    assert [r["Scored"] for r in versions.read(spark, history).collect()] == [0]
    assert len(versions.commits(spark, history)) == 2
    schema = "date date, id bigint, scored int"
    assert [str(r["date"]) for r in outcomes.late_outcomes(spark, history, schema).collect()] == [
        "2025-01-01"]


def test_without_a_history_the_stream_fails(spark, rows, tmp_path):
    with pytest.raises(Exception, match="no version of the table"):
        outcomes_of(spark, tmp_path, dates_of(rows(OUTCOME, ("2025-01-02", 1, 0))), "a")
    assert outcomes.late_outcomes(spark, str(tmp_path / "h"), "id bigint").count() == 0
