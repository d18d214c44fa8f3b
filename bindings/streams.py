"""Streams run until their input is used up; the SQL is their batch twin."""

from pyspark.sql import functions as F

from bindings.aggregates import FINAL_SQL, score_feed_games
from bindings.base import TODAY, iso, query, table
from bindings.joins import FILLED_SQL, HISTORY_SQL, OUTCOMES_SQL, outcome_table, pick_history
from bindings.projections import _STATUS, status_of
from bindings.sinks import _MONTHLY, _PER_MONTH, _monthly, _per_month
from tierpick.operators import backfill, live
from tierpick.session import run_dir
from tierpick.sources import tables, versions
from tierpick.streaming import board, outcomes

_DAYS = (None, 8, 15, 22, None)  # the events arrive in four parts, open at both ends

_SNAPSHOT = "event_id, user_id, ts, CAST(floor(value) AS INTEGER) % 3 AS away_score, CAST(value > 50 AS INTEGER) AS home_score"


def snapshots(spark, sf_dir):
    """Events as snapshots of a game's score."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", status_of(F.col("event_type")).alias("status"),
        (F.floor("value") % 3).cast("int").alias("away_score"),
        (F.col("value") > 50).cast("int").alias("home_score"))


def _arrivals(spark, sf_dir, consume):
    """Land the snapshots part by part and let the stream catch up after each."""
    rows = snapshots(spark, sf_dir)
    landing = run_dir(spark, "landing")
    day = F.datediff("ts", F.lit("2024-01-01"))
    for low, high in zip(_DAYS, _DAYS[1:]):
        part = rows if low is None else rows.where(day >= low)
        part = part if high is None else part.where(day < high)
        part.write.mode("append").parquet(landing)
        stream = board.poll(spark, landing, rows.schema)
        consume(stream).awaitTermination()
    return rows.schema


def _span():
    return F.datediff("ts", F.lit("2024-01-01"))


def _changes(spark, sf_dir, **kw):
    out, checkpoint = run_dir(spark, "changes"), run_dir(spark, "checkpoint")

    def consume(stream):
        return board.change_stream(
            stream, out, checkpoint, "user_id", ["ts", "event_id"], ["away_score", "home_score"],
            _span(), available_now=True, **kw)

    schema = _arrivals(spark, sf_dir, consume)
    return out, board.read_changes(spark, out, schema)


@query("t1_poll_snapshots", f"SELECT event_id, away_score, home_score FROM (SELECT {_SNAPSHOT} FROM events)")
def t1(spark, sf_dir):
    out, checkpoint = run_dir(spark, "polled"), run_dir(spark, "checkpoint")

    def consume(stream):
        return (
            stream.select("event_id", "away_score", "home_score").writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())

    _arrivals(spark, sf_dir, consume)
    return spark.read.parquet(out)


_LAG = f"""snaps AS (SELECT {_SNAPSHOT}, {_STATUS} AS status,
  CASE WHEN ts < DATE '2024-01-09' THEN 0 WHEN ts < DATE '2024-01-16' THEN 1 WHEN ts < DATE '2024-01-23' THEN 2 ELSE 3 END AS arrival FROM events),
lagged AS (SELECT *, lag(away_score) OVER w AS a, lag(home_score) OVER w AS h, lag(status) OVER w AS s, lag(arrival) OVER w AS n
  FROM snaps WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_CHANGED = "a IS NULL OR a <> away_score OR h <> home_score"


@query("t2_score_changes", f"WITH {_LAG} SELECT event_id, user_id, away_score, home_score FROM lagged WHERE {_CHANGED}")
def t2(spark, sf_dir):
    found = _changes(spark, sf_dir)[1]
    return found.select("event_id", "user_id", "away_score", "home_score")


@query("t2_score_changes_batch", f"WITH {_LAG} SELECT event_id, user_id, away_score, home_score FROM lagged WHERE {_CHANGED}")
def t2_batch(spark, sf_dir):
    found = live.changes(
        snapshots(spark, sf_dir), "user_id", ["ts", "event_id"], ["away_score", "home_score"],
        _span())
    return found.select("event_id", "user_id", "away_score", "home_score")


@query("t3_cached_detail", """SELECT user_id, count(*) AS goals, count(DISTINCT event_type) AS kinds FROM events
WHERE event_type <> 'error' GROUP BY 1""")
def t3(spark, sf_dir):
    stories = table(spark, sf_dir, "events").where(F.col("event_type") != "error")

    def detail(keys):
        wanted = stories.join(keys, "user_id", "left_semi")
        return wanted.groupBy("user_id").agg(
            F.count("*").alias("goals"), F.countDistinct("event_type").alias("kinds"))

    out, _ = _changes(spark, sf_dir, detail=detail)
    return board.read_detail(
        spark, out, "user_id", "bigint", "user_id bigint, goals bigint, kinds bigint")


@query("t4_recent_goals", f"""SELECT event_id, CASE WHEN event_id % 3600 - (event_id * 7) % 3600 < 60
    AND event_id % 3 + 1 = (event_id * 7) % 3600 // 1200 + 1 AND event_id % 5 <> 0 AND status IN ('LIVE', 'CRIT')
  THEN 'recent' ELSE 'plain' END AS shown FROM (SELECT event_id, {_STATUS} AS status FROM events)""")
def t4(spark, sf_dir):
    out, checkpoint = run_dir(spark, "recent"), run_dir(spark, "checkpoint")
    n = F.col("event_id")

    def consume(stream):
        shown = live.scorer_class(
            n % 3600, n % 3 + 1, n % 5 == 0, F.col("status"), (n * 7) % 3600, F.lit(False))
        return (
            stream.select("event_id", shown.alias("shown")).writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())

    _arrivals(spark, sf_dir, consume)
    return spark.read.parquet(out)


@query("t5_final_games_leave", f"""WITH {_LAG} SELECT event_id, user_id, away_score, home_score FROM lagged
WHERE {_CHANGED} OR (s = 'FINAL' AND n < arrival)""")
def t5(spark, sf_dir):
    found = _changes(spark, sf_dir, done=F.col("status") == "FINAL")[1]
    return found.select("event_id", "user_id", "away_score", "home_score")


@query("t6_late_outcomes", f"""WITH {HISTORY_SQL}, {OUTCOMES_SQL}, {FILLED_SQL}
SELECT CAST(date AS VARCHAR) AS date, player_id, tims, CAST(Scored AS VARCHAR) AS Scored FROM filled""")
def t6(spark, sf_dir):
    past = pick_history(spark, sf_dir).select("date", "player_id", "tims", "Scored")
    path, landing = run_dir(spark, "history"), run_dir(spark, "landing")
    versions.commit(past, path)
    late = outcome_table(spark, sf_dir)
    late.write.parquet(landing)
    stream = board.poll(spark, landing, late.schema)
    outcomes.outcome_stream(
        stream, path, TODAY, run_dir(spark, "checkpoint"), available_now=True
    ).awaitTermination()
    now = versions.read(spark, path)
    return now.select(iso(), "player_id", "tims", F.col("Scored").cast("string").alias("Scored"))


@query("t7_all_or_nothing", f"""WITH {FINAL_SQL} SELECT 'open' AS gate, count(*) AS scorers FROM final WHERE game_id % 3 <> 0
UNION ALL SELECT 'closed', (SELECT count(*) FROM final WHERE game_id < 0)""")
def t7(spark, sf_dir):
    games = backfill.classify_games(score_feed_games(spark, sf_dir))

    def scorers(frame, name):
        found = backfill.scorers(backfill.gate(frame))
        return found.agg(F.count("*").alias("scorers")).select(F.lit(name).alias("gate"), "scorers")

    return scorers(games.where("game_id % 3 <> 0"), "open").unionByName(scorers(games, "closed"))


@query("t8_repeated_days", f"WITH {_MONTHLY} SELECT {_PER_MONTH} FROM monthly GROUP BY date")
def t8(spark, sf_dir):
    rows = _monthly(spark, sf_dir)
    path, landing = run_dir(spark, "archive"), run_dir(spark, "landing")
    rows.write.parquet(landing)
    stream = board.poll(spark, landing, rows.schema)
    for _ in range(2):  # a second run from the start lands on the same dates
        outcomes.archive_stream(
            stream, path, run_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    return _per_month(tables.read_archive(spark, path))
