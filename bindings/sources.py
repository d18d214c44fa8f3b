"""Feeds landed as JSON files, table scans and the training extract."""

import gzip

import pandas as pd
from pyspark.sql import functions as F

from bindings.aggregates import score_feed_games
from bindings.base import CAND, ORDER, ORDER_SQL, candidates, iso, land, query, table
from bindings.projections import _orders_as_games
from tierpick import schemas
from tierpick.operators.bets import last_booked
from tierpick.operators.history import metric_values
from tierpick.operators.skew import bounded_lists
from tierpick.session import run_dir
from tierpick.sources import feeds, tables

# Entries of one landed document, at most.
_PER_DOCUMENT = 10_000


@query("s1_schedule_feed", """SELECT CAST(o_orderdate AS VARCHAR)[:10] AS date,
  strftime(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS start,
  o_custkey % 25 AS home_id, (o_custkey + 7) % 25 AS away_id FROM orders""")
def s1(spark, sf_dir):
    games = _orders_as_games(spark, sf_dir)
    game = F.struct(F.col("start").alias("startTimeUTC"), "season", F.col("home_team").alias(
        "homeTeam"), F.col("away_team").alias("awayTeam"))
    days = bounded_lists(games, ["date"], ["game_no"], game, "games", _PER_DOCUMENT)
    # The second day of a schedule is not read.
    later = F.array(F.struct("games"), F.struct("games"))
    path = land(days.select(F.col("date").alias("day"), later.alias("gameWeek")), "schedule")
    feed = feeds.read_feed(spark, path, f"day string, {schemas.SCHEDULE}")
    flat = feeds.schedule_games(feed, keys=("day",))
    return flat.select(
        F.col("day").alias("date"), "start", F.col("home_team.id").alias("home_id"),
        F.col("away_team.id").alias("away_id"))


@query("s2_roster_feed", """SELECT CAST(c_nationkey AS BIGINT) AS team_id, c_custkey AS id, c_mktsegment || ' ' || c_name AS name
FROM customer WHERE c_custkey % 3 <> 2""")
def s2(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("kind", F.col("c_custkey") % 3)
    skater = F.struct(
        F.col("c_custkey").alias("id"), F.struct(F.col("c_mktsegment").alias("default")).alias(
            "firstName"), F.struct(F.col("c_name").alias("default")).alias("lastName"))
    lists = bounded_lists(
        customer, ["c_nationkey", "kind"], ["c_custkey"], skater, "players", _PER_DOCUMENT)

    def of(kind):
        return F.when(F.col("kind") == kind, F.col("players"))

    rosters = lists.select(
        F.col("c_nationkey").alias("team_id"), of(0).alias("forwards"), of(1).alias("defensemen"),
        of(2).alias("goalies"))
    return feeds.read_rosters(spark, land(rosters, "rosters")).drop("roster_no")


@query("s3_score_feed", """SELECT CAST(o_orderdate AS VARCHAR)[:10] AS date,
  CASE WHEN o_orderstatus = 'P' THEN 'PPD' ELSE 'OK' END AS state, l_suppkey AS player_id
FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey""")
def s3(spark, sf_dir):
    games = score_feed_games(spark, sf_dir)
    game = F.struct(
        F.col("state").alias("gameScheduleState"),
        F.when(F.col("outcome").isNotNull(), F.struct(F.col("outcome").alias("lastPeriodType"))).alias(
            "gameOutcome"),
        F.struct(F.col("home_abbr").cast("string").alias("abbrev")).alias("homeTeam"),
        F.struct(F.col("away_abbr").cast("string").alias("abbrev")).alias("awayTeam"),
        F.transform("goals", lambda g: F.struct(g.alias("playerId"))).alias("goals"))
    days = bounded_lists(games, ["date"], ["game_id"], game, "games", _PER_DOCUMENT)
    flat = feeds.read_scores(spark, land(days.drop("part"), "scores"))
    return flat.select(iso(), "state", F.explode_outer("goals").alias("player_id"))


_GAME = """SELECT event_id AS game_id, 'LIVE' AS status,
  CASE WHEN user_id % 10 = 0 THEN 'Unknown Team' ELSE 'at U' || user_id END AS away_team,
  CASE WHEN event_id % 6 = 0 THEN '' ELSE 'A' || user_id % 50 END AS away_abbr,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(event_id % 9 AS INTEGER) END AS away_score,
  'Home' AS home_team, 'H' AS home_abbr, CAST(event_id % 5 AS INTEGER) AS home_score,
  CAST(event_id % 4 AS INTEGER) AS period, CASE WHEN event_id % 7 = 0 THEN '00:00' ELSE '10:00' END AS period_time_remaining,
  event_id % 7 <> 0 AND event_id % 5 = 0 AS is_intermission,
  CAST((event_id % 4 - 1) * 1200 + 1200 - CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 1200 END AS INTEGER) AS time_passed
FROM events"""


def scoreboard_feed(spark, sf_dir):
    n, user = F.col("event_id"), F.col("user_id")

    def named(value):
        return F.when(value.isNotNull(), F.struct(value.alias("default")))

    def unless(condition, value):
        return F.when(~condition, value)

    game = F.struct(
        n.alias("id"), F.lit("LIVE").alias("gameState"),
        F.struct(
            unless(n % 6 == 0, F.concat(F.lit("A"), (user % 50).cast("string"))).alias("abbrev"),
            unless(F.col("event_type") == "error", (n % 9).cast("int")).alias("score"),
            named(unless(user % 10 == 0, F.concat(F.lit("at U"), user.cast("string")))).alias(
                "placeNameWithPreposition")).alias("awayTeam"),
        F.struct(
            F.lit("H").alias("abbrev"), (n % 5).cast("int").alias("score"),
            named(F.lit("Home")).alias("placeNameWithPreposition")).alias("homeTeam"),
        F.when(n % 4 != 0, F.struct((n % 4).cast("int").alias("number"))).alias("periodDescriptor"),
        F.when(n % 7 != 0, F.struct(
            F.lit("10:00").alias("timeRemaining"), (n % 1200).cast("int").alias("secondsRemaining"),
            (n % 5 == 0).alias("inIntermission"))).alias("clock"))
    events = table(spark, sf_dir, "events").withColumn("date", F.col("ts").cast("date"))
    days = bounded_lists(events, ["date"], ["event_id"], game, "games", _PER_DOCUMENT)
    return days.select(F.array(F.struct(F.col("date").cast("string").alias("date"), "games")).alias(
        "gamesByDate"))


@query("s4_scoreboard_feed", _GAME)
def s4(spark, sf_dir):
    return feeds.read_scoreboard(spark, land(scoreboard_feed(spark, sf_dir), "scoreboard"))


@query("s4_scoreboard_of_today", f"{_GAME} WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def s4_today(spark, sf_dir):
    path = land(scoreboard_feed(spark, sf_dir), "scoreboard")
    return feeds.read_scoreboard(spark, path, today="2024-01-15")


def story_feed(spark, sf_dir):
    """Events as goals of a game (the user), period after period."""
    n = F.col("event_id")

    def named(value):
        return F.struct(value.alias("default"))

    goal = F.struct(
        F.when(n % 11 != 0, named(F.concat(F.lit("P"), (n % 9).cast("string")))).alias("name"),
        F.when(n % 13 != 0, named(F.lit("First"))).alias("firstName"),
        named(F.concat(F.lit("P"), (n % 9).cast("string"))).alias("lastName"),
        F.when(n % 17 != 0, named(F.lit("U"))).alias("teamAbbrev"),
        F.when(n % 7 != 0, F.format_string("%02d:%02d", F.minute("ts") % 20, F.second("ts"))).alias(
            "timeInPeriod"))
    events = table(spark, sf_dir, "events").withColumn(
        "period", (F.floor(F.hour("ts") / 8) + 1).cast("int"))
    lists = bounded_lists(
        events, ["user_id", "period"], ["ts", "event_id"], goal, "goals", _PER_DOCUMENT)
    scoring = F.struct(F.struct(F.col("period").alias("number")).alias("periodDescriptor"), "goals")
    # A document holds the three periods of a game.
    documents = lists.groupBy(F.col("user_id").alias("game_id"), "part").agg(
        F.sort_array(F.collect_list(F.struct("period", scoring.alias("s")))).alias("l"))
    return documents.select(
        "game_id", F.struct(F.transform("l", lambda x: x.getField("s")).alias("scoring")).alias(
            "summary"))


@query("s5_game_story_feed", """SELECT user_id AS game_id, CASE WHEN event_id % 11 = 0 THEN 'Unknown Player' ELSE 'P' || event_id % 9 END AS name,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE 'U' END AS team_abbr,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE 'First' END || ' P' || event_id % 9 AS full_name,
  CAST((hour(ts) // 8) * 1200 + CASE WHEN event_id % 7 = 0 THEN 0 ELSE (minute(ts) % 20) * 60 + second(ts) END AS INTEGER) AS time
FROM events""")
def s5(spark, sf_dir):
    return feeds.read_stories(spark, land(story_feed(spark, sf_dir), "stories")).drop("pos")


@query("s6_injury_feed", """WITH feed AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT pos, c_name AS player, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS injury,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'Out' END AS status
FROM feed WHERE c_custkey % 7 <> 0 AND (c_custkey % 3 <> 0 OR c_custkey % 2 <> 0)""")
def s6(spark, sf_dir):
    return feeds.read_injuries(spark, injury_documents(spark, sf_dir))


def injury_documents(spark, sf_dir):
    """Customers as injury lists, a document with one array per nation; one is unreadable."""
    n = F.col("c_custkey")
    entry = F.struct(
        F.when(n % 7 != 0, F.col("c_name")).otherwise("").alias("player"),
        F.when(n % 3 != 0, F.col("c_mktsegment")).otherwise("").alias("injury"),
        F.when(n % 2 != 0, "Out").alias("status"))
    pages = bounded_lists(
        table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_custkey"], entry, "list")
    path = run_dir(spark, "injuries")
    pages.select(F.to_json("list").alias("value"), F.concat_ws("-", "c_nationkey", "part").alias(
        "page")).write.partitionBy("page").text(path)
    broken = spark.createDataFrame([("[{not json",)], "value string")
    broken.write.text(f"{path}/page=broken")
    return path


@query("s6_injury_feed_absent", "SELECT c_custkey AS id, 'HEALTHY' AS injury_status, '' AS injury_desc FROM customer")
def s6_absent(spark, sf_dir):
    from tierpick.operators.enrich import merge_injuries

    none = feeds.read_injuries(spark, run_dir(spark, "absent"))
    players = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return merge_injuries(players, none).select("id", "injury_status", "injury_desc")


@query("s7_tier_feed", """SELECT c_custkey AS id, CAST(c_custkey % 5 + 1 AS INTEGER) AS tier FROM customer WHERE c_custkey % 5 < 3""")
def s7(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("list", F.col("c_custkey") % 5)
    lists = bounded_lists(
        customer, ["list"], ["c_custkey"], F.struct(F.col("c_custkey").alias("nhlPlayerId")),
        "players", _PER_DOCUMENT)
    # Five lists per document; the fourth and fifth are not read.
    documents = lists.groupBy("part").pivot("list", [0, 1, 2, 3, 4]).agg(F.first("players"))
    none = F.array().cast("array<struct<nhlPlayerId: bigint>>")
    whole = documents.select(F.array(*[
        F.struct(F.coalesce(F.col(str(i)), none).alias("players")) for i in range(5)
    ]).alias("playerLists"))
    return feeds.read_tiers(spark, land(whole, "tiers"))


@query("s8_odds_feed", """SELECT CASE WHEN l_orderkey % 4 = 0 THEN 'P' ELSE 'S' END || l_suppkey AS name,
  CAST(CAST(l_quantity AS INTEGER) * 10 - 250 AS VARCHAR) AS odds FROM lineitem
WHERE l_linenumber <= 4 AND l_suppkey % 2 = 0 AND l_partkey % 3 <> 0 AND l_orderkey % 2 = 0""")
def s8(spark, sf_dir):
    key = F.col("l_suppkey").cast("string")
    goalscorer = F.lit("Goalscorer")
    rows = table(spark, sf_dir, "lineitem").select(
        *ORDER,
        F.when(F.col("l_linenumber") <= 4, goalscorer).otherwise("Other").alias("category"),
        F.when(F.col("l_suppkey") % 2 == 0, goalscorer).otherwise("Shots").alias("sub"),
        F.when(F.col("l_partkey") % 3 != 0, "Anytime Goalscorer").otherwise(
            "First Goalscorer").alias("label"),
        F.struct(
            (2 - F.col("l_orderkey") % 2).cast("int").alias("providerId"),
            F.when(F.col("l_orderkey") % 4 == 0, F.lit("")).otherwise(
                F.concat(F.lit("S"), key)).alias("playerNameIdentifier"),
            F.concat(F.lit("P"), key).alias("participant"),
            (F.col("l_quantity").cast("int") * 10 - 250).cast("string").alias("oddsAmerican"),
        ).alias("outcome"))
    lists = bounded_lists(
        rows, ["category", "sub", "label"], ORDER, F.col("outcome"), "outcomes", _PER_DOCUMENT)
    offers = F.array(F.array(F.struct("label", "outcomes")))
    descriptor = F.struct(
        F.col("sub").alias("name"), F.struct(offers.alias("offers")).alias("offerSubcategory"))
    category = F.struct(
        F.col("category").alias("name"),
        F.array(descriptor).alias("offerSubcategoryDescriptors"))
    feed = lists.select(F.struct(F.array(category).alias("offerCategories")).alias("eventGroup"))
    return feeds.read_odds(spark, land(feed, "odds")).drop("pos")


@query("s9_scan_with_equality", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def s9(spark, sf_dir):
    return tables.scan(
        spark, f"{sf_dir}/orders.parquet", ("o_orderkey", "o_totalprice"), ("o_orderstatus", "F"))


@query("s10_read_metric", """SELECT 0.0::DOUBLE AS value, count(*) FILTER (WHERE l_returnflag = 'R') AS correct, count(*) AS total FROM lineitem""")
def s10(spark, sf_dir):
    metric = table(spark, sf_dir, "lineitem").agg(
        F.lit("current_pick_accuracy").alias("id"), F.lit(None).cast("date").alias("date"),
        F.lit(None).cast("double").alias("value"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("correct"),
        F.count("*").alias("total"))
    path = run_dir(spark, "metric")
    tables.replace_table(metric, path)
    return metric_values(tables.read_metric(spark, path))


@query("s11_compressed_extract", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def s11(spark, sf_dir):
    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: gzip.compress(t.encode("utf-8")))

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    # Responses of a bounded size each, as an API pages them.
    pages = bounded_lists(
        orders.withColumn("page", F.floor(F.col("o_orderkey") / 1000)), ["page"], ["o_orderkey"],
        F.struct("o_orderkey", "o_custkey", "o_totalprice"), "rows", _PER_DOCUMENT)
    bodies = pages.select(F.base64(packed(F.to_json("rows"))).alias("entries"))
    return tables.land_extract(bodies, "o_orderkey bigint, o_custkey bigint, o_totalprice double")


@query("s11_gzip_json", "SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS absent FROM orders")
def s11_gzip(spark, sf_dir):
    path = run_dir(spark, "extract")
    table(spark, sf_dir, "orders").write.option("compression", "gzip").json(path)
    return tables.read_extract(spark, path, "o_orderkey bigint, o_totalprice double, absent string")


@query("s12_align_fields", """SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS o_orderpriority
FROM orders""")
def s12(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    older = orders.where("o_orderkey % 2 = 0").select("o_totalprice", "o_orderkey")
    return tables.align_fields(older, orders.where("o_orderkey % 2 = 1"))


@query("s13_training_csv", f"""WITH {CAND} SELECT CAST(date AS VARCHAR) AS date, name, CASE WHEN l_linenumber = 2 THEN NULL ELSE gpg END AS gpg,
  hgpg, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(scored AS DOUBLE) END AS scored FROM cand""")
def s13(spark, sf_dir):
    rows = candidates(spark, sf_dir).select(
        iso(), "name",
        F.when(F.col("l_linenumber") == 2, "n/a").otherwise(F.col("gpg").cast("string")).alias("gpg"),
        "hgpg", F.when(F.col("l_linenumber") != 3, F.col("scored")).alias("scored"))
    path = run_dir(spark, "training")
    tables.write_csv(rows, path)
    return tables.read_training(spark, path)


@query("s14_last_booked_date", """SELECT CAST(max(o_orderdate) AS VARCHAR)[:10] AS Date FROM orders""")
def s14(spark, sf_dir):
    path = run_dir(spark, "ledger")
    tables.write_csv(table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("Date"), F.col("o_orderkey").alias("Name")), path)
    return last_booked(spark.read.option("header", True).csv(path))
