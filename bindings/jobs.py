"""The jobs a user runs, end to end on the tables."""

from pyspark.sql import functions as F

from bindings.aggregates import score_feed_games
from bindings.base import (
    BOUNDS, ORDER, ORDER_SQL, SCORED, TODAY, YESTERDAY, candidates, iso, query, score_sql, six,
    table,
)
from bindings.functions import _BET, _ODDS, _PCT
from bindings.joins import odds_feed, odds_players, search_sql
from bindings.projections import _STATUS, status_of, users_and_preferences
from bindings.sinks import _PER_MONTH, _per_month
from tierpick import schemas
from tierpick.config import BOUNDS as FIXED_BOUNDS
from tierpick.config import WEIGHTED
from tierpick.operators import picks, scoring
from tierpick.plans import bets as bet_plan
from tierpick.plans import daily, live, weights
from tierpick.session import run_dir
from tierpick.sources import tables

# --- daily run --------------------------------------------------------------

_LANDED = """team AS (SELECT n_nationkey AS team_id, n_name AS team_name, n_nationkey % 2 = 0 AS home,
    coalesce(round(t.tgpg, 4), 0) AS tgpg, coalesce(round(o.tgpg, 4), 0) AS otga, n_nationkey * 0.01::DOUBLE AS otshga
  FROM nation LEFT JOIN rates t ON n_nationkey = t.team_id LEFT JOIN rates o ON (n_nationkey + 7) % 25 = o.team_id),
landed AS (SELECT c_custkey AS id, c_name AS name, coalesce(gpg, 0) AS gpg, coalesce(hgpg, 0) AS hgpg, coalesce(five_gpg, 0) AS five_gpg,
    (c_custkey % 30) * 0.01::DOUBLE AS hppg, team_name, home, tgpg, otga, otshga,
    CASE WHEN c_custkey % 9 = 0 THEN 'INJURED' ELSE 'HEALTHY' END AS injury_status, CASE WHEN c_custkey % 9 = 0 THEN 'Out' ELSE '' END AS injury_desc,
    CASE WHEN c_custkey % {mod} < 3 THEN c_custkey % {mod} + 1 ELSE 0 END AS tims
  FROM customer JOIN team ON c_nationkey = team.team_id LEFT JOIN (SELECT o_custkey,
    count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS gpg, count(*) FILTER (WHERE o_orderstatus = 'O') / count(*) AS hgpg,
    count(*) FILTER (WHERE o_orderstatus = 'P') / count(*) AS five_gpg FROM orders GROUP BY 1) ON c_custkey = o_custkey),
board AS (SELECT *, {score} AS stat FROM landed)"""
_RATES = """rates AS (SELECT s_nationkey AS team_id, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) * 4 AS tgpg
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"""


def _board_sql(mod):
    landed = _LANDED.format(mod=mod, score=score_sql(bounds=FIXED_BOUNDS))
    return f"""WITH {_RATES}, {landed} SELECT row_number() OVER (ORDER BY id) AS id, id AS player_id, '{TODAY}' AS date, name,
  team_name, round(CAST(stat AS DOUBLE), 6) AS stat, injury_status, injury_desc, CAST(tims AS INTEGER) AS tims FROM board"""


def landed_feeds(spark, sf_dir, tier_mod):
    supplier = table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rates = lines.groupBy(F.col("s_nationkey").alias("team_id")).agg(
        (F.count(F.when(F.col("l_returnflag") == "R", 1)) / F.count("*") * 4).alias("rate"))
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name"),
        F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("team_abbr"),
        ((F.col("n_nationkey") + 7) % 25).alias("opponent_id"), F.lit("2001").alias("season"),
        (F.col("n_nationkey") % 2 == 0).alias("home"),
        (F.col("n_nationkey") * F.lit(0.01)).alias("otshga"))
    own = rates.select("team_id", F.round("rate", 4).alias("tgpg"))
    other = rates.select(F.col("team_id").alias("opponent_id"), F.round("rate", 4).alias("otga"))
    teams = nation.join(own, "team_id", "left").join(other, "opponent_id", "left").fillna(
        0.0, ["tgpg", "otga"])
    status = F.col("o_orderstatus")
    shares = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[
        (F.count(F.when(status == code, 1)) / F.count("*")).alias(name)
        for code, name in (("F", "gpg"), ("O", "hgpg"), ("P", "five_gpg"))])
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    players = customer.join(shares, key == F.col("o_custkey"), "left").select(
        key.alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("team_id"),
        "gpg", "hgpg", "five_gpg", ((key % 30) * F.lit(0.01)).alias("hppg"),
    ).fillna(0.0, ["gpg", "hgpg", "five_gpg"])
    injuries = customer.where(key % 9 == 0).select(
        F.upper("c_name").alias("player"), F.lit("Knee").alias("injury"),
        F.lit("Out").alias("status"), key.alias("pos"))
    tiers = customer.where(key % tier_mod < 3).select(
        key.alias("id"), (key % tier_mod + 1).cast("int").alias("tier"))
    return daily.Feeds(teams, players, injuries, tiers)


def _board(spark, store):
    board = tables.read_board(spark, store.board)
    return board.select(
        "id", "player_id", iso(), "name", "team_name", six("stat"), "injury_status", "injury_desc",
        "tims")


@query("b1_first_run", _board_sql(10))
def b1(spark, sf_dir):
    store = daily.Store(run_dir(spark, "daily"))
    landed = landed_feeds(spark, sf_dir, 10)
    status = daily.daily_run(spark, store, landed, TODAY, YESTERDAY, ["id"])
    assert status == "first_run"
    return _board(spark, store)


@query("b2_normal_run", _board_sql(7))
def b2(spark, sf_dir):
    store = daily.Store(run_dir(spark, "daily"))
    daily.daily_run(spark, store, landed_feeds(spark, sf_dir, 10), TODAY, YESTERDAY, ["id"])
    later = landed_feeds(spark, sf_dir, 7)
    assert daily.daily_run(spark, store, later, TODAY, YESTERDAY, ["id"]) == "normal_run"
    # The last run publishes the board as it is.
    assert daily.daily_run(spark, store, later, TODAY, YESTERDAY, ["id"], True) == "last_run"
    return _board(spark, store)


# --- history ----------------------------------------------------------------

_DAY = "2001-05-30"
_BEFORE = "2001-05-29"


@query("b3_update_history", f"""WITH {SCORED}, picks AS (SELECT * FROM scored_rows WHERE tims BETWEEN 1 AND 3
    QUALIFY row_number() OVER (PARTITION BY date, tims ORDER BY stat DESC, {ORDER_SQL}) = 1),
  hist AS (SELECT date, id AS player_id, tims, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE scored END AS Scored FROM picks
    WHERE date < DATE '{_DAY}' AND (date IN (SELECT DISTINCT date FROM picks WHERE date < DATE '{_DAY}' ORDER BY date DESC LIMIT 7)
      OR (SELECT count(*) FROM picks WHERE date = DATE '{_DAY}') < 3)),
  arch AS (SELECT date, id, max(scored) AS scored FROM cand GROUP BY 1, 2),
  after AS (SELECT hist.date, player_id, tims, CASE WHEN hist.date IN (SELECT h.date FROM hist h WHERE h.Scored IS NULL)
      THEN coalesce(arch.scored, hist.Scored) ELSE hist.Scored END AS Scored
    FROM hist LEFT JOIN arch ON hist.date = arch.date AND player_id = arch.id
    UNION ALL SELECT date, id, tims, NULL FROM picks WHERE date = DATE '{_DAY}' AND (SELECT count(*) FROM picks WHERE date = DATE '{_DAY}') = 3),
  metric AS (SELECT 500 + count(*) FILTER (WHERE Scored = 1) AS correct, 1503 AS total FROM after WHERE date = DATE '{_BEFORE}' HAVING count(*) = 3)
SELECT CAST(date AS VARCHAR) AS date, player_id, tims, CAST(Scored AS VARCHAR) AS Scored,
  coalesce((SELECT correct FROM metric), 500) AS correct, CAST(coalesce((SELECT total FROM metric), 1500) AS BIGINT) AS total FROM after""")
def b3(spark, sf_dir):
    store = daily.Store(run_dir(spark, "daily"))
    known = candidates(spark, sf_dir)
    past = picks.replay(known, ORDER, bounds=BOUNDS).where(
        F.col("date") < F.lit(_DAY).cast("date"))
    rows = past.select(
        F.col("id").alias("player_id"), "name", "date", "gpg", "hgpg", "five_gpg",
        F.col("stat").cast("double").alias("stat"), "tims",
        F.col("team_id").cast("string").alias("team_name"), "tgpg", "otga",
        F.when(F.col("l_orderkey") % 4 != 0, F.col("scored")).alias("Scored"))
    tables.write_version(
        tables.history_rows(rows, ["date", "tims"]), store.history, _BEFORE)
    known.groupBy("date", "id").agg(F.max("scored").alias("scored")).write.parquet(store.archive)
    metric = table(spark, sf_dir, "region").limit(1).select(
        F.lit("current_pick_accuracy").alias("id"), F.lit("2001-05-28").cast("date").alias("date"),
        F.lit(33.33).alias("value"), F.lit(500).cast("bigint").alias("correct"),
        F.lit(1500).cast("bigint").alias("total"))
    tables.replace_table(metric, store.metric)
    today = scoring.predict(
        known.where(F.col("date") == F.lit(_DAY).cast("date")), BOUNDS
    ).drop("scored").withColumn("team_name", F.col("team_id").cast("string"))
    daily.update_history(spark, store, today, _DAY, _BEFORE, ORDER)
    after = tables.read_version(spark, store.history, schemas.HISTORY)
    now = tables.read_metric(spark, store.metric).select(F.struct("correct", "total")).scalar()
    return after.select(
        iso(), "player_id", "tims", F.col("Scored").cast("string").alias("Scored"),
        now.getField("correct").alias("correct"), now.getField("total").alias("total"))


# --- back-fill --------------------------------------------------------------

_ARCHIVE_SQL = """arch AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, l_suppkey AS id, '' || o_custkey % 25 AS team_abbr,
    CASE WHEN month(o_orderdate) <> 3 THEN CAST(l_linestatus = 'O' AS INTEGER) END AS scored FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  gone AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, unnest(['' || o_custkey % 25, '' || o_custkey % 7]) AS team_abbr
    FROM orders WHERE o_orderkey % 500 = 0 AND month(o_orderdate) = 3),
  hits AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, l_suppkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_returnflag = 'R' AND l_quantity > 48 AND o_orderkey % 500 <> 0)"""


@query("b4_backfill", f"""WITH {_ARCHIVE_SQL}, after AS (SELECT arch.date, CASE WHEN month(arch.date) <> 3 THEN scored
    WHEN hits.id IS NULL THEN 0 ELSE 1 END AS scored FROM arch LEFT JOIN hits ON arch.date = hits.date AND arch.id = hits.id
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.date = arch.date AND gone.team_abbr = arch.team_abbr))
SELECT {_PER_MONTH} FROM after GROUP BY date""")
def b4(spark, sf_dir):
    store = daily.Store(run_dir(spark, "daily"))
    month = F.trunc("o_orderdate", "month")
    orders = table(spark, sf_dir, "orders").withColumn("date", month)
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "date", F.col("l_suppkey").alias("id"),
        (F.col("o_custkey") % 25).cast("string").alias("team_abbr"),
        F.when(F.month("date") != 3, (F.col("l_linestatus") == "O").cast("int")).alias("scored"))
    tables.archive(rows, store.archive)
    games = score_feed_games(spark, sf_dir, "l_returnflag = 'R' AND l_quantity > 48").select(
        F.trunc("date", "month").alias("date"), "game_id",
        F.when(F.col("game_id") % 500 == 0, "PPD").otherwise("OK").alias("state"),
        F.lit("REG").alias("outcome"), F.col("home_abbr").cast("string").alias("home_abbr"),
        F.col("away_abbr").cast("string").alias("away_abbr"), "goals")
    daily.run_backfill(spark, store, games, YESTERDAY)
    return _per_month(tables.read_archive(spark, store.archive))


# --- messages ---------------------------------------------------------------

@query("b5_notify_users", f"""WITH {SCORED}, day AS (SELECT * FROM scored_rows WHERE tims BETWEEN 1 AND 3 AND date = DATE '{_DAY}'
    QUALIFY row_number() OVER (PARTITION BY tims ORDER BY stat DESC, {ORDER_SQL}) = 1),
  body AS (SELECT 'Tims | Name | Team | Probability' || chr(10) || repeat('-', 40) || chr(10) ||
    CASE WHEN count(*) = 3 THEN string_agg(tims || ' | ' || name || ' | ' || team_id || ' | ' ||
      printf('%.2f', CAST(stat AS DOUBLE)) || '%' || chr(10), '' ORDER BY tims) ELSE '' END AS text FROM day)
SELECT c_name || '@mail' AS email, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS display_name,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Hey ' || c_mktsegment || ',' || chr(10) || chr(10) END || (SELECT text FROM body) AS text
FROM customer WHERE c_acctbal > 0 AND c_custkey % 4 NOT IN (0, 1)""")
def b5(spark, sf_dir):
    scored = scoring.predict(candidates(spark, sf_dir), BOUNDS)
    board = scored.select(
        F.lit(0).alias("id"), F.col("id").alias("player_id"), "name", "date", "tims", *ORDER,
        F.col("team_id").cast("string").alias("team_name"),
        F.col("stat").cast("double").alias("stat"))
    users, preferences = users_and_preferences(spark, sf_dir)
    return daily.notify_users(board, users, preferences, _DAY, ORDER)


# --- weight search and replay -----------------------------------------------

def training_csv(spark, sf_dir):
    """Candidates as a training extract in CSV, with gaps and stray tiers."""
    rows = candidates(spark, sf_dir).withColumn("date", iso()).withColumn(
        "home", F.col("home").cast("int")).withColumn(
        "tims", F.when(F.col("tims") == 0, "n/a").otherwise(F.col("tims").cast("string"))
    ).withColumn("scored", F.when(F.col("l_orderkey") % 50 != 0, F.col("scored")))
    path = run_dir(spark, "training")
    tables.write_csv(rows, path)
    return tables.read_training(spark, path)


_WEIGHTS = ", ".join(f"round(CAST(w{i} AS DOUBLE), 6) AS {w}" for i, w in enumerate(WEIGHTED))


def _known(sql):
    return sql.replace("WHERE tims BETWEEN 1 AND 3", "WHERE tims BETWEEN 1 AND 3 AND l_orderkey % 50 <> 0")


@query("b6_find_weights", f"""WITH {_known(search_sql(4))} SELECT {_WEIGHTS}, correct,
  (SELECT count(*) FROM (SELECT DISTINCT date, tims FROM known)) AS picks, (SELECT count(DISTINCT date) * 3 FROM known) AS slots
FROM results JOIN grid ON results.wid = grid.wid ORDER BY correct DESC, results.wid LIMIT 1""")
def b6(spark, sf_dir):
    best = weights.find_weights(
        training_csv(spark, sf_dir), ORDER, step_percent=25, bounds=BOUNDS)
    return best.select(*[six(w) for w in WEIGHTED], "correct", "picks", "slots")


@query("b7_season_accuracy", f"""WITH {SCORED}, picks AS (SELECT * FROM scored_rows WHERE tims BETWEEN 1 AND 3 AND l_orderkey % 50 <> 0
    AND date >= DATE '1999-10-07' QUALIFY row_number() OVER (PARTITION BY date, tims ORDER BY stat DESC, {ORDER_SQL}) = 1)
SELECT tims, count(*) AS total, count(*) FILTER (WHERE scored = 1) AS correct, count(*) FILTER (WHERE scored <> 1) AS wrong,
  round(100.0 * count(*) FILTER (WHERE scored = 1) / count(*), 6) AS pct FROM picks GROUP BY ROLLUP (tims)""")
def b7(spark, sf_dir):
    report = weights.replay_accuracy(
        training_csv(spark, sf_dir), ORDER, since="1999-10-07", bounds=BOUNDS)
    return report.withColumn("pct", F.round("pct", 6))


# --- value bets -------------------------------------------------------------

def _bet_sql():
    price = ", ".join(f"{c} DESC" for c in ORDER)
    stake = _BET.replace("(l_tax * 10)", "(s_acctbal / 10000)")
    return f"""WITH price AS (SELECT l_suppkey AS key, CAST(l_quantity AS INTEGER) AS l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY {price}) = 1),
  priced AS (SELECT s_suppkey AS id, {_ODDS} AS odds, {_PCT} AS pct, CAST(printf('%.2f', {stake}) AS DOUBLE) AS bet
    FROM supplier JOIN price ON s_suppkey = key WHERE s_suppkey % 10 NOT IN (2, 3))
SELECT id, CAST(odds AS VARCHAR) AS odds, round(pct, 6) AS percent_odds, bet, round(bet + bet * odds / 100, 6) + 0.0 AS payout
FROM priced WHERE bet > 0.1"""


@query("b8_value_bets", _bet_sql())
def b8(spark, sf_dir):
    board = odds_players(spark, sf_dir).withColumn("stat", F.col("s_acctbal") / 10000)
    found = bet_plan.value_bets(board, odds_feed(spark, sf_dir))
    return found.select(
        "id", "odds", F.round("percent_odds", 6).alias("percent_odds"), "bet",
        (F.round("payout", 6) + 0.0).alias("payout"))


# --- live board -------------------------------------------------------------

_SHOWN = f"""WITH g AS (SELECT user_id AS game_id, arg_max({_STATUS}, ROW(ts, event_id)) AS status,
    max(event_id) % 4 AS period, max(event_id) % 5 = 0 AS pause, max(event_id) % 3600 AS passed FROM events GROUP BY 1),
  live AS (SELECT * FROM g WHERE status IN ('LIVE', 'CRIT', 'FINAL')),
  goals AS (SELECT user_id AS game_id, ts, event_id, 'P' || event_id % 9 AS name, CASE WHEN event_id % 2 = 0 THEN 'home' ELSE 'away' END AS side,
    event_id % 3600 AS time FROM events WHERE event_type <> 'error'),
  per AS (SELECT game_id, name, count(*) AS goal, arg_min(time, ROW(ts, event_id)) AS time, arg_min(side, ROW(ts, event_id)) AS side,
    min(ROW(ts, event_id)) AS pos FROM goals GROUP BY 1, 2),
  shown AS (SELECT per.*, NOT (name = 'P3' AND side = 'home') AND passed - time < 60 AND period = time // 1200 + 1 AND NOT pause
      AND status IN ('LIVE', 'CRIT') AS recent FROM live JOIN per ON live.game_id = per.game_id),
  lines AS (SELECT game_id, string_agg(name || ' (' || goal || ')', ', ' ORDER BY pos, name) FILTER (WHERE side = 'home') AS home,
    string_agg(name || ' (' || goal || ')', ', ' ORDER BY pos, name) FILTER (WHERE side = 'away') AS away, bool_or(recent) AS recent FROM shown GROUP BY 1)
SELECT live.game_id, CASE WHEN status = 'FINAL' THEN 'FINAL' ELSE CASE WHEN pause THEN 'Intermission ' ELSE 'Period ' END || period || ' | 01:00' END
  || ' | H' || live.game_id || ' @ A' || live.game_id || chr(10) || '1 - 2' || chr(10) || '  home: ' || coalesce(home, '') || chr(10)
  || '  away: ' || coalesce(away, '') AS text, coalesce(recent, false) AS has_recent FROM live LEFT JOIN lines ON live.game_id = lines.game_id"""


@query("b9_live_board", _SHOWN)
def b9(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = events.groupBy(F.col("user_id").alias("game_id")).agg(
        F.max_by(status_of(F.col("event_type")), F.struct("ts", "event_id")).alias("status"),
        F.max("event_id").alias("n"))
    key, n = F.col("game_id").cast("string"), F.col("n")
    games = last.select(
        "game_id", "status", (n % 4).alias("period"), (n % 5 == 0).alias("is_intermission"),
        (n % 3600).alias("time_passed"), F.lit("01:00").alias("period_time_remaining"),
        F.concat(F.lit("H"), key).alias("home_team"), F.lit("home").alias("home_abbr"),
        F.concat(F.lit("A"), key).alias("away_team"), F.lit("away").alias("away_abbr"),
        F.lit(1).alias("home_score"), F.lit(2).alias("away_score"))
    e = F.col("event_id")
    name = F.concat(F.lit("P"), (e % 9).cast("string"))
    goals = events.where("event_type <> 'error'").select(
        F.col("user_id").alias("game_id"), F.struct("ts", "event_id").alias("pos"),
        name.alias("name"), F.when(e % 2 == 0, "home").otherwise("away").alias("team_abbr"),
        F.concat(F.lit("Full "), name).alias("full_name"), (e % 3600).alias("time"))
    watchlist = games.select(
        F.col("home_team").alias("team_name"), F.lit("Full P3").alias("full_name"))
    return live.live_board(games, goals, watchlist)
