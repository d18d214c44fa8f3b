"""Numbering, retention, trigger plan, ordering, set operations, feature windows."""

from pyspark.sql import functions as F

from bindings.aggregates import all_picks
from bindings.base import (
    CAND, DATE_SQL, ORDER, ORDER_SQL, PICKED, STAT_SQL, TODAY, candidates, iso, query, run_dir, six,
    stage, table,
)
from bindings.joins import HISTORY_SQL, pick_history
from bindings.projections import TEAM_ROWS, _NAME, _orders_as_games
from tierpick.operators import features, history, notify, picks, schedule
from tierpick.operators.skew import number_rows
from tierpick.plans import daily
from tierpick.sources import feeds

_ALL = ORDER + ["gpg", "five_gpg", "hppg", "home", "scored", "date"]


@query("w1_row_numbers", f"""WITH {CAND} SELECT {ORDER_SQL},
  row_number() OVER (ORDER BY {', '.join(_ALL)}) AS id FROM cand""")
def w1(spark, sf_dir):
    rows = candidates(spark, sf_dir).drop("id")
    return number_rows(rows, _ALL).select(*ORDER, "id")


@query("w2_retention", f"""WITH {HISTORY_SQL}, kept AS (SELECT DISTINCT date FROM hist ORDER BY date DESC LIMIT 7)
SELECT {DATE_SQL}, player_id, tims FROM hist WHERE date IN (SELECT date FROM kept)""")
def w2(spark, sf_dir):
    past = pick_history(spark, sf_dir)
    new = past.select(F.col("player_id"))
    return history.retain(past, picks=new).select(iso(), "player_id", "tims")


@query("w2_retention_no_picks", f"WITH {HISTORY_SQL} SELECT {DATE_SQL}, player_id, tims FROM hist")
def w2_none(spark, sf_dir):
    past = pick_history(spark, sf_dir)
    return history.retain(past, picks=past.where("tims > 3")).select(iso(), "player_id", "tims")


@query("w3_skip_if_present", f"""WITH {PICKED} SELECT {DATE_SQL}, tims, id FROM picks
WHERE date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F')""")
def w3(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderdate").cast("date").alias("date"))
    return history.new_picks(all_picks(spark, sf_dir, keep=["id"]), known).select(iso(), "tims", "id")


@query("w4_trigger_plan", """WITH starts AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day,
    o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS start FROM orders),
  planned AS (SELECT *, start + INTERVAL 5 MINUTE AS t, lead(start) OVER (PARTITION BY day ORDER BY start) IS NULL AS last_game FROM starts)
SELECT CAST(day AS VARCHAR) AS day, strftime(start, '%Y-%m-%dT%H:%M:%SZ') AS start,
  'TriggerStateMachineAt_' || strftime(t, '%Y%m%d%H%M') || '-dev' AS rule,
  'cron(' || minute(t) || ' ' || hour(t) || ' ' || day(t) || ' ' || month(t) || ' ? ' || year(t) || ')' AS cron,
  last_game FROM planned""")
def w4(spark, sf_dir):
    starts = _orders_as_games(spark, sf_dir).select(F.col("date").alias("day"), "start")
    plan = schedule.trigger_plan(starts, "dev")
    return plan.select(iso("day"), "start", "rule", "cron", "last_game")


@query("w7_order_by_score", f"""WITH {PICKED} SELECT {DATE_SQL}, tims, id, {STAT_SQL},
  CAST(row_number() OVER (PARTITION BY date ORDER BY picks.stat DESC, tims) AS INTEGER) AS rank FROM picks""")
def w7(spark, sf_dir):
    ranked = picks.ordered_picks(all_picks(spark, sf_dir, keep=["id"]))
    return ranked.select(iso(), "tims", "id", six("stat"), "rank")


@query("w8_order_by_tier_text", f"""WITH {PICKED}, told AS (SELECT date, name,
    CASE WHEN l_orderkey % 5 = 0 THEN 'n/a' ELSE '' || tims END AS tims FROM picks)
SELECT {DATE_SQL}, string_agg(name, ',' ORDER BY coalesce(TRY_CAST(tims AS INTEGER), 0), name) AS names
FROM told GROUP BY date""")
def w8(spark, sf_dir):
    told = all_picks(spark, sf_dir, keep=["name"]).withColumn(
        "tims", F.when(F.col("l_orderkey") % 5 == 0, "n/a").otherwise(F.col("tims").cast("string")))
    # At most three picks per date.
    listed = told.groupBy("date").agg(
        F.sort_array(F.collect_list(F.struct(*notify.by_tier("name")))).alias("l"))
    names = F.transform("l", lambda x: x.getField("name"))
    return listed.select(iso(), F.array_join(names, ",").alias("names"))


@query("u1_home_and_away", f"""WITH {TEAM_ROWS} SELECT home, count(*) AS teams, count(DISTINCT {_NAME}) AS names
FROM team_rows GROUP BY home""")
def u1(spark, sf_dir):
    teams = feeds.team_rows(_orders_as_games(spark, sf_dir))
    return teams.groupBy("home").agg(
        F.count("*").alias("teams"), F.countDistinct("team_name").alias("names"))


@query("u2_forwards_and_defensemen", """SELECT o_orderkey AS team_id, o_orderkey * 10 + n AS id,
  CASE WHEN n = 0 THEN 'F ' ELSE 'D ' END || o_orderpriority AS name
FROM orders, (VALUES (0), (1)) v(n) WHERE n = 0 OR o_orderkey % 3 <> 0""")
def u2(spark, sf_dir):
    def skater(n, first):
        return F.struct(
            (F.col("o_orderkey") * 10 + n).alias("id"),
            F.struct(F.lit(first).alias("default")).alias("firstName"),
            F.struct(F.col("o_orderpriority").alias("default")).alias("lastName"))

    rosters = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("team_id"), F.array(skater(0, "F")).alias("forwards"),
        F.when(F.col("o_orderkey") % 3 != 0, F.array(skater(1, "D"))).alias("defensemen"))
    return feeds.roster_players(rosters).drop("roster_no")


@query("u3_append_picks", f"""WITH {HISTORY_SQL} SELECT {DATE_SQL}, player_id, tims, CAST(Scored AS VARCHAR) AS Scored FROM hist
UNION ALL SELECT '{TODAY}', c_custkey, 1, NULL FROM customer""")
def u3(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(
        F.lit(TODAY).cast("date").alias("date"), F.col("c_custkey").alias("player_id"),
        F.lit(1).alias("tims"))
    both = history.append_picks(pick_history(spark, sf_dir), new)
    return both.select(iso(), "player_id", "tims", F.col("Scored").cast("string").alias("Scored"))


# --- feature windows --------------------------------------------------------

LOG_SQL = """log AS (SELECT year(l_shipdate) || '' || (year(l_shipdate) + 1) AS season, CAST(l_shipdate AS DATE) AS date, l_suppkey AS player_id,
    s_nationkey AS team_id, (s_nationkey + day(l_shipdate)) % 25 AS opponent_id,
    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS goals,
    sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS pp_goals,
    sum(CASE WHEN l_returnflag = 'R' AND l_tax > 0.07 THEN 1 ELSE 0 END) AS sh_goals
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""


def season_of(year):
    """Season key as the feed has it, such as 20242025."""
    return F.concat(year.cast("string"), (year + 1).cast("string"))


def log_of(spark, sf_dir):
    """Line items as a game log; counted per supplier and date before the team is joined."""
    goal = F.col("l_returnflag") == "R"
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("player_id"), season_of(F.year("l_shipdate")).alias("season"),
        F.col("l_shipdate").cast("date").alias("date"), goal.cast("int").alias("goals"),
        (goal & (F.col("l_linestatus") == "O")).cast("int").alias("pp_goals"),
        (goal & (F.col("l_tax") > 0.07)).cast("int").alias("sh_goals"))
    counted = features.game_log(raw, keys=("player_id", "season", "date"))
    team = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("player_id"), F.col("s_nationkey").alias("team_id"))
    return counted.join(team, "player_id").withColumn(
        "opponent_id", (F.col("team_id") + F.dayofmonth("date")) % 25)


_SEASON = "PARTITION BY player_id, season ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_GPG = f"coalesce(sum(goals) OVER ({_SEASON}) / count(*) OVER ({_SEASON}), 0)"
_FIVE = "coalesce(avg(goals) OVER (PARTITION BY player_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)"


def _long_rate(column):
    """Games of the two seasons before and of this season so far, by self-join."""
    return f"""coalesce((SELECT sum(o.{column}) / count(*) FROM log o WHERE o.player_id = log.player_id
      AND substr(o.season, 1, 4)::INT >= substr(log.season, 1, 4)::INT - 2 AND o.date < log.date), 0)"""


def _team_rate(key, column):
    """Mean over the team's dates of this season before the date."""
    return f"""SELECT {key} AS team, season, date, coalesce(avg(g) OVER (PARTITION BY {key}, season ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rate
      FROM (SELECT {key}, season, date, sum({column}) AS g FROM log GROUP BY ALL)"""


def _rates(spark, sf_dir, *names):
    rated = features.player_rates(log_of(spark, sf_dir))
    return rated.select(iso(), "player_id", *[F.round(n, 6).alias(n) for n in names])


@query("x1_goals_per_game", f"WITH {LOG_SQL} SELECT {DATE_SQL}, player_id, round({_GPG}, 6) AS gpg FROM log")
def x1(spark, sf_dir):
    return _rates(spark, sf_dir, "gpg")


@query("x2_last_five_games", f"WITH {LOG_SQL} SELECT {DATE_SQL}, player_id, round({_FIVE}, 6) AS five_gpg FROM log")
def x2(spark, sf_dir):
    return _rates(spark, sf_dir, "five_gpg")


@query("x3_last_three_seasons", f"WITH {LOG_SQL} SELECT {DATE_SQL}, player_id, round({_long_rate('goals')}, 6) AS hgpg FROM log")
def x3(spark, sf_dir):
    return _rates(spark, sf_dir, "hgpg")


@query("x4_team_goals_per_game", f"""WITH {LOG_SQL} SELECT CAST(team AS INTEGER) AS team_id, {DATE_SQL}, round(rate, 6) AS tgpg
FROM ({_team_rate('team_id', 'goals')})""")
def x4(spark, sf_dir):
    rates = features.goals_for(log_of(spark, sf_dir))
    return rates.select("team_id", iso(), F.round("tgpg", 6).alias("tgpg"))


def _against(spark, sf_dir, name):
    rates = features.goals_against(log_of(spark, sf_dir))
    return rates.select("opponent_id", iso(), F.round(name, 6).alias(name))


@query("x5_opponent_goals_against", f"""WITH {LOG_SQL} SELECT CAST(team AS INTEGER) AS opponent_id, {DATE_SQL}, round(rate, 6) AS otga
FROM ({_team_rate('opponent_id', 'goals')})""")
def x5(spark, sf_dir):
    return _against(spark, sf_dir, "otga")


@query("x6_power_play_three_seasons", f"WITH {LOG_SQL} SELECT {DATE_SQL}, player_id, round({_long_rate('pp_goals')}, 6) AS hppg FROM log")
def x6(spark, sf_dir):
    return _rates(spark, sf_dir, "hppg")


@query("x7_opponent_short_handed", f"""WITH {LOG_SQL} SELECT CAST(team AS INTEGER) AS opponent_id, {DATE_SQL}, round(rate, 6) AS otshga
FROM ({_team_rate('opponent_id', 'sh_goals')})""")
def x7(spark, sf_dir):
    return _against(spark, sf_dir, "otshga")


@query("x8_home_flag", f"WITH {TEAM_ROWS} SELECT game_no, team_id, home FROM team_rows")
def x8(spark, sf_dir):
    games = _orders_as_games(spark, sf_dir).withColumn("game", F.col("game_no"))
    return feeds.team_rows(games, keys=("game",)).select(
        F.col("game").alias("game_no"), "team_id", "home")


@query("x9_feature_table", f"""WITH {LOG_SQL}, f AS ({_team_rate('team_id', 'goals')}),
  a AS ({_team_rate('opponent_id', 'goals')}), s AS ({_team_rate('opponent_id', 'sh_goals')})
SELECT CAST(log.date AS VARCHAR) AS date, player_id, round({_GPG.replace('date', 'log.date').replace('season', 'log.season')}, 6) AS gpg,
  round({_FIVE.replace('date', 'log.date')}, 6) AS five_gpg,
  round(f.rate, 6) AS tgpg, round(a.rate, 6) AS otga, round(s.rate, 6) AS otshga
FROM log JOIN f ON log.team_id = f.team AND log.season = f.season AND log.date = f.date
JOIN a ON log.opponent_id = a.team AND log.season = a.season AND log.date = a.date
JOIN s ON log.opponent_id = s.team AND log.season = s.season AND log.date = s.date""")
def x9(spark, sf_dir):
    made = features.feature_table(stage(log_of(spark, sf_dir), "log"))
    return made.select(iso(), "player_id", *[
        F.round(c, 6).alias(c) for c in ("gpg", "five_gpg", "tgpg", "otga", "otshga")])


_AHEAD, _AHEAD_SEASON = "2000-01-01", "19992000"


_X10_SQL = f"""WITH {LOG_SQL}, past AS (SELECT * FROM log WHERE date < DATE '{_AHEAD}'), p AS (SELECT s_suppkey AS player_id, s_nationkey AS team, (s_nationkey + 10) % 25 AS opponent FROM supplier),
  five AS (SELECT player_id, avg(goals) AS g FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY date DESC) AS n FROM past) WHERE n <= 5 GROUP BY 1),
  own AS (SELECT player_id, avg(goals) FILTER (WHERE season = '{_AHEAD_SEASON}') AS gpg, avg(goals) FILTER (WHERE season >= '19971998') AS hgpg,
    avg(pp_goals) FILTER (WHERE season >= '19971998') AS hppg FROM past GROUP BY 1),
  made AS (SELECT team_id AS team, avg(g) AS r FROM (SELECT team_id, date, sum(goals) AS g FROM past WHERE season = '{_AHEAD_SEASON}' GROUP BY ALL) GROUP BY 1),
  let AS (SELECT opponent_id AS team, avg(g) AS r, avg(h) AS s FROM (SELECT opponent_id, date, sum(goals) AS g, sum(sh_goals) AS h FROM past
    WHERE season = '{_AHEAD_SEASON}' GROUP BY ALL) GROUP BY 1)
SELECT p.player_id, round(coalesce(gpg, 0), 6) AS gpg, round(coalesce(hgpg, 0), 6) AS hgpg, round(coalesce(hppg, 0), 6) AS hppg,
  round(coalesce(five.g, 0), 6) AS five_gpg, round(coalesce(made.r, 0), 6) AS tgpg, round(coalesce(let.r, 0), 6) AS otga, round(coalesce(let.s, 0), 6) AS otshga
FROM p LEFT JOIN own USING (player_id) LEFT JOIN five USING (player_id) LEFT JOIN made ON p.team = made.team LEFT JOIN let ON p.opponent = let.team"""
_X10_RATES = ("gpg", "hgpg", "hppg", "five_gpg", "tgpg", "otga", "otshga")


def _scheduled(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("player_id"), F.lit(_AHEAD_SEASON).alias("season"),
        F.lit(_AHEAD).cast("date").alias("date"), F.col("s_nationkey").alias("team_id"),
        ((F.col("s_nationkey") + 10) % 25).alias("opponent_id"))


@query("x10_rates_as_of", _X10_SQL)
def x10(spark, sf_dir):
    made = features.rates_as_of(stage(log_of(spark, sf_dir), "log"), _scheduled(spark, sf_dir))
    return made.select("player_id", *[F.round(c, 6).alias(c) for c in _X10_RATES])


@query("x10_rates_brought_forward", _X10_SQL)
def x10_forward(spark, sf_dir):
    """The same from running totals: a first log, then day after day."""
    log = stage(log_of(spark, sf_dir), "log")
    store = daily.Store(run_dir(spark, "store"))
    days = ("1999-12-28", "1999-12-29", "1999-12-30", "1999-12-31")
    for before, day in zip((None, *days), days):
        rows = log.where(F.col("date") <= F.lit(day).cast("date"))
        if before is not None:
            rows = rows.where(F.col("date") > F.lit(before).cast("date"))
        daily.add_day(spark, store, rows, day)
    totals = daily.read_totals(spark, store, _AHEAD)
    made = features.rates_from(totals, _scheduled(spark, sf_dir), _AHEAD_SEASON)
    return made.select("player_id", *[F.round(c, 6).alias(c) for c in _X10_RATES])
