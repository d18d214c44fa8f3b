"""Joins."""

from pyspark.sql import functions as F

from bindings.base import (
    BOUNDS, CAND, DATE_SQL, ORDER, ORDER_SQL, PICKED, SCORED, TODAY, candidates, feature_sql, iso,
    query, stage, table,
)
from bindings.projections import TEAM_ROWS, _orders_as_games, users_and_preferences
from tierpick.config import WEIGHTED
from tierpick.operators import bets, enrich, history, live, notify, picks, scoring, search
from tierpick.sources import feeds


def _players(spark, sf_dir):
    """Customers as players; the team is their nation."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("gpg"), F.col("c_nationkey").alias("team_id"),
        F.lit(0.0).alias("stat"))


def _teams(spark, sf_dir):
    """Suppliers as team rows: a nation comes several times, the last row counts."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("team_id"), F.col("s_name").alias("team_name"),
        F.lit("X").alias("team_abbr"), F.col("s_acctbal").alias("tgpg"),
        F.col("s_suppkey").alias("pos"))


_LAST_TEAM = """last_team AS (SELECT s_nationkey AS team_id, max_by(s_name, s_suppkey) AS team_name,
  max_by(s_acctbal, s_suppkey) AS tgpg FROM supplier GROUP BY s_nationkey)"""


@query("j1_players_teams", f"""WITH {_LAST_TEAM} SELECT c_custkey AS id, c_name AS name, c_acctbal AS gpg,
  team_name, tgpg FROM customer JOIN last_team ON c_nationkey = team_id""")
def j1(spark, sf_dir):
    teams = _teams(spark, sf_dir)
    players = _players(spark, sf_dir).join(teams.select("team_id"), "team_id", "left_semi")
    return enrich.join_teams(players, teams, position="pos")


@query("j1_missing_team", """SELECT c_custkey AS id FROM customer
WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0)""")
def j1_missing(spark, sf_dir):
    teams = _teams(spark, sf_dir).where(F.col("pos") % 2 == 0)
    return enrich.players_without_team(_players(spark, sf_dir), teams).select("id")


@query("j1b_unnest_teams", f"""SELECT c_custkey AS id, c_name AS name, n_name AS team_name,
  n_regionkey % 2 = 0 AS home FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def j1b(spark, sf_dir):
    from tierpick.operators.skew import bounded_lists

    nation = table(spark, sf_dir, "nation")
    item = F.struct("id", "name", "team_id")
    rosters = bounded_lists(_players(spark, sf_dir), ["team_id"], ["id"], item, "players")
    nested = rosters.join(
        nation.select(
            F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name"),
            (F.col("n_regionkey") % 2 == 0).alias("home")), "team_id")
    return enrich.nest_players(nested)


@query("j2_injury_join", f"""WITH hurt AS (SELECT lower(c_name) AS key, max_by(o_orderstatus, o_orderkey) AS status
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN key IS NULL THEN 'HEALTHY' ELSE 'INJURED' END AS injury_status,
  CASE WHEN key IS NULL THEN '' ELSE status END AS injury_desc
FROM customer LEFT JOIN hurt ON lower(c_name) = key""")
def j2(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 == 0)
    customer = table(spark, sf_dir, "customer")
    injuries = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.upper("c_name").alias("player"), F.lit("").alias("injury"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("pos"))
    players = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return enrich.merge_injuries(players, injuries).select("id", "injury_status", "injury_desc")


_LISTS = """lists AS (SELECT l_suppkey * 20 AS id, max(l_linenumber) AS tier FROM lineitem
  WHERE l_linenumber <= 3 AND l_quantity > 49 GROUP BY 1)"""


def _tier_lists(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(
        (F.col("l_linenumber") <= 3) & (F.col("l_quantity") > 49)
    ).select((F.col("l_suppkey") * 20).alias("id"), F.col("l_linenumber").alias("tier"))


@query("j3_tier_join", f"""WITH {_LISTS}, last AS (SELECT o_custkey AS id, max(o_orderkey) AS pos FROM orders GROUP BY 1)
SELECT o_orderkey AS pos, o_custkey AS id,
  CASE WHEN tier IS NOT NULL AND o_orderkey = last.pos THEN tier ELSE 0 END AS tims
FROM orders JOIN last ON o_custkey = last.id LEFT JOIN lists ON o_custkey = lists.id""")
def j3(spark, sf_dir):
    players = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("id"))
    return enrich.tag_tiers(players, _tier_lists(spark, sf_dir), position="pos").select(
        "pos", "id", "tims")


@query("j3_unmatched_lists", f"""WITH {_LISTS} SELECT l_suppkey * 20 AS id, l_linenumber AS tier FROM lineitem
WHERE l_linenumber <= 3 AND l_quantity > 49 AND l_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)""")
def j3_unmatched(spark, sf_dir):
    players = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return enrich.unmatched_tiers(players, _tier_lists(spark, sf_dir))


# Names made of the tables: part names with an accent, and two aliased names.
_PLAYER_NAME = """CASE WHEN s_suppkey % 10 = 0 THEN 'Mitch Marner ' || s_suppkey
  WHEN s_suppkey % 10 = 1 THEN 'Ren' || chr(233) || ' ' || s_suppkey ELSE s_name END"""
_ODDS_NAME = """CASE WHEN l_suppkey % 10 = 0 THEN 'Mitchell Marner ' || l_suppkey
  WHEN l_suppkey % 10 = 1 THEN 'Rene ' || l_suppkey WHEN l_suppkey % 10 = 2 THEN 'Nobody ' || l_suppkey
  WHEN l_suppkey % 10 = 3 THEN 'Brendan Brisson' ELSE s_name END"""
_ODDS = "CAST(l_quantity * 10 - 250 AS INTEGER)"
_RANKED_ODDS = f"""SELECT l_suppkey, {_ODDS} AS odds FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(c + ' DESC' for c in ORDER)}) = 1"""


def odds_players(spark, sf_dir):
    key = F.col("s_suppkey")
    name = (
        F.when(key % 10 == 0, F.concat(F.lit("Mitch Marner "), key.cast("string")))
        .when(key % 10 == 1, F.concat(F.lit("René "), key.cast("string")))
        .otherwise(F.col("s_name")))
    return table(spark, sf_dir, "supplier").select(key.alias("id"), name.alias("name"), "s_acctbal")


def odds_feed(spark, sf_dir):
    key = F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "supplier"), key == F.col("s_suppkey"))
    name = (
        F.when(key % 10 == 0, F.concat(F.lit("Mitchell Marner "), key.cast("string")))
        .when(key % 10 == 1, F.concat(F.lit("Rene "), key.cast("string")))
        .when(key % 10 == 2, F.concat(F.lit("Nobody "), key.cast("string")))
        .when(key % 10 == 3, F.lit("Brendan Brisson"))
        .otherwise(F.col("s_name")))
    return rows.select(
        F.struct(*ORDER).alias("pos"), name.alias("name"),
        (F.col("l_quantity") * 10 - 250).cast("int").cast("string").alias("odds"))


@query("j4_link_odds", f"""WITH price AS ({_RANKED_ODDS})
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 NOT IN (2, 3) THEN CAST(odds AS VARCHAR) END AS odds
FROM supplier LEFT JOIN price ON s_suppkey = l_suppkey""")
def j4(spark, sf_dir):
    linked = enrich.link_odds(odds_players(spark, sf_dir), odds_feed(spark, sf_dir))
    return linked.select("id", "odds")


@query("j4_unmatched_odds", f"""SELECT 'Nobody ' || l_suppkey AS name, CAST({_ODDS} AS VARCHAR) AS odds
FROM lineitem WHERE l_suppkey % 10 = 2""")
def j4_unmatched(spark, sf_dir):
    return enrich.unmatched_odds(odds_players(spark, sf_dir), odds_feed(spark, sf_dir)).select(
        "name", "odds")


HISTORY_SQL = f"""{PICKED}, hist AS (SELECT date, id AS player_id, tims, stat,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE scored END AS Scored, {ORDER_SQL} FROM picks)"""


def pick_history(spark, sf_dir):
    """Picks of all dates as a written table; a quarter of the outcomes is still open."""
    chosen = picks.replay(
        candidates(spark, sf_dir), ORDER, bounds=BOUNDS, keep=["id", "scored"])
    rows = chosen.select(
        "date", F.col("id").alias("player_id"), "tims", "stat",
        F.when(F.col("l_orderkey") % 4 != 0, F.col("scored")).alias("Scored"), *ORDER)
    return stage(rows, "history")


OUTCOMES_SQL = """outcomes AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS id,
  max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS scored FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2)"""


def outcome_table(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_suppkey") % 5 != 0)
    return rows.groupBy(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("id")
    ).agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("scored"))


FILLED_SQL = f"""pending AS (SELECT DISTINCT date FROM hist WHERE Scored IS NULL AND date < DATE '{TODAY}'),
filled AS (SELECT hist.date, player_id, tims, stat, CASE WHEN pending.date IS NOT NULL AND outcomes.scored IS NOT NULL
  THEN outcomes.scored ELSE hist.Scored END AS Scored FROM hist LEFT JOIN pending ON hist.date = pending.date
  LEFT JOIN outcomes ON hist.date = outcomes.date AND player_id = outcomes.id)"""


@query("j5_fill_outcomes", f"""WITH {HISTORY_SQL}, {OUTCOMES_SQL}, {FILLED_SQL}
SELECT {DATE_SQL}, player_id, tims, CAST(Scored AS VARCHAR) AS Scored FROM filled""")
def j5(spark, sf_dir):
    filled = history.fill_outcomes(
        pick_history(spark, sf_dir), outcome_table(spark, sf_dir), TODAY)
    return filled.select(iso(), "player_id", "tims", F.col("Scored").cast("string").alias("Scored"))


@query("j6_preferences_users", """SELECT c_name || '@mail' AS email,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS display_name
FROM customer WHERE c_custkey % 4 NOT IN (0, 1) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def j6(spark, sf_dir):
    users, _ = users_and_preferences(spark, sf_dir)
    preferences = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") == "F").alias("notify"))
    return notify.opted_in(users, preferences)


@query("j7_retention_semi_join", f"""WITH {HISTORY_SQL} SELECT {DATE_SQL}, player_id, tims FROM hist
WHERE date IN (SELECT DISTINCT date FROM hist ORDER BY date DESC LIMIT 30)""")
def j7(spark, sf_dir):
    return history.retain(pick_history(spark, sf_dir), keep=30).select(iso(), "player_id", "tims")


@query("j8_ledger_anti_join", """SELECT CAST(o_orderdate AS VARCHAR)[:10] AS Date, o_orderkey FROM orders
WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 45)""")
def j8(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").cast("string").alias("Date"), "o_orderkey")
    ledger = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45).select(
        F.col("l_shipdate").cast("date").cast("string").alias("Date"))
    return bets.unbooked(rows, ledger)


@query("j9_watchlist_flag", """SELECT c_custkey AS id, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
  AND o_totalprice > 400000) AS watched FROM customer""")
def j9(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"),
        F.col("c_nationkey").alias("team_name"))
    listed = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 400000).join(
        customer, F.col("o_custkey") == F.col("id")).select("team_name", "full_name")
    return live.watch_flag(customer, listed).select("id", "watched")


@query("j10_game_scorers", """WITH per AS (SELECT o_orderkey AS game_id, 'S' || l_suppkey % 7 AS name, l_suppkey % 2 AS team,
    count(*) AS goal FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2, 3),
  sides AS (SELECT o_orderkey AS game_id, side FROM orders, (VALUES ('home'), ('away')) s(side) WHERE o_orderstatus <> 'P')
SELECT sides.game_id, side, per.name, goal FROM sides LEFT JOIN per ON sides.game_id = per.game_id
  AND team = CASE side WHEN 'home' THEN 0 ELSE 1 END""")
def j10(spark, sf_dir):
    games = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("game_id"),
        F.when(F.col("o_orderstatus") == "P", "FUT").otherwise("LIVE").alias("status"),
        F.lit(1).alias("period"), F.lit(False).alias("is_intermission"),
        F.lit(0).alias("time_passed"), F.lit("0").alias("home_abbr"), F.lit("1").alias("away_abbr"),
        F.lit("H").alias("home_team"), F.lit("A").alias("away_team"))
    scorers = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").groupBy(
        F.col("l_orderkey").alias("game_id"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 7).cast("string")).alias("name"),
        (F.col("l_suppkey") % 2).cast("string").alias("team_abbr"),
    ).agg(F.count("*").alias("goal"), F.lit(0).alias("time"), F.lit(0).alias("pos")).withColumn(
        "full_name", F.col("name"))
    none = games.select(F.col("home_team").alias("team_name"), F.col("home_team").alias("full_name"))
    board = live.board_scorers(games, scorers, none.limit(0))
    return board.select("game_id", "side", "name", "goal")


def trial_candidates(spark, sf_dir):
    """Labelled candidates with table-bound features, ready for the search."""
    return search.search_input(candidates(spark, sf_dir), ORDER, BOUNDS)


def search_sql(steps: int) -> str:
    """Every vector on every candidate, written out."""
    ks = [f"k{i}" for i in range(6)]
    ranges = ", ".join(f"range(0, {steps + 1}) {k}({k})" for k in ks)
    unit = f"CAST({1.0 / steps!r} AS FLOAT)"
    weights = ", ".join(
        f"CAST({k} AS FLOAT) * {unit} AS w{i}" for i, k in enumerate([*ks, f"({steps} - {' - '.join(ks)})"]))
    features = ", ".join(f"{feature_sql(w)} AS f{i}" for i, w in enumerate(WEIGHTED))
    score = " + ".join(f"f{i} * w{i}" for i in range(7))
    return f"""{CAND},
grid AS (SELECT row_number() OVER (ORDER BY {', '.join(ks)}) - 1 AS wid, {weights}
  FROM {ranges} WHERE {' + '.join(ks)} <= {steps}),
known AS (SELECT date, tims, scored, {ORDER_SQL}, {features} FROM cand WHERE tims BETWEEN 1 AND 3),
best AS (SELECT wid, date, tims, arg_min(scored, ROW(-({score}), {ORDER_SQL})) AS scored
  FROM known, grid GROUP BY wid, date, tims),
results AS (SELECT wid, CAST(sum(scored) AS BIGINT) AS correct FROM best GROUP BY wid)"""


@query("j11_grid_on_candidates", f"WITH {search_sql(3)} SELECT wid, correct FROM results")
def j11(spark, sf_dir):
    return search.evaluate_grid(trial_candidates(spark, sf_dir), 3, ORDER)


@query("j12_users_picks", f"""WITH {SCORED}, day AS (SELECT *, '' || tims AS t FROM scored_rows WHERE tims BETWEEN 1 AND 3
    AND date = DATE '2001-05-30'
    QUALIFY row_number() OVER (PARTITION BY tims ORDER BY stat DESC, {ORDER_SQL}) = 1),
  body AS (SELECT 'Tims | Name | Team | Probability' || chr(10) || repeat('-', 40) || chr(10) ||
    coalesce(string_agg(tims || ' | ' || name || ' | ' || team_id || ' | ' ||
      printf('%.2f', CAST(stat AS DOUBLE)) || '%' || chr(10), '' ORDER BY tims), '') AS text FROM day)
SELECT c_name || '@mail' AS email, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Hey ' || c_mktsegment || ',' || chr(10) || chr(10) END
  || (SELECT text FROM body) AS text FROM customer WHERE c_acctbal > 0 AND c_custkey % 4 NOT IN (0, 1)""")
def j12(spark, sf_dir):
    day = candidates(spark, sf_dir).where(F.col("date") == F.lit("2001-05-30").cast("date"))
    chosen = picks.historical_picks(scoring.predict(day, BOUNDS), ORDER).select(
        "tims", "name", F.col("team_id").alias("team_name"), F.col("stat").cast("double").alias("stat"),
        F.col("tims").alias("pick_no"))
    users = notify.opted_in(*users_and_preferences(spark, sf_dir))
    return notify.messages(users, chosen).select("email", "text")


@query("j13_opponent_figures", f"""WITH {TEAM_ROWS}, stats AS (SELECT c_nationkey AS team_id, max(c_acctbal) AS otga FROM customer
  WHERE c_nationkey <> 3 GROUP BY 1)
SELECT game_no, team_rows.team_id, opponent_id, coalesce(otga, 0) AS otga FROM team_rows
LEFT JOIN stats ON opponent_id = stats.team_id""")
def j13(spark, sf_dir):
    teams = feeds.team_rows(_orders_as_games(spark, sf_dir).withColumn(
        "game", F.col("game_no")), keys=("game",))
    stats = table(spark, sf_dir, "customer").where(F.col("c_nationkey") != 3).groupBy(
        F.col("c_nationkey").alias("team_id")).agg(F.max("c_acctbal").alias("otga"))
    return enrich.opponent_columns(teams, stats, ["otga"]).select(
        F.col("game").alias("game_no"), "team_id", "opponent_id", "otga")
