"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from bindings.base import (
    BOUNDS, CAND, DATE_SQL, ORDER, ORDER_SQL, SCORED, STAT_SQL, TODAY, YESTERDAY, candidates,
    feature_sql, iso, query, score_sql, six, table, unit_sql,
)
from tierpick.config import SEASON_START, WEIGHTED
from tierpick.functions import sql
from tierpick.functions.text import full_name, place_or_common
from tierpick.operators import backfill, bets, live, notify, picks, schedule, scoring
from tierpick.operators.history import picks_of
from tierpick.sources import feeds, tables


def _orders_as_games(spark, sf_dir):
    """Orders as games with nested home and away teams."""
    orders = table(spark, sf_dir, "orders")

    def team(number):
        place = F.when(number % 5 == 0, F.lit(" ")).otherwise(
            F.concat(F.lit("Place "), number.cast("string")))
        return F.struct(
            number.alias("id"),
            F.struct(place.alias("default")).alias("placeName"),
            F.concat(F.lit("T"), number.cast("string")).alias("abbrev"),
            F.struct(F.concat(F.lit("Common "), number.cast("string")).alias("default")).alias(
                "commonName"),
        )

    start = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return orders.select(
        F.col("o_orderkey").alias("game_no"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start"),
        F.year("o_orderdate").cast("string").alias("season"),
        team(F.col("o_custkey") % 25).alias("home_team"),
        team((F.col("o_custkey") + 7) % 25).alias("away_team"),
    )


TEAM_ROWS = """team_rows AS (
  SELECT o_orderkey AS game_no, CAST(o_orderdate AS DATE) AS date, side,
    CASE WHEN side = 0 THEN o_custkey % 25 ELSE (o_custkey + 7) % 25 END AS team_id,
    CASE WHEN side = 0 THEN (o_custkey + 7) % 25 ELSE o_custkey % 25 END AS opponent_id,
    CAST(year(o_orderdate) AS VARCHAR) AS season, side = 0 AS home
  FROM orders, (VALUES (0), (1)) sides(side))"""

_NAME = """CASE WHEN team_id % 5 = 0 THEN 'Common ' ELSE 'Place ' END || team_id"""


@query("p1_game_to_team_rows", f"""WITH {TEAM_ROWS}
SELECT game_no * 2 + side AS team_no, {_NAME} AS team_name, 'T' || team_id AS team_abbr, season,
  team_id, opponent_id, home FROM team_rows""")
def p1(spark, sf_dir):
    return feeds.team_rows(_orders_as_games(spark, sf_dir))


@query("p2_place_or_common_name", """SELECT o_orderkey,
  CASE WHEN o_custkey % 5 = 0 THEN o_orderpriority ELSE 'City ' || o_custkey END AS team_name
FROM orders""")
def p2(spark, sf_dir):
    place = F.when(F.col("o_custkey") % 5 == 0, F.lit(" ")).otherwise(
        F.concat(F.lit("City "), F.col("o_custkey").cast("string")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", place_or_common(place, F.col("o_orderpriority")).alias("team_name"))


@query("p3_full_name", """SELECT c_custkey,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_mktsegment END || ' ' || c_name AS name FROM customer""")
def p3(spark, sf_dir):
    first = F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", full_name(first, F.col("c_name")).alias("name"))


@query("p4_drop_columns", f"""WITH {CAND} SELECT name, gpg, hgpg, five_gpg, {ORDER_SQL} FROM cand""")
def p4(spark, sf_dir):
    hidden = ("date", "tims", "scored", "home", "hppg", "tgpg", "otga", "otshga", "id", "team_id")
    return tables.without(candidates(spark, sf_dir), hidden)


@query("p5_rename_player_id", f"""WITH {CAND}
SELECT coalesce(CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey END, id) AS player_id, {ORDER_SQL}
FROM cand""")
def p5(spark, sf_dir):
    df = candidates(spark, sf_dir)
    own = F.when(F.col("l_linenumber") != 1, F.col("l_partkey"))
    return tables.with_player_id(df.withColumn("player_id", own)).select("player_id", *ORDER)


_UNITS = ", ".join(
    f"round(CAST({unit_sql(x)} AS DOUBLE), 6) AS {x}" for x in BOUNDS)


def _normalised(df, zero_range="zero", bounds=BOUNDS):
    return df.select(*ORDER, *[
        F.round(
            scoring.min_max(F.col(x), *bounds[x], zero_range=zero_range).cast("double"), 6
        ).alias(x) for x in bounds
    ])


@query("p6_min_max_normalise", f"WITH {CAND} SELECT {ORDER_SQL.replace(', l_extendedprice', '')}, "
       f"l_extendedprice, {_UNITS} FROM cand")
def p6(spark, sf_dir):
    return _normalised(candidates(spark, sf_dir))


@query("p6b_normalise_labelled", f"""WITH {CAND} SELECT {ORDER_SQL}, {_UNITS} FROM cand
WHERE tims BETWEEN 1 AND 3""")
def p6b(spark, sf_dir):
    return _normalised(scoring.labelled(candidates(spark, sf_dir)))


@query("p6c_normalise_guarded", f"""WITH {CAND} SELECT {ORDER_SQL},
  0.0::DOUBLE AS gpg, round(CAST({unit_sql('hgpg')} AS DOUBLE), 6) AS hgpg,
  round(CAST((CAST(coalesce(CASE WHEN l_linenumber > 2 THEN tgpg END, 0) AS FLOAT) - CAST(0.0 AS FLOAT))
    / (CAST(500000.0 AS FLOAT) - CAST(0.0 AS FLOAT)) AS DOUBLE), 6) AS tgpg FROM cand""")
def p6c(spark, sf_dir):
    df = candidates(spark, sf_dir).withColumn(
        "tgpg", F.when(F.col("l_linenumber") > 2, F.col("tgpg")))
    units = scoring.feature_columns(df, {**BOUNDS, "gpg": (7.0, 7.0)})
    return df.select(*ORDER, *[
        F.round(units[x].cast("double"), 6).alias(x) for x in ("gpg",)],
        F.round(scoring.min_max(F.col("hgpg"), *BOUNDS["hgpg"]).cast("double"), 6).alias("hgpg"),
        F.round(units["tgpg"].cast("double"), 6).alias("tgpg"))


@query("p7_interaction_feature", f"""WITH {CAND} SELECT {ORDER_SQL},
  round(CAST({feature_sql('hppg_otshga')} AS DOUBLE), 6) AS hppg_otshga FROM cand""")
def p7(spark, sf_dir):
    df = candidates(spark, sf_dir)
    units = scoring.feature_columns(df, BOUNDS)
    return df.select(*ORDER, units["hppg_otshga"].alias("hppg_otshga")).select(
        *ORDER, six("hppg_otshga"))


_TRIAL = {"gpg": 0.3, "five_gpg": 0.4, "hgpg": 0.1, "tgpg": 0.05, "otga": 0.05,
          "hppg_otshga": 0.04, "is_home": 0.06}


@query("p8_linear_score", f"""WITH {CAND} SELECT {ORDER_SQL},
  round(CAST({score_sql(_TRIAL)} AS DOUBLE), 6) AS stat FROM cand""")
def p8(spark, sf_dir):
    df = candidates(spark, sf_dir)
    features = scoring.normalise(df, BOUNDS, keep=ORDER)
    total = scoring.weighted_sum({w: F.col(w) for w in WEIGHTED}, _TRIAL)
    return features.select(*ORDER, total.alias("stat")).select(*ORDER, six("stat"))


@query("p9_predict", f"WITH {SCORED} SELECT {ORDER_SQL}, {STAT_SQL} FROM scored_rows")
def p9(spark, sf_dir):
    return scoring.predict(candidates(spark, sf_dir), BOUNDS).select(*ORDER, six("stat"))


@query("d1_score_in_sql", f"WITH {SCORED} SELECT {ORDER_SQL}, {STAT_SQL} FROM scored_rows")
def d1(spark, sf_dir):
    """Scoring called from SQL text."""
    sql.register(spark, BOUNDS)
    names = ", ".join(BOUNDS)
    return spark.sql(
        f"SELECT {ORDER_SQL}, tier_score({names}, home) AS stat FROM {{rows}}",
        rows=candidates(spark, sf_dir)).select(*ORDER, six("stat"))


@query("p10_run_status", f"""SELECT CASE WHEN count(*) FILTER (WHERE CAST(o_orderdate AS DATE)
  = DATE '{TODAY}') > 0 THEN 'normal_run' ELSE 'first_run' END AS status FROM orders""")
def p10(spark, sf_dir):
    board = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return schedule.run_status(board, TODAY)


@query("p11_fresh_board", f"""SELECT o_custkey AS id, o_totalprice, CAST(o_orderdate AS VARCHAR)[:10] AS date
FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '{TODAY}'""")
def p11(spark, sf_dir):
    board = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("player_id"), "o_totalprice",
        F.col("o_orderdate").cast("date").alias("date"))
    return schedule.fresh_board(board, TODAY).select("id", "o_totalprice", iso())


@query("p12_past_dates", f"""SELECT DISTINCT {DATE_SQL} FROM (SELECT CAST(l_shipdate AS DATE) AS date
  FROM lineitem) WHERE date IS NOT NULL AND date <= DATE '{YESTERDAY}'""")
def p12(spark, sf_dir):
    dates = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return backfill.past_dates(dates.distinct(), YESTERDAY).select(iso())


@query("p13_yesterdays_picks", f"""WITH {CAND} SELECT {DATE_SQL}, {ORDER_SQL} FROM cand
WHERE date = DATE '{TODAY}' - 1""")
def p13(spark, sf_dir):
    return picks_of(candidates(spark, sf_dir), F.date_sub(F.lit(TODAY).cast("date"), 1)).select(
        iso(), *ORDER)


@query("p14_labelled_in_tier", f"""WITH {CAND} SELECT {ORDER_SQL}, tims, scored FROM cand
WHERE scored IN (0, 1) AND tims IN (1, 2, 3)""")
def p14(spark, sf_dir):
    return scoring.labelled(candidates(spark, sf_dir)).select(*ORDER, "tims", "scored")


@query("p15_coerce_tier", f"""SELECT {ORDER_SQL}, CASE WHEN l_quantity > 40 OR l_linenumber > 3 THEN 0
  ELSE l_linenumber END AS tims FROM lineitem""")
def p15(spark, sf_dir):
    # Numbers with a decimal point, NaN and nothing at all, as a CSV column has them.
    raw = F.when(F.col("l_quantity") > 45, F.lit(float("nan"))).when(
        F.col("l_quantity") <= 40, F.col("l_linenumber").cast("double"))
    return table(spark, sf_dir, "lineitem").select(*ORDER, scoring.coerce_tier(raw).alias("tims"))


@query("p16_season_filter", """SELECT o_orderkey, CAST(o_orderdate AS VARCHAR)[:10] AS date FROM orders
WHERE o_orderdate >= DATE '2000-10-07'""")
def p16(spark, sf_dir):
    since = SEASON_START.replace("2025", "2000")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return picks.of_season(rows, since).select("o_orderkey", iso())


@query("p17_complete_rows", f"""WITH {CAND} SELECT {ORDER_SQL} FROM cand
WHERE l_orderkey % 7 <> 0 AND l_partkey % 5 <> 0""")
def p17(spark, sf_dir):
    df = candidates(spark, sf_dir)
    holes = df.withColumn("hgpg", F.when(F.col("l_orderkey") % 7 != 0, F.col("hgpg"))).withColumn(
        "scored", F.when(F.col("l_partkey") % 5 != 0, F.col("scored")))
    return tables.complete_rows(holes).select(*ORDER)


@query("p18_minimum_bet", f"""SELECT {ORDER_SQL}, l_tax AS bet FROM lineitem WHERE l_tax > 0.05""")
def p18(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*ORDER, F.col("l_tax").alias("bet"))
    return bets.worth_betting(rows, 0.05)


_STATUS = """CASE event_type WHEN 'click' THEN 'LIVE' WHEN 'view' THEN 'CRIT'
  WHEN 'purchase' THEN 'FINAL' WHEN 'signup' THEN 'FUT' ELSE 'PRE' END"""


def status_of(event_type):
    return (
        F.when(event_type == "click", "LIVE").when(event_type == "view", "CRIT")
        .when(event_type == "purchase", "FINAL").when(event_type == "signup", "FUT")
        .otherwise("PRE"))


@query("p19_live_games", f"""SELECT event_id, status FROM (SELECT event_id, {_STATUS} AS status FROM events)
WHERE status IN ('LIVE', 'CRIT', 'FINAL')""")
def p19(spark, sf_dir):
    games = table(spark, sf_dir, "events").select(
        "event_id", status_of(F.col("event_type")).alias("status"))
    return live.live_only(games)


@query("p20_route_games", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'postponed'
  WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'incomplete' ELSE 'final' END AS route FROM orders""")
def p20(spark, sf_dir):
    games = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "PPD").otherwise("OK").alias("state"),
        F.when((F.col("o_orderstatus") != "O") | (F.col("o_orderkey") % 3 != 0), "REG").alias(
            "outcome"))
    return backfill.classify_games(games).select("o_orderkey", "route")


@query("p21_scorer_class", f"""SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'watched'
  WHEN passed - goal_time < 60 AND period = goal_time // 1200 + 1 AND event_id % 5 <> 0
    AND status IN ('LIVE', 'CRIT') THEN 'recent' ELSE 'plain' END AS shown,
  event_type || ' (' || user_id % 4 || ')' AS text
FROM (SELECT *, {_STATUS} AS status, event_id % 3600 AS passed, (event_id * 7) % 3600 AS goal_time,
  event_id % 3 + 1 AS period FROM events)""")
def p21(spark, sf_dir):
    from tierpick.functions.text import scorer_text

    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        live.scorer_class(
            n % 3600, n % 3 + 1, n % 5 == 0, status_of(F.col("event_type")), (n * 7) % 3600,
            F.col("user_id") % 10 == 0).alias("shown"),
        scorer_text(F.col("event_type"), F.col("user_id") % 4).alias("text"))


@query("p22_opted_in_users", """SELECT CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name || '@mail' END AS email,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS display_name
FROM customer WHERE c_acctbal > 0 AND c_custkey % 4 NOT IN (0, 1)""")
def p22(spark, sf_dir):
    users, preferences = users_and_preferences(spark, sf_dir)
    return notify.opted_in(users, preferences)


def users_and_preferences(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    mail = F.when(F.col("c_custkey") % 4 == 0, F.lit("")).when(
        F.col("c_custkey") % 4 != 1, F.concat("c_name", F.lit("@mail")))
    users = customer.select(
        F.col("c_custkey").alias("id"), mail.alias("email"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("display_name"))
    preferences = customer.select(
        F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("notify"))
    return users, preferences


@query("p23_ignored_names", "SELECT s_suppkey, s_name AS name FROM supplier WHERE s_name NOT IN "
       "('Supplier#000000003', 'Supplier#000000007')")
def p23(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    return bets.not_ignored(rows, ("Supplier#000000003", "Supplier#000000007"))
