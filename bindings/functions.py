"""Scalar functions."""

from pyspark.sql import functions as F

from bindings.aggregates import all_picks
from bindings.base import CAND, DATE_SQL, ORDER, ORDER_SQL, PICKED, candidates, iso, query, table
from tierpick.config import NAME_ALIASES
from tierpick.functions import clock, odds, text
from tierpick.operators import live, picks, scoring
from tierpick.sources import feeds


@query("f1_home_zone_date", """SELECT event_id,
  CAST(CAST(timezone('America/Toronto', timezone('UTC', ts)) AS DATE) - 1 AS VARCHAR) AS day,
  strftime(timezone('America/Toronto', timezone('UTC', ts)) + INTERVAL 5 DAY, '%Y-%m-%dT%H:%M:%S') AS time FROM events""")
def f1(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", clock.home_day(ts, -1).cast("string").alias("day"),
        clock.home_time(ts, 5).alias("time"))


@query("f2_trigger_time", """SELECT event_id, strftime(date_trunc('second', ts) + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS trigger
FROM events""")
def f2(spark, sf_dir):
    start = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = clock.trigger_time(start)
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("trigger"))


@query("f3_cron_text", """SELECT event_id, 'cron(' || minute(ts) || ' ' || hour(ts) || ' ' || day(ts) || ' ' || month(ts)
  || ' ? ' || year(ts) || ')' AS cron FROM events""")
def f3(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", clock.cron_text(F.col("ts")).alias("cron"))


@query("f4_rule_name", """SELECT event_id, 'TriggerStateMachineAt_' || strftime(ts, '%Y%m%d%H%M') || '-prod' AS rule
FROM events""")
def f4(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", clock.rule_name(F.col("ts"), "prod").alias("rule"))


@query("f5_date_number", """SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS day FROM orders""")
def f5(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", clock.date_number(F.col("o_orderdate")).alias("day"))


@query("f6_goal_clock", """SELECT event_id, CAST((event_id % 4) * 1200 + CASE WHEN event_id % 7 = 0 THEN 0
  ELSE (minute(ts) % 20) * 60 + second(ts) END AS INTEGER) AS clock FROM events""")
def f6(spark, sf_dir):
    shown = F.when(F.col("event_id") % 7 != 0, F.format_string(
        "%02d:%02d", F.minute("ts") % 20, F.second("ts")))
    at = clock.goal_clock((F.col("event_id") % 4 + 1).cast("int"), shown)
    return table(spark, sf_dir, "events").select("event_id", at.alias("clock"))


@query("f7_elapsed", """SELECT event_id, CAST((event_id % 4) * 1200 + 1200 - CASE WHEN event_id % 7 = 0 THEN 0
  ELSE event_id % 1200 END AS INTEGER) AS elapsed FROM events""")
def f7(spark, sf_dir):
    left = F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 1200).cast("int"))
    passed = clock.elapsed((F.col("event_id") % 4 + 1).cast("int"), left)
    return table(spark, sf_dir, "events").select("event_id", passed.alias("elapsed"))


@query("f8_goal_period", "SELECT event_id, CAST((event_id % 4800) // 1200 + 1 AS INTEGER) AS period FROM events")
def f8(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", clock.goal_period(F.col("event_id") % 4800).alias("period"))


@query("f9_name_key", "SELECT doc_id, md5(lower(text)) AS key FROM documents")
def f9(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.name_key(F.col("text"))).alias("key"))


# Only letters of the documents outside ASCII; strip_accents does not know the sharp s.
@query("f10_fold_ascii", "SELECT doc_id, md5(replace(strip_accents(text), 'ß', 'ss')) AS folded FROM documents")
def f10(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.fold_ascii(F.col("text"))).alias("folded"))


def _alias_sql(value):
    for old, new in NAME_ALIASES:
        value = f"replace({value}, '{old}', '{new}')"
    return value


_RAW_NAME = """CASE l_linenumber WHEN 1 THEN 'Cam ' WHEN 2 THEN 'Cameron ' WHEN 3 THEN 'Nicholas Paul ' WHEN 4 THEN 'T.J. Brodie '
  WHEN 5 THEN 'Elias-Nils Pettersson ' ELSE 'Tim ' END || s_name"""


@query("f11_alias_chain", f"""SELECT {ORDER_SQL}, {_alias_sql(f'({_RAW_NAME})')} AS name
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def f11(spark, sf_dir):
    n = F.col("l_linenumber")
    first = F.lit("Tim ")
    for i, known in enumerate(
            ("Cam ", "Cameron ", "Nicholas Paul ", "T.J. Brodie ", "Elias-Nils Pettersson "), 1):
        first = F.when(n == i, known).otherwise(first)
    rows = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(*ORDER, text.alias_name(F.concat(first, "s_name")).alias("name"))


_ODDS = "(CAST(l_quantity AS INTEGER) * 10 - 250)"
_PCT = f"""CASE WHEN {_ODDS} < 0 THEN abs({_ODDS}) / (abs({_ODDS}) + 100) * 100
  WHEN {_ODDS} > 0 THEN 100 / ({_ODDS} + 100) * 100 END"""


def _american():
    value = F.col("l_quantity").cast("int") * 10 - 250
    return F.when(value > 0, F.concat(F.lit("+"), value.cast("string"))).otherwise(
        value.cast("string"))


@query("f12_implied_percent", f"SELECT {ORDER_SQL}, round({_PCT}, 6) AS pct FROM lineitem")
def f12(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        *ORDER, F.round(odds.implied_percent(_american()), 6).alias("pct"))


_STAT = "(l_tax * 10)"
_DEC = f"CASE WHEN {_ODDS} >= 0 THEN {_ODDS} / 100 + 1 ELSE 100 / abs({_ODDS}) + 1 END"
_BET = f"""CASE WHEN {_STAT} = 0 OR {_ODDS} = 0 THEN 0.0 ELSE
  least(greatest(0.0, ({_STAT} - {_PCT} / 100) / ({_DEC} - 1) * 100.0), 100.0) END"""


@query("f13_bet_size", f"SELECT {ORDER_SQL}, CAST(printf('%.2f', {_BET}) AS DOUBLE) AS bet FROM lineitem")
def f13(spark, sf_dir):
    price = _american()
    stake = odds.bet_size(F.col("l_tax") * 10, odds.implied_percent(price), price, 100.0)
    return table(spark, sf_dir, "lineitem").select(*ORDER, (stake + 0.0).alias("bet"))


@query("f14_payout", f"""SELECT {ORDER_SQL}, round(l_tax * 100 + l_tax * 100 * {_ODDS} / 100, 6) + 0.0 AS payout,
  round(l_tax * 100 * CASE WHEN {_ODDS} >= 0 THEN {_ODDS} / 100 + 1 ELSE 100 / abs({_ODDS}) + 1 END, 6) + 0.0 AS corrected
FROM lineitem""")
def f14(spark, sf_dir):
    bet, price = F.col("l_tax") * 100, _american()
    return table(spark, sf_dir, "lineitem").select(
        *ORDER, (F.round(odds.payout(bet, price), 6) + 0.0).alias("payout"),
        (F.round(odds.payout(bet, price, corrected=True), 6) + 0.0).alias("corrected"))


@query("f15_tier_as_int", f"SELECT {ORDER_SQL}, l_linenumber AS tims FROM lineitem")
def f15(spark, sf_dir):
    told = F.col("l_linenumber").cast("string")
    return table(spark, sf_dir, "lineitem").select(*ORDER, picks.tier_number(told).alias("tims"))


@query("f16_pick_list_text", f"""WITH {PICKED} SELECT {DATE_SQL}, tims,
  CASE WHEN tims = 1 THEN '' ELSE 'Hey ' || name || ',' || chr(10) || chr(10) END || tims || ' | ' || name || ' | ' || team_id || ' | ' ||
  CASE WHEN tims = 2 THEN 'unknown' ELSE printf('%.2f', CAST(stat AS DOUBLE)) || '%' END || chr(10) AS line FROM picks""")
def f16(spark, sf_dir):
    stat = F.when(F.col("tims") == 2, "unknown").otherwise(
        F.col("stat").cast("double").cast("string"))
    hello = text.greeting(F.when(F.col("tims") != 1, F.col("name")))
    line = text.pick_line(F.col("tims"), F.col("name"), F.col("team_id"), stat)
    made = all_picks(spark, sf_dir, keep=["name", "team_id"])
    return made.select(iso(), "tims", F.concat(hello, line).alias("line"))


@query("f18_fixed_digits", f"""WITH {CAND} SELECT {ORDER_SQL}, printf('%.3f', tgpg / 7919) AS three,
  printf('%.6f', otga / 7919) AS six FROM cand""")
def f18(spark, sf_dir):
    return candidates(spark, sf_dir).select(
        *ORDER, text.fixed(F.col("tgpg") / 7919, 3).alias("three"),
        text.fixed(F.col("otga") / 7919, 6).alias("six"))


@query("f19_scorer_text", "SELECT event_id, event_type || ' (' || user_id % 4 || ')' AS text FROM events")
def f19(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", text.scorer_text(F.col("event_type"), F.col("user_id") % 4).alias("text"))


@query("f22_nested_default", """SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k,
  'none' AS missing FROM events""")
def f22(spark, sf_dir):
    parsed = F.from_json("props", "k int, other struct<name: string>")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).select(
        "event_id", feeds.nested("p.k", 0).alias("k"),
        feeds.nested("p.other.name", "none").alias("missing"))


@query("f23_flat_bounds", """SELECT min(l_quantity) AS min_gpg, max(l_quantity) AS max_gpg, min(l_tax) + 0.0 AS min_hppg,
  CAST(NULL AS DOUBLE) AS max_hppg, CAST(NULL AS DOUBLE) AS min_tgpg, CAST(NULL AS DOUBLE) AS max_tgpg FROM lineitem""")
def f23(spark, sf_dir):
    nested = table(spark, sf_dir, "lineitem").agg(
        F.struct(F.min("l_quantity").alias("min"), F.max("l_quantity").alias("max")).alias("gpg"),
        F.struct((F.min("l_tax") + 0.0).alias("min")).alias("hppg"))
    return scoring.flat_bounds(nested, ("gpg", "hppg", "tgpg"))


@query("f21_board_lines", """WITH b AS (SELECT event_id AS game_id, user_id, event_id % 4 AS period, event_id % 5 = 0 AS pause, event_type
  FROM events WHERE event_type IN ('click', 'view', 'purchase'))
SELECT game_id, CASE WHEN event_type = 'purchase' THEN 'FINAL | H' || user_id || ' @ A' || user_id
  ELSE CASE WHEN pause THEN 'Intermission ' ELSE 'Period ' END || period || ' | 12:34 | H' || user_id || ' @ A' || user_id END
  || chr(10) || user_id % 6 || ' - ' || user_id % 5 || chr(10) || '  HH: x (2)' || chr(10) || '  AA: ' AS text,
  event_type <> 'purchase' AND NOT pause AND period = 1 AS has_recent FROM b""")
def f21(spark, sf_dir):
    from bindings.projections import status_of

    n, user = F.col("event_id"), F.col("user_id")
    games = table(spark, sf_dir, "events").select(
        n.alias("game_id"), status_of(F.col("event_type")).alias("status"),
        (n % 4).cast("int").alias("period"), (n % 5 == 0).alias("is_intermission"),
        F.lit("12:34").alias("period_time_remaining"), F.lit(50).alias("time_passed"),
        F.concat(F.lit("H"), user.cast("string")).alias("home_team"), F.lit("HH").alias("home_abbr"),
        F.concat(F.lit("A"), user.cast("string")).alias("away_team"), F.lit("AA").alias("away_abbr"),
        (user % 6).alias("home_score"), (user % 5).alias("away_score"))
    scorers = games.select(
        "game_id", F.lit("HH").alias("team_abbr"), F.lit("x").alias("name"), F.lit(2).alias("goal"),
        F.lit(10).alias("time"), F.lit("full x").alias("full_name"), F.lit(0).alias("pos"))
    nobody = games.select(
        F.col("home_team").alias("team_name"), F.lit("nobody").alias("full_name"))
    board = live.board_scorers(games, scorers, nobody)
    return live.overview(games, board).select("game_id", "text", "has_recent")
