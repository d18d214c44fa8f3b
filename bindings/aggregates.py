"""Aggregations and the weight grid."""

from pyspark.sql import functions as F

from bindings.base import (
    BOUNDS, CAND, DATE_SQL, ORDER, ORDER_SQL, PICKED, SCORED, STAT_SQL, TODAY, candidates, iso,
    query, six, table,
)
from bindings.joins import (
    FILLED_SQL, HISTORY_SQL, OUTCOMES_SQL, outcome_table, pick_history, search_sql,
    trial_candidates,
)
from bindings.projections import _orders_as_games
from tierpick.config import WEIGHTED
from tierpick.functions import sql
from tierpick.operators import backfill, bets, grid, history, live, picks, schedule, scoring, search
from tierpick.operators.skew import bounded_lists, placed


def scored(spark, sf_dir):
    return scoring.predict(candidates(spark, sf_dir), BOUNDS)


def all_picks(spark, sf_dir, weights=None, keep=None):
    kw = {"keep": keep} if weights is None else {"keep": keep, "weights": weights}
    return picks.replay(candidates(spark, sf_dir), ORDER, bounds=BOUNDS, **kw)


@query("a1_pick_of_day", f"""WITH {PICKED}, ranked AS (SELECT *, count(*) OVER (PARTITION BY date) AS tiers FROM picks),
seen AS (SELECT date, tims, min(ROW({ORDER_SQL})) AS first_row FROM scored_rows WHERE tims BETWEEN 1 AND 3 GROUP BY 1, 2)
SELECT CAST(ranked.date AS VARCHAR) AS date, ranked.tims, id, {STAT_SQL}, CAST(NULL AS INTEGER) AS Scored,
  CAST(row_number() OVER (PARTITION BY ranked.date ORDER BY first_row) AS INTEGER) AS pick_no
FROM ranked JOIN seen ON ranked.date = seen.date AND ranked.tims = seen.tims WHERE tiers = 3""")
def a1(spark, sf_dir):
    chosen = picks.pick_of_day(scored(spark, sf_dir), ORDER)
    return chosen.select(iso(), "tims", "id", six("stat"), "Scored", "pick_no")


@query("a2_historical_picks", f"""WITH {PICKED} SELECT {DATE_SQL}, tims, {ORDER_SQL}, scored, {STAT_SQL} FROM picks""")
def a2(spark, sf_dir):
    made = all_picks(spark, sf_dir, keep=["scored"])
    return made.select(iso(), "tims", *ORDER, "scored", six("stat"))


_COUNTS = "CAST(sum(CASE WHEN scored > 0 THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS picks"


@query("a3_correct_and_slots", f"""WITH {PICKED}
SELECT {_COUNTS}, (SELECT count(DISTINCT date) * 3 FROM cand WHERE tims BETWEEN 1 AND 3) AS slots FROM picks""")
def a3(spark, sf_dir):
    known = scoring.labelled(candidates(spark, sf_dir))
    return picks.correctness(all_picks(spark, sf_dir, keep=["scored"]), known)


@query("a3b_picks_made", f"WITH {PICKED} SELECT {DATE_SQL}, {_COUNTS} FROM picks GROUP BY date")
def a3b(spark, sf_dir):
    per_date = all_picks(spark, sf_dir, keep=["scored"]).groupBy("date").agg(
        F.count(F.when(F.col("scored") > 0, 1)).alias("correct"), F.count("*").alias("picks"))
    return per_date.select(iso(), "correct", "picks")


@query("a3c_accuracy_of_slots", f"""WITH {PICKED} SELECT round(count(*) FILTER (WHERE scored > 0) /
  (SELECT count(DISTINCT date) * 3 FROM cand WHERE tims BETWEEN 1 AND 3), 6) AS accuracy FROM picks""")
def a3c(spark, sf_dir):
    return a3(spark, sf_dir).select(F.round(F.col("correct") / F.col("slots"), 6).alias("accuracy"))


_ACCURACY = """SELECT tims, count(*) AS total, count(*) FILTER (WHERE scored = 1) AS correct,
  count(*) FILTER (WHERE scored <> 1) AS wrong, round(100.0 * count(*) FILTER (WHERE scored = 1) / count(*), 6) AS pct
FROM picks GROUP BY ROLLUP (tims)"""


@query("a4_accuracy_by_tier", f"WITH {PICKED} {_ACCURACY}")
def a4(spark, sf_dir):
    report = picks.accuracy(all_picks(spark, sf_dir, keep=["scored"]))
    return report.withColumn("pct", F.round("pct", 6))


_FIXED = {"gpg": 0.76, "five_gpg": 0.0, "hgpg": 0.06, "tgpg": 0.0, "otga": 0.04,
          "hppg_otshga": 0.08, "is_home": 0.06}


def _fixed_sql():
    from bindings.base import score_sql

    return f"""WITH {CAND}, scored_rows AS (SELECT *, {score_sql(_FIXED)} AS stat FROM cand), picks AS (
  SELECT * FROM scored_rows WHERE tims BETWEEN 1 AND 3
  QUALIFY row_number() OVER (PARTITION BY date, tims ORDER BY stat DESC, {ORDER_SQL}) = 1) {_ACCURACY}"""


@query("a5_replay_fixed_weights", _fixed_sql())
def a5(spark, sf_dir):
    report = picks.accuracy(all_picks(spark, sf_dir, _FIXED, ["scored"]))
    return report.withColumn("pct", F.round("pct", 6))


@query("a6_running_metric", f"""WITH {HISTORY_SQL}, {OUTCOMES_SQL}, {FILLED_SQL},
day AS (SELECT max(date) AS date, count(*) AS n, count(*) FILTER (WHERE Scored = 1) AS hits FROM filled
  WHERE date = DATE '2001-05-30'),
prior AS (SELECT count(*) FILTER (WHERE Scored = 1) AS correct, count(*) AS total FROM hist WHERE date < DATE '2001-05-30')
SELECT {DATE_SQL}, CAST(printf('%.2f', (correct + hits) / (total + 3) * 100) AS DOUBLE) AS value, correct + hits AS correct, total + 3 AS total
FROM day, prior WHERE n = 3""")
def a6(spark, sf_dir):
    past = pick_history(spark, sf_dir)
    filled = history.fill_outcomes(past, outcome_table(spark, sf_dir), TODAY)
    day = F.lit("2001-05-30").cast("date")
    metric = past.where(F.col("date") < day).agg(
        F.max("date").alias("date"), F.count(F.when(F.col("Scored") == 1, 1)).alias("correct"),
        F.count("*").alias("total"))
    return history.running_metric(history.picks_of(filled, day), metric).select(
        iso(), "value", "correct", "total")


@query("a7_label_summary", f"""WITH {CAND} SELECT scored, count(*) AS rows,
  round((SELECT avg(scored) FROM cand), 6) AS mean FROM cand GROUP BY scored""")
def a7(spark, sf_dir):
    return scoring.label_summary(candidates(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query("a8_distinct_dates", f"WITH {CAND} SELECT count(DISTINCT date) AS dates FROM cand WHERE tims > 0")
def a8(spark, sf_dir):
    return scoring.labelled_dates(candidates(spark, sf_dir))


@query("a9_distinct_start_times", """SELECT DISTINCT CAST(o_orderdate AS VARCHAR)[:10] AS date,
  strftime(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS start FROM orders""")
def a9(spark, sf_dir):
    starts = schedule.start_times(_orders_as_games(spark, sf_dir), ["date"])
    return starts.select(iso(), "start")


@query("a10_pending_dates", f"""WITH {HISTORY_SQL} SELECT DISTINCT {DATE_SQL} FROM hist
WHERE Scored IS NULL AND date < DATE '{TODAY}'""")
def a10(spark, sf_dir):
    return history.pending_dates(pick_history(spark, sf_dir), TODAY).select(iso())


def score_feed_games(spark, sf_dir, goal="l_returnflag = 'R'"):
    """Orders as finished, open or postponed games; scorers are their returned items."""
    goals = bounded_lists(
        table(spark, sf_dir, "lineitem").where(goal),
        ["l_orderkey"], ORDER[1:], F.col("l_suppkey"), "goals")
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(goals, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderkey").alias("game_id"),
        F.when(F.col("o_orderstatus") == "P", "PPD").otherwise("OK").alias("state"),
        F.when((F.col("o_orderstatus") != "O") | (F.col("o_orderkey") % 3 != 0), "REG").alias(
            "outcome"),
        (F.col("o_custkey") % 25).alias("home_abbr"), (F.col("o_custkey") % 7).alias("away_abbr"),
        "goals")


FINAL_SQL = """final AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderkey AS game_id, l_suppkey AS player_id
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_orderstatus <> 'P'
  AND (o_orderstatus <> 'O' OR o_orderkey % 3 <> 0))"""


@query("a11_scorers_per_date", f"""WITH {FINAL_SQL} SELECT {DATE_SQL},
  row_number() OVER (PARTITION BY date ORDER BY game_id, player_id) - 1 AS place, player_id FROM final""")
def a11(spark, sf_dir):
    routed = backfill.classify_games(score_feed_games(spark, sf_dir))
    return backfill.scorer_lists(backfill.scorers(routed)).select(iso(), "place", "player_id")


def event_goals(spark, sf_dir):
    """Events as goals: the game is the user, the scorer a group of event ids."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").where(F.col("event_type") != "error").select(
        F.col("user_id").alias("game_id"), F.struct("ts", "event_id").alias("pos"),
        F.concat(F.lit("P"), (n % 9).cast("string")).alias("name"),
        F.concat(F.lit("U"), ((n * 5 + F.col("user_id")) % 2).cast("string")).alias("team_abbr"),
        F.concat(F.lit("First P"), (n % 9).cast("string")).alias("full_name"),
        (n % 3600).alias("time"))


GOALS_SQL = """goals AS (SELECT user_id AS game_id, ts, event_id, 'P' || event_id % 9 AS name,
  'U' || (event_id * 5 + user_id) % 2 AS team_abbr, event_id % 3600 AS time FROM events WHERE event_type <> 'error'),
per_scorer AS (SELECT game_id, name, count(*) AS goal, arg_min(time, ROW(ts, event_id)) AS time,
  arg_min(team_abbr, ROW(ts, event_id)) AS team_abbr, min(ROW(ts, event_id)) AS pos FROM goals GROUP BY 1, 2)"""


@query("a12_goals_per_scorer", f"WITH {GOALS_SQL} SELECT game_id, name, goal, time, team_abbr FROM per_scorer")
def a12(spark, sf_dir):
    return live.goals_per_scorer(event_goals(spark, sf_dir)).select(
        "game_id", "name", "goal", "time", "team_abbr")


@query("a13_scorers_by_team", f"""WITH {GOALS_SQL} SELECT game_id, team_abbr,
  row_number() OVER (PARTITION BY game_id, team_abbr ORDER BY pos, name) - 1 AS place, name, goal, time FROM per_scorer""")
def a13(spark, sf_dir):
    found = live.goals_per_scorer(event_goals(spark, sf_dir))
    return live.scorers_by_team(found).select(
        "game_id", "team_abbr", "place", "name", "goal", "time")


@query("a14_bet_totals", """SELECT count(*) AS bets, round(sum(bet), 4) AS total_bet, round(sum(payout), 4) AS total_payout
FROM (SELECT l_tax * 100 AS bet, l_tax * 100 + l_tax * 100 * (l_quantity * 10 - 250) / 100 AS payout
  FROM lineitem WHERE l_tax > 0.05)""")
def a14(spark, sf_dir):
    from tierpick.functions.odds import payout

    rows = table(spark, sf_dir, "lineitem").where(F.col("l_tax") > 0.05).withColumn(
        "bet", F.col("l_tax") * 100)
    paid = rows.withColumn("payout", payout(F.col("bet"), F.col("l_quantity") * 10 - 250))
    sums = bets.totals(paid)
    n = rows.agg(F.count("*")).scalar()
    return sums.select(
        n.alias("bets"), F.round("total_bet", 4).alias("total_bet"),
        F.round("total_payout", 4).alias("total_payout"))


@query("a15_names_by_team", """SELECT s_nationkey AS team_name, s_name AS name,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier WHERE s_acctbal > 1000""")
def a15(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 1000).select(
        "s_suppkey", F.col("s_nationkey").alias("team_name"), F.col("s_name").alias("name"))
    return bets.names_by_team(rows, ["s_suppkey"])


_BEST = ", ".join(f"round(CAST(w{i} AS DOUBLE), 6) AS {w}" for i, w in enumerate(WEIGHTED))


def _best_sql(direction):
    return f"""WITH {search_sql(3)} SELECT {_BEST}, correct,
  (SELECT count(*) FROM (SELECT DISTINCT date, tims FROM known)) AS picks,
  (SELECT count(DISTINCT date) * 3 FROM known) AS slots
FROM results JOIN grid ON results.wid = grid.wid ORDER BY correct DESC, results.wid {direction} LIMIT 1"""


def _found(spark, sf_dir, tie):
    best = search.search(trial_candidates(spark, sf_dir), 3, ORDER, tie)
    return best.select(*[six(w) for w in WEIGHTED], "correct", "picks", "slots")


@query("a16_best_weights", _best_sql("ASC"))
def a16(spark, sf_dir):
    return _found(spark, sf_dir, "first")


@query("a16_best_weights_last", _best_sql("DESC"))
def a16_last(spark, sf_dir):
    return _found(spark, sf_dir, "last")


@query("a17_team_rosters", """SELECT n_nationkey AS team_id, n_name AS team_name, n_regionkey % 2 = 0 AS home,
  row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS place, c_custkey AS id, c_name AS name
FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def a17(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team_name"),
        (F.col("n_regionkey") % 2 == 0).alias("home"))
    players = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("team_id"), F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"))
    rosters = placed(players, ["team_id"], ["id"])
    return nation.join(rosters, "team_id").select(
        "team_id", "team_name", "home", "place", "id", "name")


_BOUND_SQL = ", ".join(
    f"round(CAST({f}({x}) AS DOUBLE), 4) AS {f}_{x}" for f in ("min", "max") for x in BOUNDS)


@query("a18_fit_bounds", f"WITH {CAND} SELECT {_BOUND_SQL} FROM cand".replace(
    "(gpg)", "(CAST(gpg AS FLOAT))").replace("(hgpg)", "(CAST(hgpg AS FLOAT))").replace(
    "(five_gpg)", "(CAST(five_gpg AS FLOAT))").replace("(tgpg)", "(CAST(tgpg AS FLOAT))").replace(
    "(otga)", "(CAST(otga AS FLOAT))").replace("(otshga)", "(CAST(otshga AS FLOAT))").replace(
    "(hppg)", "(CAST(hppg AS FLOAT))"))
def a18(spark, sf_dir):
    fitted = scoring.fit_bounds(candidates(spark, sf_dir))
    return fitted.select(*[F.round(F.col(c).cast("double"), 4).alias(c) for c in fitted.columns])


_LO_HI = ", ".join(
    f"CAST({f}({x}) AS FLOAT) AS {f}_{x}" for f in ("min", "max") for x in BOUNDS)


def _fitted_sql():
    unit = "((CAST({x} AS FLOAT) - min_{x}) / (max_{x} - min_{x}))"
    parts = []
    from tierpick.config import WEIGHTS

    for w in WEIGHTED:
        if w == "hppg_otshga":
            value = f"({unit.format(x='hppg')} * {unit.format(x='otshga')})"
        elif w == "is_home":
            value = "CAST(CASE WHEN home THEN 1 ELSE 0 END AS FLOAT)"
        else:
            value = unit.format(x=w)
        parts.append(f"{value} * CAST({WEIGHTS[w]} AS FLOAT)")
    return f"""WITH {CAND}, fit AS (SELECT {_LO_HI} FROM cand)
SELECT {ORDER_SQL}, round(CAST({' + '.join(parts)} AS DOUBLE), 6) AS stat FROM cand, fit"""


@query("a18_predict_fitted_bounds", _fitted_sql())
def a18_predict(spark, sf_dir):
    df = candidates(spark, sf_dir)
    return scoring.predict(df, scoring.fit_bounds(df)).select(*ORDER, six("stat"))


@query("a19_grid_sums_to_one", f"""WITH {search_sql(4)}
SELECT CAST(count(*) AS BIGINT) AS vectors, bool_and(abs(w0 + w1 + w2 + w3 + w4 + w5 + w6 - 1) < 0.000001) AS complete,
  (SELECT count(*) FROM known) AS candidates FROM grid""")
def a19(spark, sf_dir):
    checked = grid.grid_check(grid.weight_grid(spark, 4))
    n = trial_candidates(spark, sf_dir).agg(F.count("*")).scalar()
    return checked.select(
        "vectors", (F.col("worst") < 0.000001).alias("complete"), n.alias("candidates"))


# The mean score of a vector is the weighted sum of the mean features, so the
# grid meets one row per tier instead of every candidate.
_MEANS = ", ".join(f"round(avg(CAST(f{i} AS DOUBLE)), 9) AS m{i}" for i in range(7))


_G1_SQL = f"""WITH {search_sql(6)}, means AS (SELECT tims, {_MEANS} FROM known GROUP BY tims)
SELECT tims, {', '.join(f'CAST(k{i} AS INTEGER) AS k{i}' for i in range(6))},
  round({' + '.join(f'CAST(w{i} AS DOUBLE) * m{i}' for i in range(7))}, 6) AS mean_stat
FROM (SELECT *, {', '.join(f'CAST(round(w{i} * 6) AS INTEGER) AS k{i}' for i in range(6))} FROM grid), means"""


@query("g1_grid_mean_scores", _G1_SQL)
def g1(spark, sf_dir):
    known = trial_candidates(spark, sf_dir)
    means = known.groupBy("tims").agg(
        *[F.round(F.avg(F.col(w).cast("double")), 9).alias(f"m_{w}") for w in WEIGHTED])
    # Three rows, one per tier, held in each vector's row as an array.
    tiers = means.agg(F.collect_list(F.struct("*"))).scalar()
    vectors = grid.weight_grid(spark, 6).withColumn("_tiers", tiers)
    flat = vectors.select("*", F.inline("_tiers"))
    total = None
    for w in WEIGHTED:
        term = F.col(w).cast("double") * F.col(f"m_{w}")
        total = term if total is None else total + term
    return flat.select("tims", *[f"k{i}" for i in range(6)], F.round(total, 6).alias("mean_stat"))


@query("d3_grid_in_sql", _G1_SQL)
def d3(spark, sf_dir):
    """The grid called from SQL text, with the mean features of three tiers."""
    sql.register(spark)
    means = ", ".join(f"round(avg(CAST({w} AS DOUBLE)), 9) AS m_{w}" for w in WEIGHTED)
    total = " + ".join(f"CAST({w} AS DOUBLE) * m_{w}" for w in WEIGHTED)
    return spark.sql(
        f"""WITH means AS (SELECT tims, {means} FROM {{known}} GROUP BY tims),
        tiers AS (SELECT collect_list(struct(*)) AS list FROM means),
        flat AS (SELECT *, inline((SELECT list FROM tiers)) FROM weight_grid(6))
        SELECT tims, k0, k1, k2, k3, k4, k5, round({total}, 6) AS mean_stat FROM flat""",
        known=trial_candidates(spark, sf_dir))


@query("g2_grid_place_of_best", f"""WITH {search_sql(4)}
SELECT results.wid, correct, {_BEST} FROM results JOIN grid ON results.wid = grid.wid
WHERE correct = (SELECT max(correct) FROM results)""")
def g2(spark, sf_dir):
    results = search.evaluate_grid(trial_candidates(spark, sf_dir), 4, ORDER)
    top = results.agg(F.max("correct")).scalar()
    best = search.with_weights(results.where(F.col("correct") == top), 4)
    return best.select("wid", "correct", *[six(w) for w in WEIGHTED])


@query("g3_coarse_step_grid", f"""WITH {search_sql(2)}
SELECT count(*) AS vectors, min(correct) AS worst, max(correct) AS best FROM results""")
def g3(spark, sf_dir):
    results = search.evaluate_grid(
        trial_candidates(spark, sf_dir), grid.steps_of(50), ORDER, step=0.5)
    return results.agg(
        F.count("*").alias("vectors"), F.min("correct").alias("worst"),
        F.max("correct").alias("best"))
