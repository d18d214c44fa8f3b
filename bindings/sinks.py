"""Sinks: each writes to a folder of its run and returns what is read back."""

from pyspark.sql import functions as F

from bindings.base import (
    BOUNDS, CAND, ORDER, ORDER_SQL, SCORED, STAT_SQL, TODAY, YESTERDAY, candidates, iso, query, six,
    table,
)
from bindings.functions import _BET, _ODDS, _PCT, _STAT, _american
from bindings.joins import HISTORY_SQL, pick_history
from bindings.windows import _ALL
from tierpick.operators import backfill, bets, scoring
from tierpick.session import run_dir
from tierpick.sources import tables


@query("k1_replace_table", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def k1(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = run_dir(spark, "replace")
    tables.replace_table(orders, path)
    tables.replace_table(orders.where("o_orderstatus = 'F'").drop("o_orderstatus"), path)
    return tables.read_table(spark, path)


@query("k1_replace_by_nothing", "SELECT count(*) - count(*) AS rows FROM orders")
def k1_none(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    path = run_dir(spark, "replace")
    tables.replace_table(orders, path)
    tables.replace_table(orders.where("o_orderkey < 0"), path)
    return tables.read_table(spark, path).agg(F.count("*").alias("rows"))


@query("k2_publish_board", f"""WITH {SCORED} SELECT row_number() OVER (ORDER BY {', '.join(_ALL)}) AS id,
  id AS player_id, '{TODAY}' AS date, {ORDER_SQL}, {STAT_SQL} FROM scored_rows""")
def k2(spark, sf_dir):
    players = scoring.predict(candidates(spark, sf_dir), BOUNDS)
    # The board's own date replaces the candidate date, which is part of the order here.
    order = ["shipped" if c == "date" else c for c in _ALL]
    path = run_dir(spark, "board")
    tables.publish_board(
        players.withColumn("shipped", F.col("date")).withColumnRenamed("id", "player_id"),
        TODAY, order, path)
    board = tables.read_board(spark, path)
    assert not {"home", "hppg", "otshga"} & set(board.columns)
    return board.select("id", "player_id", iso(), *ORDER, six("stat"))


@query("k3_publish_history", f"""WITH {HISTORY_SQL} SELECT row_number() OVER (ORDER BY date, tims) AS id,
  CAST(date AS VARCHAR) AS date, player_id, tims, CAST(Scored AS VARCHAR) AS Scored FROM hist""")
def k3(spark, sf_dir):
    path = run_dir(spark, "history")
    rows = tables.history_rows(pick_history(spark, sf_dir), ["date", "tims"])
    tables.write_version(rows, path, TODAY)
    back = tables.read_version(
        spark, path, "id bigint, date date, player_id bigint, tims int, Scored int")
    return back.select(
        "id", iso(), "player_id", "tims", F.col("Scored").cast("string").alias("Scored"))


@query("k4_write_metric", "SELECT 'current_pick_accuracy' AS id, count(*) AS total FROM orders")
def k4(spark, sf_dir):
    metric = table(spark, sf_dir, "orders").agg(F.count("*").alias("total")).select(
        F.lit("current_pick_accuracy").alias("id"), F.lit(TODAY).cast("date").alias("date"),
        F.lit(1.0).alias("value"), F.lit(1).cast("bigint").alias("correct"), "total")
    path = run_dir(spark, "metric")
    tables.write_metric(metric, path)
    tables.write_metric(metric.where("total < 0"), path)  # nothing new: stays
    return tables.read_metric(spark, path).select("id", "total")


@query("k5_csv_export", f"WITH {CAND} SELECT name, CAST(scored AS VARCHAR) AS scored, CAST(tims AS VARCHAR) AS tims FROM cand")
def k5(spark, sf_dir):
    path = run_dir(spark, "export")
    tables.write_csv(candidates(spark, sf_dir).select("name", "scored", "tims"), path)
    return spark.read.option("header", True).csv(path)


@query("k6_append_ledger", f"""WITH priced AS (SELECT *, {_STAT} AS stat, {_PCT} AS pct, {_ODDS} AS odds,
    CAST(printf('%.2f', {_BET}) AS DOUBLE) AS bet FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT '{TODAY}' AS "Date", s_name AS "Name", '' || s_nationkey AS "Team",
  printf('%.2f', stat * 100) AS "My Probability", printf('%.2f', pct) AS "DraftKings Probability",
  CASE WHEN odds > 0 THEN '+' ELSE '' END || odds AS "DraftKings Odds",
  printf('%.2f', bet) AS "Bet Size", printf('%.2f', bet + bet * odds / 100) AS "Payout Amount",
  CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS "Scored"
FROM priced WHERE bet > 0.1""")
def k6(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    ).select(
        F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("team_name"),
        (F.col("l_tax") * 10).alias("stat"), _american().alias("odds"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("scored"))
    booked = bets.ledger_rows(bets.worth_betting(bets.price(rows)), TODAY)
    path = run_dir(spark, "ledger")
    tables.append_ledger(booked, spark.createDataFrame([], "Date string"), path)
    # The same day again adds nothing.
    schema = ", ".join(f"`{c}` string" for c in booked.columns)
    ledger = spark.read.schema(schema).option("header", True).csv(path)
    tables.append_ledger(booked, ledger, path)
    whole = spark.read.schema(schema).option("header", True).csv(path)
    return whole


def _monthly(spark, sf_dir):
    """Candidates by month, the archive's dates; a fifth has no outcome yet."""
    return candidates(spark, sf_dir).select(
        F.trunc("date", "month").alias("date"), "id", "tims", "gpg",
        F.col("team_id").cast("string").alias("team_abbr"),
        F.when(F.month("date") != 3, F.col("scored")).alias("scored"))


_MONTHLY = f"""{CAND}, monthly AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, id, tims, gpg,
  '' || team_id AS team_abbr, CASE WHEN month(date) <> 3 THEN scored END AS scored FROM cand)"""
_PER_MONTH = "CAST(date AS VARCHAR) AS date, count(*) AS rows, count(scored) AS known, CAST(coalesce(sum(scored), 0) AS BIGINT) AS hits"


def _per_month(archive):
    return archive.groupBy("date").agg(
        F.count("*").alias("rows"), F.count("scored").alias("known"),
        F.coalesce(F.sum("scored"), F.lit(0)).alias("hits")).select(iso(), "rows", "known", "hits")


@query("k7_archive", f"WITH {_MONTHLY} SELECT {_PER_MONTH} FROM monthly GROUP BY date")
def k7(spark, sf_dir):
    rows, path = _monthly(spark, sf_dir), run_dir(spark, "archive")
    tables.archive(rows, path)
    tables.archive(rows.where(F.year("date") == 1998), path)  # repeated dates replace themselves
    return _per_month(tables.read_archive(spark, path))


_HITS = """hits AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, l_suppkey AS id FROM orders
  JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 48)"""


@query("k8_label_backfill", f"""WITH {_MONTHLY}, {_HITS} SELECT {_PER_MONTH} FROM (
  SELECT monthly.date, CASE WHEN month(monthly.date) = 3 THEN CASE WHEN hits.id IS NULL THEN 0 ELSE 1 END ELSE scored END AS scored
  FROM monthly LEFT JOIN hits ON monthly.date = hits.date AND monthly.id = hits.id) GROUP BY date""")
def k8(spark, sf_dir):
    path = run_dir(spark, "archive")
    tables.archive(_monthly(spark, sf_dir), path)
    archive = tables.read_archive(spark, path)
    dates = backfill.past_dates(backfill.dates_without_outcome(archive), YESTERDAY)
    found = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "lineitem").where("l_quantity > 48"),
        F.col("o_orderkey") == F.col("l_orderkey")
    ).select(F.trunc("o_orderdate", "month").alias("date"), F.col("l_suppkey").alias("player_id"))
    tables.rewrite_dates(backfill.label(archive, found, dates), dates, path)
    return _per_month(tables.read_archive(spark, path))


@query("k9_delete_postponed", f"""WITH {_MONTHLY} SELECT {_PER_MONTH} FROM monthly
WHERE NOT (date = DATE '1997-05-01' OR (year(date) = 1998 AND team_abbr IN ('3', '7', '15'))) GROUP BY date""")
def k9(spark, sf_dir):
    path = run_dir(spark, "archive")
    rows = _monthly(spark, sf_dir)
    tables.archive(rows, path)
    archive = tables.read_archive(spark, path)
    some = archive.where(F.year("date") == 1998).select(
        "date", F.explode(F.array(*[F.lit(t) for t in ("3", "7", "15")])).alias("team_abbr"))
    # All teams of one month, so that nothing is left of it.
    every = archive.where(F.col("date") == F.lit("1997-05-01").cast("date")).select(
        "date", "team_abbr")
    gone = some.unionByName(every).distinct()
    dates = gone.select("date").distinct()
    kept = backfill.without_postponed(archive.join(dates, "date", "left_semi"), gone)
    tables.rewrite_dates(kept, dates, path)
    return _per_month(tables.read_archive(spark, path))


@query("k10_dates_without_outcome", f"WITH {_MONTHLY} SELECT DISTINCT CAST(date AS VARCHAR) AS date FROM monthly WHERE scored IS NULL")
def k10(spark, sf_dir):
    path = run_dir(spark, "archive")
    tables.archive(_monthly(spark, sf_dir), path)
    return backfill.dates_without_outcome(tables.read_archive(spark, path)).select(iso())


@query("k10_rows_of_a_date", f"WITH {_MONTHLY} SELECT id, tims, gpg, team_abbr FROM monthly WHERE date = DATE '1998-08-01'")
def k10_date(spark, sf_dir):
    path = run_dir(spark, "archive")
    tables.archive(_monthly(spark, sf_dir), path)
    return tables.read_archive(spark, path, "1998-08-01").select("id", "tims", "gpg", "team_abbr")
