"""Plan of the runs of a day."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tierpick.functions.clock import cron_text, rule_name, trigger_time


def start_times(games: DataFrame, keys=()) -> DataFrame:
    return games.select(*keys, "start").distinct()


def trigger_plan(starts: DataFrame, env: str, key: str = "day", minutes: int = 5) -> DataFrame:
    """One trigger per distinct start time of a day; the last one is flagged.

    A day has no more distinct start times than seconds, so its window is small.
    """
    at = trigger_time(F.col("start"), minutes)
    planned = starts.select(key, "start").distinct().withColumn("trigger", at)
    by_time = Window.partitionBy(key).orderBy("start")
    return planned.select(
        key, "start", "trigger",
        rule_name(F.col("trigger"), env).alias("rule"),
        cron_text(F.col("trigger")).alias("cron"),
        F.lead("start").over(by_time).isNull().alias("last_game"),
    )


def run_status(board: DataFrame, today, last_game: bool = False) -> DataFrame:
    """One row: last_run, normal_run when today's board exists, else first_run."""
    todays = board.where(F.col("date") == F.lit(today).cast("date"))
    return todays.limit(1).agg(F.count("*").alias("_n")).select(
        F.when(F.lit(last_game), "last_run")
        .when(F.col("_n") > 0, "normal_run")
        .otherwise("first_run")
        .alias("status")
    )


def fresh_board(board: DataFrame, today) -> DataFrame:
    """Today's rows of the board under their player id; ``position`` is their place."""
    todays = board.where(F.col("date") == F.lit(today).cast("date"))
    return todays.withColumnRenamed("id", "position").withColumnRenamed("player_id", "id")
