"""Pick history: retention, late outcomes, appending, running metric."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierpick.config import METRIC_ID, RETENTION_DAYS, TIERS
from tierpick.functions.numbers import round_exact


def _as_date(day) -> Column:
    return day if isinstance(day, Column) else F.lit(day).cast("date")


def cutoff_date(history: DataFrame, keep: int) -> DataFrame:
    """One row: the oldest of the ``keep`` latest dates."""
    # `keep` rows at most reach the last step.
    latest = history.select("date").distinct().orderBy(F.desc("date")).limit(keep)
    return latest.agg(F.min("date").alias("date"))


def retain(history: DataFrame, keep: int = RETENTION_DAYS - 1, picks: DataFrame | None = None
           ) -> DataFrame:
    """Rows of the latest ``keep`` dates; all rows while ``picks`` is empty."""
    recent = F.col("date") >= cutoff_date(history, keep).scalar()
    if picks is None:
        return history.where(recent)
    none_new = picks.limit(1).agg(F.count("*") == 0).scalar()
    return history.where(none_new | recent)


def new_picks(picks: DataFrame, history: DataFrame) -> DataFrame:
    """Picks of dates the history does not have yet."""
    return picks.join(history.select("date").distinct(), "date", "left_anti")


def pending_dates(history: DataFrame, today) -> DataFrame:
    """Past dates with at least one unknown outcome."""
    return (
        history.where(F.col("Scored").isNull() & (F.col("date") < _as_date(today)))
        .select("date").distinct()
    )


def fill_outcomes(history: DataFrame, outcomes: DataFrame, today) -> DataFrame:
    """Outcomes of pending dates, matched by (date, player_id); others stay as they are.

    ``outcomes`` has date, id, scored, one row per (date, id). Only its pending
    dates and the players of the history are read on.
    """
    pending = pending_dates(history, today)
    wanted = history.join(pending, "date", "left_semi").select(
        "date", F.col("player_id").alias("id")
    )
    found = (
        outcomes.where(F.col("scored").isNotNull())
        .join(wanted, ["date", "id"], "left_semi")
        .groupBy("date", "id").agg(F.max(F.col("scored").cast("int")).alias("_outcome"))
        .withColumnRenamed("id", "player_id")
    )
    joined = history.join(found, ["date", "player_id"], "left")
    return joined.select(
        *[c for c in history.columns if c != "Scored"],
        F.coalesce("_outcome", "Scored").alias("Scored"),
    )


def append_picks(history: DataFrame, picks: DataFrame) -> DataFrame:
    return history.unionByName(picks, allowMissingColumns=True)


def update_history(history: DataFrame, picks: DataFrame, outcomes: DataFrame, today,
                   keep: int = RETENTION_DAYS - 1) -> DataFrame:
    """Drop the oldest dates, fill late outcomes, append the new picks."""
    added = new_picks(picks, history)
    kept = retain(history, keep, added)
    return append_picks(fill_outcomes(kept, outcomes, today), added)


def picks_of(history: DataFrame, day) -> DataFrame:
    return history.where(F.col("date") == _as_date(day))


def running_metric(yesterday: DataFrame, metric: DataFrame) -> DataFrame:
    """Metric after yesterday's picks; no row unless there are exactly three.

    Without a metric so far the figures are null. A metric that already has
    the date is returned as it is, so a repeated run does not count twice.
    """
    day = yesterday.agg(
        F.max("date").alias("date"),
        F.count("*").alias("_picks"),
        F.count(F.when(F.col("Scored") == 1, 1)).alias("_hits"),
    ).where(F.col("_picks") == len(TIERS))
    # The metric is one row.
    last = metric.agg(F.max_by(F.struct("date", "correct", "total"), F.struct("date"))).scalar()
    again = F.coalesce(last.getField("date") >= F.col("date"), F.lit(False))
    correct = last.getField("correct") + F.when(again, 0).otherwise(F.col("_hits"))
    total = last.getField("total") + F.when(again, 0).otherwise(len(TIERS))
    return day.select(
        F.lit(METRIC_ID).alias("id"),
        "date",
        round_exact(F.try_divide(correct, total) * 100, 2).alias("value"),
        correct.alias("correct"),
        total.alias("total"),
    )


def metric_values(metric: DataFrame) -> DataFrame:
    """The current metric with 0 for missing figures."""
    return metric.where(F.col("id") == METRIC_ID).select(
        F.coalesce("value", F.lit(0.0)).alias("value"),
        F.coalesce("correct", F.lit(0)).alias("correct"),
        F.coalesce("total", F.lit(0)).alias("total"),
    )
