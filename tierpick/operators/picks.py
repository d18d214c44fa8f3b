"""Best candidate per group, pick of the day, replay and accuracy."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tierpick.config import BOUNDS, SEASON_START, TIERS, WEIGHTS
from tierpick.operators.scoring import labelled, predict


def _rank(score: str) -> Column:
    """Sort key of a score: the highest first, null and NaN last."""
    worst = F.lit(float("nan"))
    return F.coalesce(-F.col(score), worst)


def _is_number(score: str) -> Column:
    return F.col(score).isNotNull() & ~F.isnan(score)


def best_per_group(df: DataFrame, keys: list[str], score: str, order: list[str],
                   keep: list[str] | None = None) -> DataFrame:
    """Row with the highest score of each group; on a tie the first in ``order``.

    An aggregate, so each task sends one row per group into the shuffle, also
    for a group that holds most of the rows. NaN and null never win. Only the
    keys, the order, the score and the ``keep`` columns are carried (all by
    default).
    """
    carried = df.columns if keep is None else [*keys, *order, score, *keep]
    rest = [c for c in carried if c not in keys and c not in order]
    entry = F.struct(_rank(score).alias("_rank"), *order, *rest)
    best = df.groupBy(*keys).agg(F.min(entry).alias("_best")).select(*keys, "_best.*")
    columns = [c for c in df.columns if c in carried]
    return best.where(_is_number(score)).select(*columns)


def historical_picks(df: DataFrame, order: list[str], score: str = "stat",
                     keep: list[str] | None = None) -> DataFrame:
    """Best candidate of every (date, tier)."""
    tiered = df.where(F.col("tims").isin(*TIERS))
    return best_per_group(tiered, ["date", "tims"], score, order, keep)


def pick_of_day(df: DataFrame, order: list[str], score: str = "stat",
                keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Best candidate per tier with an unknown outcome yet.

    A day without all three tiers has no picks. ``pick_no`` is the order in
    which the tiers first appear. An outcome the input has is dropped.
    """
    keys = list(keys)
    tiered = df.withColumn("tims", tier_number(F.col("tims"))).where(F.col("tims").isin(*TIERS))
    dropped = (*keys, *order, "tims", "scored")
    rest = [c for c in tiered.columns if c.lower() not in dropped]
    best = tiered.groupBy(*keys, "tims").agg(
        F.min(F.struct(_rank(score).alias("_rank"), *order, *rest)).alias("_best"),
        F.min(F.struct(*order)).alias("_seen"),
    ).where(F.col(f"_best.{score}").isNotNull() & ~F.isnan(f"_best.{score}"))
    # At most one entry per tier in the list.
    days = best.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_seen", "tims", "_best"))).alias("_picks")
    ).where(F.size("_picks") == len(TIERS))
    return days.select(*keys, F.posexplode("_picks").alias("_pos", "_pick")).select(
        *keys,
        F.col("_pick.tims").alias("tims"),
        *[F.col(f"_pick._best.{c}").alias(c) for c in tiered.columns if c in (*order, *rest)
          and c not in (*keys, "tims")],
        F.lit(None).cast("int").alias("Scored"),
        (F.col("_pos") + 1).alias("pick_no"),
    )


def correctness(picks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Correct picks, picks made, and slots: three for every date with candidates."""
    hits = picks.agg(
        F.count(F.when(F.col("scored") > 0, 1)).alias("correct"), F.count("*").alias("picks")
    )
    slots = candidates.agg((F.countDistinct("date") * len(TIERS)).alias("slots")).scalar()
    return hits.withColumn("slots", slots)


def accuracy(picks: DataFrame, by: str = "tims") -> DataFrame:
    """Total, correct, wrong and percentage per tier, and overall where the tier is null."""
    hit = F.col("scored") == 1
    per_tier = picks.groupBy(by).agg(
        F.count("*").alias("total"), F.count(F.when(hit, 1)).alias("correct")
    )
    counts = per_tier.rollup(by).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"),
    )
    share = F.when(F.col("total") > 0, F.col("correct") / F.col("total") * 100).otherwise(0.0)
    return counts.select(
        by, "total", "correct", (F.col("total") - F.col("correct")).alias("wrong"),
        share.alias("pct"),
    )


def ordered_picks(picks: DataFrame, score: str = "stat") -> DataFrame:
    """Add ``rank``: position of a pick within its date by score, then tier."""
    by_score = Window.partitionBy("date").orderBy(F.col(score).desc(), "tims")
    return picks.withColumn("rank", F.row_number().over(by_score))


def replay(df: DataFrame, order: list[str], weights=WEIGHTS, bounds=BOUNDS, since=None,
           keep: list[str] | None = None) -> DataFrame:
    """Picks the given weights would have made on labelled candidates."""
    known = labelled(df)
    if since is not None:
        known = of_season(known, since)
    return historical_picks(predict(known, bounds, weights), order, keep=keep)


def of_season(df: DataFrame, since=SEASON_START) -> DataFrame:
    """Rows from the start of the season on."""
    return df.where(F.col("date") >= F.lit(since).cast("date"))


def tier_number(tims: Column) -> Column:
    """A tier told as text, as a number; null for other text."""
    return tims.cast("string").try_cast("int")

