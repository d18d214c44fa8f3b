"""Late labels: which games are done, who scored, what to remove."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierpick.operators.skew import placed


def classify_games(games: DataFrame) -> DataFrame:
    """Add ``route``: incomplete, postponed or final."""
    state = F.col("state")
    return games.withColumn(
        "route",
        F.when((state == "OK") & F.col("outcome").isNull(), "incomplete")
        .when(state == "PPD", "postponed")
        .otherwise("final"),
    )


def gate(games: DataFrame) -> DataFrame:
    """All games, or none while any of them is incomplete."""
    stop = games.agg(
        F.coalesce(F.max((F.col("route") == "incomplete").cast("int")), F.lit(0)) == 1
    ).scalar()
    return games.where(~stop)


def past_dates(dates: DataFrame, yesterday) -> DataFrame:
    """Dates up to yesterday, null dates dropped."""
    return dates.where(F.col("date").isNotNull() & (F.col("date") <= F.lit(yesterday).cast("date")))


def scorers(games: DataFrame) -> DataFrame:
    """Distinct scorers of each final game."""
    final = games.where(F.col("route") == "final")
    return (
        final.select("date", "game_id", F.explode("goals").alias("player_id"))
        .where(F.col("player_id").isNotNull()).distinct()
    )


def scorer_lists(found: DataFrame) -> DataFrame:
    """Scorers of a date, numbered game after game."""
    return placed(found, ["date"], ["game_id", "player_id"]).select("date", "place", "player_id")


def label(archive: DataFrame, found: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of the given dates with scored = 1 for scorers, else 0."""
    hits = found.select("date", F.col("player_id").alias("id")).distinct().withColumn(
        "_hit", F.lit(1)
    )
    rows = archive.join(dates.select("date").distinct(), "date", "left_semi")
    return rows.join(hits, ["date", "id"], "left").select(
        *[c for c in archive.columns if c != "scored"],
        F.coalesce("_hit", F.lit(0)).alias("scored"),
    )


def postponed_teams(games: DataFrame) -> DataFrame:
    """Both teams of each postponed game."""
    return games.where(F.col("route") == "postponed").select(
        "date", F.explode(F.array("home_abbr", "away_abbr")).alias("team_abbr")
    )


def without_postponed(archive: DataFrame, postponed: DataFrame) -> DataFrame:
    return archive.join(postponed, ["date", "team_abbr"], "left_anti")


def dates_without_outcome(archive: DataFrame) -> DataFrame:
    return archive.where(F.col("scored").isNull()).select("date").distinct()
