"""Live board: goals per scorer, changes of the score, overview lines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tierpick.config import LIVE_STATES, RECENT_GOAL_SECONDS
from tierpick.functions.clock import goal_period
from tierpick.functions.text import scorer_text
from tierpick.operators.skew import placed


def live_only(games: DataFrame) -> DataFrame:
    return games.where(F.col("status").isin(*LIVE_STATES))


def goals_per_scorer(goals: DataFrame) -> DataFrame:
    """Goals of each name in a game; time, team and full name of its first goal.

    ``goals`` has game_id, pos (place of the goal in the feed), name,
    team_abbr, full_name, time.
    """
    first = F.min_by(F.struct("time", "team_abbr", "full_name", "pos"), "pos").alias("_first")
    counted = goals.groupBy("game_id", "name").agg(F.count("*").alias("goal"), first)
    return counted.select("game_id", "name", "goal", "_first.*")


def scorers_by_team(scorers: DataFrame) -> DataFrame:
    """Scorers of a (game, team), numbered in the order of their first goals."""
    return placed(scorers, ["game_id", "team_abbr"], ["pos", "name"]).select(
        "game_id", "team_abbr", "place", "name", "time", "goal", "full_name")


def watch_flag(scorers: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Add ``watched``: the full name is on the list of the scorer's team."""
    listed = watchlist.select("team_name", "full_name").distinct().withColumn("_w", F.lit(True))
    joined = scorers.join(listed, ["team_name", "full_name"], "left")
    return joined.select(*scorers.columns, F.col("_w").isNotNull().alias("watched"))


def scorer_class(game_time: Column, period: Column, intermission: Column, status: Column,
                 goal_time: Column, watched: Column) -> Column:
    """watched, recent (a goal of the last minute of play) or plain."""
    recent = (
        ((game_time - goal_time) < RECENT_GOAL_SECONDS)
        & (period == goal_period(goal_time))
        & ~intermission
        & status.isin("LIVE", "CRIT")
    )
    return F.when(watched, "watched").when(recent, "recent").otherwise("plain")


def board_scorers(games: DataFrame, scorers: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Scorers of both teams of each live game with class and text.

    A game gives a row for each side and scorer; a side without any keeps one
    row with null.
    """
    sides = live_only(games).select(
        "game_id", "status", "period", "is_intermission", "time_passed",
        F.explode(F.array(
            F.struct(F.lit("home").alias("side"), F.col("home_abbr").alias("team_abbr"),
                     F.col("home_team").alias("team_name")),
            F.struct(F.lit("away").alias("side"), F.col("away_abbr").alias("team_abbr"),
                     F.col("away_team").alias("team_name")),
        )).alias("_s"),
    ).select("*", "_s.*").drop("_s")
    joined = sides.join(scorers, ["game_id", "team_abbr"], "left")
    flagged = watch_flag(joined, watchlist)
    shown = scorer_class(
        F.col("time_passed"), F.col("period"), F.col("is_intermission"), F.col("status"),
        F.col("time"), F.col("watched"),
    )
    return flagged.select(
        "game_id", "side", "team_abbr", "team_name", "name", "full_name", "goal", "time", "pos",
        F.when(F.col("name").isNotNull(), shown).alias("shown"),
        F.when(F.col("name").isNotNull(), scorer_text(F.col("name"), F.col("goal"))).alias("text"),
    )


def overview(games: DataFrame, board: DataFrame) -> DataFrame:
    """Header, score and scorer lines of each live game, and whether a goal is recent.

    The text of a side names the scorers of one game.
    """
    named = F.sort_array(F.collect_list(F.struct("pos", "name", "text")))
    lines = board.where(F.col("name").isNotNull()).groupBy("game_id", "side").agg(
        F.transform(named, lambda s: s["text"]).alias("texts"))
    per_game = lines.groupBy("game_id").agg(
        F.max(F.when(F.col("side") == "home", F.array_join("texts", ", "))).alias("home_text"),
        F.max(F.when(F.col("side") == "away", F.array_join("texts", ", "))).alias("away_text"),
    )
    recent = board.groupBy("game_id").agg(
        F.max(F.coalesce(F.col("shown") == "recent", F.lit(False))).alias("has_recent")
    )
    joined = live_only(games).join(per_game, "game_id", "left").join(recent, "game_id", "left")
    match = F.concat_ws(" @ ", "home_team", "away_team")
    state = F.when(F.col("is_intermission"), "Intermission").otherwise("Period")
    header = F.when(F.col("status") == "FINAL", F.concat_ws(" | ", F.lit("FINAL"), match)).otherwise(
        F.concat_ws(
            " | ", F.concat_ws(" ", state, F.col("period").cast("string")),
            F.col("period_time_remaining"), match,
        )
    )

    def side_line(side):
        text = F.coalesce(F.col(f"{side}_text"), F.lit(""))
        return F.concat(F.lit("  "), F.col(f"{side}_abbr"), F.lit(": "), text)

    return joined.select(
        "game_id",
        F.concat_ws(
            "\n", header,
            F.concat_ws(" - ", F.col("home_score").cast("string"), F.col("away_score").cast("string")),
            side_line("home"), side_line("away"),
        ).alias("text"),
        F.coalesce("has_recent", F.lit(False)).alias("has_recent"),
    )


def changes(snapshots: DataFrame, key: str, time: list[str], values: list[str],
            span: Column) -> DataFrame:
    """Snapshots that are the first of their key or differ from the one before.

    ``span`` numbers slices of time. Each row is compared inside its (key,
    span) slice; the first row of a slice is compared with the last row of the
    key's slice before, so a busy key is spread over many tasks.
    """
    state = F.struct(*values)
    cut = snapshots.withColumn("_span", span)
    ends = cut.groupBy(key, "_span").agg(F.max_by(state, F.struct(*time)).alias("_end"))
    # One row per key and slice.
    over_spans = Window.partitionBy(key).orderBy("_span")
    before = ends.select(
        F.col(key).alias("_key"), F.col("_span").alias("_slice"),
        F.lag("_end").over(over_spans).alias("_carried")
    )
    inside = Window.partitionBy(key, "_span").orderBy(*time)
    # Null keys and slices are values like others.
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_slice"))
    joined = cut.withColumn("_inside", F.lag(state).over(inside)).join(before, same)
    previous = F.coalesce("_inside", "_carried")
    return joined.where(previous.isNull() | ~previous.eqNullSafe(state)).select(*snapshots.columns)
