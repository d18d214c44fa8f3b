"""Live board of the games under way."""

from pyspark.sql import DataFrame

from tierpick.operators import live


def live_board(games: DataFrame, goals: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Text of every live game with its scorers."""
    scorers = live.goals_per_scorer(goals)
    return live.overview(games, live.board_scorers(games, scorers, watchlist))
