"""Value bets of a day."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierpick.config import BANKROLL, MINIMUM_BET
from tierpick.operators import bets, enrich


def value_bets(board: DataFrame, odds: DataFrame, bankroll: float = BANKROLL,
               minimum: float = MINIMUM_BET, position: str = "pos",
               player_position: str = "id") -> DataFrame:
    """Players of the board whose stake at the market's odds is worth it."""
    linked = enrich.link_odds(board, odds, position, player_position)
    priced = bets.price(linked.where(F.col("odds").isNotNull()), bankroll)
    return bets.worth_betting(priced, minimum)
