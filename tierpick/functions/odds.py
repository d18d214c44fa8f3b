"""American odds, bet size and payout."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierpick.functions.numbers import round_exact


def implied_percent(odds: Column) -> Column:
    """Probability in percent that the odds stand for; null for 0 or no odds."""
    value = odds.cast("int")
    size = F.abs(value)
    return F.when(value < 0, size / (size + 100) * 100).when(
        value > 0, F.lit(100) / (size + 100) * 100
    )


def decimal_odds(odds: Column) -> Column:
    value = odds.cast("int")
    return F.when(value >= 0, value / 100 + 1).otherwise(
        F.try_divide(F.lit(100), F.abs(value)) + 1
    )


def bet_size(stat: Column, percent: Column, odds: Column, bankroll: float) -> Column:
    """Kelly stake between 0 and the bankroll, to the cent.

    No score, no price or a value of 0 gives no bet.
    """
    edge = stat - percent / 100
    share = F.try_divide(edge, decimal_odds(odds) - 1)
    stake = F.least(F.greatest(F.lit(0.0), share * bankroll), F.lit(float(bankroll)))
    priced = (F.coalesce(stat, F.lit(0.0)) != 0) & (F.coalesce(percent, F.lit(0.0)) != 0)
    return F.when(priced, round_exact(stake, 2)).otherwise(0.0)


def payout(bet: Column, odds: Column, corrected: bool = False) -> Column:
    """Return of a won bet.

    The default adds bet * odds / 100 for either sign, as the ledger has it;
    ``corrected`` uses the decimal odds, which differ for negative odds.
    """
    if corrected:
        return bet * decimal_odds(odds)
    return bet + bet * odds.cast("double") / 100
