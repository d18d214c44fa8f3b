"""Value bets against market odds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierpick.config import BANKROLL, IGNORED_NAMES, MINIMUM_BET
from tierpick.functions.odds import bet_size, implied_percent, payout
from tierpick.functions.text import fixed
from tierpick.operators.skew import placed


def price(players: DataFrame, bankroll: float = BANKROLL, corrected: bool = False) -> DataFrame:
    """Add market percentage, stake and payout to players with ``stat`` and ``odds``."""
    priced = players.withColumn("percent_odds", implied_percent(F.col("odds")))
    priced = priced.withColumn(
        "bet", bet_size(F.col("stat"), F.col("percent_odds"), F.col("odds"), bankroll)
    )
    return priced.withColumn("payout", payout(F.col("bet"), F.col("odds"), corrected))


def worth_betting(priced: DataFrame, minimum: float = MINIMUM_BET) -> DataFrame:
    return priced.where(F.col("bet") > minimum)


def not_ignored(players: DataFrame, names=IGNORED_NAMES) -> DataFrame:
    return players.where(~F.col("name").isin(*names))


def totals(bets: DataFrame) -> DataFrame:
    return bets.agg(
        F.coalesce(F.sum("bet"), F.lit(0.0)).alias("total_bet"),
        F.coalesce(F.sum("payout"), F.lit(0.0)).alias("total_payout"),
    )


def names_by_team(bets: DataFrame, order: list[str]) -> DataFrame:
    """Names per team, numbered in input order."""
    return placed(bets, ["team_name"], order).select("team_name", "place", "name")


def ledger_rows(bets: DataFrame, today) -> DataFrame:
    """Bets in the ledger's columns and text formats."""
    scored = F.col("scored").cast("string") if "scored" in bets.columns else F.lit(None)
    return bets.select(
        F.lit(str(today)).alias("Date"),
        F.col("name").alias("Name"),
        F.col("team_name").alias("Team"),
        fixed(F.col("stat") * 100, 2).alias("My Probability"),
        fixed(F.col("percent_odds"), 2).alias("DraftKings Probability"),
        F.col("odds").cast("string").alias("DraftKings Odds"),
        fixed(F.col("bet"), 2).alias("Bet Size"),
        fixed(F.col("payout"), 2).alias("Payout Amount"),
        F.coalesce(scored, F.lit("")).alias("Scored"),
    )


def last_booked(ledger: DataFrame) -> DataFrame:
    """One row: the last date in the ledger, null for an empty one."""
    return ledger.agg(F.max("Date").alias("Date"))


def unbooked(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows of dates that are not booked yet."""
    return rows.join(ledger.select("Date").distinct(), "Date", "left_anti")
