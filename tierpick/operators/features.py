"""Rates per player, team and opponent, known before each game.

Over a whole log they are windows. From day to day they come from running
totals (``Totals``), one row per player and season and per team and season,
to which a day adds only its own rows.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SEASONS_BACK = 2  # the current season and the two before it
RECENT_GAMES = 5
_COUNTS = ("goals", "pp_goals", "sh_goals")


def game_log(rows: DataFrame, keys=("season", "date", "player_id", "team_id", "opponent_id"),
             counts=_COUNTS) -> DataFrame:
    """One row per player and game date.

    The windows below run on this frame: a player with very many raw rows has
    at most one row per date in it.
    """
    return rows.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in counts])


def first_year(season: Column) -> Column:
    """Year in which a season begins: of 20242025 or of 2024 it is 2024."""
    return F.substring(season.cast("string"), 1, 4).cast("int")


def _rate(total: Column, games: Column) -> Column:
    return F.coalesce(F.try_divide(total, games), F.lit(0.0))


def _to_date(*keys: str) -> Window:
    return (
        Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    )


def player_rates(log: DataFrame) -> DataFrame:
    """gpg, five_gpg, hgpg and hppg of every player before every game.

    hgpg and hppg cover the games of this season so far and all games of the
    two seasons before. One shuffle and one sort, by player.
    """
    earlier = (
        Window.partitionBy("player_id").orderBy("_year").rangeBetween(-SEASONS_BACK, -1)
    )
    # Dates rise with seasons, so all windows share one order: player, year, date.
    season = _to_date("player_id", "_year")
    by_date = Window.partitionBy("player_id").orderBy("_year", "date")
    recent = by_date.rowsBetween(-RECENT_GAMES, -1)

    def so_far(column):
        return F.coalesce(F.sum(column).over(earlier), F.lit(0)) + F.coalesce(
            F.sum(column).over(season), F.lit(0)
        )

    games_so_far = F.count("goals").over(earlier) + F.count("goals").over(season)
    # The window with the longest order comes first, so that its sort serves the others.
    rated = log.withColumn("_year", first_year(F.col("season"))).withColumn(
        "five_gpg", F.coalesce(F.avg("goals").over(recent), F.lit(0.0)))
    return rated.select(
        "*",
        _rate(F.sum("goals").over(season), F.count("goals").over(season)).alias("gpg"),
        _rate(so_far("goals"), games_so_far).alias("hgpg"),
        _rate(so_far("pp_goals"), games_so_far).alias("hppg"),
    ).drop("_year")


def team_rates(log: DataFrame, team: str, measures: dict[str, str]) -> DataFrame:
    """Season rates of a team before each of its dates; ``measures``: rate name -> column."""
    daily = log.groupBy(team, "season", "date").agg(
        *[F.sum(c).alias(f"_{c}") for c in set(measures.values())]
    )
    before = _to_date(team, "season")
    return daily.select(
        team, "season", "date",
        *[
            _rate(F.sum(f"_{c}").over(before), F.count(f"_{c}").over(before)).alias(rate)
            for rate, c in measures.items()
        ],
    )


def goals_for(log: DataFrame) -> DataFrame:
    return team_rates(log, "team_id", {"tgpg": "goals"})


def goals_against(log: DataFrame) -> DataFrame:
    """What was scored against a team: the goals of the players it met."""
    return team_rates(log, "opponent_id", {"otga": "goals", "otshga": "sh_goals"})


def feature_table(log: DataFrame) -> DataFrame:
    """All rates of a player's game; missing team figures count as 0.

    The log is read three times: hand in a table.
    """
    rated = player_rates(log)
    rated = rated.join(goals_for(log), ["team_id", "season", "date"], "left")
    rated = rated.join(goals_against(log), ["opponent_id", "season", "date"], "left")
    return rated.fillna(0.0, ["tgpg", "otga", "otshga"])


def rates_as_of(log: DataFrame, scheduled: DataFrame) -> DataFrame:
    """All rates of rostered players before games that are still to be played.

    ``scheduled`` has season, date, player_id, team_id and opponent_id, one date
    per player. Its rows join the log without counts, which the windows then
    neither add nor count; they come back with the rates as of their date. Of
    the log only the players and teams that are scheduled are read on. Many days
    in a row are cheaper from ``Totals``.
    """
    ahead = scheduled.select(
        *[F.col(c).cast(log.schema[c].dataType).alias(c) if c not in _COUNTS
          else F.lit(None).cast("long").alias(c) for c in log.columns],
        F.lit(True).alias("_ahead"))
    logged = log.withColumn("_ahead", F.lit(False))

    def with_log(key: str) -> DataFrame:
        wanted = scheduled.select(F.col(key).cast(log.schema[key].dataType).alias(key)).distinct()
        return logged.join(wanted, key, "left_semi").select(*ahead.columns).unionByName(ahead)

    made = player_rates(with_log("player_id")).where("_ahead").drop("_ahead", *_COUNTS)
    made = made.join(goals_for(with_log("team_id")), ["team_id", "season", "date"], "left")
    made = made.join(
        goals_against(with_log("opponent_id")), ["opponent_id", "season", "date"], "left")
    return made.fillna(0.0, ["tgpg", "otga", "otshga"])


class Totals(NamedTuple):
    """Running totals after some day; a season is told by its first year.

    players: player_id, year, games, goals, pp_goals; recent: player_id, date,
    goals of the last games of each player; teams: team_id, year, days, goals;
    opponents: the same of what was scored against a team, and sh_goals.
    """

    players: DataFrame
    recent: DataFrame
    teams: DataFrame
    opponents: DataFrame


_TOTAL_KEYS = {"players": ["player_id", "year"], "teams": ["team_id", "year"],
               "opponents": ["team_id", "year"]}


def _last_games(games: DataFrame) -> DataFrame:
    newest = Window.partitionBy("player_id").orderBy(F.desc("date"))
    return games.withColumn("_n", F.row_number().over(newest)).where(
        F.col("_n") <= RECENT_GAMES).drop("_n")


def _team_totals(rows: DataFrame, team: str, measures: list[str]) -> DataFrame:
    daily = rows.groupBy(F.col(team).alias("team_id"), "year", "date").agg(
        *[F.sum(c).alias(c) for c in measures])
    return daily.groupBy("team_id", "year").agg(
        F.count(measures[0]).alias("days"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in measures])


def totals_of(log: DataFrame) -> Totals:
    """Totals of all games of a log, which holds every day whole."""
    rows = log.withColumn("year", first_year(F.col("season")))
    players = rows.groupBy("player_id", "year").agg(
        F.count("goals").alias("games"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("goals", "pp_goals")])
    return Totals(
        players, _last_games(rows.select("player_id", "date", "goals")),
        _team_totals(rows, "team_id", ["goals"]),
        _team_totals(rows, "opponent_id", ["goals", "sh_goals"]))


def forward(totals: Totals, day: DataFrame) -> Totals:
    """Totals after one more day (or several), given as a log of its games only."""
    added = totals_of(day)
    out = {"recent": _last_games(totals.recent.unionByName(added.recent))}
    for name, keys in _TOTAL_KEYS.items():
        both = getattr(totals, name).unionByName(getattr(added, name))
        sums = [c for c in both.columns if c not in keys]
        out[name] = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    return Totals(**out)


def player_rates_from(totals: Totals, season: str) -> DataFrame:
    """player_id, gpg, five_gpg, hgpg and hppg after the last day of the totals."""
    year = first_year(F.lit(season))
    now = F.col("year") == year
    kept = totals.players.where(F.col("year").between(year - SEASONS_BACK, year))

    def of(column, when=None):
        return F.sum(column if when is None else F.when(when, F.col(column)))

    long = kept.groupBy("player_id").agg(
        _rate(of("goals", now), of("games", now)).alias("gpg"),
        _rate(of("goals"), of("games")).alias("hgpg"),
        _rate(of("pp_goals"), of("games")).alias("hppg"))
    last = totals.recent.groupBy("player_id").agg(
        F.coalesce(F.avg("goals"), F.lit(0.0)).alias("five_gpg"))
    rates = ["gpg", "five_gpg", "hgpg", "hppg"]
    return last.join(long, "player_id", "left").fillna(0.0, rates).select("player_id", *rates)


def team_rates_from(totals: Totals, season: str) -> DataFrame:
    """team_id, tgpg, otga and otshga after the last day of the totals."""
    year = first_year(F.lit(season))

    def of(table, **rates):
        now = table.where(F.col("year") == year)
        return now.select("team_id", *[_rate(F.col(c), F.col("days")).alias(rate)
                                       for rate, c in rates.items()])

    own, let = of(totals.teams, tgpg="goals"), of(totals.opponents, otga="goals", otshga="sh_goals")
    return own.join(let, "team_id", "full").fillna(0.0, ["tgpg", "otga", "otshga"])


def rates_from(totals: Totals, scheduled: DataFrame, season: str) -> DataFrame:
    """``scheduled`` (player_id, team_id, opponent_id) with all rates; unknown ones are 0.

    Equal to ``rates_as_of`` over the log that the totals were made of.
    """
    teams = team_rates_from(totals, season)
    made = scheduled.join(player_rates_from(totals, season), "player_id", "left")
    made = made.join(teams.select("team_id", "tgpg"), "team_id", "left")
    against = teams.select(F.col("team_id").alias("opponent_id"), "otga", "otshga")
    return made.join(against, "opponent_id", "left").fillna(
        0.0, ["gpg", "five_gpg", "hgpg", "hppg", "tgpg", "otga", "otshga"])
