"""Joins that add team, injury, tier and odds to candidates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierpick.config import IGNORED_NAMES
from tierpick.functions.text import alias_name, fold_ascii, name_key

# No join here is forced to broadcast: Spark broadcasts a side it measures as
# small, and else shuffles and splits skewed partitions.

_PLAYER_ONLY = ("team_id", "odds", "stat")
_TEAM_ONLY = ("team_id", "opponent_id", "season", "team_abbr")


def last_by(df: DataFrame, key: str, position: str) -> DataFrame:
    """Last row of each key by position."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("_r")).select(key, "_r.*")


def players_without_team(players: DataFrame, teams: DataFrame) -> DataFrame:
    return players.join(teams.select("team_id"), "team_id", "left_anti")


def join_teams(players: DataFrame, teams: DataFrame, position: str | None = None,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Player columns then team columns; team columns win where both have one.

    A player whose team is missing fails the job. With ``position`` the last
    row of a repeated team counts. ``keep`` names key columns of the team that
    stay.
    """
    unique = last_by(teams, "team_id", position).drop(position) if position else teams
    team_columns = [c for c in unique.columns if c not in _TEAM_ONLY or c in keep]
    side = unique.select(F.col("team_id").alias("_team_id"), F.struct(*team_columns).alias("_t"))
    own = [c for c in players.columns if c not in _PLAYER_ONLY and c not in team_columns]
    joined = players.join(side, players["team_id"] == side["_team_id"], "left")
    found = F.assert_true(
        F.col("_t").isNotNull(),
        F.concat(F.lit("no team for player "), F.col("id").cast("string")),
    )
    return joined.where(found.isNull()).select(*own, "_t.*")


def nest_players(players: DataFrame, position: str | None = None) -> DataFrame:
    """Teams with a ``players`` array -> one row per player, joined with its team.

    A roster may come in parts; a team counts once. With ``position`` the last
    row of a repeated team counts, else its rows have to agree.
    """
    flat = players.select(F.explode("players").alias("_p")).select("_p.*")
    teams = players.drop("players", "part")
    return join_teams(flat, teams if position else teams.distinct(), position)


def merge_injuries(players: DataFrame, injuries: DataFrame, position: str = "pos") -> DataFrame:
    """Injury status by name, case ignored; the last entry of a name counts."""
    known = (
        injuries.groupBy(name_key(F.col("player")).alias("_key"))
        .agg(F.max_by("status", position).alias("_status"))
    )
    joined = players.withColumn("_key", name_key(F.col("name"))).join(
        known.withColumn("_hurt", F.lit(True)), "_key", "left"
    )
    hurt = F.col("_hurt").isNotNull()
    return joined.select(
        *players.columns,
        F.when(hurt, "INJURED").otherwise("HEALTHY").alias("injury_status"),
        F.when(hurt, F.col("_status")).otherwise("").alias("injury_desc"),
    )


def tag_tiers(players: DataFrame, lists: DataFrame, position: str | None = None) -> DataFrame:
    """Tier of each player, 0 without one; the highest of several lists counts.

    With ``position`` only the last row of a repeated player id is tagged.
    """
    tiers = lists.groupBy("id").agg(F.max("tier").alias("_tier"))
    if position:
        last = players.groupBy("id").agg(F.max(position).alias("_last"))
        tiers = tiers.join(last, "id")
    joined = players.join(tiers, "id", "left")
    hit = F.col("_tier").isNotNull()
    if position:
        hit = hit & (F.col(position) == F.col("_last"))
    own = [c for c in players.columns if c != "tims"]
    return joined.select(*own, F.when(hit, F.col("_tier")).otherwise(0).alias("tims"))


def unmatched_tiers(players: DataFrame, lists: DataFrame) -> DataFrame:
    """List entries without a player."""
    return lists.join(players.select("id"), "id", "left_anti")


def resolve_names(players: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct odds names with the folded roster name they belong to, else null.

    First by the folded name, then by the folded name after the aliases.
    """
    roster = players.select(fold_ascii(F.col("name")).alias("_name")).distinct()
    first = roster.select("_name", F.col("_name").alias("_first"))
    second = roster.select("_name", F.col("_name").alias("_second"))
    keyed = names.withColumn("_plain", fold_ascii(F.col("name"))).withColumn(
        "_alias", fold_ascii(alias_name(F.col("name")))
    )
    found = keyed.join(first, F.col("_plain") == first["_name"], "left").drop("_name")
    found = found.join(
        second, F.col("_first").isNull() & (F.col("_alias") == second["_name"]), "left"
    ).drop("_name")
    return found.select(*names.columns, "_alias", F.coalesce("_first", "_second").alias("_key"))


def link_odds(players: DataFrame, odds: DataFrame, position: str = "pos",
              player_position: str = "id") -> DataFrame:
    """Add ``odds`` to players; the last matching odds row counts.

    Of players with the same folded name only the last gets them. The odds
    rows shrink to the last one per name before any join.
    """
    last_of_name = F.max(F.struct(F.col(position).alias("at"), "odds")).alias("_row")
    named = resolve_names(players, odds.groupBy("name").agg(last_of_name))
    price = (
        named.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.max("_row").alias("_row"))
        .select("_key", F.col("_row.odds").alias("_odds"))
    )
    keyed = players.withColumn("_key", fold_ascii(F.col("name")))
    last = keyed.groupBy("_key").agg(F.max(player_position).alias("_last"))
    priced = price.join(last, "_key")
    joined = keyed.join(priced, "_key", "left")
    own = [c for c in players.columns if c != "odds"]
    mine = F.col("_last") == F.col(player_position)
    return joined.select(*own, F.when(mine, F.col("_odds")).alias("odds"))


def unmatched_odds(players: DataFrame, odds: DataFrame, ignored=IGNORED_NAMES) -> DataFrame:
    """Odds rows that no player matches and that are not to be ignored."""
    named = resolve_names(players, odds.select("name").distinct())
    lost = named.where(F.col("_key").isNull() & ~F.col("_alias").isin(*ignored)).select("name")
    return odds.join(lost, "name", "left_semi").select(*odds.columns)


def opponent_columns(teams: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Team rows with figures of their opponent."""
    other = stats.select(F.col("team_id").alias("_other"), *columns)
    return teams.join(other, teams["opponent_id"] == other["_other"], "left").drop("_other").fillna(
        0.0, columns
    )
