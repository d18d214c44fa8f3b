"""Landed feeds: nested JSON -> flat rows. Positions keep the order of the feed."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.utils import AnalysisException

from tierpick import schemas
from tierpick.config import ODDS_CATEGORY, ODDS_LABEL, ODDS_PROVIDER
from tierpick.functions.clock import elapsed, goal_clock
from tierpick.functions.text import first_filled, full_name, place_or_common


def read_feed(spark: SparkSession, path: str, schema: str, multiline: bool = False,
              optional: bool = False) -> DataFrame:
    """JSON files under a declared schema; an absent optional feed is empty."""
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", multiline)
    try:
        return reader.json(path)
    except AnalysisException as error:
        if optional and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def nested(path: str, default):
    """A nested field, or its default where it or anything above it is missing."""
    return F.coalesce(F.col(path), F.lit(default))


def schedule_games(feed: DataFrame, keys=()) -> DataFrame:
    """Games of the first day of the schedule."""
    day = feed.select(*keys, F.posexplode(F.col("gameWeek").getItem(0).getField("games")).alias(
        "game_no", "_g"))
    return day.select(
        *keys, "game_no", F.col("_g.startTimeUTC").alias("start"), F.col("_g.season"),
        F.col("_g.homeTeam").alias("home_team"), F.col("_g.awayTeam").alias("away_team"),
    )


def team_rows(games: DataFrame, keys=()) -> DataFrame:
    """Two rows per game: home, then away."""

    def side(own, other, home):
        return F.struct(
            place_or_common(
                F.col(f"{own}.placeName.default"), F.col(f"{own}.commonName.default")
            ).alias("team_name"),
            F.col(f"{own}.abbrev").alias("team_abbr"),
            F.col("season"),
            F.col(f"{own}.id").alias("team_id"),
            F.col(f"{other}.id").alias("opponent_id"),
            F.lit(home).alias("home"),
        )

    both = F.array(side("home_team", "away_team", True), side("away_team", "home_team", False))
    return games.select(
        *keys, "game_no", F.posexplode(both).alias("_side", "_t")
    ).select(*keys, (F.col("game_no") * 2 + F.col("_side")).alias("team_no"), "_t.*")


def roster_players(feed: DataFrame, keys=("team_id",)) -> DataFrame:
    """Forwards, then defensemen."""
    skaters = F.concat(
        F.coalesce("forwards", F.array()), F.coalesce("defensemen", F.array())
    )
    return feed.select(*keys, F.posexplode(skaters).alias("roster_no", "_p")).select(
        *keys, "roster_no",
        F.col("_p.id").alias("id"),
        full_name(F.col("_p.firstName.default"), F.col("_p.lastName.default")).alias("name"),
    )


def score_games(feed: DataFrame, keys=("date",)) -> DataFrame:
    """Games of a date with state, outcome, teams and the ids of the scorers."""
    return feed.select(*keys, F.posexplode("games").alias("game_id", "_g")).select(
        *keys, "game_id",
        F.col("_g.gameScheduleState").alias("state"),
        F.col("_g.gameOutcome").alias("outcome"),
        F.col("_g.homeTeam.abbrev").alias("home_abbr"),
        F.col("_g.awayTeam.abbrev").alias("away_abbr"),
        F.col("_g.goals.playerId").alias("goals"),
    )


def scoreboard_games(feed: DataFrame, today=None) -> DataFrame:
    """Games of today's scoreboard, every missing field with its default."""
    days = feed.select(F.explode("gamesByDate").alias("_d"))
    if today is not None:
        days = days.where(F.col("_d.date") == str(today))
    games = days.select(F.explode("_d.games").alias("_g"))

    def field(name, default):
        return nested(f"_g.{name}", default)

    period = field("periodDescriptor.number", 0)
    return games.select(
        F.col("_g.id").alias("game_id"),
        *[
            column
            for side in ("away", "home")
            for column in (
                field(f"{side}Team.placeNameWithPreposition.default", "Unknown Team").alias(
                    f"{side}_team"),
                field(f"{side}Team.abbrev", "").alias(f"{side}_abbr"),
                field(f"{side}Team.score", 0).alias(f"{side}_score"),
            )
        ],
        F.col("_g.gameState").alias("status"),
        period.alias("period"),
        field("clock.timeRemaining", "00:00").alias("period_time_remaining"),
        field("clock.inIntermission", False).alias("is_intermission"),
        elapsed(period, F.col("_g.clock.secondsRemaining")).alias("time_passed"),
    )


def story_goals(feed: DataFrame, keys=("game_id",)) -> DataFrame:
    """Goals of a game story with their place in the feed."""
    periods = feed.select(*keys, F.posexplode("summary.scoring").alias("_no", "_s"))
    goals = periods.select(
        *keys, "_no", F.col("_s.periodDescriptor.number").alias("period"),
        F.posexplode("_s.goals").alias("_goal_no", "_g"),
    )
    return goals.select(
        *keys, F.struct("_no", "_goal_no").alias("pos"),
        F.coalesce("_g.name.default", F.lit("Unknown Player")).alias("name"),
        F.coalesce("_g.teamAbbrev.default", F.lit("")).alias("team_abbr"),
        full_name(F.col("_g.firstName.default"), F.col("_g.lastName.default")).alias("full_name"),
        goal_clock(F.col("period"), F.col("_g.timeInPeriod")).alias("time"),
    )


def injury_rows(feed: DataFrame) -> DataFrame:
    """Rows with a player and an injury or a status; unreadable records drop out."""

    def filled(column):
        return F.coalesce(F.col(column), F.lit("")) != ""

    return feed.where(filled("player") & (filled("injury") | filled("status")))


def tier_entries(feed: DataFrame) -> DataFrame:
    """Player id and tier; the place of a list is its tier."""
    lists = feed.select(F.posexplode(F.slice("playerLists", 1, 3)).alias("_no", "_l"))
    return lists.select(
        (F.col("_no") + 1).alias("tier"), F.explode("_l.players").alias("_p")
    ).select(F.col("_p.nhlPlayerId").alias("id"), "tier")


def odds_rows(feed: DataFrame, provider: int = ODDS_PROVIDER) -> DataFrame:
    """Name and price of the provider's goalscorer outcomes, with their place in the feed."""
    category = feed.select(
        F.posexplode("eventGroup.offerCategories").alias("_a", "_c")
    ).where(F.col("_c.name") == ODDS_CATEGORY)
    sub = category.select(
        "_a", F.posexplode("_c.offerSubcategoryDescriptors").alias("_b", "_s")
    ).where(F.col("_s.name") == ODDS_CATEGORY)
    groups = sub.select("_a", "_b", F.posexplode("_s.offerSubcategory.offers").alias("_d", "_g"))
    offers = groups.select("_a", "_b", "_d", F.posexplode("_g").alias("_e", "_o")).where(
        F.col("_o.label") == ODDS_LABEL
    )
    outcomes = offers.select(
        "_a", "_b", "_d", "_e", F.posexplode("_o.outcomes").alias("_f", "_x")
    ).where(F.col("_x.providerId") == provider)
    return outcomes.select(
        F.struct("_a", "_b", "_d", "_e", "_f").alias("pos"),
        first_filled(F.col("_x.playerNameIdentifier"), F.col("_x.participant")).alias("name"),
        F.col("_x.oddsAmerican").alias("odds"),
    )


def read_schedule(spark, path, **kw):
    return schedule_games(read_feed(spark, path, schemas.SCHEDULE, **kw))


def read_rosters(spark, path, **kw):
    """Roster files below ``team_id=<id>`` folders."""
    return roster_players(read_feed(spark, path, f"{schemas.ROSTER}, team_id bigint", **kw))


def read_scores(spark, path, **kw):
    """Score files below ``date=<day>`` folders."""
    return score_games(read_feed(spark, path, f"{schemas.SCORE}, date date", **kw))


def read_injuries(spark, path, **kw):
    """Injury list, a JSON array per document, with ``pos`` in it.

    An absent feed has no rows, nor has an unreadable document.
    """
    try:
        documents = spark.read.option("wholetext", True).text(path, **kw)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        documents = spark.createDataFrame([], "value string")
    entries = F.from_json("value", ArrayType(StructType.fromDDL(schemas.INJURIES)))
    listed = documents.select(F.posexplode(entries).alias("pos", "_e"))
    return injury_rows(listed.select(F.col("pos").cast("bigint").alias("pos"), "_e.*"))


def read_tiers(spark, path, **kw):
    return tier_entries(read_feed(spark, path, schemas.TIER_LISTS, **kw))


def read_odds(spark, path, **kw):
    return odds_rows(read_feed(spark, path, schemas.ODDS, **kw))


def read_scoreboard(spark, path, today=None, **kw):
    return scoreboard_games(read_feed(spark, path, schemas.SCOREBOARD, **kw), today)


def read_stories(spark, path, **kw):
    """Story files below ``game_id=<id>`` folders."""
    return story_goals(read_feed(spark, path, f"{schemas.GAME_STORY}, game_id bigint", **kw))
