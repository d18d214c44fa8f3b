"""Messages to users who asked for them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierpick.functions.text import PICK_LIST_HEAD, greeting, pick_line


def opted_in(users: DataFrame, preferences: DataFrame) -> DataFrame:
    """E-mail and display name of users with notifications on."""
    wanted = preferences.where(F.col("notify")).select("user_id").distinct()
    return users.join(wanted, users["id"] == wanted["user_id"], "left_semi").where(
        F.coalesce("email", F.lit("")) != ""
    ).select("email", F.coalesce("display_name", F.lit("")).alias("display_name"))


def by_tier(*rest: str) -> list:
    """What the pick list is ordered by: the tier as a number, text first, then ``rest``."""
    tier = F.coalesce(F.col("tims").cast("string").try_cast("int"), F.lit(0))
    return [tier.alias("t"), *rest]


def pick_list(picks: DataFrame, position: str = "pick_no") -> DataFrame:
    """One row: the pick list as text, by tier. ``picks`` are those of one day."""
    line = pick_line(F.col("tims"), F.col("name"), F.col("team_name"), F.col("stat"))
    lines = F.sort_array(F.collect_list(F.struct(*by_tier(position), line.alias("line"))))
    joined = F.array_join(F.transform(lines, lambda x: x.getField("line")), "")
    return picks.agg(F.concat(F.lit(PICK_LIST_HEAD), joined).alias("text"))


def messages(users: DataFrame, picks: DataFrame, position: str = "pick_no") -> DataFrame:
    """One message per user with all picks of the day; also with no picks."""
    body = pick_list(picks, position).scalar()
    return users.select(
        "email", "display_name",
        F.concat(greeting(F.col("display_name")), body).alias("text"),
    )
