"""Two days from landed feed files: rates, board, history, labels, and the next day."""

from pyspark.sql import functions as F

from bindings.base import iso, query, run_dir, score_sql, six, table
from bindings.windows import season_of
from tierpick import schemas
from tierpick.config import BOUNDS
from tierpick.operators import features
from tierpick.plans import daily
from tierpick.sources import tables

_DAYS = {1: "2001-06-01", 2: "2001-06-02"}
_BEFORE, _SEASON = "2001-05-31", "20012002"
_TIERED, _HURT = {1: 10, 2: 7}, {1: 9, 2: 8}  # every how-manieth customer is in a tier, is hurt
_PAGE = 10_000  # customers in one document of a feed


def _log(spark, sf_dir):
    """Orders as the games of customers."""
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    price = F.col("o_totalprice")
    return features.game_log(orders.select(
        season_of(F.year("o_orderdate")).alias("season"), F.col("o_orderdate").cast("date").alias("date"),
        F.col("c_custkey").alias("player_id"), F.col("c_nationkey").alias("team_id"),
        ((F.col("c_nationkey") + F.dayofmonth("o_orderdate")) % 25).alias("opponent_id"),
        (price > 150000).cast("int").alias("goals"), (price > 300000).cast("int").alias("pp_goals"),
        (price < 100000).cast("int").alias("sh_goals")))


def _land(spark, sf_dir, root, day):
    """The feed files of a day: nations 0 to 23 play in pairs, customers are their players."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    players = table(spark, sf_dir, "customer").withColumn(
        "page", F.floor(key / _PAGE).cast("int"))
    team = F.struct(
        F.col("n_nationkey").cast("long").alias("id"), F.struct(F.col("n_name").alias("default")).alias("placeName"),
        F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("abbrev"))
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 24").select(
        F.floor(F.col("n_nationkey") / 2).cast("int").alias("game"),
        (F.col("n_nationkey") % 2 == day - 1).alias("home"), team.alias("team"))
    sides = nations.groupBy("game").agg(
        F.max_by("team", "home").alias("homeTeam"), F.min_by("team", "home").alias("awayTeam"))

    def games(frame, *fields):
        """A list of games; twelve of them a page."""
        return F.sort_array(F.collect_list(F.struct("game", *fields))).alias("games")

    started = sides.withColumns({"season": F.lit(_SEASON), "startTimeUTC": F.lit(f"{_DAYS[day]}T23:00:00Z")})
    started.agg(games(started, "season", "startTimeUTC", "homeTeam", "awayTeam")).select(
        F.array(F.struct("games")).alias("gameWeek")).write.json(f"{root}/schedule")

    skater = F.struct(key.cast("long").alias("id"), F.struct(F.lit("P").alias("default")).alias("firstName"),
                      F.struct(F.col("c_name").alias("default")).alias("lastName"))
    players.groupBy(nation.alias("team_id"), "page").agg(
        F.collect_list(F.when(key % 2 == 0, skater)).alias("forwards"),
        F.collect_list(F.when(key % 2 == 1, skater)).alias("defensemen"),
    ).drop("page").write.partitionBy("team_id").json(f"{root}/rosters")

    entry = F.struct(F.upper(F.concat(F.lit("p "), "c_name")).alias("player"),
                     F.lit("Knee").alias("injury"), F.lit("Out").alias("status"))
    players.where(key % _HURT[day] == 0).groupBy("page").agg(
        F.to_json(F.collect_list(entry)).alias("value")).write.partitionBy("page").text(f"{root}/injuries")

    listed = F.struct(key.cast("long").alias("nhlPlayerId"))
    players.groupBy("page").agg(F.array(*[
        F.struct(F.collect_list(F.when(key % _TIERED[day] == tier, listed)).alias("players"))
        for tier in range(3)]).alias("playerLists")).drop("page").write.json(f"{root}/tiers")

    if day == 2:  # the scores of the day before; game 5 was postponed
        scored = players.where((key % 11 < 3) & (nation < 24)).groupBy(
            "page", F.floor(nation / 2).cast("int").alias("game")).agg(
            F.collect_list(F.struct(key.cast("long").alias("playerId"))).alias("goals"))
        played = scored.join(sides, "game").withColumns({
            "gameScheduleState": F.when(F.col("game") == 5, "PPD").otherwise("OK"),
            "gameOutcome": F.struct(F.lit("REG").alias("lastPeriodType"))})
        played.groupBy("page").agg(games(
            played, "gameScheduleState", "gameOutcome", "homeTeam", "awayTeam", "goals")).select(
            "games", F.lit(_DAYS[1]).alias("date")).write.partitionBy("date").json(f"{root}/scores")


def _rates_sql(day):
    past = f"(SELECT * FROM log WHERE date < DATE '{_DAYS[day]}')"
    return f"""cand{day} AS (SELECT c_custkey AS id, n_name AS team_name, c_nationkey AS team, {'n_nationkey % 2 = 0' if day == 1 else 'n_nationkey % 2 = 1'} AS home,
    coalesce(gpg, 0) AS gpg, coalesce(hgpg, 0) AS hgpg, coalesce(hppg, 0) AS hppg, coalesce(five_gpg, 0) AS five_gpg,
    coalesce(made.r, 0) AS tgpg, coalesce(let.r, 0) AS otga, coalesce(let.s, 0) AS otshga,
    CASE WHEN c_custkey % {_HURT[day]} = 0 THEN 'INJURED' ELSE 'HEALTHY' END AS injury_status,
    CASE WHEN c_custkey % {_TIERED[day]} < 3 THEN c_custkey % {_TIERED[day]} + 1 ELSE 0 END AS tims
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT id AS i, avg(goals) FILTER (WHERE y = 2001) AS gpg, avg(goals) FILTER (WHERE y >= 1999) AS hgpg,
    avg(pp) FILTER (WHERE y >= 1999) AS hppg FROM {past} GROUP BY 1) ON i = c_custkey
  LEFT JOIN (SELECT id AS j, avg(goals) AS five_gpg FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS n FROM {past})
    WHERE n <= 5 GROUP BY 1) ON j = c_custkey
  LEFT JOIN (SELECT team, avg(g) AS r FROM (SELECT team, date, sum(goals) AS g FROM {past} WHERE y = 2001 GROUP BY ALL) GROUP BY 1) made
    ON made.team = n_nationkey
  LEFT JOIN (SELECT opp, avg(g) AS r, avg(h) AS s FROM (SELECT opp, date, sum(goals) AS g, sum(sh) AS h FROM {past} WHERE y = 2001 GROUP BY ALL) GROUP BY 1) let
    ON let.opp = CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 1 ELSE n_nationkey - 1 END
  WHERE c_nationkey < 24),
  day{day} AS (SELECT *, {score_sql(bounds=BOUNDS)} AS stat FROM cand{day}),
  pick{day} AS (SELECT * FROM day{day} WHERE tims BETWEEN 1 AND 3 QUALIFY row_number() OVER (PARTITION BY tims ORDER BY stat DESC, id) = 1)"""


_OUT = "round(CAST(stat AS DOUBLE), 6) AS stat, CAST(tims AS INTEGER) AS tims"


@query("b1_landed_days", f"""WITH log AS (SELECT year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS date, c_custkey AS id, c_nationkey AS team,
    (c_nationkey + day(o_orderdate)) % 25 AS opp, sum(CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END) AS goals,
    sum(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS pp, sum(CASE WHEN o_totalprice < 100000 THEN 1 ELSE 0 END) AS sh
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  {_rates_sql(1)}, {_rates_sql(2)},
  label AS (SELECT *, CASE WHEN id % 11 < 3 THEN 1 ELSE 0 END AS scored FROM day1 WHERE team NOT IN (10, 11))
SELECT 'board' AS kind, '{_DAYS[2]}' AS date, id AS player_id, team_name, injury_status, {_OUT}, NULL::VARCHAR AS scored FROM day2
UNION ALL SELECT 'label', '{_DAYS[1]}', id, team_name, injury_status, {_OUT}, CAST(scored AS VARCHAR) FROM label
UNION ALL SELECT 'history', '{_DAYS[1]}', id, team_name, NULL, {_OUT}, CAST((SELECT scored FROM label WHERE label.id = pick1.id) AS VARCHAR) FROM pick1
UNION ALL SELECT 'history', '{_DAYS[2]}', id, team_name, NULL, {_OUT}, NULL FROM pick2""")
def b1_landed(spark, sf_dir):
    log, store = _log(spark, sf_dir), daily.Store(run_dir(spark, "daily"))
    day_of = F.col("date")
    daily.add_day(spark, store, log.where(day_of <= F.lit(_BEFORE).cast("date")), _BEFORE)
    for day, before in ((1, _BEFORE), (2, _DAYS[1])):
        root = run_dir(spark, f"landing-{day}")
        _land(spark, sf_dir, root, day)
        totals = daily.read_totals(spark, store, _DAYS[day])
        rates = features.player_rates_from(totals, _SEASON).withColumnRenamed("player_id", "id")
        landed = daily.read_feeds(spark, root, features.team_rates_from(totals, _SEASON), rates)
        assert daily.daily_run(spark, store, landed, _DAYS[day], before, ["id"]) == "first_run"
        daily.add_day(spark, store, log.where(day_of == F.lit(_DAYS[day]).cast("date")), _DAYS[day])

    def rows(frame, kind, key, scored, status=F.col("injury_status")):
        return frame.select(
            F.lit(kind).alias("kind"), iso(), F.col(key).alias("player_id"), "team_name",
            status.cast("string").alias("injury_status"), six("stat"), "tims",
            scored.cast("string").alias("scored"))

    labels = tables.read_archive(spark, store.archive).where(day_of == F.lit(_DAYS[1]).cast("date"))
    past = tables.read_version(spark, store.history, schemas.HISTORY)
    board = rows(tables.read_board(spark, store.board), "board", "player_id", F.lit(None))
    return board.unionByName(rows(labels, "label", "id", F.col("scored"))).unionByName(
        rows(past, "history", "player_id", F.col("Scored"), F.lit(None)))
