"""The runs of a day: first run, normal run, last run; history; back-fill; messages."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierpick import schemas
from tierpick.config import BOUNDS, WEIGHTS
from tierpick.operators import backfill, enrich, features, history, notify, picks
from tierpick.operators.schedule import fresh_board, run_status
from tierpick.operators.scoring import predict
from tierpick.session import scratch, stage
from tierpick.sources import feeds, tables, versions

KEPT_DAYS = 8  # running totals that stay, so that a day can be added again


@dataclass
class Feeds:
    """Flat rows of the landed feeds."""

    teams: DataFrame      # feeds.team_rows, with tgpg, otga, otshga
    players: DataFrame    # feeds.roster_players, with gpg, hgpg, five_gpg, hppg
    injuries: DataFrame   # feeds.injury_rows, with pos
    tiers: DataFrame      # feeds.tier_entries
    games: DataFrame | None = None  # feeds.score_games of past dates, for their outcomes


@dataclass
class Store:
    """Paths of the tables."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name in ("board", "history", "metric", "archive", "ledger", "totals"):
            return f"{self.root}/{name}"
        raise AttributeError(name)


def candidates(landed: Feeds, bounds=BOUNDS, weights=WEIGHTS) -> DataFrame:
    """Players with team, score, injury status and tier."""
    position = "team_no" if "team_no" in landed.teams.columns else None
    joined = enrich.join_teams(landed.players, landed.teams, position, keep=("team_abbr",))
    scored = predict(joined, bounds, weights)
    return enrich.tag_tiers(enrich.merge_injuries(scored, landed.injuries), landed.tiers)


def read_feeds(spark: SparkSession, landing: str, team_rates: DataFrame,
               player_rates: DataFrame, **kw) -> Feeds:
    """The feeds of a day from their folders below ``landing``.

    Folders: schedule, rosters, injuries, tiers, scores. Teams get their own
    scoring rate (team_id, tgpg) and what their opponent allows (otga, otshga);
    players get their rates by id. A player without rates has scored nothing.
    """
    teams = feeds.team_rows(feeds.read_schedule(spark, f"{landing}/schedule", **kw))
    teams = teams.join(team_rates.select("team_id", "tgpg"), "team_id", "left").fillna(0.0, ["tgpg"])
    teams = enrich.opponent_columns(
        teams, team_rates.select("team_id", "otga", "otshga"), ["otga", "otshga"])
    rates = ["gpg", "hgpg", "five_gpg", "hppg"]
    players = feeds.read_rosters(spark, f"{landing}/rosters", **kw).drop("roster_no").join(
        player_rates.select("id", *rates), "id", "left").fillna(0.0, rates)
    players = players.join(teams.select("team_id").distinct(), "team_id", "left_semi")
    return Feeds(
        teams, players, feeds.read_injuries(spark, f"{landing}/injuries"),
        feeds.read_tiers(spark, f"{landing}/tiers", **kw),
        feeds.read_scores(spark, f"{landing}/scores", optional=True, **kw))


def read_totals(spark: SparkSession, store: Store, before) -> features.Totals | None:
    """The running totals after the last day before ``before``; none if there are none yet."""
    parts = {}
    for name in features.Totals._fields:
        path = f"{store.totals}/{name}"
        if not any(c.label < str(before) for c in versions.commits(spark, path)):
            return None
        parts[name] = versions.read(spark, path, before=str(before))
    return features.Totals(**parts)


def add_day(spark: SparkSession, store: Store, log: DataFrame, day) -> None:
    """Bring the running totals forward by the games of a day.

    It reads the totals of the last day before and the day's own rows; a day
    that is added again replaces itself. The first call may bring a whole log.
    """
    before = read_totals(spark, store, day)
    with scratch(spark):
        log = stage(log, "day")  # read once for each of the totals
        after = features.totals_of(log) if before is None else features.forward(before, log)
        for name, table in after._asdict().items():
            versions.commit(table, f"{store.totals}/{name}", label=str(day), keep=KEPT_DAYS)


def update_history(spark: SparkSession, store: Store, players: DataFrame, today, yesterday,
                   order: list[str]) -> None:
    """Add today's picks, fill late outcomes, then update the metric of yesterday."""
    dated = players.withColumn("date", F.lit(today).cast("date"))
    chosen = picks.pick_of_day(dated, order).withColumnRenamed("id", "player_id")
    keep = [c.split(" ")[0] for c in schemas.HISTORY.split(", ") if not c.startswith("id ")]
    new = stage(chosen.select(*keep), "picks")
    before = tables.read_version(spark, store.history, schemas.HISTORY, before=today).drop("id")
    outcomes = tables.scan(
        spark, store.archive, ("date", "id", "scored"), schema="date date, id bigint, scored int"
    )
    after = stage(history.update_history(before, new, outcomes, today), "history")
    rows = tables.history_rows(after, ["date", "tims", "player_id"])
    tables.write_version(rows, store.history, today)
    metric = history.running_metric(
        history.picks_of(after, yesterday), tables.read_metric(spark, store.metric)
    )
    tables.write_metric(metric, store.metric)


def daily_run(spark: SparkSession, store: Store, landed: Feeds, today, yesterday,
              order: list[str], last_game: bool = False) -> str:
    """Run the mode that is due and return it. What it stages is removed at its end."""
    with scratch(spark):
        return _run(spark, store, landed, today, yesterday, order, last_game)


def _run(spark, store, landed, today, yesterday, order, last_game) -> str:
    board = tables.read_board(spark, store.board)
    status = run_status(board, today, last_game).first()["status"]
    if status == "first_run":
        if landed.games is not None:
            run_backfill(spark, store, landed.games, yesterday)
        archived = candidates(landed).select(
            "*", F.lit(today).cast("date").alias("date"), F.lit(None).cast("int").alias("scored")
        )
        # Also where a day that is run again has no players any more.
        tables.rewrite_dates(
            archived, spark.range(1).select(F.lit(today).cast("date").alias("date")), store.archive)
        # From here on the archived day is the input.
        # A day without players gives an empty board.
        players = tables.read_archive(
            spark, store.archive, today, schema=archived.schema).drop("date", "scored")
        update_history(spark, store, players, today, yesterday, order)
        tables.publish_board(players, today, order, store.board)
    elif status == "normal_run":
        # The board is rewritten from itself, so its next state is staged first.
        players = stage(enrich.tag_tiers(fresh_board(board, today), landed.tiers), "players")
        tables.publish_board(players, today, ["position"], store.board)
    return status


def run_backfill(spark: SparkSession, store: Store, games: DataFrame, yesterday) -> None:
    """Label the dates without outcomes, unless one of their games is not done."""
    archive = tables.read_archive(spark, store.archive, schema=schemas.ARCHIVE)
    dates = backfill.past_dates(backfill.dates_without_outcome(archive), yesterday)
    routed = backfill.classify_games(games).join(dates, "date", "left_semi")
    open_gate = backfill.gate(routed)
    done = open_gate.select("date").distinct()
    kept = backfill.without_postponed(
        archive.join(done, "date", "left_semi"), backfill.postponed_teams(open_gate)
    )
    labels = backfill.label(kept, backfill.scorers(open_gate), done)
    tables.rewrite_dates(labels, done, store.archive)


def notify_users(board: DataFrame, users: DataFrame, preferences: DataFrame, today,
                 order: list[str]) -> DataFrame:
    """One message per opted-in user with today's picks."""
    todays = fresh_board(board, today)
    chosen = picks.pick_of_day(todays, order)
    return notify.messages(notify.opted_in(users, preferences), chosen)
