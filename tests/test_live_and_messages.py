import datetime as dt

from pyspark.sql import functions as F

from tierpick.operators import bets, live, notify, schedule
from tierpick.plans.live import live_board

GAMES = (
    "game_id long, status string, period int, is_intermission boolean, time_passed int, "
    "period_time_remaining string, home_team string, home_abbr string, home_score int, "
    "away_team string, away_abbr string, away_score int"
)
GOALS = "game_id long, pos int, name string, team_abbr string, full_name string, time int"


def test_live_board(rows):
    games = rows(
        GAMES, (1, "LIVE", 2, False, 1300, "18:20", "Toronto", "TOR", 2, "Boston", "BOS", 1),
        (2, "FUT", 0, False, 0, "", "X", "X", 0, "Y", "Y", 0),
        (3, "FINAL", 3, False, 3600, "00:00", "A", "A", 0, "B", "B", 0),
        (4, "CRIT", 3, True, 3600, "00:00", "C", "C", 0, "D", "D", 0))
    goals = rows(
        GOALS, (1, 0, "A. M", "TOR", "Auston Matthews", 100), (1, 1, "B. X", "BOS", "Bo X", 1270),
        (1, 2, "A. M", "TOR", "Auston Matthews", 1290))
    watch = rows("team_name string, full_name string", ("Toronto", "Auston Matthews"))
    scorers = live.goals_per_scorer(goals)
    board = {(r["side"], r["name"]): r["shown"] for r in
             live.board_scorers(games, scorers, watch).where("game_id = 1").collect()}
    assert board == {("home", "A. M"): "watched", ("away", "B. X"): "recent"}
    found = {r["game_id"]: r for r in live_board(games, goals, watch).collect()}
    assert set(found) == {1, 3, 4}
    assert found[1]["text"] == (
        "Period 2 | 18:20 | Toronto @ Boston\n2 - 1\n  TOR: A. M (2)\n  BOS: B. X (1)")
    assert found[1]["has_recent"] and not found[3]["has_recent"]
    assert found[3]["text"].startswith("FINAL | A @ B\n")
    assert found[4]["text"].startswith("Intermission 3 | 00:00 | C @ D\n0 - 0\n  C: \n  D: ")


def test_scorer_class_limits(spark):
    def shown(passed, period, pause, status, goal):
        column = live.scorer_class(
            F.lit(passed), F.lit(period), F.lit(pause), F.lit(status), F.lit(goal), F.lit(False))
        return spark.range(1).select(column.alias("c")).first()["c"]

    assert shown(1259, 2, False, "LIVE", 1200) == "recent"
    assert shown(1260, 2, False, "LIVE", 1200) == "plain"
    assert shown(1210, 2, False, "LIVE", 1190) == "plain"
    assert shown(1259, 2, True, "LIVE", 1200) == "plain"
    assert shown(1259, 2, False, "FINAL", 1200) == "plain"


def test_changes_of_a_busy_key(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20).alias("k"), "id",
        (F.floor(F.col("id") / 13) % 3).alias("v"))
    found = {r["id"] for r in live.changes(
        df.repartition(7), "k", ["id"], ["v"], F.floor(F.col("id") / 100)).collect()}
    want, last = set(), {}
    for r in df.orderBy("id").collect():
        if last.get(r["k"], None) != r["v"] or r["k"] not in last:
            want.add(r["id"])
        last[r["k"]] = r["v"]
    assert found == want


def test_messages(rows):
    users = rows("id long, email string, display_name string", (1, "a@x", "Al"), (2, "", "B"),
                 (3, "c@x", None), (4, None, "D"), (5, "e@x", "E"))
    wants = rows("user_id long, notify boolean", (1, True), (2, True), (3, True), (4, True),
                 (5, False))
    chosen = notify.opted_in(users, wants)
    assert {(r["email"], r["display_name"]) for r in chosen.collect()} == {("a@x", "Al"), ("c@x", "")}
    picks = rows("tims string, name string, team_name string, stat string, pick_no int",
                 ("2", "Bo", "T2", "0.256", 1), ("1", "Cy", "T1", "n/a", 2))
    text = {r["email"]: r["text"] for r in notify.messages(chosen, picks).collect()}
    head = "Tims | Name | Team | Probability\n" + "-" * 40 + "\n"
    assert text["a@x"] == "Hey Al,\n\n" + head + "1 | Cy | T1 | n/a\n2 | Bo | T2 | 0.26%\n"
    assert text["c@x"].startswith(head)
    empty = notify.messages(chosen, picks.limit(0)).collect()
    assert {r["text"] for r in empty} == {"Hey Al,\n\n" + head, head}


def test_trigger_plan(rows):
    starts = rows("day string, start string", ("d", "2026-01-15T03:00:00Z"),
                  ("d", "2026-01-15T00:00:00Z"), ("d", "2026-01-15T00:30:00Z"),
                  ("d", "2026-01-15T00:30:00Z"))
    plan = schedule.trigger_plan(starts, "dev").orderBy("start").collect()
    assert [r["rule"] for r in plan] == [
        f"TriggerStateMachineAt_2026011500{m}-dev" if m != "305" else
        "TriggerStateMachineAt_202601150305-dev" for m in ("05", "35", "305")]
    assert [r["last_game"] for r in plan] == [False, False, True]
    assert plan[0]["cron"] == "cron(5 0 15 1 ? 2026)"
    assert plan[0]["trigger"] == dt.datetime(2026, 1, 15, 0, 5)


def test_run_status(rows):
    board = rows("date string, id long, player_id long", ("2025-01-01", 1, 9)).withColumn(
        "date", F.col("date").cast("date"))
    for today, last, want in (("2025-01-01", False, "normal_run"),
                              ("2025-01-02", False, "first_run"), ("2025-01-02", True, "last_run")):
        assert schedule.run_status(board, today, last).first()["status"] == want
    assert schedule.fresh_board(board, "2025-01-01").first()["id"] == 9


def test_bets(rows):
    players = rows("name string, team_name string, stat double, odds string, id int",
                   ("a", "T", 0.5, "+150", 1), ("b", "T", 0.1, "+100", 2), ("c", "U", 0.9, "-120", 3))
    found = bets.worth_betting(bets.price(players))
    assert {r["name"] for r in found.collect()} == {"a", "c"}
    ledger = {r["Name"]: r for r in bets.ledger_rows(found, "2025-01-01").collect()}
    assert ledger["a"].asDict() == {
        "Date": "2025-01-01", "Name": "a", "Team": "T", "My Probability": "50.00",
        "DraftKings Probability": "40.00", "DraftKings Odds": "+150", "Bet Size": "6.67",
        "Payout Amount": "16.68", "Scored": ""}
    assert bets.totals(found.limit(0)).first()["total_bet"] == 0.0
    lists = {tuple(r) for r in bets.names_by_team(found, ["id"]).collect()}
    assert lists == {("T", 0, "a"), ("U", 0, "c")}
    assert bets.not_ignored(players, ("a",)).count() == 2
