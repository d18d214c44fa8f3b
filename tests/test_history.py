import datetime as dt

import pytest
from pyspark.sql import functions as F

from tierpick.operators import backfill, history

SCHEMA = "date string, player_id long, tims int, Scored int"
DATES = ["2025-05-27", "2025-05-28", "2025-05-29", "2025-06-04", "2025-06-06", "2025-06-09",
         "2025-06-12", "2026-01-27"]


def as_dates(df):
    return df.withColumn("date", F.col("date").cast("date"))


@pytest.fixture
def past(rows):
    """Eight dates with three picks each; the last date is open."""
    return as_dates(rows(SCHEMA, *[
        (d, i * 10 + t, t, None if d == DATES[-1] else t % 2)
        for i, d in enumerate(DATES) for t in (1, 2, 3)]))


@pytest.fixture
def nothing_known(rows):
    return as_dates(rows("date string, id long, scored int"))


def test_new_picks_push_out_the_oldest_date(rows, past, nothing_known):
    new = as_dates(rows(SCHEMA, *[("2026-01-28", 900 + t, t, None) for t in (1, 2, 3)]))
    after = history.update_history(past, new, nothing_known, "2026-01-28")
    dates = {str(r["date"]) for r in after.collect()}
    assert after.count() == 24 and DATES[0] not in dates and "2026-01-28" in dates


def test_without_picks_all_dates_stay(rows, past, nothing_known):
    after = history.update_history(past, past.limit(0), nothing_known, "2026-01-28")
    assert after.count() == 24


def test_a_second_run_adds_nothing(rows, past, nothing_known):
    again = as_dates(rows(SCHEMA, *[(DATES[-1], 900 + t, t, None) for t in (1, 2, 3)]))
    after = history.update_history(past, again, nothing_known, DATES[-1])
    assert after.exceptAll(past).count() == 0 and after.count() == 24


def test_late_outcomes(rows):
    past = as_dates(rows(
        SCHEMA, ("2025-01-01", 1, 1, None), ("2025-01-01", 2, 2, 0), ("2025-01-01", 3, 3, None),
        ("2025-01-02", 4, 1, 1), ("2025-01-03", 5, 1, None)))
    known = as_dates(rows(
        "date string, id long, scored int", ("2025-01-01", 1, 1), ("2025-01-01", 2, 1),
        ("2025-01-01", 3, None), ("2025-01-02", 4, 0), ("2025-01-03", 5, 1)))
    after = history.fill_outcomes(past, known, "2025-01-03")
    # All rows of an open date are matched; other dates and today are left alone.
    assert {r["player_id"]: r["Scored"] for r in after.collect()} == {
        1: 1, 2: 1, 3: None, 4: 1, 5: None}
    assert [str(r["date"]) for r in history.pending_dates(past, "2025-01-03").collect()] == [
        "2025-01-01"]


METRIC = "id string, date string, value double, correct long, total long"


def metric_of(rows, scored, before=(10, 20), date="2025-01-01"):
    day = as_dates(rows(SCHEMA, *[("2025-01-02", i, 1, s) for i, s in enumerate(scored)]))
    prior = [("current_pick_accuracy", date, 50.0, *before)] if before else []
    return history.running_metric(day, as_dates(rows(METRIC, *prior)))


@pytest.mark.parametrize("scored, correct", [((1, 0, 1), 12), ((1, 1, 1), 13), ((0, 0, 0), 10)])
def test_metric(rows, scored, correct):
    found = metric_of(rows, scored).first()
    assert (found["correct"], found["total"]) == (correct, 23)
    assert found["value"] == round(correct / 23 * 100, 2)


def test_metric_needs_three_picks(rows):
    assert metric_of(rows, (1, 0)).count() == 0


def test_metric_without_prior_is_null(rows):
    found = metric_of(rows, (1, 0, 1), before=None).first()
    assert (found["value"], found["correct"], found["total"]) == (None, None, None)


def test_metric_of_the_same_day_counts_once(rows):
    found = metric_of(rows, (1, 0, 1), date="2025-01-02").first()
    assert (found["correct"], found["total"]) == (10, 20)


GAMES = "date string, game_id int, state string, outcome string, home_abbr string, away_abbr string, goals array<long>"


def test_back_fill_gate_and_labels(rows):
    games = as_dates(rows(
        GAMES, ("2025-01-01", 1, "OK", "REG", "A", "B", [1, 2, 1]),
        ("2025-01-01", 2, "PPD", None, "C", "D", None),
        ("2025-01-02", 3, "OK", "OT", "A", "C", [2, None])))
    routed = backfill.classify_games(games)
    assert [r["route"] for r in routed.orderBy("game_id").collect()] == [
        "final", "postponed", "final"]
    archive = as_dates(rows(
        "date string, id long, team_abbr string, scored int", ("2025-01-01", 1, "A", None),
        ("2025-01-01", 3, "C", None), ("2025-01-01", 4, "B", None), ("2025-01-02", 2, "A", None),
        ("2025-01-03", 9, "A", None)))
    kept = backfill.without_postponed(archive, backfill.postponed_teams(backfill.gate(routed)))
    labels = backfill.label(kept, backfill.scorers(routed), routed)
    assert {(str(r["date"]), r["id"]): r["scored"] for r in labels.collect()} == {
        ("2025-01-01", 1): 1, ("2025-01-01", 4): 0, ("2025-01-02", 2): 1}
    lists = {(str(r["date"]), r["place"], r["player_id"]) for r in
             backfill.scorer_lists(backfill.scorers(routed)).collect()}
    assert lists == {("2025-01-01", 0, 1), ("2025-01-01", 1, 2), ("2025-01-02", 0, 2)}


def test_one_open_game_stops_all(rows):
    games = as_dates(rows(
        GAMES, ("2025-01-01", 1, "OK", "REG", "A", "B", [1]),
        ("2025-01-02", 2, "OK", None, "A", "B", [])))
    assert backfill.gate(backfill.classify_games(games)).count() == 0
    assert backfill.gate(backfill.classify_games(games.limit(0))).count() == 0


def test_past_dates(rows):
    dates = as_dates(rows("date string", ("2025-01-01",), (None,), ("2025-01-03",)))
    assert [r["date"] for r in backfill.past_dates(dates, "2025-01-02").collect()] == [
        dt.date(2025, 1, 1)]
