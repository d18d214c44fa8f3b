import json

import pytest

from tierpick import schemas
from tierpick.sources import feeds


@pytest.fixture
def landed(spark, tmp_path):
    def write(*documents, name="feed.json"):
        path = tmp_path / "feed"
        path.mkdir(exist_ok=True)
        (path / name).write_text("\n".join(
            d if isinstance(d, str) else json.dumps(d) for d in documents))
        return str(path)

    return write


def team(number, place, common):
    return {"id": number, "placeName": {"default": place}, "abbrev": f"T{number}",
            "commonName": {"default": common}}


def game(start, home, away):
    return {"startTimeUTC": start, "season": "20242025", "homeTeam": home, "awayTeam": away}


def test_schedule_to_team_rows(spark, landed):
    first = {"games": [
        game("2025-06-11T23:00:00Z", team(1, "Alpha", "A"), team(2, "Bravo", "B")),
        game("2025-06-11T20:00:00Z", team(3, " ", "Club"), team(4, "Delta", "D"))]}
    later = {"games": [game("2025-06-12T23:00:00Z", team(5, "E", "E"), team(6, "F", "F"))]}
    path = landed({"gameWeek": [first, later]})
    rows = feeds.team_rows(feeds.read_schedule(spark, path)).orderBy("team_no").collect()
    assert [(r["team_name"], r["team_id"], r["opponent_id"], r["home"]) for r in rows] == [
        ("Alpha", 1, 2, True), ("Bravo", 2, 1, False), ("Club", 3, 4, True),
        ("Delta", 4, 3, False)]
    assert rows[0]["season"] == "20242025" and rows[0]["team_abbr"] == "T1"


def test_no_games(spark, landed):
    path = landed({"gameWeek": [{"games": []}]})
    assert feeds.team_rows(feeds.read_schedule(spark, path)).count() == 0


def test_rosters_leave_goalies_out(spark, landed):
    def skater(number):
        return {"id": number, "firstName": {"default": "F"}, "lastName": {"default": f"L{number}"}}

    path = landed({"team_id": 7, "forwards": [skater(1), skater(2)], "defensemen": [skater(3)],
                   "goalies": [skater(4)]}, {"team_id": 8, "forwards": [skater(5)]})
    rows = feeds.read_rosters(spark, path).orderBy("team_id", "roster_no").collect()
    assert [(r["team_id"], r["id"], r["name"]) for r in rows] == [
        (7, 1, "F L1"), (7, 2, "F L2"), (7, 3, "F L3"), (8, 5, "F L5")]


def test_scores(spark, landed):
    path = landed({"date": "2025-01-01", "games": [
        {"gameScheduleState": "OK", "gameOutcome": {"lastPeriodType": "REG"},
         "homeTeam": {"abbrev": "A"}, "awayTeam": {"abbrev": "B"}, "goals": [{"playerId": 9}]},
        {"gameScheduleState": "PPD", "homeTeam": {"abbrev": "C"}, "awayTeam": {"abbrev": "D"}}]})
    rows = feeds.read_scores(spark, path).orderBy("game_id").collect()
    assert [(r["state"], r["outcome"] is None, r["goals"]) for r in rows] == [
        ("OK", False, [9]), ("PPD", True, None)]


def test_injuries_skip_gaps_and_bad_records(spark, landed):
    path = landed(
        {"pos": 0, "player": "A", "injury": "Leg", "status": ""},
        {"pos": 1, "player": "", "injury": "Leg", "status": "Out"},
        {"pos": 2, "player": "B", "injury": "", "status": ""}, "{broken",
        {"pos": 3, "player": "C", "status": "Out"})
    assert {r["player"] for r in feeds.read_injuries(spark, path).collect()} == {"A", "C"}
    assert feeds.read_injuries(spark, path + "-absent").count() == 0


def test_absent_required_feed_fails(spark, landed):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        feeds.read_tiers(spark, landed() + "-absent").collect()


def test_tier_lists(spark, landed):
    lists = [{"players": [{"nhlPlayerId": n}]} for n in (11, 12, 13, 14)]
    rows = feeds.read_tiers(spark, landed({"playerLists": lists})).collect()
    assert {(r["id"], r["tier"]) for r in rows} == {(11, 1), (12, 2), (13, 3)}


def test_odds(spark, landed):
    def category(name, sub, label):
        outcomes = [
            {"providerId": 2, "playerNameIdentifier": "A", "participant": "x", "oddsAmerican": "+1"},
            {"providerId": 2, "playerNameIdentifier": "", "participant": "B", "oddsAmerican": "-2"},
            {"providerId": 1, "playerNameIdentifier": "C", "participant": "y", "oddsAmerican": "+3"},
            {"providerId": 2, "participant": "D", "oddsAmerican": "+4"}]
        offers = [[{"label": label, "outcomes": outcomes}]]
        return {"name": name, "offerSubcategoryDescriptors": [
            {"name": sub, "offerSubcategory": {"offers": offers}}, {"name": sub}]}

    path = landed({"eventGroup": {"offerCategories": [
        category("Goalscorer", "Goalscorer", "Anytime Goalscorer"),
        category("Goalscorer", "Goalscorer", "First Goalscorer"),
        category("Goalscorer", "Shots", "Anytime Goalscorer"),
        category("Other", "Goalscorer", "Anytime Goalscorer"), {"name": "Goalscorer"}]}})
    rows = feeds.read_odds(spark, path).orderBy("pos").collect()
    assert [(r["name"], r["odds"]) for r in rows] == [("A", "+1"), ("B", "-2"), ("D", "+4")]
    assert feeds.read_odds(spark, landed({}, name="feed.json")).count() == 0


def test_scoreboard_defaults(spark, landed):
    path = landed({"gamesByDate": [
        {"date": "2025-01-01", "games": [{"id": 1, "gameState": "LIVE"}]},
        {"date": "2025-01-02", "games": [{"id": 2}]}]})
    row = feeds.read_scoreboard(spark, path, today="2025-01-01").collect()
    assert len(row) == 1
    assert row[0].asDict() == {
        "game_id": 1, "away_team": "Unknown Team", "away_abbr": "", "away_score": 0,
        "home_team": "Unknown Team", "home_abbr": "", "home_score": 0, "status": "LIVE",
        "period": 0, "period_time_remaining": "00:00", "is_intermission": False,
        "time_passed": 0}


def test_stories(spark, landed):
    goal = {"name": {"default": "A. B"}, "firstName": {"default": "Al"},
            "lastName": {"default": "Be"}, "teamAbbrev": {"default": "TOR"}, "timeInPeriod": "01:05"}
    path = landed({"game_id": 5, "summary": {"scoring": [
        {"periodDescriptor": {"number": 2}, "goals": [goal, {}]},
        {"periodDescriptor": {"number": 3}, "goals": []}]}})
    rows = feeds.read_stories(spark, path).orderBy("pos").collect()
    assert [(r["name"], r["full_name"], r["team_abbr"], r["time"]) for r in rows] == [
        ("A. B", "Al Be", "TOR", 1265), ("Unknown Player", " ", "", 1200)]


def test_schema_is_declared(spark):
    for ddl in (schemas.SCHEDULE, schemas.ROSTER, schemas.SCORE, schemas.TIER_LISTS,
                schemas.INJURIES, schemas.ODDS, schemas.SCOREBOARD, schemas.GAME_STORY,
                schemas.BOARD, schemas.HISTORY, schemas.METRIC):
        assert spark.createDataFrame([], ddl).columns
