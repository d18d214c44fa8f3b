import pytest

from tierpick.operators import enrich

TEAMS = "team_id long, team_name string, team_abbr string, opponent_id long, season string, home boolean, tgpg double, pos int"
PLAYERS = "id long, name string, team_id long, gpg double, stat double"


def test_join_teams(rows):
    teams = rows(TEAMS, (1, "A", "AA", 2, "s", True, 3.0, 0), (2, "B", "BB", 1, "s", False, 2.0, 1),
                 (1, "A2", "AA", 2, "s", True, 3.5, 2))
    players = rows(PLAYERS, (10, "x", 1, 0.5, 0.0), (11, "y", 2, 0.4, 0.0))
    out = enrich.join_teams(players, teams, position="pos").orderBy("id")
    assert out.columns == ["id", "name", "gpg", "team_name", "home", "tgpg"]
    assert [r["team_name"] for r in out.collect()] == ["A2", "B"]


def test_team_columns_win(rows):
    teams = rows("team_id long, name string", (1, "team"))
    out = enrich.join_teams(rows(PLAYERS, (10, "x", 1, 0.5, 0.0)), teams).first()
    assert out["name"] == "team"


def test_missing_team_fails(rows):
    teams = rows("team_id long, team_name string", (1, "A"))
    players = rows(PLAYERS, (10, "x", 9, 0.5, 0.0))
    with pytest.raises(Exception, match="no team for player 10"):
        enrich.join_teams(players, teams).collect()
    assert enrich.players_without_team(players, teams).count() == 1


def test_nested_teams(rows):
    nested = rows(
        "team_id long, team_name string, players array<struct<id: long, name: string, team_id: long>>",
        (1, "A", [(1, "x", 1), (2, "y", 1)]), (2, "B", []))
    out = enrich.nest_players(nested).orderBy("id").collect()
    assert [(r["id"], r["team_name"]) for r in out] == [(1, "A"), (2, "A")]


def test_injuries(rows):
    players = rows("id long, name string", (1, "Connor McDavid"), (2, "X Y"), (3, None))
    injuries = rows(
        "player string, injury string, status string, pos int",
        ("connor mcdavid", "Leg", "Out", 0), ("CONNOR MCDAVID", "Leg", "Day-To-Day", 1))
    out = {r["id"]: r for r in enrich.merge_injuries(players, injuries).collect()}
    assert (out[1]["injury_status"], out[1]["injury_desc"]) == ("INJURED", "Day-To-Day")
    assert (out[2]["injury_status"], out[2]["injury_desc"]) == ("HEALTHY", "")
    assert out[3]["injury_status"] == "HEALTHY"
    none = injuries.limit(0)
    assert {r["injury_status"] for r in enrich.merge_injuries(players, none).collect()} == {
        "HEALTHY"}
    assert enrich.merge_injuries(players.limit(0), injuries).count() == 0


def test_tiers(rows):
    players = rows("id long, name string", (1, "a"), (2, "b"), (3, "c"), (4, "d"))
    lists = rows("id long, tier int", (1, 1), (5, 1), (2, 2), (6, 2), (3, 3), (7, 3), (1, 3))
    out = enrich.tag_tiers(players, lists).orderBy("id").collect()
    assert [r["tims"] for r in out] == [3, 2, 3, 0]
    assert enrich.unmatched_tiers(players, lists).count() == 3
    assert {r["tims"] for r in enrich.tag_tiers(players, lists.limit(0)).collect()} == {0}
    assert enrich.tag_tiers(players.limit(0), lists).count() == 0


def test_only_the_last_of_repeated_players_is_tagged(rows):
    players = rows("id long, pos int", (1, 0), (1, 1), (2, 2))
    lists = rows("id long, tier int", (1, 2), (2, 1))
    out = enrich.tag_tiers(players, lists, position="pos").orderBy("pos").collect()
    assert [r["tims"] for r in out] == [0, 2, 1]


def test_odds(rows):
    players = rows("id long, name string", (1, "Tim Stützle"), (2, "Mitch Marner"), (3, "René A"),
                   (4, "Rene A"), (5, "No Odds"))
    odds = rows(
        "pos int, name string, odds string",
        (0, "Tim Stutzle", "+300"), (1, "Mitchell Marner", "+200"), (2, "Mitch Marner", "+150"),
        (3, "Mitchell Marner", "+180"), (4, "René A", "-110"), (5, "Ghost", "+900"),
        (6, "Brendan Brisson", "+900"), (7, "Tim Stuetzle", "+310"))
    out = {r["id"]: r["odds"] for r in enrich.link_odds(players, odds).collect()}
    assert out == {1: "+310", 2: "+180", 3: None, 4: "-110", 5: None}
    assert [r["name"] for r in enrich.unmatched_odds(players, odds).collect()] == ["Ghost"]


def test_opponent_columns(rows):
    teams = rows("team_id long, opponent_id long", (1, 2), (2, 3))
    stats = rows("team_id long, otga double", (2, 1.5))
    out = {r["team_id"]: r["otga"] for r in
           enrich.opponent_columns(teams, stats, ["otga"]).collect()}
    assert out == {1: 1.5, 2: 0.0}


def test_of_a_repeated_nested_team_the_last_row_counts(rows):
    nested = rows(
        "team_id long, pos int, team_name string, players array<struct<id: long, name: string, team_id: long>>",
        (1, 2, "New", [(1, "x", 1)]), (1, 1, "Old", [(2, "y", 1)]), (2, 3, "B", []))
    out = enrich.nest_players(nested, position="pos").orderBy("id").collect()
    assert [(r["id"], r["team_name"]) for r in out] == [(1, "New"), (2, "New")]
