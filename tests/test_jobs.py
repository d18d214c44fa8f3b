from pyspark.sql import functions as F

import __spark_entry__ as entry
from tierpick import schemas
from tierpick.plans import daily
from tierpick.sources import tables


def landed(rows, tier_of):
    teams = rows(
        "team_id long, team_name string, team_abbr string, season string, opponent_id long, "
        "home boolean, tgpg double, otga double, otshga double",
        (1, "Alpha", "AA", "s", 2, True, 3.0, 2.0, 0.5), (2, "Beta", "BB", "s", 1, False, 2.5, 3.0, 0.4))
    players = rows(
        "id long, name string, team_id long, gpg double, hgpg double, five_gpg double, hppg double",
        *[(n, f"P {n}", n % 2 + 1, n / 20, n / 30, n / 25, n / 100) for n in range(1, 13)])
    injuries = rows("player string, injury string, status string, pos int", ("p 3", "Leg", "Out", 0))
    tiers = rows("id long, tier int", *[(n, tier_of(n)) for n in range(1, 13) if tier_of(n)])
    return daily.Feeds(teams, players, injuries, tiers)


def test_days_in_a_row(spark, rows, tmp_path):
    store = daily.Store(str(tmp_path))
    feeds = landed(rows, lambda n: n % 4)
    assert daily.daily_run(spark, store, feeds, "2025-01-01", "2024-12-31", ["id"]) == "first_run"
    board = tables.read_board(spark, store.board)
    assert board.count() == 12
    assert {r["tims"] for r in board.collect()} == {0, 1, 2, 3}
    assert board.where("injury_status = 'INJURED'").first()["player_id"] == 3
    past = tables.read_version(spark, store.history, schemas.HISTORY)
    assert {(r["tims"], r["player_id"], r["Scored"]) for r in past.collect()} == {
        (1, 9, None), (2, 10, None), (3, 11, None)}

    other = landed(rows, lambda n: (n + 1) % 4)
    assert daily.daily_run(spark, store, other, "2025-01-01", "2024-12-31", ["id"]) == "normal_run"
    board = tables.read_board(spark, store.board)
    assert {(r["player_id"], r["tims"]) for r in board.collect()} == {
        (n, (n + 1) % 4) for n in range(1, 13)}
    assert sorted(r["id"] for r in board.collect()) == list(range(1, 13))
    assert daily.daily_run(spark, store, other, "2025-01-01", "", ["id"], True) == "last_run"

    # The next day: label the first day, then pick again.
    games = rows(
        "date string, game_id int, state string, outcome string, home_abbr string, "
        "away_abbr string, goals array<long>", ("2025-01-01", 1, "OK", "REG", "AA", "BB", [9, 11]))
    games = games.withColumn("date", F.col("date").cast("date"))
    daily.run_backfill(spark, store, games, "2025-01-01")
    labels = tables.read_archive(spark, store.archive)
    assert labels.agg(F.sum("scored")).first()[0] == 2 and labels.count() == 12
    tables.replace_table(rows(schemas.METRIC).unionByName(rows(
        "id string, date string, value double, correct long, total long",
        ("current_pick_accuracy", "2024-12-31", 50.0, 10, 20)).withColumn(
            "date", F.col("date").cast("date"))), store.metric)
    assert daily.daily_run(spark, store, feeds, "2025-01-02", "2025-01-01", ["id"]) == "first_run"
    past = tables.read_version(spark, store.history, schemas.HISTORY)
    assert {(str(r["date"]), r["player_id"], r["Scored"]) for r in past.collect()} == {
        ("2025-01-01", 9, 1), ("2025-01-01", 10, 0), ("2025-01-01", 11, 1),
        ("2025-01-02", 9, None), ("2025-01-02", 10, None), ("2025-01-02", 11, None)}
    metric = tables.read_metric(spark, store.metric).first()
    assert (metric["correct"], metric["total"], metric["value"]) == (12, 23, 52.17)


def test_a_doubled_team_counts_once_and_an_empty_day_publishes_an_empty_board(spark, rows, tmp_path):
    feeds = landed(rows, lambda n: n % 4)
    numbered = feeds.teams.withColumn("team_no", F.lit(0))
    feeds.teams = numbered.unionByName(
        numbered.withColumns({"team_no": F.lit(1), "team_name": F.lit("Later")}))
    found = daily.candidates(feeds).collect()
    assert len(found) == 12 and {r["team_name"] for r in found} == {"Later"}

    store = daily.Store(str(tmp_path / "s"))
    games = rows("date date, game_id int, state string, outcome string, home_abbr string, "
                 "away_abbr string, goals array<long>")
    feeds.players, feeds.games = feeds.players.limit(0), games
    assert daily.daily_run(spark, store, feeds, "2025-01-01", "2024-12-31", ["id"]) == "first_run"
    assert tables.read_board(spark, store.board).count() == 0


def test_two_days_from_landed_feeds_with_labels_between(spark, rows, tmp_path):
    import json

    def put(folder, body):
        path = tmp_path / folder
        path.mkdir(parents=True)
        (path / "f.json").write_text(json.dumps(body))

    def team(n):
        return {"id": n, "abbrev": "AB"[n - 1] * 2, "placeName": {"default": f"Place {n}"},
                "commonName": {"default": "c"}}

    def skater(n):
        return {"id": n, "firstName": {"default": "P"}, "lastName": {"default": str(n)}}

    for day in ("1", "2"):
        put(f"{day}/schedule", {"gameWeek": [{"games": [
            {"startTimeUTC": "2025-01-01T00:00:00Z", "season": "20242025",
             "homeTeam": team(1), "awayTeam": team(2)}]}]})
        for n in (1, 2):
            put(f"{day}/rosters/team_id={n}", {
                "forwards": [skater(10 * n + k) for k in range(3)], "defensemen": []})
        put(f"{day}/injuries", [
            {"player": "P 10", "injury": "Leg", "status": "Doubtful"},
            {"player": "p 10", "injury": "Leg", "status": "Out"}])
        put(f"{day}/tiers", {"playerLists": [
            {"players": [{"nhlPlayerId": 10 + k}, {"nhlPlayerId": 20 + k}]} for k in range(3)]})
    put("2/scores/date=2025-01-01", {"games": [
        {"gameScheduleState": "OK", "gameOutcome": {"lastPeriodType": "REG"},
         "homeTeam": {"abbrev": "AA"}, "awayTeam": {"abbrev": "BB"},
         "goals": [{"playerId": 21}, {"playerId": 12}]}]})
    team_rates = rows("team_id long, tgpg double, otga double, otshga double",
                      (1, 3.0, 2.0, 0.5), (2, 2.5, 3.0, 0.4))
    rates = rows("id long, gpg double, hgpg double, five_gpg double, hppg double",
                 *[(n, n / 20, n / 30, n / 25, 0.0) for n in (10, 11, 12, 20, 21, 22)])
    store = daily.Store(str(tmp_path / "store"))
    for day, today, before in (("1", "2025-01-01", "2024-12-31"), ("2", "2025-01-02", "2025-01-01")):
        feeds = daily.read_feeds(spark, str(tmp_path / day), team_rates, rates)
        assert daily.daily_run(spark, store, feeds, today, before, ["id"]) == "first_run"
    board = tables.read_board(spark, store.board).collect()
    assert len(board) == 6 and {r["injury_desc"] for r in board} == {"", "Out"}
    past = tables.read_version(spark, store.history, schemas.HISTORY).collect()
    assert {(str(r["date"]), r["tims"], r["player_id"], r["Scored"]) for r in past} == {
        ("2025-01-01", 1, 20, 0), ("2025-01-01", 2, 21, 1), ("2025-01-01", 3, 22, 0),
        ("2025-01-02", 1, 20, None), ("2025-01-02", 2, 21, None), ("2025-01-02", 3, 22, None)}


def test_entry_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_flagship(spark):
    report = entry.entry(spark)
    assert report.columns == ["tims", "total", "correct", "wrong", "pct"]
    assert report.count() == 4
