import datetime as dt
import random
from collections import defaultdict

from tierpick.operators import features

SCHEMA = "season int, date string, player_id int, team_id int, opponent_id int, goals int, pp_goals int, sh_goals int"


def test_rates_equal_brute_force(rows):
    random.seed(2)
    raw = []
    for season in (2020, 2021, 2022, 2023):
        for day in range(1, 9):
            for player in range(4):
                if random.random() < 0.8:
                    for _ in range(random.choice([1, 3])):
                        raw.append((season, f"{season}-01-{day:02d}", player, player % 2,
                                    1 - player % 2, random.randint(0, 2), random.randint(0, 1),
                                    random.randint(0, 1)))
    log = defaultdict(lambda: [0, 0, 0])
    for season, date, player, team, other, g, p, s in raw:
        for i, v in enumerate((g, p, s)):
            log[season, date, player, team, other][i] += v

    def rate(entries, i):
        return sum(e[i] for e in entries) / len(entries) if entries else 0.0

    def team_rate(key_at, team, season, date, i):
        days = defaultdict(int)
        for key, v in log.items():
            if key[key_at] == team and key[0] == season and key[1] < date:
                days[key[1]] += v[i]
        return sum(days.values()) / len(days) if days else 0.0

    found = features.feature_table(features.game_log(rows(SCHEMA, *raw).repartition(5)))
    out = found.collect()
    assert len(out) == len(log)
    for r in out:
        season, date, player = r["season"], r["date"], r["player_id"]
        mine = sorted((k, v) for k, v in log.items() if k[2] == player and k[1] < date)
        this = [v for k, v in mine if k[0] == season]
        three = [v for k, v in mine if k[0] >= season - 2]
        want = (rate(this, 0), rate([v for _, v in mine[-5:]], 0), rate(three, 0), rate(three, 1),
                team_rate(3, r["team_id"], season, date, 0),
                team_rate(4, r["opponent_id"], season, date, 0),
                team_rate(4, r["opponent_id"], season, date, 2))
        got = tuple(r[c] for c in ("gpg", "five_gpg", "hgpg", "hppg", "tgpg", "otga", "otshga"))
        assert all(abs(a - b) < 1e-12 for a, b in zip(got, want)), (r, want)


def test_seasons_as_the_feed_has_them(rows):
    log = rows("season string, date string, player_id int, team_id int, opponent_id int, "
               "goals long, pp_goals long, sh_goals long",
               ("20232024", "2024-01-01", 1, 1, 2, 4, 0, 0), ("20242025", "2025-01-01", 1, 1, 2, 2, 1, 0))
    ahead = rows("season string, date string, player_id int, team_id int, opponent_id int",
                 ("20252026", "2025-10-07", 1, 1, 2), ("20252026", "2025-10-07", 9, 1, 2))
    found = {r["player_id"]: r for r in features.rates_as_of(log, ahead).collect()}
    assert found[1]["hgpg"] == 3.0 and found[1]["hppg"] == 0.5 and found[1]["gpg"] == 0.0
    assert found[1]["five_gpg"] == 3.0 and found[9]["hgpg"] == found[9]["tgpg"] == 0.0


LOG = "season string, date date, player_id int, team_id int, opponent_id int, goals long, pp_goals long, sh_goals long"
RATES = ["gpg", "hgpg", "hppg", "five_gpg", "tgpg", "otga", "otshga"]


def season_log(seed=7):
    """Four seasons; one game in ten has been logged without counts."""
    rng, out = random.Random(seed), []
    for year in (2020, 2021, 2022, 2023):
        for day in range(1, 13):
            for player in range(6):
                if rng.random() < 0.7:
                    counts = [rng.randint(0, 3), rng.randint(0, 1), rng.randint(0, 1)]
                    out.append((f"{year}{year + 1}", dt.date(year, 11, day), player, player % 3,
                                (player + day) % 3, *([None] * 3 if rng.random() < 0.1 else counts)))
    return out


def games(rows, day, players):
    return rows("season string, date date, player_id int, team_id int, opponent_id int", *[
        ("20232024", day, p, p % 3, (p + 1) % 3) for p in players])


def same_rates(found, twin):
    keys = ["player_id", *RATES]
    left, right = ({r["player_id"]: tuple(round(r[c], 9) for c in keys) for r in df.collect()}
                   for df in (found, twin))
    assert left == right and left


def test_logged_games_without_counts_are_not_taken_for_scheduled_ones(rows):
    log = rows(LOG, *season_log())
    ahead = games(rows, dt.date(2023, 11, 20), (0, 1, 9))
    made = features.rates_as_of(log, ahead).collect()
    assert sorted(r["player_id"] for r in made) == [0, 1, 9]
    assert {str(r["date"]) for r in made} == {"2023-11-20"}


def test_totals_brought_forward_equal_the_windows(rows):
    log = season_log()
    last = dt.date(2023, 11, 8)
    totals = features.totals_of(rows(LOG, *[r for r in log if r[1] <= last]))
    for day in range(9, 13):
        mine = [r for r in log if r[1] == dt.date(2023, 11, day)]
        ahead = games(rows, dt.date(2023, 11, day), range(8))
        past = rows(LOG, *[r for r in log if r[1] < dt.date(2023, 11, day)])
        same_rates(features.rates_from(totals, ahead, "20232024"), features.rates_as_of(past, ahead))
        totals = features.forward(totals, rows(LOG, *mine))


def test_a_day_added_twice_counts_once(spark, rows, tmp_path):
    from tierpick.plans import daily

    store, log = daily.Store(str(tmp_path)), season_log()
    assert daily.read_totals(spark, store, "2023-11-01") is None
    daily.add_day(spark, store, rows(LOG, *[r for r in log if r[1] < dt.date(2023, 11, 12)]),
                  "2023-11-11")
    for _ in range(2):
        daily.add_day(spark, store, rows(LOG, *[r for r in log if r[1] == dt.date(2023, 11, 12)]),
                      "2023-11-12")
    ahead = games(rows, dt.date(2023, 11, 13), range(6))
    same_rates(
        features.rates_from(daily.read_totals(spark, store, "2023-11-13"), ahead, "20232024"),
        features.rates_as_of(rows(LOG, *log), ahead))


def test_all_player_windows_share_one_sort(rows):
    plan = features.player_rates(rows(LOG, *season_log()))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("Sort [") == 1 and text.count("Exchange hashpartitioning") == 1
