import random

from tierpick.operators import picks

SCHEMA = "date string, tims int, n int, stat double, scored int"


def test_ties_go_to_the_first_row_and_nan_never_wins(rows):
    nan = float("nan")
    df = rows(
        SCHEMA, ("d", 1, 2, 0.5, 1), ("d", 1, 1, 0.5, 0), ("d", 1, 3, nan, 1),
        ("d", 2, 4, nan, 1), ("d", 2, 5, -1.0, 0), ("d", 3, 6, nan, 1), ("d", 3, 7, None, 1),
        ("d", 0, 8, 9.0, 1), ("d", 1, 9, None, 1),
    )
    found = picks.historical_picks(df, ["n"]).collect()
    assert {(r["tims"], r["n"]) for r in found} == {(1, 1), (2, 5)}


def test_zero_and_minus_zero_tie(rows):
    df = rows(SCHEMA, ("d", 1, 1, -0.0, 1), ("d", 1, 2, 0.0, 0))
    assert picks.historical_picks(df, ["n"]).first()["n"] == 1


def test_keep_limits_the_columns(rows):
    df = rows(SCHEMA, ("d", 1, 1, 0.1, 1))
    assert picks.historical_picks(df, ["n"], keep=["scored"]).columns == df.columns
    assert picks.historical_picks(df, ["n"], keep=[]).columns == ["date", "tims", "n", "stat"]


def test_hot_group_equals_brute_force(spark, rows):
    random.seed(1)
    data = []
    for n in range(3000):
        hot = n % 3 == 0
        date = "hot" if hot else f"d{n % 40}"
        tier = 1 if hot else random.randint(0, 3)
        data.append((date, tier, n, random.choice([0.1, 0.2, 0.3]), random.randint(0, 1)))
    want = {}
    for date, tier, n, stat, scored in data:
        if tier and (date, tier) not in want or tier and stat > want[date, tier][1]:
            want[date, tier] = (n, stat)
    df = rows(SCHEMA, *data).repartition(8)
    found = {(r["date"], r["tims"]): (r["n"], r["stat"]) for r in
             picks.historical_picks(df, ["n"]).collect()}
    assert found == want


def test_pick_of_day(rows):
    df = rows(
        "date string, tims string, n int, stat double, name string, scored int",
        ("a", "2", 1, 0.2, "x", 1), ("a", "1", 2, 0.1, "y", 1), ("a", "1", 3, 0.4, "z", 1),
        ("a", "3", 4, 0.3, "w", 1), ("a", "0", 0, 0.9, "v", 1),
        ("b", "1", 5, 0.3, "u", 1), ("b", "2", 6, 0.3, "t", 1),
    )
    found = picks.pick_of_day(df, ["n"]).orderBy("pick_no").collect()
    assert [(r["tims"], r["name"], r["pick_no"]) for r in found] == [
        (2, "x", 1), (1, "z", 2), (3, "w", 3)]
    assert {r["Scored"] for r in found} == {None}


def test_picks_of_known_candidates(rows):
    # Best per tier among rows with the real tier, id and score of two matches.
    df = rows(
        "date string, tims int, id long, name string, stat double",
        ("d", 1, 8477493, "Aleksander Barkov", 0.09153088927268982),
        ("d", 1, 8477935, "Sam Bennett", 0.309813916683197),
        ("d", 1, 8477934, "Leon Draisaitl", 0.35604169964790344),
        ("d", 2, 8473419, "Brad Marchand", 0.2610989212989807),
        ("d", 3, 8470621, "Corey Perry", 0.23373079299926758),
    )
    found = picks.pick_of_day(df, ["id"])
    assert {r["id"] for r in found.collect()} == {8477934, 8473419, 8470621}


def test_accuracy_and_correctness(rows):
    df = rows(SCHEMA, ("a", 1, 1, 0.5, 1), ("a", 2, 2, 0.5, 0), ("b", 1, 3, 0.5, 1),
              ("b", 1, 4, 0.4, 0))
    made = picks.historical_picks(df, ["n"])
    report = {r["tims"]: r for r in picks.accuracy(made).collect()}
    assert (report[None]["total"], report[None]["correct"], report[None]["wrong"]) == (3, 2, 1)
    assert report[1]["pct"] == 100.0 and report[2]["pct"] == 0.0
    both = picks.correctness(made, df).first()
    assert (both["correct"], both["picks"], both["slots"]) == (2, 3, 6)


def test_rank_within_date(rows):
    df = rows(SCHEMA, ("a", 1, 1, 0.2, 1), ("a", 2, 2, 0.5, 0), ("a", 3, 3, 0.2, 0))
    ranked = picks.ordered_picks(df).orderBy("rank").collect()
    assert [r["tims"] for r in ranked] == [2, 1, 3]
