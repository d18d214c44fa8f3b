import datetime as dt
import random

from pyspark.sql import functions as F

from tierpick.functions import clock, odds, text
from tierpick.functions.numbers import round_exact


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_round_exact_equals_python(spark):
    random.seed(5)
    values = [0.125, 0.375, 2.675, 1.005, 33.325, 3.125, -0.125, -2.675, 0.005, 0.015, 1e15 + 0.3,
              0.0, 1e300, 52.173913043478265]
    values += [round(random.uniform(-100, 100), random.choice([2, 3, 4])) for _ in range(1500)]
    values += [k / 200 for k in range(-400, 400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3):
        out = df.select("v", round_exact(F.col("v"), digits).alias("r"),
                        text.fixed(F.col("v"), digits).alias("t")).collect()
        for r in out:
            assert r["r"] == round(r["v"], digits), (r, digits)
            if abs(r["v"]) < 1e6:
                assert r["t"] == f"{r['v']:.{digits}f}", (r, digits)


def test_american_odds(spark):
    df = spark.createDataFrame(
        [("-150",), ("+150",), ("100",), ("0",), (None,)], "o string")
    pct = [r["p"] for r in df.select(odds.implied_percent(F.col("o")).alias("p")).collect()]
    assert pct == [150 / 250 * 100, 100 / 250 * 100, 50.0, None, None]


def python_bet(stat, percent, price, bankroll):
    if not stat or not percent:
        return 0
    decimal = price / 100 + 1 if price >= 0 else 100 / abs(price) + 1
    share = (stat - percent / 100) / (decimal - 1)
    return round(min(max(0, share * bankroll), bankroll), 2)


def test_bet_size_and_payout(spark):
    cases = [(0.5, 40.0, 150), (0.9, 10.0, 900), (0.1, 50.0, 100), (0.0, 50.0, 100),
             (0.7, 60.0, -150), (0.4, None, 0), (None, 50.0, 100), (0.35604, 22.2222, 350)]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)],
                               "s double, p double, o int, i int")
    bet = odds.bet_size(F.col("s"), F.col("p"), F.col("o"), 100.0)
    out = df.select(bet.alias("b")).collect()
    assert [r["b"] for r in out] == [python_bet(*c, 100.0) for c in cases]
    assert one(spark, odds.payout(F.lit(10.0), F.lit(150))) == 25.0
    assert one(spark, odds.payout(F.lit(10.0), F.lit(-200))) == -10.0
    assert one(spark, odds.payout(F.lit(10.0), F.lit(-200), corrected=True)) == 15.0


def test_names(spark):
    assert one(spark, text.fold_ascii(F.lit("Tim Stützle"))) == "Tim Stutzle"
    assert one(spark, text.fold_ascii(F.lit("Émile Żółć Øster Großß Æbel š"))) == (
        "Emile Zolc Oster Grossss AEbel s")
    assert one(spark, text.fold_ascii(F.lit("O’Reilly u\u0308 a–b \u1ec5 ĲǼ “q”…"))) == (
        "O'Reilly u a-b e IJAE \"q\"...")
    assert one(spark, text.alias_name(F.lit("Cameron York"))) == "Cameroneron York"
    assert one(spark, text.alias_name(F.lit("Cam York"), whole=True)) == "Cam York"
    assert one(spark, text.alias_name(F.lit("T.J. Brodie"), whole=True)) == "TJ Brodie"
    assert one(spark, text.full_name(F.lit(None).cast("string"), F.lit("B"))) == " B"
    assert one(spark, text.first_filled(F.lit(""), F.lit("b"))) == "b"
    assert one(spark, text.first_filled(F.lit(None).cast("string"), F.lit("b"))) == "b"
    assert one(spark, text.place_or_common(F.lit(" "), F.lit("Utah"))) == "Utah"


def test_percent_or_text(spark):
    df = spark.createDataFrame([("0.256",), ("n/a",), (None,)], "s string")
    out = [r["t"] for r in df.select(text.percent_or_text(F.col("s")).alias("t")).collect()]
    assert out == ["0.26%", "n/a", ""]


def test_cron_and_rule(spark):
    cases = {
        "2025-01-15T00:00:00": "cron(0 0 15 1 ? 2025)",
        "2024-02-29T23:59:00": "cron(59 23 29 2 ? 2024)",
        "2025-03-05T04:07:00": "cron(7 4 5 3 ? 2025)",
    }
    for moment, cron in cases.items():
        at = F.lit(moment).cast("timestamp_ntz")
        assert one(spark, clock.cron_text(at)) == cron
    late = clock.trigger_time(F.lit("2026-01-15T23:58:00Z"))
    assert one(spark, clock.rule_name(late, "dev")) == "TriggerStateMachineAt_202601160003-dev"


def test_game_clock(spark):
    assert one(spark, clock.goal_clock(F.lit(2), F.lit("03:07"))) == 1387
    assert one(spark, clock.goal_clock(F.lit(1), F.lit(None).cast("string"))) == 0
    assert one(spark, clock.elapsed(F.lit(3), F.lit(100))) == 3500
    assert one(spark, clock.elapsed(F.lit(1), F.lit(None).cast("int"))) == 1200
    assert [one(spark, clock.goal_period(F.lit(t))) for t in (0, 1199, 1200)] == [1, 1, 2]
    assert one(spark, clock.date_number(F.lit("2025-10-07").cast("date"))) == 20251007


def test_home_zone(spark):
    late = dt.datetime(2025, 1, 2, 3, 0)  # still the day before in Toronto
    assert clock.home_date(late) == dt.date(2025, 1, 1)
    assert clock.home_date(late, days=-1) == dt.date(2024, 12, 31)
    assert one(spark, clock.home_day(F.lit(late))) == dt.date(2025, 1, 1)
    assert one(spark, clock.home_time(F.lit(late), 5)) == "2025-01-06T22:00:00"
