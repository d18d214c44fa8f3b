import struct

from pyspark.sql import functions as F

from tierpick.operators import scoring

SCHEMA = (
    "n int, gpg double, hgpg double, five_gpg double, hppg double, tgpg double, otga double, "
    "otshga double, home boolean"
)
TEAM = (3.2, 3.18461, 0.7230769230769231, True)
# gpg, hgpg, five_gpg, hppg and the exact float32 score.
GOLDEN = [
    (0.375, 0.43209876543209874, 0.4, 0.09053497942386832, 0.2010648250579834),
    (0.16923076923076924, 0.16666666666666666, 0.0, 0.045454545454545456, 0.05038461834192276),
    (0.10256410256410256, 0.18238993710691823, 0.0, 0.0, 0.04274310916662216),
    (0.16393442622950818, 0.23741007194244604, 0.0, 0.03597122302158273, 0.060201674699783325),
    (0.13953488372093023, 0.16030534351145037, 0.6, 0.0, 0.16497603058815002),
]
WEIGHTS = {"gpg": 0.3, "five_gpg": 0.4, "hgpg": 0.3, "tgpg": 0.0, "otga": 0.0,
           "hppg_otshga": 0.0, "is_home": 0.0}


def test_golden_scores_are_bit_equal(rows):
    df = rows(SCHEMA, *[(i, *g[:4], *TEAM) for i, g in enumerate(GOLDEN)])
    found = scoring.predict(df, weights=WEIGHTS).orderBy("n").collect()
    assert [r["stat"] for r in found] == [g[4] for g in GOLDEN]
    assert dict(scoring.predict(df).dtypes)["stat"] == "float"


def f32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def test_all_features_count_in_order(rows):
    df = rows(SCHEMA, (0, 0.5, 1.0, 0.25, 0.157, 2.0, 1.0, 0.56, True))
    weights = dict(zip(WEIGHTS, (0.1, 0.2, 0.3, 0.1, 0.1, 0.1, 0.1)))
    features = scoring.normalise(df).first()
    total = 0.0
    for name, weight in weights.items():
        total = f32(total + f32(features[name] * f32(weight)))
    assert scoring.predict(df, weights=weights).first()["stat"] == total
    assert features["hppg_otshga"] == f32(f32(f32(0.157) / f32(0.314)) * f32(f32(0.56) / f32(1.12)))


def test_empty_range_and_missing_columns(rows):
    df = rows("gpg double, hgpg double, five_gpg double, hppg double", (1.0, 1.0, 1.0, 0.1))
    bounds = {**scoring.BOUNDS, "gpg": (1.0, 1.0)}
    out = scoring.normalise(df, bounds).first()
    assert out["gpg"] == 0.0 and out["tgpg"] == 0.0 and out["is_home"] == 0.0
    none = scoring.normalise(df, bounds, zero_range="null").first()
    assert none["gpg"] is None and none["hgpg"] == 0.5


def test_fitted_bounds(rows):
    df = rows(SCHEMA, (0, 1.0, 1.0, 1.0, 0.1, 1.0, 1.0, 1.0, True),
              (1, 3.0, 2.0, 4.0, 0.3, 5.0, 9.0, 2.0, False))
    fitted = scoring.fit_bounds(df)
    assert fitted.first()["max_otga"] == 9.0
    out = scoring.normalise(df, fitted, keep=["n"]).orderBy("n").collect()
    assert [r["gpg"] for r in out] == [0.0, 1.0]


def test_flat_bounds(rows):
    nested = rows("gpg struct<min: double, max: double>, hppg struct<min: double>",
                  ((0.0, 2.0), (0.1,)))
    flat = scoring.flat_bounds(nested, ("gpg", "hppg", "otga")).first()
    assert (flat["max_gpg"], flat["min_hppg"], flat["max_hppg"], flat["min_otga"]) == (
        2.0, 0.1, None, None)


def test_coerce_tier(rows):
    df = rows("t double", (1.0,), (3.0,), (4.0,), (float("nan"),), (None,), (2.5,), (0.0,))
    found = df.select(scoring.coerce_tier(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in found] == [1, 3, 0, 0, 0, 0, 0]
    text = rows("t string", ("2",), ("n/a",)).select(scoring.coerce_tier(F.col("t")).alias("t"))
    assert [r["t"] for r in text.collect()] == [2, 0]


def test_label_summary(rows):
    found = scoring.label_summary(rows("scored int", (1,), (0,), (0,), (0,))).collect()
    assert {r["scored"]: r["rows"] for r in found} == {0: 3, 1: 1}
    assert {r["mean"] for r in found} == {0.25}
