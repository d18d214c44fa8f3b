"""Scoring and the weight grid for SQL text: functions of the session, made of SQL only."""

from pyspark.sql import SparkSession

from tierpick.config import BOUNDS, WEIGHTED, WEIGHTS

_COUNTS = [f"k{i}" for i in range(len(WEIGHTED))]


def _single(value) -> str:
    return f"CAST({value!r} AS FLOAT)" if isinstance(value, float) else f"CAST({value} AS FLOAT)"


def _unit(feature: str, low: float, high: float) -> str:
    """Min-max normalised in float32; an empty range gives 0."""
    span = f"({_single(float(high))} - {_single(float(low))})"
    share = f"CAST(try_divide({_single(feature)} - {_single(float(low))}, {span}) AS FLOAT)"
    return f"IF({span} > 0, {share}, CAST(0 AS FLOAT))"


def predict_body(bounds=BOUNDS, weights=WEIGHTS) -> str:
    """The score as SQL text over the raw features and ``home``."""
    unit = {x: _unit(x, *bounds[x]) for x in bounds}
    features = unit | {"hppg_otshga": f"({unit['hppg']} * {unit['otshga']})",
                       "is_home": "CAST(home AS FLOAT)"}
    return " + ".join(f"{features[w]} * {_single(float(weights[w]))}" for w in WEIGHTED)


def register(spark: SparkSession, bounds=BOUNDS, weights=WEIGHTS) -> None:
    """Make ``tier_score`` and ``weight_grid`` known to the SQL of this session.

    ``tier_score(gpg, hgpg, five_gpg, tgpg, otga, otshga, hppg, home)`` equals
    ``scoring.predict``. ``weight_grid(steps)`` is a table of all weight vectors
    with the steps of each, as ``grid.weight_grid``; each part is exploded up to
    what the parts before leave.
    """
    raw = ", ".join(f"{x} DOUBLE" for x in bounds)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tier_score({raw}, home BOOLEAN) RETURNS FLOAT "
              f"RETURN {predict_body(bounds, weights)}")
    views, left = "", "steps"
    for k in _COUNTS[:-1]:
        views += f" LATERAL VIEW explode(sequence(0, {left})) AS {k}"
        left += f" - {k}"
    step = "CAST(1D / steps AS FLOAT)"
    parts = [*_COUNTS[:-1], f"({left})"]
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION weight_grid(steps INT) RETURNS TABLE("
        f"{', '.join(f'{k} INT' for k in _COUNTS)}, {', '.join(f'{w} FLOAT' for w in WEIGHTED)}) RETURN "
        f"SELECT {', '.join(parts)}, "
        f"{', '.join(f'CAST({k} AS FLOAT) * {step}' for k in parts)} FROM (SELECT 1) AS one{views}")
