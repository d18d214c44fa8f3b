"""Normalisation, interaction feature and linear score, in float32."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierpick.config import BOUNDS, TIERS, WEIGHTED, WEIGHTS

# Features that count as 0 where they are missing.
_OPTIONAL = ("tgpg", "otga", "otshga")


def _single(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def min_max(value: Column, low, high, zero_range: str = "zero") -> Column:
    """(value - low) / (high - low), rounded to float32 like the inputs.

    Not clamped. An empty range gives 0.0, or null with ``zero_range="null"``.
    """
    low, span = _single(low), _single(high) - _single(low)
    quotient = F.try_divide(_single(value) - low, span).cast("float")
    if zero_range == "null":
        return F.when(span != 0, quotient)
    if zero_range != "zero":
        raise ValueError("zero_range is 'zero' or 'null'")
    return F.when(span > 0, quotient).otherwise(_single(0.0))


def fit_bounds(df: DataFrame, features=tuple(BOUNDS)) -> DataFrame:
    """One row with ``min_x`` and ``max_x`` of every feature."""
    return df.agg(
        *[F.min(x).cast("float").alias(f"min_{x}") for x in features],
        *[F.max(x).cast("float").alias(f"max_{x}") for x in features],
    )


def flat_bounds(nested: DataFrame, features=tuple(BOUNDS)) -> DataFrame:
    """Columns ``{min, max}`` per feature -> ``min_x``, ``max_x``; missing ones null."""

    def pick(feature, end):
        known = feature in nested.columns and end in nested.schema[feature].dataType.names
        return F.col(f"{feature}.{end}") if known else F.lit(None).cast("double")

    return nested.select(
        *[pick(x, end).alias(f"{end}_{x}") for x in features for end in ("min", "max")]
    )


def _bound_pairs(bounds) -> dict:
    """Bounds given as a dict, or as the one-row frame of ``fit_bounds``."""
    if not isinstance(bounds, DataFrame):
        return dict(bounds)
    row = bounds.select(F.struct(*bounds.columns).alias("b")).scalar()
    return {x: (row.getField(f"min_{x}"), row.getField(f"max_{x}")) for x in BOUNDS}


def feature_columns(df: DataFrame, bounds=BOUNDS, zero_range: str = "zero") -> dict[str, Column]:
    """Expressions of the seven weighted features of a candidate frame."""
    pairs = _bound_pairs(bounds)

    def raw(feature):
        if feature not in _OPTIONAL:
            return F.col(feature)
        if feature not in df.columns:
            return F.lit(0.0)
        return F.coalesce(F.col(feature), F.lit(0.0))

    unit = {x: min_max(raw(x), *pairs[x], zero_range=zero_range) for x in pairs}
    home = F.col("home").cast("float") if "home" in df.columns else _single(0.0)
    return {
        **{x: unit[x] for x in ("gpg", "five_gpg", "hgpg", "tgpg", "otga")},
        "hppg_otshga": unit["hppg"] * unit["otshga"],
        "is_home": home,
    }


def normalise(df: DataFrame, bounds=BOUNDS, zero_range: str = "zero", keep=()) -> DataFrame:
    """The ``keep`` columns and the seven weighted features."""
    features = feature_columns(df, bounds, zero_range)
    return df.select(*keep, *[features[x].alias(x) for x in WEIGHTED])


def weighted_sum(features: dict[str, Column], weights=WEIGHTS) -> Column:
    """Sum of feature times weight, added in the fixed order."""
    total = None
    for name in WEIGHTED:
        term = features[name] * _single(weights[name])
        total = term if total is None else total + term
    return total


def predict(df: DataFrame, bounds=BOUNDS, weights=WEIGHTS, out: str = "stat",
            zero_range: str = "zero") -> DataFrame:
    """Add the score of every candidate. One projection, no shuffle."""
    return df.withColumn(out, weighted_sum(feature_columns(df, bounds, zero_range), weights))


def coerce_tier(tims: Column) -> Column:
    """Tier as an int; whatever is not 0..3 becomes 0."""
    value = tims.cast("string").try_cast("double")
    return F.when(value.isin(*[float(t) for t in TIERS]), value.cast("int")).otherwise(0)


def labelled(df: DataFrame) -> DataFrame:
    """Candidates with a known outcome in one of the tiers."""
    return df.where(F.col("scored").isin(0, 1) & F.col("tims").isin(*TIERS))


def labelled_dates(df: DataFrame) -> DataFrame:
    """Number of dates with labelled candidates."""
    return labelled(df).agg(F.countDistinct("date").alias("dates"))


def label_summary(df: DataFrame, label: str = "scored") -> DataFrame:
    """Rows per label and its mean over all rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("rows"))
    mean = counts.agg(F.sum(F.col(label) * F.col("rows")) / F.sum("rows")).scalar()
    return counts.select(label, "rows", mean.alias("mean"))
