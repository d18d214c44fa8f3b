"""Registry, table access and the frames that many bindings share."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierpick.config import WEIGHTED, WEIGHTS
from tierpick.session import run_dir, stage  # noqa: F401

QUERIES: dict = {}
SQL: dict = {}

# Total order of lineitem rows, used to break ties.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
ORDER_SQL = ", ".join(ORDER)

# Bounds of the table columns that stand for the features.
BOUNDS = {
    "gpg": (0.0, 50.0),
    "hgpg": (0.0, 105000.0),
    "five_gpg": (0.0, 0.1),
    "tgpg": (0.0, 500000.0),
    "otga": (0.0, 1000.0),
    "otshga": (-1000.0, 10000.0),
    "hppg": (0.0, 0.08),
}
TODAY = "2001-06-01"
YESTERDAY = "2001-05-31"


def query(name: str, sql: str | None = None):
    """Register a binding under its key, with its SQL twin."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def land(df: DataFrame, name: str) -> str:
    """Write a frame as JSON feed files; give their folder."""
    path = run_dir(df.sparkSession, name)
    df.write.json(path)
    return path


def iso(column="date"):
    return F.col(column).cast("string").alias(column)


def six(column: str):
    """A float as a double with six decimals."""
    return F.round(F.col(column).cast("double"), 6).alias(column)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidates: date, tier, outcome, features, identity."""
    rows = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    supplier = table(spark, sf_dir, "supplier")
    joined = (
        rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")).otherwise(0).alias("tims"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("scored"),
        (F.col("l_linestatus") == "O").alias("home"),
        F.col("l_quantity").alias("gpg"),
        F.col("l_extendedprice").alias("hgpg"),
        F.col("l_discount").alias("five_gpg"),
        F.col("l_tax").alias("hppg"),
        F.col("o_totalprice").alias("tgpg"),
        F.col("p_retailprice").alias("otga"),
        F.col("s_acctbal").alias("otshga"),
        F.col("l_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("team_id"),
        *ORDER,
    )


CAND = f"""cand AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
    CASE WHEN l_linenumber <= 3 THEN l_linenumber ELSE 0 END AS tims,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS scored,
    l_linestatus = 'O' AS home,
    l_quantity AS gpg, l_extendedprice AS hgpg, l_discount AS five_gpg, l_tax AS hppg,
    o_totalprice AS tgpg, p_retailprice AS otga, s_acctbal AS otshga,
    l_suppkey AS id, s_name AS name, s_nationkey AS team_id,
    {ORDER_SQL}
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey)"""


def unit_sql(feature: str, bounds=BOUNDS) -> str:
    low, high = (f"CAST({x} AS FLOAT)" for x in bounds[feature])
    return f"((CAST({feature} AS FLOAT) - {low}) / ({high} - {low}))"


def feature_sql(name: str, bounds=BOUNDS) -> str:
    if name == "hppg_otshga":
        return f"({unit_sql('hppg', bounds)} * {unit_sql('otshga', bounds)})"
    if name == "is_home":
        return "CAST(CASE WHEN home THEN 1 ELSE 0 END AS FLOAT)"
    return unit_sql(name, bounds)


def score_sql(weights=WEIGHTS, bounds=BOUNDS) -> str:
    return " + ".join(
        f"{feature_sql(w, bounds)} * CAST({weights[w]} AS FLOAT)" for w in WEIGHTED
    )


SCORED = f"{CAND}, scored_rows AS (SELECT *, {score_sql()} AS stat FROM cand)"
PICKED = f"""{SCORED}, picks AS (
  SELECT * FROM scored_rows WHERE tims BETWEEN 1 AND 3
  QUALIFY row_number() OVER (PARTITION BY date, tims ORDER BY stat DESC, {ORDER_SQL}) = 1)"""

STAT_SQL = "round(CAST(stat AS DOUBLE), 6) AS stat"
DATE_SQL = "CAST(date AS VARCHAR) AS date"
