"""Tables: scans, training extract, replace, append, archive partitions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tierpick import schemas
from tierpick.config import RETENTION_DAYS, TRAINING_FEATURES
from tierpick.operators.bets import unbooked
from tierpick.operators.skew import number_rows, split_hot
from tierpick.session import stage
from tierpick.sources import extract, versions

_NOT_NUMERIC = ("date", "name")
_HIDDEN_ON_BOARD = ("team_abbr", "home", "hppg", "otshga", "Scored", "position")
_HIDDEN_IN_HISTORY = ("home", "hppg", "otshga")


def scan(spark: SparkSession, path: str, columns=("*",), eq=None, schema: str | None = None
         ) -> DataFrame:
    """Columns of a table, with one optional (column, value) equality."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if schema is None or error.getCondition() not in (
            "PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"
        ):
            raise
        table = spark.createDataFrame([], schema).limit(0)  # joins with it cost nothing
    if eq is not None:
        table = table.where(F.col(eq[0]) == eq[1])
    return table.select(*columns)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """What ``replace_table`` wrote last."""
    return versions.read(spark, path, schema)


def read_board(spark, path):
    return read_table(spark, path, schemas.BOARD)


def read_metric(spark, path):
    return read_table(spark, path, schemas.METRIC)


# --- training extract -------------------------------------------------------

def read_extract(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows, gzip or plain; fields that a row lacks are null."""
    return spark.read.schema(schema).json(path)


def land_extract(bodies: DataFrame, schema: str, column: str = "entries") -> DataFrame:
    """base64(gzip(JSON array)) responses -> rows.

    The JVM has no gunzip function, so tasks unpack a response piece by piece
    and send its elements on as they come; only the packed text has to fit into
    a cell. A response that ends early or is no JSON array fails the job; null
    and empty ones have no rows.
    """
    found = bodies.select(F.col(column).cast("string")).mapInArrow(extract.cut, "element string")
    row = F.from_json("element", StructType.fromDDL(schema)).alias("_e")
    return found.select(row).select("_e.*")


def align_fields(older: DataFrame, newest: DataFrame) -> DataFrame:
    """Rows of both with the fields of the newest; what a row lacks is null."""
    known = set(older.columns)
    filled = older.select(*[
        F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name)
        for f in newest.schema.fields
    ])
    return filled.unionByName(newest)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """CSV with all columns but date and name as numbers; what is no number is null."""
    text = spark.read.option("header", True).csv(path)
    return text.select(*[
        F.col(c) if c in _NOT_NUMERIC else F.col(c).try_cast("double").alias(c)
        for c in text.columns
    ])


def complete_rows(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[*TRAINING_FEATURES, "scored"])


# --- sinks ------------------------------------------------------------------

def replace_table(df: DataFrame, path: str) -> None:
    """The table holds exactly these rows afterwards; no rows empty it.

    Until the new rows are complete, and if the job fails, readers see the old ones.
    """
    versions.commit(df, path)


def without(df: DataFrame, hidden) -> DataFrame:
    """The table without its hidden columns; names it lacks don't matter."""
    return df.drop(*hidden)


def with_player_id(players: DataFrame) -> DataFrame:
    """``player_id`` in place of ``id``; where both are there, ``id`` fills its nulls."""
    if "player_id" not in players.columns:
        return players.withColumnRenamed("id", "player_id")
    if "id" in players.columns:
        return players.withColumn("player_id", F.coalesce("player_id", "id"))
    return players


def _numbered(df: DataFrame, order: list[str], hidden) -> DataFrame:
    """Numbered rows without the hidden columns.

    Scores and picks are costly, so their joins run once and the sorted rows are
    written; only hidden columns that the order needs are sorted along.
    """
    carried = without(df, [c for c in hidden if c not in order])
    return without(number_rows(carried, order, written=True), hidden)


def board_rows(players: DataFrame, today, order: list[str]) -> DataFrame:
    """Rows of today's board: date, player_id, and id by position in ``order``."""
    if "player_id" not in players.columns:
        order = ["player_id" if c == "id" else c for c in order]
    dated = with_player_id(players).withColumn("date", F.lit(today).cast("date"))
    return _numbered(dated, order, _HIDDEN_ON_BOARD)


def publish_board(players: DataFrame, today, order: list[str], path: str) -> None:
    replace_table(board_rows(players, today, order), path)


def history_rows(history: DataFrame, order: list[str]) -> DataFrame:
    return _numbered(history, order, _HIDDEN_IN_HISTORY)


def write_version(df: DataFrame, path: str, version, keep: int = RETENTION_DAYS) -> None:
    """Write a table's state of a day beside the older ones; a re-run replaces its own.

    The last ``keep`` days stay.
    """
    versions.commit(df, path, label=str(version), keep=keep)


def read_version(spark: SparkSession, path: str, schema: str, before=None) -> DataFrame:
    """Latest state of a table, optionally the latest before a day."""
    return versions.read(spark, path, schema, before=None if before is None else str(before))


def write_metric(metric: DataFrame, path: str) -> None:
    """Replace the metric; without a new one the table stays as it is."""
    row = metric.limit(1).collect()  # one row by definition
    if row:
        replace_table(metric.sparkSession.createDataFrame(row, metric.schema), path)


def append_ledger(rows: DataFrame, ledger: DataFrame, path: str) -> None:
    unbooked(rows, ledger).write.mode("append").option("header", True).csv(path)


def archive(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Replace the dates that ``df`` holds; other dates stay. Safe to repeat.

    A large date is written by several tasks. ``df`` may be read from the archive.
    """
    df = stage(df, "archived")  # counted and written: its joins run once
    parts = split_hot(df, ["date"], df.columns, rows_per_file)
    (
        parts.repartition("date", "part").drop("part")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date").parquet(path)
    )


def rewrite_dates(rows: DataFrame, dates: DataFrame, path: str) -> None:
    """Replace the given dates of the archive by ``rows``, also where none are left.

    ``rows`` may be derived from the archive itself: tasks write to a staging
    folder, and the old files go only when all rows have been read.
    """
    left = rows.select("date").distinct()
    emptied = dates.select("date").distinct().join(left, "date", "left_anti").collect()
    archive(rows, path)
    versions.remove(rows.sparkSession, [f"{path}/date={r['date']}" for r in emptied])


def read_archive(spark: SparkSession, path: str, date=None, schema=None) -> DataFrame:
    """All rows of the archive, or those of one date (partition pruned).

    With a schema an archive that isn't there yet is empty.
    """
    table = scan(spark, path, schema=schema)
    return table if date is None else table.where(F.col("date") == F.lit(date).cast("date"))
