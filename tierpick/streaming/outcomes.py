"""Late outcomes and daily picks as streams."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tierpick.operators.history import fill_outcomes
from tierpick.session import scratch, stage
from tierpick.sources import versions
from tierpick.sources.tables import archive, read_archive, scan

KEPT_BATCHES = 8  # versions of the history that stay, with the notes of their batches


def _started(stream: DataFrame, body, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a query keeps as long as its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def outcome_stream(outcomes: DataFrame, history_path: str, today, checkpoint: str,
                   available_now: bool = False) -> StreamingQuery:
    """Fill outcomes into the history as they arrive.

    The history is a versioned table that has to be there (``versions.commit``):
    each micro-batch reads its newest version and commits the next, noting the
    query and the batch, so a batch that is repeated is applied once and a query
    with a new checkpoint goes on from what is there. A batch that fills
    nothing commits nothing. What no outcome matches stays null. Outcomes of
    days before the oldest one kept arrive too late: ``late_outcomes`` lists them.
    """

    def each_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        note = f"{_query_id(spark, checkpoint)} {epoch}"
        if note in (c.note for c in versions.commits(spark, history_path)):
            return
        with scratch(spark):
            before = versions.read(spark, history_path)
            batch = stage(batch.dropDuplicates(["date", "id", "scored"]), "outcomes")
            oldest = before.agg(F.min("date")).scalar()
            batch.where(F.col("date") < oldest).write.mode("overwrite").parquet(
                f"{history_path}/_late/{note.replace(' ', '-')}")
            in_time = batch.where(F.col("date") >= oldest)
            after = stage(fill_outcomes(before, in_time, today).select(*before.columns), "filled")
            if after.exceptAll(before).limit(1).count():
                versions.commit(after, history_path, note=note, keep=KEPT_BATCHES)

    return _started(outcomes, each_batch, checkpoint, available_now)


def late_outcomes(spark: SparkSession, history_path: str, schema: str) -> DataFrame:
    """Outcomes that came after their day had left the history."""
    # Folders that begin with an underscore are read when they are named.
    return scan(spark, f"{history_path}/_late/*", schema=schema)


def archive_stream(candidates: DataFrame, path: str, checkpoint: str,
                   available_now: bool = False) -> StreamingQuery:
    """Archive candidates by date and id; what comes again replaces itself.

    A date may come in several micro-batches: its other candidates stay. The
    dates that a batch touches are staged with it by ``archive``, as they are
    rewritten. Dates are folders that the commit lists, so they are broadcast.
    """

    def each_batch(batch: DataFrame, epoch: int) -> None:
        with scratch(batch.sparkSession):
            batch = stage(batch, "arrived")
            known = read_archive(batch.sparkSession, path, schema=batch.schema)
            keys = batch.select("date", F.col("id").alias("_id")).distinct()
            dates = F.broadcast(batch.select("date").distinct())
            rest = known.join(dates, "date", "left_semi").join(
                keys, (known["date"] == keys["date"]) & known["id"].eqNullSafe(keys["_id"]),
                "left_anti")
            archive(batch.unionByName(rest.select(*batch.columns)), path)

    return _started(candidates, each_batch, checkpoint, available_now)
