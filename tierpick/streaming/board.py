"""Live score changes as a stream of snapshots."""

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tierpick.config import POLL_INTERVAL

_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

_SLICES_AT_ONCE = 5_000  # of an Arrow batch


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB and log changed keys only.

    A store is opened per partition and batch, so there are two partitions per
    core at most; a checkpoint keeps the number it began with.
    """
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                     2 * spark.sparkContext.defaultParallelism)
    wanted = _STATE_STORE | {"spark.sql.shuffle.partitions": str(partitions)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def poll(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None,
         files_per_batch: int | None = None) -> DataFrame:
    """Stream of snapshot files, oldest first."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _sortable(df: DataFrame, column: str) -> tuple[Column, str]:
    """A time column as a plain number or text that sorts alike, and its type."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column), "long"
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp")), "long"
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long"), "long"
    if isinstance(kind, T.IntegralType):
        return F.col(column).cast("long"), "long"
    if isinstance(kind, T.FractionalType):
        value = F.col(column).cast("double")
        return F.when(~F.isnan(value), value), "double"
    return F.col(column).cast("string"), "string"


def _filled(field: T.StructField) -> Column:
    """A column whose NaN is null."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def _same(column: pa.ChunkedArray) -> np.ndarray:
    """Rows that equal the one before them; null equals null."""
    now, before = column[1:], column[:-1]
    same = pc.or_(pc.fill_null(pc.equal(now, before), False),
                  pc.and_(pc.is_null(now), pc.is_null(before)))
    return np.concatenate([[False], same.to_numpy(zero_copy_only=False)]).astype(bool)


def _number_type(kind: pa.DataType) -> pa.DataType | None:
    """The numbers that a time is made of; others are packed as they are."""
    if pa.types.is_timestamp(kind):
        return pa.int64()
    return pa.int32() if pa.types.is_date32(kind) else None


def _lists(table: pa.Table) -> list[list]:
    """The values of each column."""
    found = []
    for column in table.columns:
        number = _number_type(column.type)
        found.append((column if number is None else column.cast(number)).to_pylist())
    return found


def _unpack(schema: pa.Schema):
    """mapInArrow body: the rows whose values were packed."""
    def column(values, kind: pa.DataType) -> pa.Array:
        number = _number_type(kind)
        return pa.array(values, kind) if number is None else pa.array(values, number).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = zip(*map(pickle.loads, batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [column(v, f.type) for v, f in zip(rows, schema)], schema=schema)

    return run


def _slice_ends(times: list[str], columns: list[str]):
    """mapInArrow body: of each slice the first and last row and those that change the score.

    The rows of a slice leave it as one packed value. A partition holds whole
    slices of one micro-batch, so it is as large as the trigger lets it be.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        sorted_by = pa.table({c: rows.column(c) for c in ["_key", "_span", *times]})
        order = pc.sort_indices(sorted_by, null_placement="at_start", sort_keys=[
            (c, "ascending") for c in sorted_by.column_names])
        ends = sorted_by.take(order)
        inner = _same(ends["_key"]) & _same(ends["_span"])
        last = ~np.append(inner[1:], False)
        kept = np.flatnonzero(~(inner & _same(rows["_score"].take(order))) | last)
        rows, inner = rows.take(order.take(pa.array(kept))), inner[kept]
        starts = np.flatnonzero(~inner)
        for at in range(0, len(starts), _SLICES_AT_ONCE):
            ends = [*starts[at:at + _SLICES_AT_ONCE + 1].tolist(), rows.num_rows]
            ends = ends[:_SLICES_AT_ONCE + 1]
            part = rows.slice(ends[0], ends[-1] - ends[0])
            packed = list(zip(
                zip(*_lists(part.select(times))), *_lists(part.select(["_score", "_done"])),
                [(pickle.dumps(row),) for row in zip(*_lists(part.select(columns)))]))
            slices = [pickle.dumps(packed[low - ends[0]:high - ends[0]])
                      for low, high in zip(ends, ends[1:])]
            keys = rows["_key"].take(pa.array(ends[:-1])).combine_chunks()
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(slices, pa.binary())], names=["_key", "_slice"])

    return run


def _follow(columns: list[str], times: list[str], expire_ms: int | None):
    """applyInPandasWithState body: rows whose score differs from the one before of their key.

    Most keys bring few rows, so these are plain tuples, and they come packed by
    slices: each operation on a frame and each column of it costs more than the
    work. Frames may also hold the columns themselves.
    """

    def plain(values):
        return [None if pd.isna(v) else v for v in values.tolist()]

    def records(frame):
        if "_slice" in frame:
            return [row for rows in frame["_slice"].tolist() for row in pickle.loads(rows)]
        return zip(zip(*(plain(frame[t]) for t in times)), frame["_score"].tolist(),
                   frame["_done"].tolist(), zip(*(frame[c].tolist() for c in columns)))

    def place(row):  # nulls first
        return [(t is not None, t) for t in row[0]]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = []
        if state.exists:
            *at, score = state.get
            rows.append((tuple(at), score, False, None))
        for frame in frames:
            rows += records(frame)
        rows.sort(key=place)
        found = [row[3] for n, row in enumerate(rows)
                 if row[3] is not None and (n == 0 or row[1] != rows[n - 1][1])]
        at, score, done, _ = rows[-1]
        if done:
            state.remove()
        else:
            state.update((*at, score))
            if expire_ms is not None:
                state.setTimeoutDuration(expire_ms)
        if found:
            yield pd.DataFrame(dict(zip(columns, zip(*found))))

    return run


def changed_snapshots(snapshots: DataFrame, key: str, time: list[str], values: list[str],
                      span: Column, done: Column | None = None,
                      expire_ms: int | None = None) -> DataFrame:
    """Stream of the snapshots that are the first of their key or differ from the one before.

    The last snapshot of a key is keyed state: a micro-batch reads and writes
    the keys it touches. Before that its rows are reduced per (key, ``span``)
    to what can matter, so a busy key is spread over tasks by its slices of
    time and brings two rows per slice plus its changes to its state.

    Keys whose last snapshot is ``done`` leave the state, and so do those
    without a snapshot for ``expire_ms`` of processing time; their next
    snapshot counts as a first one. NaN counts as null.
    """
    columns = [f"_c{i}" for i in range(len(snapshots.columns))]
    sortable = [_sortable(snapshots, c) for c in time]
    times = [f"_t{i}" for i in range(len(time))]
    over = F.lit(False) if done is None else F.coalesce(done, F.lit(False))
    rows = snapshots.select(
        F.col(key).alias("_key"), *[_filled(f).alias(c) for c, f in zip(columns, snapshots.schema)],
        *[c.alias(t) for t, (c, _) in zip(times, sortable)],
        F.to_json(F.struct(*values)).alias("_score"), over.alias("_done"), span.alias("_span"))
    state = ", ".join([*(f"{t} {kind}" for t, (_, kind) in zip(times, sortable)), "_score string"])
    slices = T.StructType([rows.schema["_key"], T.StructField("_slice", T.BinaryType())])
    reduced = rows.repartition("_key", "_span").mapInArrow(_slice_ends(times, columns), slices)
    arrow = snapshots.sparkSession.createDataFrame([], snapshots.schema).limit(0).toArrow().schema
    timeout = (GroupStateTimeout.NoTimeout if expire_ms is None
               else GroupStateTimeout.ProcessingTimeTimeout)
    found = reduced.groupBy("_key").applyInPandasWithState(
        _follow(["_row"], times, expire_ms), "_row binary", state, "append", timeout)
    return found.mapInArrow(_unpack(arrow), snapshots.schema)


def change_stream(snapshots: DataFrame, out: str, checkpoint: str, key: str, time: list[str],
                  values: list[str], span: Column, done: Column | None = None,
                  detail: Callable[[DataFrame], DataFrame] | None = None,
                  available_now: bool = False, expire_ms: int | None = None) -> StreamingQuery:
    """Write every snapshot that differs from the last one of its key (``changed_snapshots``).

    ``detail`` gives the detail rows of the keys it is handed; it is asked for
    changed keys only, and only their rows are written. ``read_detail`` gives
    what holds now. A repeated batch starts from the same state and replaces
    its own output. Timers (``expire_ms``) keep a query running, so they don't
    go with ``available_now``.
    """
    if available_now and expire_ms is not None:
        raise ValueError("a query with timers doesn't end by itself")
    schema = snapshots.schema
    found = changed_snapshots(snapshots, key, time, values, span, done, expire_ms)

    def each_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        path = f"{out}/changes/epoch={epoch}"
        batch.write.mode("overwrite").parquet(path)
        if detail is not None:
            changed = spark.read.schema(schema).parquet(path).select(key).distinct()
            detail(changed).write.mode("overwrite").parquet(f"{out}/detail/epoch={epoch}")

    writer = found.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = (
        writer.trigger(availableNow=True) if available_now
        else writer.trigger(processingTime=POLL_INTERVAL)
    )
    with keyed_state(snapshots.sparkSession):
        return writer.start()


def _epochs(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    known = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    return spark.read.schema(known).parquet(path)


def read_changes(spark: SparkSession, out: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{out}/changes").drop("epoch")


def read_detail(spark: SparkSession, out: str, key: str, key_type: str, schema: str) -> DataFrame:
    """The detail rows of each key from the last batch in which it changed."""
    last = _epochs(spark, f"{out}/changes", f"{key} {key_type}").groupBy(
        F.col(key).alias("_key")).agg(F.max("epoch").alias("_epoch"))
    rows = _epochs(spark, f"{out}/detail", schema)
    return rows.join(last, rows[key].eqNullSafe(last["_key"]) & (rows["epoch"] == last["_epoch"])
                     ).drop("_key", "_epoch", "epoch")
