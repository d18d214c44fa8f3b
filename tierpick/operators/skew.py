"""Working on groups of any size.

A group that is too large for one task is cut into parts by a hash of its
rows, so every row lands in exactly one part however often a task is re-run.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tierpick.config import MAX_GROUP_ROWS
from tierpick.session import stage


def split_hot(df: DataFrame, keys: list[str], spread: list[str],
              max_rows: int = MAX_GROUP_ROWS, part: str = "part") -> DataFrame:
    """Add ``part``: 0 in groups of up to ``max_rows`` rows, a hash class beyond.

    Only the groups beyond the limit are joined back, at most
    rows / max_rows of them; so they are broadcast and the rows stay where they are.
    """
    hot = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > max_rows)
        .select(*[F.col(k).alias(f"_{k}") for k in keys],
                F.ceil(F.col("_n") / max_rows).alias("_parts"))
    )
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        match = same if match is None else match & same
    spot = F.pmod(F.xxhash64(*spread), F.col("_parts"))
    return df.join(F.broadcast(hot), match, "left").select(
        *df.columns,
        F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(spot).cast("int").alias(part),
    )


def bounded_lists(df: DataFrame, keys: list[str], order: list[str], item: Column, out: str,
                  max_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Documents of bounded size: one ordered list per group, several (``part``) for larger ones.

    For feeds that deliver in pages. Operators number rows with ``placed`` instead.
    """
    parts = split_hot(df.withColumn("_item", item), keys, order, max_rows)
    # Else the grouping could take over the partitioning by keys of the join above.
    parts = parts.repartition(*keys, "part")
    packed = F.sort_array(F.collect_list(F.struct(*order, "_item")))
    return parts.groupBy(*keys, "part").agg(
        F.transform(packed, lambda x: x.getField("_item")).alias(out)
    )


_ROW_BITS = 33  # monotonically_increasing_id: partition above, row in the partition below


_MOST_RANGES = 1024    # splitters are literals of the plan
_SAMPLED = 20          # rows sampled per range


def _splitters(df: DataFrame, order: list[str], ranges: int) -> list:
    """Rows that cut the table into about equal ranges, from a sample of bounded size."""
    sample = df.select(*order, F.rand(17).alias("_turn")).orderBy("_turn").limit(_SAMPLED * ranges)
    rows = sample.drop("_turn").orderBy(*order).collect()
    step = max(1, -(-len(rows) // ranges))
    return rows[step::step]


def _literal(value, kind: T.DataType) -> Column:
    """A value of any type that sorts, as a literal of that type."""
    if value is not None and isinstance(kind, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    if value is not None and isinstance(kind, T.ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def _range_of(df: DataFrame, order: list[str], splitters: list) -> Column:
    """Number of the range of a row: how many splitters it is not below, by halving."""
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order)])
    kinds = [df.select(c).schema[0].dataType for c in order]

    def literal(values) -> Column:
        return F.struct(*[_literal(v, k).alias(f"c{i}")
                          for i, (v, k) in enumerate(zip(values, kinds))])

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(row < literal(splitters[middle]), among(low, middle)).otherwise(
            among(middle + 1, high))

    return among(0, len(splitters))


def number_rows(df: DataFrame, order: list[str], out: str = "id",
                partitions: int | None = None, written: bool = False) -> DataFrame:
    """Number the rows 1..n in the given order without one task seeing them all.

    A sample gives splitters, which stay in the plan as literals. Rows are
    counted per range, dealt to their range, sorted there and numbered from
    where the ranges before end. Nothing is written; a task that is run again
    finds the same ranges and numbers. ``df`` is computed three times (twice
    for the order's columns only) and has to give the same rows each time;
    ``order`` has to be a total order.

    With ``written`` the sorted rows are written once and read back instead,
    for results that are read several times or rows that are costly to compute.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, low = F.monotonically_increasing_id(), (1 << _ROW_BITS) - 1
    if written:
        ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        dealt = stage(ranged.withColumn("_at", at), "numbered")
        dealt = dealt.withColumns({"_range": F.shiftright("_at", _ROW_BITS),
                                   "_place": F.col("_at").bitwiseAND(low) + 1})
        sizes = dealt
    else:
        splitters = _splitters(df, order, min(partitions, _MOST_RANGES))
        sizes = df.withColumn("_range", _range_of(df, order, splitters))
        dealt = sizes.repartitionById(len(splitters) + 1, F.col("_range")).sortWithinPartitions(
            *order).withColumn("_place", at.bitwiseAND(low) + 1)
    # As many rows as ranges.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.groupBy("_range").agg(F.count("*").alias("_size")).select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return dealt.join(F.broadcast(offsets), "_range").select(
        *[c for c in df.columns if c != out],
        (F.col("_offset") + F.col("_place")).cast("long").alias(out)
    )


def placed(df: DataFrame, keys: list[str], order: list[str], out: str = "place") -> DataFrame:
    """Number the rows of each key 0.. in the given order, however many it has.

    The rows of a key are numbered through a range-sorted table; no task and no
    list holds a whole key.
    """
    numbered = number_rows(df, [*keys, *order], out="_number", written=True)  # read twice
    first = numbered.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.min("_number").alias("_first"))
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        match = same if match is None else match & same
    return numbered.join(first, match).select(
        *df.columns, (F.col("_number") - F.col("_first")).alias(out))
