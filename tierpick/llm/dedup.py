"""Exact duplicates by content sort."""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tierpick.session import stage

MOST_HOT = 20_000  # no more texts than this can be split
START = 48  # characters of a text that splitters hold
LEAST_HOT = 100  # rows of one text below which it is never split


def spare_name(df: DataFrame, name: str) -> str:
    """The name, longer by as many underscores as it takes to be none of the frame's."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Normalised texts are range-partitioned at sampled splitters (by their
    start, then a hash) and sorted, spilling to disk if need be, so equal texts
    are neighbours; whole texts are compared, hashes alone never decide. The row with the largest id stays.

    A text with more than max(100, rows / 20,000) copies is cut into parts by
    a hash of the id before it is shuffled. Each part sends one row with its
    text on, and those are compared in full again.

    Null text: equal to empty. Null id: sorts last, stays only if all ids of
    its text are null. Rows equal in id and text: one is kept. An empty table
    gives no rows; columns besides id and text are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), normalised(F.col(text)).alias("_norm"))
    rows = rows.withColumn("_hash", F.xxhash64("_norm"))
    limit = max(LEAST_HOT, -(-docs.count() // MOST_HOT))
    hot = (
        rows.groupBy("_hash").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
        .select("_hash", F.ceil(F.col("_n") / limit).alias("_parts"))
    )
    # At most MOST_HOT rows, as each stands for more than rows / MOST_HOT.
    salted = rows.join(F.broadcast(hot), "_hash", "left").select(
        "_id", "_norm", "_hash", F.col("_parts").isNotNull().alias("_hot"),
        F.when(F.col("_parts").isNull(), 0)
        .otherwise(F.pmod(F.xxhash64(F.col("_id")), F.col("_parts"))).alias("_salt"))
    # Splitters are sampled from starts and hashes of texts, so that the sample stays small. The
    # range partitioning also serves the windows, which compare whole texts: one shuffle, one sort.
    salted = salted.withColumn("_start", F.substring("_norm", 1, START))
    ranged = salted.repartitionByRange("_start", "_hash", "_salt")
    group = Window.partitionBy("_start", "_hash", "_salt", "_norm")
    place = F.row_number().over(group.orderBy(F.col("_id").desc_nulls_last()))
    sized = ranged.select(
        "*", place.alias("_place"), F.max("_id").over(group).alias("_keep"),
        F.count("*").over(group).alias("_size"))
    head = F.col("_hot") & (F.col("_place") == 1)
    parts = stage(sized.select(
        "_id", "_hot", "_salt", "_place", "_keep", "_size",
        F.sha2(F.col("_norm").cast("binary"), 256).alias("_sha"),
        F.when(head, F.col("_norm")).alias("_head")), "content-sort")
    heads = parts.where(F.col("_head").isNotNull())
    whole = heads.groupBy("_head").agg(
        F.max("_keep").alias("_whole_keep"), F.sum("_size").alias("_whole_size"))
    merged = heads.join(whole, "_head").select(
        "_sha", "_salt", "_whole_keep", "_whole_size",
        F.row_number().over(
            Window.partitionBy("_sha").orderBy(F.col("_keep").desc_nulls_last(), "_salt")
        ).alias("_rank"))

    def out(frame, keep, size, first):
        return frame.select(
            F.col("_id").alias(doc_id), keep.alias("keep_id"), size.alias("group_size"),
            first.alias("kept"), F.col("_sha").alias("text_sha256"))

    cold = parts.where(~F.col("_hot"))
    warm = parts.where("_hot").join(merged, ["_sha", "_salt"])
    first = F.col("_place") == 1
    return out(cold, F.col("_keep"), F.col("_size"), first).unionByName(
        out(warm, F.col("_whole_keep"), F.col("_whole_size"), first & (F.col("_rank") == 1)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without exact copies, all columns; of equal texts the largest id stays.

    Rows equal in id and text are copies as well: one of them stays.
    """
    key, content = names = [spare_name(docs, n) for n in ("_key", "_sha")]

    def keyed(frame, sha):
        # A null id is a key like any other.
        return frame.withColumns({key: F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
                                  content: sha})

    kept = keyed(exact_groups(docs, doc_id, text).where("kept"), F.col("text_sha256"))
    rows = keyed(docs, F.sha2(normalised(F.col(text)).cast("binary"), 256))
    return rows.join(kept.select(*names), names, "left_semi").dropDuplicates(names).select(
        *docs.columns)
