"""Tables that are replaced as a whole: a folder per version, and commits that name them.

A version is written to a folder of its own. Only when that is complete is a
small commit file created, with the next number and never over an existing one;
readers follow the newest commit. A job that fails leaves the table as it was,
a reader that has begun keeps its version, and of two jobs that replace a table
at once the second fails. Versions beyond the stated number are removed.
"""

import json
import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

KEEP_VERSIONS = 3


class Commit(NamedTuple):
    number: int
    folder: str
    label: str | None  # what the version stands for, e.g. a day; sorts as text
    note: str | None


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of a table."""
    for folder in folders:
        fs, path = _at(spark, folder)
        fs.delete(path, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _at(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """The versions that can be read, oldest first; a commit cut off while written is none."""
    found = []
    for name in sorted(n for n in _names(spark, f"{path}/_commits") if n.isdigit()):
        fs, file = _at(spark, f"{path}/_commits/{name}")
        stream = fs.open(file)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            entry = json.loads(text)
        except ValueError:
            continue
        found.append(Commit(int(name), entry["folder"], entry["label"], entry["note"]))
    return found


def _last_number(spark: SparkSession, path: str) -> int:
    return max((int(n) for n in _names(spark, f"{path}/_commits") if n.isdigit()), default=0)


def commit(df: DataFrame, path: str, label: str | None = None, note: str | None = None,
           keep: int = KEEP_VERSIONS) -> int:
    """Make these rows the newest version of the table and give its number.

    ``df`` may be read from the table itself. With labels the last version of
    each of the ``keep`` greatest labels stays, else the last ``keep`` versions.
    """
    spark = df.sparkSession
    number = _last_number(spark, path) + 1
    folder = f"version-{number:09d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{folder}")
    fs, file = _at(spark, f"{path}/_commits/{number:09d}")
    stream = fs.create(file, False)  # fails where another job has taken the number
    try:
        stream.write(bytearray(json.dumps(
            {"folder": folder, "label": label, "note": note}).encode()))
    finally:
        stream.close()
    _tidy(spark, path, keep)
    return number


def _tidy(spark: SparkSession, path: str, keep: int) -> None:
    known = commits(spark, path)
    last = {c.label: c for c in known if c.label is not None}
    if last:
        stay = {last[label].folder for label in sorted(last)[-keep:]} | {known[-1].folder}
    else:
        stay = {c.folder for c in known[-keep:]}
    for c in known:
        if c.folder not in stay:  # the commit goes first: no reader finds a half-removed version
            remove(spark, [f"{path}/_commits/{c.number:09d}"])
    # Also folders of jobs that failed before this version; later ones may still be written.
    newest = known[-1].number
    remove(spark, [f"{path}/{name}" for name in _names(spark, path)
                   if name.startswith("version-") and name not in stay
                   and int(name.split("-")[1]) <= newest])


def read(spark: SparkSession, path: str, schema: str | None = None, before: str | None = None
         ) -> DataFrame:
    """The newest version, or of those with a label below ``before`` that of the greatest label.

    Without one the table is empty, if a schema is given; else it is an error.
    """
    known = commits(spark, path)
    if before is not None:
        known = [c for c in known if c.label is not None and c.label < before]
    if known:
        newest = max(known, key=lambda c: (c.label or "", c.number))
        return spark.read.parquet(f"{path}/{newest.folder}")
    if schema is None:
        raise AnalysisException(f"[PATH_NOT_FOUND] no version of the table {path}")
    return spark.createDataFrame([], schema)
