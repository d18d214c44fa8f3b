"""Runs: stretches of words that repeat with a period at least three times.

A point (i, d) says that word i equals word i - d. The points of a lag d that
follow each other form a diagonal; m points give a stretch of m + d words with
period d. Words are read in order, earlier occurrences lengthen the diagonals of
their lags, and a diagonal that ends while it is long enough is a run.

Which earlier occurrences count is bounded without losing a run. A run of
period q and at least max(24, 3 q) words has max(24 - q, 2 q) points or more.
Hence a class of lags, 1 to 16, 17 to 32, 33 to 64 and so on up to g, only
needs the words that equal an earlier one together with the g - 1 words before
them, and only the last such occurrence: as g is at least q and q is the least
period, no nearer one lies inside the run. So a word adds one point per class at
most, words without a repeated context add none, and a text of n words takes
n log n steps however often its words repeat.
"""

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 24
LEAST_TIMES = 3
#: Words that are worked on together, if no single text has more.
BATCH_WORDS = 1 << 18

_FIRST_CLASS = 16  # largest lag of the first class


def _counted(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the keys at places ``at``, those that occur again: numbered keys by place, places."""
    _, keys, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = times[keys] > 1
    names = np.full(n, -1, dtype=np.int64)
    names[at[again]] = keys[again]
    return names, at[again]


def diagonals(codes: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, length and period of all runs, one class of lags after the other.

    ``codes`` are the words of many texts; equal words of one text have equal
    numbers, words of different texts different ones. ``longest`` is the number
    of words of the longest text.
    """
    n = len(codes)
    names, at = _counted(codes, np.arange(n), n)
    grams, lowest = 1, 0  # the names are those of the last ``grams`` words
    while len(at):
        if grams >= _FIRST_CLASS:
            yield _ended(names, at, grams, lowest)
            lowest = grams
        # A run of the next class has a period above ``lowest``.
        if LEAST_TIMES * (lowest + 1) > longest:
            return
        # A repeated name of twice as many words has two repeated halves.
        at = at[at >= grams]
        at = at[names[at - grams] >= 0]
        names, at = _counted(names[at - grams] * n + names[at], at, n)
        grams *= 2


def _ended(names: np.ndarray, at: np.ndarray, grams: int, lowest: int):
    order = np.argsort(names[at], kind="stable")  # by name, then by place
    places = at[order]
    same = names[places[1:]] == names[places[:-1]]
    i = places[1:][same]
    lag = i - places[:-1][same]
    fits = (lag > lowest) & (lag <= grams)
    i, lag = i[fits], lag[fits]
    order = np.argsort(i, kind="stable")
    i, lag = i[order], lag[order]
    first = np.ones(len(i), dtype=bool)
    first[1:] = (i[1:] != i[:-1] + 1) | (lag[1:] != lag[:-1])
    first = np.flatnonzero(first)
    points = np.diff(np.append(first, len(i))) + grams - 1
    period = lag[first]
    length = points + period
    enough = length >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
    start = i[first] - (grams - 1) - period
    return start[enough], length[enough], period[enough]


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """Of each list of words the runs (start, length, period) by start, then period."""
    sizes = [len(words) for words in texts]
    codes = np.empty(sum(sizes), dtype=np.int64)
    number, at = count(), 0
    for words in texts:
        codes[at:at + len(words)] = list(
            map(defaultdict(number.__next__).__getitem__, words))
        at += len(words)
    found = list(diagonals(codes, max(sizes, default=0)))
    out: list[list] = [[] for _ in texts]
    if found:
        start, length, period = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((period, start))
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, start[order], "right")
        first = start[order] - (ends - sizes)[text]
        for t, *run in zip(text.tolist(), first.tolist(), length[order].tolist(),
                           period[order].tolist()):
            out[t].append(tuple(run))
    return out


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats: all of it after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return [words[k] for k in np.flatnonzero(kept).tolist()]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, runs (array of start, length, period), collapsed.

    Words are separated by blanks (0x20 and 0x09 to 0x0D) and numbered from 0.
    ``runs`` lists all stretches with least period q and at least 24 and 3 q
    words that can't be extended, by start, then period. ``collapsed`` is the
    text with one period of each run left, its words joined by one space.

    Null, empty or blank text: no runs, empty collapsed text. Texts are worked
    on whole; equal rows each give their own row; a null id stays null. No rows
    give no rows, further columns are ignored. Nothing is shuffled.
    """
    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            first, texts, waiting = 0, [], 0
            for row in range(len(batch) + 1):
                if row == len(batch) or waiting >= BATCH_WORDS:
                    yield _found(ids.slice(first, len(texts)), texts)
                    first, texts, waiting = row, [], 0
                if row < len(batch):
                    texts.append((column[row].as_py() or b"").split())
                    waiting += len(texts[-1])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,"
                                "period:long>>, collapsed string")


def _found(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
    found = runs_of(texts)
    left = [b" ".join(kept_words(words, runs)) for words, runs in zip(texts, found)]
    listed = [[dict(zip(("start", "length", "period"), run)) for run in runs] for runs in found]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(listed, pa.list_(RUN)), pa.array(left, pa.binary()).cast(pa.string())],
        names=["doc_id", "runs", "collapsed"])


def digest(found: DataFrame) -> DataFrame:
    """From the rows of ``find``: number of runs, the most repeated run, checksums.

    The most repeated run has the greatest exact length / period, compared by
    cross-multiplication; ties go to the smallest start, then period.
    """
    def better(a: Column, b: Column) -> Column:
        return a["length"] * b["period"] > b["length"] * a["period"]

    most = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.try_element_at("runs", F.lit(1)),
        lambda best, run: F.when(better(run, best), run).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_most", most).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_most.start", "_most.length",
        "_most.period",
        F.expr("1000 * _most.length div _most.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents of which about one in ten gets a periodic end, by its id.

    h = crc32 of the decimal id, g = h div 10; with h % 10 = 0 each word i from
    a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8).
    A null id or a text without words stays as it is.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    marked = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), h.alias("_h"),
        F.when(h % 10 == 0, words).alias("_words"))
    marked = marked.withColumn("_g", F.expr("_h div 10")).withColumn("_n", F.size("_words"))
    placed = marked.withColumn("_a", F.expr("if(_n > 0, int(_g % _n), null)"))
    placed = placed.withColumn("_p", F.expr("int(1 + (_n - _a) div (3 + _g % 8))"))
    rewritten = F.array_join(F.expr(
        "transform(_words, (w, i) -> "
        "element_at(_words, 1 + if(i < _a, i, _a + (i - _a) % _p)))"), " ")
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), rewritten)
                         .otherwise(F.col("text")).alias("text"))
