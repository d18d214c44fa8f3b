"""Spans of pattern matches in whole texts, with DataFrame functions only.

Places count code points, ends are exclusive. Nothing is shuffled.
"""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, match).

    The text between the matches comes from a split at them; adding up the
    lengths gives the places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add,
                       lambda done: done["out"])


def found_where(gate: Column, text: Column, pattern: str) -> Column:
    """The matches, looked for only where a cheap condition allows any."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(gate, found(text, pattern)).otherwise(none)


def of_kind(spans: Column, kind: int) -> Column:
    """(start, kind, end), which sorts as spans are listed."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def written(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end, joined by commas, by start, then by kind."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def apart_from(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(
        others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))


def leftmost(spans: Column) -> Column:
    """Of overlapping spans the one that starts first, then the longest."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"],
                         a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    kept = F.slice(spans, 1, 0)

    def add(done: Column, s: Column) -> Column:
        clash = (F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"])
        return F.when(clash, done).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(order, kept, add)


def counts(column: str, kinds: Sequence[str]) -> list[Column]:
    """n_<kind> of the spans."""
    def count(kind: int) -> Column:
        return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")

    return [count(k).alias(f"n_{name}") for k, name in enumerate(kinds)]
