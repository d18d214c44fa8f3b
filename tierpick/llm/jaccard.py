"""Similarity join on word shingles: rare-first prefix filtering."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierpick.llm.components import components
from tierpick.llm.dedup import spare_name
from tierpick.llm.words import Reader, scramble
from tierpick.session import stage

FLUSH = 3 << 19  # shingles that a task holds before it sends them on
LOCALLY_HOT = 256  # texts of one flush from which a shingle counts as frequent
GROUP_SHINGLES = 4 << 20  # of a range or bucket, about 0.3 GB while a task works on it
BLOCK_BYTES = 8 << 20  # of shingles
BLOCK_SETS = 512
HEADS = 3  # of a list, with which all its sets are compared first
FREQUENT = 1 << 40  # comes after all counts
PARTS = 4  # similarity of 4 / 5 = 0.8
WHOLE = 5

_U = np.uint64


def required(a, b):
    """Least overlap of sets of these sizes that are similar: ceil(4 (a + b) / 9)."""
    return -(-PARTS * (a + b) // (PARTS + WHOLE))


def prefix_length(n):
    """As many first shingles as two similar sets can't both lack."""
    return n - -(-PARTS * n // WHOLE) + 1


def _sets(reader: Reader, column: pa.Array):
    """Row, distinct sorted shingles."""
    for row, data, offsets in reader.chunks(column):
        words, _, _, bounds = reader.read(data, offsets)
        hashes, at = reader.shingles(words, bounds)
        for i in range(len(offsets) - 1):
            yield row + i, np.unique(hashes[at[i]:at[i + 1]])


def _fingerprint(shingles: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = scramble(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U)
        return scramble(np.array([total + _U(len(shingles)) * _U(0x9E3779B97F4A7C15)], _U))[0]


def shingle_sets(docs: DataFrame, key: Column, text: str) -> DataFrame:
    """Per row: doc_id (the key), n_shingles, set_id (equal for equal sets, null for empty ones)."""

    def run(batches):
        reader = Reader()
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            ids = np.zeros(batch.num_rows, dtype=_U)
            for row, shingles in _sets(reader, batch.column(1)):
                n[row] = len(shingles)
                if len(shingles):
                    ids[row] = _fingerprint(shingles)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(ids.view(np.int64), mask=n == 0)],
                names=["doc_id", "n_shingles", "set_id"])

    rows = docs.select(key.alias("doc_id"), F.col(text))
    return rows.mapInArrow(run, T.StructType([
        rows.schema["doc_id"], T.StructField("n_shingles", T.LongType()),
        T.StructField("set_id", T.LongType())]))


def _squeeze(sorted_hashes: np.ndarray) -> bytes:
    """Differences of sorted numbers, byte by byte: their many zeros then compress."""
    steps = np.diff(sorted_hashes, prepend=_U(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(_U).ravel(), dtype=_U)


_POSTINGS = "range int, kind int, hashes binary, places binary, sets binary, sizes binary"
NORMAL, PASSED_ON, NOTICE = 0, 1, 2


def _postings(docs: DataFrame, text: str, ranges: int) -> DataFrame:
    """Shingles with their sets, sorted and cut into ranges of hashes.

    Sets that are equal within a flush are sent once. A shingle in many sets
    of a flush isn't sent to its range, which could not hold it: only a notice
    goes there, its postings go on by any range.
    """

    def blobs(hashes, owner, sets, sizes, kind, edges):
        cuts = np.searchsorted(hashes, edges)
        for r in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[r], cuts[r + 1]
            used, places = np.unique(owner[lo:hi], return_inverse=True)
            small = np.uint16 if len(used) <= 1 << 16 else np.uint32
            yield (int(r), kind, _squeeze(hashes[lo:hi]), places.astype(small).tobytes(),
                   sets[used].tobytes(), sizes[used].tobytes())

    def flush(found, edges, turn):
        sets = np.array(list(found), dtype=_U)
        sizes = np.array([len(x) for x in found.values()], dtype=np.uint32)
        hashes = np.concatenate(list(found.values()))
        owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        runs = np.diff(np.append(first, len(hashes)))
        hot = np.repeat(runs >= LOCALLY_HOT, runs)
        yield from blobs(hashes[~hot], owner[~hot], sets, sizes, NORMAL, edges)
        if hot.any():
            none = np.zeros(0, np.uint32)
            notices = hashes[first[runs >= LOCALLY_HOT]]
            cuts = np.searchsorted(notices, edges)
            for r in np.flatnonzero(np.diff(cuts)):
                yield (int(r), NOTICE, _squeeze(notices[cuts[r]:cuts[r + 1]]), b"", b"",
                       none.tobytes())
            for _, *blob in blobs(hashes[hot], owner[hot], sets, sizes, PASSED_ON, edges):
                turn = (turn + 1) % ranges
                yield (turn, *blob)

    def batch_of(rows):
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
            names=["range", "kind", "hashes", "places", "sets", "sizes"])

    def run(batches):
        reader, found, held = Reader(), {}, 0
        edges = np.array([(i << 64) // ranges for i in range(ranges)], dtype=_U)
        edges = np.append(edges, _U(2**64 - 1))
        for batch in batches:
            for _, shingles in _sets(reader, batch.column(0)):
                if len(shingles):
                    key = int(_fingerprint(shingles))
                    if key not in found:
                        found[key] = shingles
                        held += len(shingles)
                if held >= FLUSH:
                    yield batch_of(list(flush(found, edges, key % ranges)))
                    found, held = {}, 0
        if found:
            yield batch_of(list(flush(found, edges, next(iter(found)) % ranges)))

    return docs.select(F.col(text)).mapInArrow(run, _POSTINGS)


_REPEATED = "bucket int, sets binary, sizes binary, hashes binary, counts binary"


def _repeated(postings: DataFrame, buckets: int) -> DataFrame:
    """Shingles of two sets or more with the number of their sets, by bucket of the set."""

    def run(table: pa.Table) -> pa.Table:
        hashes, sets, sizes, passed, notices = [], [], [], [], []
        for kind, h, p, s, n in zip(*(table.column(c).to_pylist() for c in (
                "kind", "hashes", "places", "sets", "sizes"))):
            h = _expand(h)
            if kind == NOTICE:
                notices.append(h)
                continue
            s, n = np.frombuffer(s, _U), np.frombuffer(n, np.uint32)
            p = np.frombuffer(p, np.uint16 if len(s) <= 1 << 16 else np.uint32)
            if kind == PASSED_ON:
                passed.append((h, s[p], n[p]))
            else:
                hashes.append(h), sets.append(s[p]), sizes.append(n[p])
        parts = [(*x, np.full(len(x[0]), FREQUENT, dtype=np.int64)) for x in passed]
        if hashes:
            h, s, n = map(np.concatenate, (hashes, sets, sizes))
            del hashes, sets, sizes
            order = np.argsort(h)
            ordered = h[order]
            same = ordered[1:] == ordered[:-1]
            keep = np.zeros(len(h), dtype=bool)  # all but shingles that occur once
            keep[1:] |= same
            keep[:-1] |= same
            noted = np.unique(np.concatenate(notices)) if notices else np.zeros(0, _U)
            keep |= np.isin(ordered, noted)
            order = order[keep]
            h, s, n = h[order], s[order], n[order]
            order = np.lexsort((s, h))
            h, s, n = h[order], s[order], n[order]
            fresh = np.ones(len(h), dtype=bool)  # once for each set
            fresh[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            h, s, n = h[fresh], s[fresh], n[fresh]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else []
            runs = np.diff(np.append(first, len(h))).astype(np.int64)
            count = np.repeat(runs, runs)
            count[np.isin(h, noted)] = FREQUENT
            keep = count > 1
            parts.append((h[keep], s[keep], n[keep], count[keep]))
        out = {"bucket": [], "sets": [], "sizes": [], "hashes": [], "counts": []}
        if parts:
            h, s, n, count = map(np.concatenate, zip(*parts))
            bucket = (s % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, s, n, count, bucket = (x[order] for x in (h, s, n, count, bucket))
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                at = slice(cuts[b], cuts[b + 1])
                out["bucket"].append(int(b))
                out["sets"].append(s[at].tobytes())
                out["sizes"].append(n[at].tobytes())
                out["hashes"].append(h[at].tobytes())
                out["counts"].append(count[at].tobytes())
        return pa.table(out, schema=pa.schema([
            ("bucket", pa.int32()), ("sets", pa.binary()), ("sizes", pa.binary()),
            ("hashes", pa.binary()), ("counts", pa.binary())]))

    return postings.groupBy("range").applyInArrow(run, _REPEATED)


_PREFIXES = "set_id long, n long, hash long, place long, shingles binary, prefix binary"


def _prefixes(repeated: DataFrame) -> DataFrame:
    """Prefix entries (hash, place) of the sets whose prefix holds repeated shingles.

    Rarest first, so those that occur once lead. One more row per set has all
    its repeated shingles, which are all that it can share, and its prefix
    from the first repeated shingle on.
    """

    def run(table: pa.Table) -> pa.Table:
        s, n, h, count = (
            np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()])
            for c, t in (("sets", _U), ("sizes", np.uint32), ("hashes", _U),
                         ("counts", np.int64)))
        order = np.lexsort((h, count, s))
        s, n, h, count = s[order], n[order].astype(np.int64), h[order], count[order]
        fresh = np.ones(len(s), dtype=bool)
        fresh[1:] = (s[1:] != s[:-1]) | (h[1:] != h[:-1])
        s, n, h = s[fresh], n[fresh], h[fresh]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        many = np.diff(np.append(first, len(s)))
        out: list[list] = [[], [], [], [], [], []]
        for at, m in zip(first.tolist(), many.tolist()):
            size = int(n[at])
            alone = size - m
            entries = prefix_length(size) - alone
            if entries <= 0:
                continue
            key = int(s[at:at + 1].view(np.int64)[0])
            entries = min(entries, m)
            out[0] += [key] * (entries + 1)
            out[1] += [size] * (entries + 1)
            out[2] += [*h[at:at + entries].view(np.int64).tolist(), None]
            out[3] += [*range(alone, alone + entries), alone]
            out[4] += [*[None] * entries, np.sort(h[at:at + m]).tobytes()]
            out[5] += [*[None] * entries, h[at:at + entries].tobytes()]
        return pa.table([pa.array(c, t) for c, t in zip(
            out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
            names=["set_id", "n", "hash", "place", "shingles", "prefix"])

    return repeated.groupBy("bucket").applyInArrow(run, _PREFIXES)


def _most_in_common(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """Upper bound of the overlap, from splitting both at the middle of one (suffix filter)."""
    if depth == 0 or min(len(a), len(b)) < 8:
        return min(len(a), len(b))
    middle = b[len(b) // 2]
    i, j = int(np.searchsorted(a, middle)), len(b) // 2
    return (_most_in_common(a[:i], b[:j], depth - 1)
            + _most_in_common(a[i:], b[j:], depth - 1))


def _similar(x: np.ndarray, y: np.ndarray, na: int, nb: int) -> bool:
    """Whether sets of na and nb shingles, whose repeated ones are given, are similar."""
    if _most_in_common(x, y) < required(na, nb):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= 80 * (na + nb - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, each compared once."""

    def run(batches):
        for batch in batches:
            keep = pa.array([
                _similar(np.frombuffer(x, _U), np.frombuffer(y, _U), na, nb)
                for na, nb, x, y in zip(*(batch.column(c).to_pylist()
                                          for c in ("na", "nb", "_x", "_y")))], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep)],
                names=["u", "v"])

    x = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("_x"))
    y = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("_y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "_x", "_y").mapInArrow(
        run, "u long, v long")


def _paired(x: dict, y: dict) -> list:
    """Columns of a pair, the smaller set (or of equal ones the smaller id) as a."""
    first = (x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["set_id"] < y["set_id"]))
    out = []
    for name, short in (("set_id", ""), ("n", "n"), ("place", "p")):
        out.append(F.when(first, x[name]).otherwise(y[name]).alias(f"{short}a"))
        out.append(F.when(first, y[name]).otherwise(x[name]).alias(f"{short}b"))
    return out


def _likely(pairs: DataFrame) -> DataFrame:
    """Each pair once, if its sizes and the places of a common shingle allow.

    Before the first common shingle nothing is shared, so the rest of either
    set has to hold the required overlap. Similar sets pass at that shingle;
    rows of further common shingles may fail without harm.
    """
    need = F.ceil(F.lit(PARTS) * (F.col("na") + F.col("nb")) / (PARTS + WHOLE))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return pairs.where(
        (WHOLE * F.col("na") >= PARTS * F.col("nb")) & (rest >= need)
    ).select("a", "b", "na", "nb").distinct()


def _spokes(entries: DataFrame) -> DataFrame:
    """Pairs of every set with a few heads of its lists, the same ones in most lists."""
    head = [F.min(F.struct(F.xxhash64("set_id", F.lit(k)).alias("turn"), "set_id", "n", "place"))
            .alias(f"head{k}") for k in range(HEADS)]
    heads = entries.groupBy("hash").agg(F.count("*").alias("_m"), *head).where("_m > 1").select(
        "hash", F.explode(F.array_distinct(F.array(*[f"head{k}" for k in range(HEADS)])))
        .alias("head"))
    both = entries.join(heads, "hash").where(F.col("set_id") != F.col("head.set_id"))
    one = {c: F.col(c) for c in ("set_id", "n", "place")}
    return _likely(both.select(*_paired(one, {c: F.col(f"head.{c}") for c in one})))


def _across(found: DataFrame, components_so_far: DataFrame) -> DataFrame:
    """Links between sets that share a prefix shingle but no component so far.

    Sets that such shared shingles connect form a field. A field is cut into
    blocks, and a task gets two blocks: the sets travel once per pair of
    blocks, and the pairs of sets exist only inside the task.
    """
    sets = found.where(F.col("shingles").isNotNull()).join(
        components_so_far.withColumnRenamed("node", "set_id"), "set_id", "left"
    ).withColumn("component", F.coalesce("component", "set_id"))
    lists = found.where(F.col("hash").isNotNull()).select("hash", "set_id").join(
        sets.select("set_id", "component"), "set_id")
    mixed = lists.groupBy("hash").agg(
        F.min("component").alias("_low"), F.max("component").alias("_high"),
        F.min("set_id").alias("v")).where("_low != _high").select("hash", "v")
    fields = components(lists.join(mixed, "hash").select(
        F.col("set_id").alias("u"), "v").distinct())
    fields = fields.select(F.col("node").alias("set_id"), F.col("component").alias("field"))
    # The blocks of a field are found on rows without shingles.
    small = fields.join(sets.select("set_id", F.octet_length("shingles").alias("_bytes")), "set_id")
    sizes = small.groupBy("field").agg(F.greatest(
        F.ceil(F.sum("_bytes") / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_SETS)).alias("blocks"))
    placed = fields.join(sizes, "field").join(
        sets.select("set_id", "n", "place", "shingles", "prefix", "component"), "set_id"
    ).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")))
    sent = placed.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    sent = sent.select(
        "field", F.least("block", "other").alias("low"), F.greatest("block", "other")
        .alias("high"), "block", "set_id", "n", "place", "component", "shingles", "prefix")
    return sent.groupBy("field", "low", "high").applyInArrow(_compare_blocks, "u long, v long")


def _compare_blocks(table: pa.Table) -> pa.Table:
    """Links between components, found by the prefixes of the sets of two blocks."""
    ids, n, place, component, block = (
        table.column(c).to_numpy() for c in ("set_id", "n", "place", "component", "block"))
    shingles = [np.frombuffer(x, _U) for x in table.column("shingles").to_pylist()]
    prefixes = [np.frombuffer(x, _U) for x in table.column("prefix").to_pylist()]
    two = len(np.unique(block)) > 1
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in prefixes])
    places = np.concatenate([p + np.arange(len(x)) for p, x in zip(place, prefixes)])
    hashes = np.concatenate(prefixes)
    order = np.argsort(hashes, kind="stable")
    owner, places, hashes = owner[order], places[order], hashes[order]
    edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1], [True]]))
    likely = np.zeros((len(ids), len(ids)), dtype=bool)
    for lo, hi in zip(edges[:-1], edges[1:]):
        own = owner[lo:hi]
        if hi - lo < 2 or (component[own] == component[own[0]]).all():
            continue
        rest, size = n[own] - places[lo:hi], n[own]
        need = -(-PARTS * (size[:, None] + size[None, :]) // (PARTS + WHOLE))
        fits = ((np.minimum(rest[:, None], rest[None, :]) >= need)
                & (WHOLE * size[:, None] >= PARTS * size[None, :])
                & (WHOLE * size[None, :] >= PARTS * size[:, None]))
        likely[np.ix_(own, own)] |= fits
    likely &= component[:, None] != component[None, :]
    if two:  # pairs within a block are another task's
        likely &= block[:, None] != block[None, :]
    root = {int(c): int(c) for c in component}

    def top(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links: list[tuple] = []
    for i, j in zip(*np.nonzero(np.triu(likely, 1))):
        a, b = top(int(component[i])), top(int(component[j]))
        if a != b and _similar(shingles[i], shingles[j], int(n[i]), int(n[j])):
            root[max(a, b)] = min(a, b)
            links.append((int(ids[i]), int(ids[j])))
    return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)],
                    names=["u", "v"])


def _spread(frame: DataFrame, by: str, groups: int, tasks: int) -> DataFrame:
    """The frame as it is, or over a task per two groups where those are more than the tasks."""
    return frame if groups <= 2 * tasks else frame.repartition(groups // 2, by)


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Words are runs of other bytes than space and 0x09-0x0D, A-Z in lower case;
    a text's set holds its distinct shingles of five words (all its words as
    one if there are fewer). Two texts link if their Jaccard similarity is at
    least 0.8; component_id is the least doc_id that links lead to.

    1. Shingles are counted over all distinct sets in ranges of their hash.
    2. Each set's shingles are ordered rarest first; its prefix is kept.
    3. Sets in a prefix list are compared with a few heads of the list; the
       links give first components.
    4. Pairs of a list that are still in different components are compared,
       those that length, places and suffix bounds leave, inside tasks that
       hold two blocks of sets each; every pair of sets meets in one task.

    Step 3 spares a group of near copies its square; no link between different
    components is lost. Equal sets have one id and are never compared.

    Null and empty texts and texts of blanks: empty set, own component. Null
    ids are ignored in components; such a row gets the component of its set.
    Repeated rows share a component. No rows give no rows; further columns are
    ignored.
    """
    return _grouped(docs, doc_id, text).select(
        "doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, n_shingles, set_id, _least (least id of the group, null without any)."""
    spark = docs.sparkSession
    sized = stage(shingle_sets(docs, F.col(doc_id).cast("long"), text), "shingle-sets")
    # Several ranges per task, so that tasks are even and no group is a task's whole share. As the
    # input grows, ranges and buckets grow in number, not in size.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = (sized.agg(F.sum("n_shingles")).first()[0] or 0) // GROUP_SHINGLES
    buckets, ranges = max(tasks, least), max(2 * tasks, least)
    postings = _spread(_postings(docs, text, ranges), "range", ranges, tasks)
    repeated = _spread(_repeated(postings, buckets), "bucket", buckets, tasks)
    found = stage(_prefixes(repeated), "prefixes")
    sets = found.where(F.col("shingles").isNotNull()).select("set_id", "shingles")
    entries = found.where(F.col("hash").isNotNull()).select("set_id", "n", "hash", "place")

    links = stage(_verified(_spokes(entries), sets), "star-links")
    final = components(links.unionByName(_across(found, components(links))))

    groups = sized.join(final.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "doc_id", "n_shingles", "set_id", F.coalesce("component", "set_id").alias("_group"))
    least = groups.where(F.col("_group").isNotNull()).groupBy("_group").agg(
        F.min("doc_id").alias("_least"))
    return groups.join(least, "_group", "left").drop("_group")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of similar ones, all columns: the one with the least id.

    Rows that share an id stay or go together. Rows without id stay if no row
    of their group has one, and if they have no shingles.
    """
    key = spare_name(docs, "_key")
    groups = _grouped(docs, doc_id, text)
    kept = groups.where(F.col("doc_id") == F.coalesce("_least", "doc_id"))
    named = docs.where(F.col(doc_id).isNotNull()).withColumn(key, F.col(doc_id).cast("long"))
    named = named.join(kept.select(F.col("doc_id").alias(key)), key, "left_semi")

    # Rows without id are known by their texts.
    content = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    nameless = docs.where(F.col(doc_id).isNull()).withColumn(key, content)
    sets = shingle_sets(nameless, F.col(key), text).withColumnRenamed("doc_id", key)
    led = groups.where(F.col("doc_id").isNull() & F.col("_least").isNotNull())
    gone = sets.join(led.select("set_id"), "set_id", "left_semi").select(key)
    nameless = nameless.join(gone, key, "left_anti")
    return named.select(*docs.columns).unionByName(nameless.select(*docs.columns))
