"""Packing of token sequences: best-fit decreasing with a segment tree.

Pieces of equal length are interchangeable, so the packing is computed on the
number of pieces per length (at most ``capacity`` numbers, whatever the size of
the corpus) and gives exactly the sequences that best-fit decreasing gives
piece by piece. Spark then numbers the pieces of each length and looks up the
place of each number.
"""

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from tierpick.session import stage

CAPACITY = 4096
END_ID = 1
CACHED = 250_000  # chunks and words in each of the two generations that a worker remembers
LEARNT_AT_ONCE = 1_000_000  # characters whose new words go to the tokenizer together
TEXTS_AT_ONCE = 1_000  # of an Arrow batch, which lies in the worker and beside the heap

# Texts in which lower-casing by character, canonical composition and white space
# are the same to Python and to the tokenizer, if they have no special tokens
# ("<|") either. Others are tokenized whole.
_usual = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ɏ]*").fullmatch


class RemainingCapacities:
    """Segment tree over remaining capacities; finds the tightest that is open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.size, dtype=bool)

    def set(self, remaining: int, is_open: bool):
        node = self.size + remaining
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least ``least``."""
        node = self.size + least
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                break
            node //= 2
        else:
            return None
        while node < self.size:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.size


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Best-fit decreasing over counts: (length, first, n, sequence, per_sequence, offset).

    Pieces ``first`` to ``first + n - 1`` of the length go to sequences
    ``sequence`` onwards, ``per_sequence`` to each, the first at ``offset``.
    Sequences with the same content are kept as one range of numbers.
    """
    tree = RemainingCapacities(capacity)
    ranges: dict[int, list] = {}  # remaining capacity: ranges (first sequence, how many)
    steps, made = [], 0

    def put(remaining, first, n):
        if n and remaining:
            ranges.setdefault(remaining, []).append((first, n))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        done, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                per = capacity // length
                first, n, remaining = made, -(-left // per), capacity
                made += n
            else:
                first, n = ranges[remaining].pop()
                if not ranges[remaining]:
                    tree.set(remaining, False)
                per = remaining // length
            full = min(n, left // per)
            if full:
                steps.append((length, done, full * per, first, per, capacity - remaining))
                put(remaining - per * length, first, full)
                done, left = done + full * per, left - full * per
            used = full
            if left and full < n:  # the last sequence gets fewer
                steps.append((length, done, left, first + full, per, capacity - remaining))
                put(remaining - left * length, first + full, 1)
                used, left = full + 1, 0
            put(remaining, first + used, n - used)
    return steps


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable ones stay, others follow."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Encoder:
    """Token ids of texts as bytes, little-endian and unsigned, 4 each.

    The tokenizer never joins characters across white space, nor across the
    words into which it splits a chunk. So chunks and words are looked up and
    only new words are tokenized, with the normalising steps, which have been
    done by then, taken out of the tokenizer. What is known lies in two
    generations: a full one becomes the old one, and what is used again moves
    on to the new one before the old one goes.
    """

    # The tokenizer's own split pattern (fixed value).
    words_of = regex.compile(
        r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def __init__(self, path: str):
        self.path = path
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.bare.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.letters = str.maketrans(_byte_letters())
        self.known: dict[str, bytes] = {}  # ids of chunks and words
        self.old: dict[str, bytes] = {}

    @cached_property
    def whole(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _ids(self, tokenizer, text) -> np.ndarray:
        found = tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, dtype="<u4")

    def _parts(self, chunk: str) -> list[str]:
        """The words of a chunk; most are letters and a mark at the end."""
        if chunk[:-1].isalpha() and not chunk[-1].isalnum():
            return [chunk[:-1], chunk[-1]]
        return self.words_of(chunk)

    def _learn_words(self, new: list[str]):
        written = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
                   for w in new]
        ids = self._ids(self.bare, " ".join(written))
        ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
        data = ids.tobytes()
        self.known.update(zip(new, map(data.__getitem__, map(slice, [0, *ends], ends))))

    def _recall(self, names: set[str]) -> set[str]:
        """Those that neither generation has; the others are in the new one afterwards."""
        new = names.difference(self.known)
        found = self.old.keys() & new
        self.known.update(zip(found, map(self.old.__getitem__, found)))
        return new - found

    def _learn(self, chunks: set[str]):
        """Make all chunks known at once."""
        if len(self.known) > CACHED:
            self.old, self.known = self.known, {}
        new = self._recall(chunks)
        words = set(filter(str.isalpha, new))
        mixed = list(new - words)
        parts = list(map(self._parts, mixed))
        if unknown := self._recall(words.union(*parts)):
            self._learn_words(list(unknown))
        known = self.known.__getitem__
        self.known.update(zip(mixed, [b"".join(map(known, p)) for p in parts]))

    def _group(self, texts: list[str | list[str]]) -> Iterator[bytes]:
        self._learn(set().union(*(t for t in texts if isinstance(t, list))))
        known = self.known.__getitem__
        for text in texts:
            if isinstance(text, list):
                yield b"".join(map(known, text))
            else:
                yield self._ids(self.whole, text).tobytes()

    def each(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        group, size = [], 0
        for text in texts:
            usual = _usual(text) and "<|" not in text
            group.append(text.lower().split() if usual else text)
            size += len(text)
            if size >= LEARNT_AT_ONCE:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def __call__(self, text: str) -> bytes:
        return next(self.each([text]))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_PIECES = (
    "doc_id long, piece int, start long, length int, ids_crc32 long, _task int, _local long"
)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """Token pieces of at most ``capacity``, numbered per task and length.

    The tokenizer and what it has learnt stay with a worker for its next task.
    """
    own = docs.sparkSession.sparkContext.broadcast({})  # each worker has its own copy
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        kept = own.value
        if not kept:
            kept["encoder"] = Encoder(tokenizer_path(tokenizer))
        encode = kept["encoder"].each
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            texts = (content.as_py() or "" for content in batch.column(1))
            for key, found in zip(batch.column(0).to_pylist(), encode(texts)):
                ids = found + end
                for i, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    length = len(part) // 4
                    local = seen.get(length, 0)
                    seen[length] = local + 1
                    for column, value in zip(
                            out, (key, i, at // 4, length, zlib.crc32(part), local)):
                        column.append(value)
            n = len(out[0])
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()),
                pa.array(out[4], pa.int64()), pa.array([task] * n, pa.int32()),
                pa.array(out[5], pa.int64()),
            ], names=["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_local"])

    rows = docs.select(F.col(doc_id).cast("long"), F.col(text))
    return rows.mapInArrow(run, _PIECES)


@contextmanager
def _arrow_batches(spark: SparkSession, rows: int):
    """Jobs that run inside hand at most so many rows at once to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, rows)
        yield
    finally:
        spark.conf.set(name, before)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
         tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY,
         end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its token ids and ``end_id``; only longer ones are cut
    into pieces of ``capacity``. Pieces are written once with their number
    among those of their task and length, so a lost task can't number anew.

    Null and empty texts: one piece of one id. Null ids are carried. Repeated
    rows are packed each for itself. No rows give no rows; further columns
    are ignored.
    """
    with _arrow_batches(docs.sparkSession, TEXTS_AT_ONCE):
        cut = stage(pieces(docs, doc_id, text, tokenizer, capacity, end_id), "pieces")
    each = cut.groupBy("length", "_task").agg(F.count("*").alias("_n"))
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in
              cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps = sorted(plan(counts, capacity))
    keys = [(s[0], s[1]) for s in steps]
    # As many rows per length as tasks.
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = each.select("length", "_task", F.coalesce(
        F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = cut.join(offsets, ["length", "_task"]).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("_before") + F.col("_local")).alias("_number"))

    def place(batches):
        for batch in batches:
            sequence, offset = [], []
            for length, number in zip(batch.column("length").to_pylist(),
                                      batch.column("_number").to_pylist()):
                _, first, _, at, per, start = steps[bisect_right(keys, (length, number)) - 1]
                sequence.append(at + (number - first) // per)
                offset.append(start + (number - first) % per * length)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
               "sequence_id long, offset long")
