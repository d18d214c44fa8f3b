"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search."""

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierpick.llm.words import SHINGLE, Reader, not_alphanumeric, scramble

SIMILARITY = 0.8
BITS = 128
BLOCKS = 16  # of 8 bits
# At similarity 0.8 the shingle vectors of equally long texts without repeated shingles have cosine
# 8 / 9, so each bit differs with probability 0.15: 19 of 128 with deviation 4. Beyond 40 are 1.3 in
# a million. Repeated shingles lower the cosine, so they do not go by fingerprints.
RADIUS = 40
ITEMS_AT_ONCE = 5000
WINDOWS_AT_ONCE = 256
FILTER_BITS = 22

_U = np.uint64


def _reader() -> Reader:
    return Reader(not_alphanumeric(), fold_latin=True)


def _bits(shingles: np.ndarray) -> np.ndarray:
    """+1 and -1 for the 128 hash bits of each shingle."""
    both = np.stack([shingles, scramble(shingles ^ _U(0x6A09E667F3BCC909))], axis=-1)
    bits = np.unpackbits(both.view(np.uint8), axis=-1).astype(np.int8)
    return 2 * bits - 1


def simhash(windows: np.ndarray) -> np.ndarray:
    """Fingerprints (16 bytes) of rows of shingles; a repeated shingle weighs more."""
    return np.packbits(_bits(windows).sum(axis=-2, dtype=np.int32) > 0, axis=-1)


class HammingIndex:
    """Finds all fingerprints within the radius.

    A fingerprint within the radius differs in at most radius / blocks bits in
    one block at least. For every block and value the index has the items
    whose block is that near, as bits.
    """

    def __init__(self, fingerprints: np.ndarray, radius: int = RADIUS):
        self.fingerprints, self.radius = fingerprints, radius
        ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)
        self.ones = ones.astype(np.uint8)
        values = np.arange(256, dtype=np.uint8)[:, None]
        self.near = np.stack([
            np.packbits(self.ones[values ^ fingerprints[:, b]] <= radius // BLOCKS, axis=1)
            for b in range(BLOCKS)])

    def search(self, fingerprint: np.ndarray) -> np.ndarray:
        found = np.bitwise_or.reduce(self.near[np.arange(BLOCKS), fingerprint], axis=0)
        found = np.flatnonzero(np.unpackbits(found, count=len(self.fingerprints)))
        apart = self.ones[self.fingerprints[found] ^ fingerprint].sum(axis=1)
        return found[apart <= self.radius]


def _repeats(windows: np.ndarray) -> np.ndarray:
    """Whether a row holds a shingle more than once."""
    windows = np.sort(windows, axis=-1)
    return (windows[..., 1:] == windows[..., :-1]).any(axis=-1)


class Sharing:
    """Finds all items that share a shingle with a window, or those of them with repeats."""

    def __init__(self, items: list[np.ndarray]):
        self.lists = []
        for repeated in (False, True):
            own = [(k, np.unique(x)) for k, x in enumerate(items) if not repeated or _repeats(x)]
            shingles = np.concatenate([x for _, x in own] or [np.zeros(0, _U)])
            owner = np.concatenate([np.full(len(x), k) for k, x in own] or [np.zeros(0, int)])
            order = np.argsort(shingles, kind="stable")
            self.lists.append((shingles[order], owner[order].astype(np.int64)))

    def search(self, window: np.ndarray, repeated: bool = False) -> np.ndarray:
        shingles, owner = self.lists[repeated]
        if not len(shingles):
            return owner
        window = np.unique(window)
        first = np.searchsorted(shingles, window, "left")
        last = np.searchsorted(shingles, window, "right")
        return np.unique(np.concatenate([owner[a:b] for a, b in zip(first, last)]))


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of shingles, weighted by how often they occur."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    return both / (len(a) + len(b) - both)


class Benchmark:
    """A block of items, prepared for search."""

    def __init__(self, ids: list, texts: list):
        self.reader = _reader()
        self.items: list[tuple] = []  # id, words, shingles
        for (row, data, offsets) in self.reader.chunks(pa.array(texts, pa.string())):
            words, _, _, bounds = self.reader.read(data, offsets)
            shingles, at = self.reader.shingles(words, bounds)
            for i in range(len(offsets) - 1):
                if bounds[i + 1] > bounds[i]:
                    self.items.append((ids[row + i], int(bounds[i + 1] - bounds[i]),
                                       shingles[at[i]:at[i + 1]]))
        self.passes: dict[int, dict] = {}  # by words per shingle
        for number, (_, n, shingles) in enumerate(self.items):
            group = self.passes.setdefault(min(n, SHINGLE), {})
            group.setdefault(len(shingles), []).append(number)
        for size, lengths in self.passes.items():
            known = np.unique(np.concatenate(
                [self.items[k][2] for numbers in lengths.values() for k in numbers]))
            quick = np.zeros(1 << FILTER_BITS, dtype=bool)
            quick[known >> _U(64 - FILTER_BITS)] = True
            by_length = {}
            for length, numbers in lengths.items():
                own = np.unique(np.concatenate([self.items[k][2] for k in numbers]))
                prints = np.stack([simhash(self.items[k][2]) for k in numbers])
                by_length[length] = (np.array(numbers), own, HammingIndex(prints),
                                     Sharing([self.items[k][2] for k in numbers]))
            self.passes[size] = {"quick": quick, "known": known, "lengths": by_length}

    def search(self, column: pa.Array) -> Iterator[tuple]:
        """(row, item id, similarity, first word, words) for each text and item, best window."""
        for row, data, offsets in self.reader.chunks(column):
            words, _, _, bounds = self.reader.read(data, offsets)
            for size, one in self.passes.items():
                shingles, at = self.reader.shingles(words, bounds, size)
                hits = np.flatnonzero(one["quick"][shingles >> _U(64 - FILTER_BITS)])
                hits = hits[np.isin(shingles[hits], one["known"])]
                texts = np.searchsorted(at, hits, "right") - 1
                for text in np.unique(texts):
                    places = hits[texts == text] - at[text]
                    for found in self._text(shingles[at[text]:at[text + 1]], places, one):
                        yield (row + int(text), *found)

    def _text(self, shingles, places, one):
        for length, (numbers, own, index, sharing) in one["lengths"].items():
            # Only windows that share enough shingles with the items can be similar; each of
            # them can be moved on to start at a shared one, or as far as the text goes.
            shared = places[np.isin(shingles[places], own)]
            width = min(length, len(shingles))
            least = -(-4 * (length + width) // 9)
            if len(shared) < least or 5 * width < 4 * length:
                continue
            starts = np.unique(np.minimum(shared, len(shingles) - width))
            inside = (np.searchsorted(shared, starts + width)
                      - np.searchsorted(shared, starts))
            starts = starts[inside >= least]
            best: dict[int, tuple] = {}
            for at in range(0, len(starts), WINDOWS_AT_ONCE):
                some = starts[at:at + WINDOWS_AT_ONCE]
                windows = shingles[some[:, None] + np.arange(width)]
                repeated = _repeats(windows)
                for start, window, fingerprint, again in zip(
                        some, windows, simhash(windows), repeated):
                    near = sharing.search(window) if again else np.union1d(
                        index.search(fingerprint), sharing.search(window, repeated=True))
                    for k in near:
                        number = int(numbers[k])
                        item, n, target = self.items[number]
                        similarity = weighted_similarity(window, target)
                        if similarity >= SIMILARITY and similarity > best.get(number, (0,))[0]:
                            best[number] = (similarity, int(start), n)
            for number, (similarity, start, n) in sorted(best.items()):
                yield self.items[number][0], similarity, start, n


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list]]:
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(text)).toLocalIterator()
    while block := list(islice(rows, ITEMS_AT_ONCE)):
        yield [r[0] for r in block], [r[1] for r in block]


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id",
                 text: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """Pairs: doc_id, item_id, similarity, first_word, n_words.

    A text has an item if a window of as many words as the item is at least
    0.8 similar by shingles of five words, each weighted by how often it
    occurs (items of fewer words: all their words as one). Words are runs of
    ASCII letters and digits and of other bytes than ASCII, Latin letters in
    lower case. One row per text and item, with its best window, the first of
    equals.

    The items are a stated query set, held in blocks of 5,000; each block goes
    once over all texts, in one pass without a shuffle.

    Null and empty texts and items: never found. Null ids are carried.
    Repeated rows are reported each. Empty tables give no rows; further
    columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text))
    names = ["doc_id", "item_id", "similarity", "first_word", "n_words"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    out = None
    for ids, texts in _blocks(benchmark, item_id, item_text):

        def run(batches, ids=ids, texts=texts):
            items = Benchmark(ids, texts)
            for batch in batches:
                keys = batch.column(0)
                found = [(keys[row].as_py(), *rest) for row, *rest in items.search(batch.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 5, kinds)],
                    names=names)

        part = rows.mapInArrow(
            run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.limit(0).selectExpr(
            "doc_id", "0L AS item_id", "0D AS similarity", "0L AS first_word", "0L AS n_words")
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns, without a shuffle."""
    at = docs.columns.index(text)
    for ids, texts in _blocks(benchmark, item_id, item_text):

        def run(batches, ids=ids, texts=texts):
            items = Benchmark(ids, texts)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for row, *_ in items.search(batch.column(at)):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
