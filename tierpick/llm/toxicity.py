"""Toxicity of whole texts: boosted trees over dense features, calibrated by isotonic regression."""

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierpick.llm import boosting
from tierpick.llm.words import Reader, not_alphanumeric, scramble
from tierpick.session import stage

MOST_LABELS = 16_000  # labelled rows that the classifier is fitted on
MOST_WORDS = 50_000  # words of toxic texts that are looked at for the lexicon
MOST_ENTRIES = 5_000  # of the lexicon
LEAST_TEXTS = 4  # different toxic texts that an entry occurs in
LEAST_WEIGHT = 2.0  # log-odds of an entry
THRESHOLD = 0.7
FOLDS = 3
PREFIXES = (4, 5, 6)
NEAR = 8  # words
WINDOW = 32  # words

# --- fixed values -----------------------------------------------------------
INSULTS = (
    "idiot moron stupid scum trash loser pathetic worthless disgusting clown dumb jerk fool "
    "imbécile crétin connard salaud ordure débile abruti minable "
    "idiota imbécil estúpido basura asqueroso inútil payaso tonto cretino "
    "dumm dummkopf trottel abschaum müll widerlich wertlos versager vollidiot"
).split()
SECOND_PERSON = (
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos tú ti tus usted ustedes "
    "vosotros du dich dir dein deine deinen ihr euch euer sie ihnen"
).split()
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
FILLERS = "*.-_'^~"
# ----------------------------------------------------------------------------

_U = np.uint64
_TOXIC, _CLEAN = 1, 0


class Words:
    """Word hashes of a piece of texts, plain and with obfuscation undone."""

    def __init__(self):
        self.reader = Reader(not_alphanumeric(), fold_latin=True)
        self.plain = np.arange(256, dtype=np.uint8)
        for a, b in LOOKALIKES.items():
            self.plain[ord(a)] = ord(b)
        self.filler = np.zeros(256, dtype=bool)
        self.filler[[ord(c) for c in FILLERS]] = True
        code = np.arange(256)
        self.upper = (code >= 65) & (code <= 90)
        self.letter = self.upper | ((code >= 97) & (code <= 122)) | (code >= 128)
        self.digit = (code >= 48) & (code <= 57)
        self.shout = (code == 33) | (code == 63)
        self.other = (code < 128) & ~self.letter & ~self.digit & ~self.shout & (code > 32)

    def hash_of(self, words) -> np.ndarray:
        text = pa.array([" ".join(words)])
        _, data, offsets = next(self.reader.chunks(text))
        return np.unique(self.reader.read(data, offsets)[0])

    def undone(self, data, offsets):
        """The texts with look-alikes as letters and fillers between letters left out."""
        inside = self.letter | self.digit
        drop = np.zeros(len(data), dtype=bool)
        solid = inside[data] | np.isin(data, [ord("@"), ord("$")])
        mixed = self.filler[data]
        drop[1:-1] = mixed[1:-1] & (solid[:-2] | mixed[:-2]) & (solid[2:] | mixed[2:])
        drop[np.minimum(offsets[:-1], max(len(data) - 1, 0))] = False
        kept = np.concatenate([[0], np.cumsum(~drop)])
        return self.plain[data[~drop]], kept[offsets]

    def prefixes(self, data, offsets, starts, ends):
        """(which word, hash of its first bytes) for all prefix lengths."""
        which, hashes = [], []
        low = self.reader.lower[data].astype(_U)
        for n in PREFIXES:
            at = np.flatnonzero(ends - starts > n)
            h = np.full(len(at), n, dtype=_U)
            for k in range(n):
                h = scramble(h * _U(257) + low[starts[at] + k])
            which.append(at), hashes.append(h)
        return np.concatenate(which), np.concatenate(hashes)


def _lexicon_counts(batches, only=None):
    """Texts per fold and word or prefix (kind 0 or 1), counted in each batch."""
    words = Words()
    for batch in batches:
        folds = np.asarray(batch.column(1).to_numpy(), dtype=np.int64)
        seen = []  # kind and fold, hash
        for row, data, offsets in words.reader.chunks(batch.column(0)):
            h, starts, ends, bounds = words.reader.read(data, offsets)
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            which, p = words.prefixes(data, offsets, starts, ends)
            for kind, hashes, owner in ((0, h, text), (1, p, text[which])):
                if only is not None:
                    known = np.isin(hashes, only[kind])
                    hashes, owner = hashes[known], owner[known]
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                fresh = np.ones(len(hashes), dtype=bool)
                fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                seen.append((kind * FOLDS + folds[row + owner[fresh]], hashes[fresh]))
        group = np.concatenate([g for g, _ in seen]) if seen else np.zeros(0, np.int64)
        hashes = np.concatenate([h for _, h in seen]) if seen else np.zeros(0, _U)
        for k in range(2 * FOLDS):
            unique, n = np.unique(hashes[group == k], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(unique), k // FOLDS, np.int32)),
                 pa.array(np.full(len(unique), k % FOLDS, np.int32)),
                 pa.array(unique.view(np.int64)), pa.array(n.astype(np.int64))],
                names=["kind", "fold", "hash", "n"])


_COUNTS = "kind int, fold int, hash long, n long"


class LexiconCounts:
    """Numbers of toxic and clean texts per word and prefix and fold, from (text, toxic, fold)."""

    def __init__(self, texts: DataFrame):
        self.sizes = {kind: np.zeros(FOLDS) for kind in (_TOXIC, _CLEAN)}
        for r in texts.groupBy("toxic", "fold").count().collect():
            self.sizes[r["toxic"]][r["fold"]] = r["count"]
        counted = (
            texts.where("toxic = 1").select("text", "fold").mapInArrow(_lexicon_counts, _COUNTS)
            .groupBy("kind", "hash").pivot("fold", list(range(FOLDS))).agg(F.sum("n"))
            .na.fill(0)
        )
        all_folds = sum(F.col(str(k)) for k in range(FOLDS))
        top = (counted.withColumn("n", all_folds).where(F.col("n") >= LEAST_TEXTS)
               .orderBy(F.desc("n"), "kind", "hash").limit(MOST_WORDS).collect())
        self.toxic = {(r["kind"], r["hash"]): np.array([r[str(k)] for k in range(FOLDS)])
                      for r in top}
        only = {kind: np.array(sorted(h for k, h in self.toxic if k == kind),
                               dtype=np.int64).view(_U) for kind in (0, 1)}
        self.clean = {key: np.zeros(FOLDS) for key in self.toxic}
        rows = (
            texts.where("toxic = 0").select("text", "fold")
            .mapInArrow(partial(_lexicon_counts, only=only), _COUNTS)
            .groupBy("kind", "fold", "hash").agg(F.sum("n").alias("n")).collect()
        )
        for r in rows:
            self.clean[r["kind"], r["hash"]][r["fold"]] = r["n"]

    def lexicon(self, without: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Words (0) and prefixes (1) with their log-odds, from all folds or all but one."""
        keep = np.arange(FOLDS) != (-1 if without is None else without)
        n_toxic, n_clean = (self.sizes[k][keep].sum() for k in (_TOXIC, _CLEAN))
        best: dict[int, list] = {0: [], 1: []}
        for (kind, entry), n in self.toxic.items():
            n, others = n[keep].sum(), self.clean[kind, entry][keep].sum()
            weight = np.log((n + 0.5) / (n_toxic + 1)) - np.log((others + 0.5) / (n_clean + 1))
            if n >= min(LEAST_TEXTS, LEAST_TEXTS * keep.mean()) and weight >= LEAST_WEIGHT:
                best[kind].append((weight, entry))
        out = {}
        for kind, found in best.items():
            found = sorted(found, reverse=True)[:MOST_ENTRIES]
            hashes = np.array([h for _, h in found], dtype=np.int64).view(_U)
            order = np.argsort(hashes)
            out[kind] = (hashes[order], np.array([w for w, _ in found], dtype=float)[order])
        return out


FEATURES = (
    "length", "lexicon_density", "lexicon_weight", "lexicon_hits", "lexicon_entries",
    "heaviest_entry", "insult_density", "prefix_density", "prefix_hits", "second_person_near",
    "densest_window", "capitals", "shouts", "punctuation", "mixed_words", "undone_density",
    "undone_hits",
)


class Features:
    """Dense features of the texts of a column; ids, labels, language and source aren't seen."""

    def __init__(self, lexicon: dict):
        self.words, self.lexicon = Words(), lexicon
        self.insults = self.words.hash_of(INSULTS)
        self.second = self.words.hash_of(SECOND_PERSON)

    @staticmethod
    def _find(hashes, entries):
        known, weights = entries
        if not len(known):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes)), np.zeros(
                len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[at] == hashes
        return hit, np.where(hit, weights[at], 0.0), at

    def _piece(self, data, offsets) -> np.ndarray:
        w, n = self.words, len(offsets) - 1
        h, starts, ends, bounds = w.reader.read(data, offsets)
        counts = np.diff(bounds)
        text = np.repeat(np.arange(n), counts)
        per = np.maximum(counts, 1)

        def total(values, owner=text):
            return np.bincount(owner, values, n)

        hit, weight, entry = self._find(h, self.lexicon[0])
        at = np.flatnonzero(hit)
        pairs = np.unique(np.stack([text[at], entry[at]]), axis=1)
        heaviest = np.zeros(n)
        np.maximum.at(heaviest, text[at], weight[at])
        insult = np.isin(h, self.insults)
        which, prefix = w.prefixes(data, offsets, starts, ends)
        prefix_hit = np.zeros(len(h), dtype=bool)
        prefix_hit[which[self._find(prefix, self.lexicon[1])[0]]] = True
        bad = hit | insult
        second = np.flatnonzero(np.isin(h, self.second))
        marks = np.flatnonzero(bad)
        near = np.zeros(len(marks), dtype=bool)
        if len(second) and len(marks):
            right = np.minimum(np.searchsorted(second, marks), len(second) - 1)
            for other in (second[right], second[np.maximum(right - 1, 0)]):
                near |= (np.abs(other - marks) <= NEAR) & (text[other] == text[marks])
        running = np.concatenate([[0], np.cumsum(bad)])
        stop = np.minimum(marks + WINDOW, bounds[text[marks] + 1])
        densest = np.zeros(n)
        np.maximum.at(densest, text[marks], running[stop] - running[marks])

        def bytes_of(mask):
            sums = np.concatenate([[0], np.cumsum(mask[data])])
            return sums[offsets[1:]] - sums[offsets[:-1]]

        letters = np.maximum(bytes_of(w.letter), 1)
        size = np.maximum(np.diff(offsets), 1)
        digits = np.concatenate([[0], np.cumsum(w.digit[data])])
        letter = np.concatenate([[0], np.cumsum(w.letter[data])])
        mixed = (digits[ends] > digits[starts]) & (letter[ends] > letter[starts])
        data2, offsets2 = w.undone(data, offsets)
        h2, _, _, bounds2 = w.reader.read(data2, offsets2)
        text2 = np.repeat(np.arange(n), np.diff(bounds2))
        hit2 = self._find(h2, self.lexicon[0])[0] | np.isin(h2, self.insults)
        hits = total(bad)
        undone = np.maximum(total(hit2, text2) - hits, 0)
        return np.stack([
            np.log1p(counts), total(hit) / per, total(weight) / per, np.log1p(total(hit)),
            np.log1p(np.bincount(pairs[0], minlength=n)), heaviest, total(insult) / per,
            total(prefix_hit) / per, np.log1p(total(prefix_hit)),
            total(near, text[marks]) / per, densest, bytes_of(w.upper) / letters,
            bytes_of(w.shout) / size, bytes_of(w.other) / size, total(mixed) / per,
            undone / per, np.log1p(undone)], axis=1)

    def __call__(self, column: pa.Array) -> np.ndarray:
        parts = [self._piece(data, offsets)
                 for _, data, offsets in self.words.reader.chunks(column)]
        return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


class Classifier:
    """Everything that scoring needs; plain arrays of bounded size."""

    def __init__(self, lexicon, cuts, model, margins, rates):
        self.lexicon, self.cuts, self.model = lexicon, cuts, model
        self.margins, self.rates = margins, rates

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.full(len(features), self.rates)
        margin = self.model.margin(boosting.binned(features, self.cuts))
        score = np.interp(margin, self.margins, self.rates)
        # Margins beyond the outermost rates keep their order.
        return np.clip(score + 1e-6 * np.tanh(margin / 10), 0.0, 1.0)


def training_part(column):
    """crc32 of the id as text, modulo 3, isn't 1."""
    return F.crc32(column.cast("string").cast("binary")) % 3 != 1


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
          text: str = "text", toxic: str = "toxic") -> Classifier:
    """Fit on at most 16,000 labelled rows, picked evenly by a hash of the id.

    Equal texts count once. Each fold gets its features by the lexicon of the
    other folds, and its margins for the calibration by trees grown on them,
    so that neither has seen the text. With labels of one kind only, or none,
    every score is their mean (0 without labels).
    """
    picked = (
        labels.where(training_part(F.col(doc_id)) & F.col(toxic).isNotNull())
        .groupBy(F.col(doc_id).alias("_label_id")).agg(F.max(toxic).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("_label_id"), "_label_id").limit(MOST_LABELS)
    )
    # The sample has at most MOST_LABELS rows of two numbers.
    sample = stage(
        docs.select(F.col(doc_id).alias("_label_id"), F.coalesce(F.col(text), F.lit(""))
                    .alias("text")).join(F.broadcast(picked), "_label_id")
        .withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
        .groupBy(F.xxhash64("text", F.lit(1)).alias("_text"))
        .agg(F.min(F.struct("toxic", "fold", "text")).alias("row")).select("row.*"), "labelled")
    counts = LexiconCounts(sample)
    lexicons = [counts.lexicon(without=k) for k in range(FOLDS)]

    def run(batches):
        features = [Features(x) for x in lexicons]
        for batch in batches:
            for k in range(FOLDS):
                own = batch.filter(pc.equal(batch.column(2), k))
                yield pa.RecordBatch.from_arrays(
                    [own.column(1), own.column(2),
                     pa.array(list(features[k](own.column(0))), pa.list_(pa.float64()))],
                    names=["toxic", "fold", "values"])

    rows = sample.select("text", "toxic", "fold").mapInArrow(
        run, "toxic int, fold int, values array<double>").collect()
    label = np.array([r["toxic"] for r in rows])
    whole = counts.lexicon()
    if len(set(label.tolist())) < 2:
        return Classifier(whole, None, None, None, float(label.mean()) if len(label) else 0.0)
    # In one order, however the rows came: sums of floats depend on it.
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["toxic"], rows[i]["values"]))
    label, fold = label[order], np.array([rows[i]["fold"] for i in order])
    values = np.array([rows[i]["values"] for i in order])
    cuts = boosting.quantile_cuts(values)
    bins = boosting.binned(values, cuts)
    margin = np.zeros(len(label))
    for k in range(FOLDS):
        others = fold != k
        if len(set(label[others].tolist())) < 2:
            others[:] = True
        margin[fold == k] = boosting.fit(bins[others], label[others]).margin(bins[fold == k])
    return Classifier(whole, cuts, boosting.fit(bins, label), *boosting.isotonic(margin, label))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          toxic: str = "toxic") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from 0.7 on).

    Whole texts are scored in one pass without a shuffle. Null and empty texts
    are scored by their features, all of which are 0. Null ids: not held out.
    Repeated rows are scored each. No rows give no rows; further columns are
    ignored, also where labels have columns of the same names.
    """
    classifier = train(docs, labels, doc_id, text, toxic)

    def run(batches):
        features = Features(classifier.lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(classifier.score(features(batch.column(1))))],
                names=["doc_id", "score"])

    scored = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(~training_part(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id",
               text: str = "text", toxic: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns, without a shuffle."""
    classifier = train(docs, labels, doc_id, text, toxic)
    at = docs.columns.index(text)

    def run(batches):
        features = Features(classifier.lexicon)
        for batch in batches:
            fine = classifier.score(features(batch.column(at))) < THRESHOLD
            yield batch.filter(pa.array(fine))

    return docs.mapInArrow(run, docs.schema)
