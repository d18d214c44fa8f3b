"""Personal data: high-recall generators, boosted trees, calibrated thresholds."""

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierpick.llm import boosting, pii_samples, spans
from tierpick.session import stage

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95  # on the held-out half, for spans beyond the base patterns
CONTEXT = 24  # characters before a candidate that are looked at

# --- fixed values -----------------------------------------------------------
# Base patterns, written so that they never go back: a run is tried from its
# start only (or from where the match before ended).
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GATES = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){13}",
    "phone": r"\+[0-9]",
}
# Further forms; they may overlap each other and the base spans.
FURTHER = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++"
             r"(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z./])[0-9]{4}([./])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:00[0-9]{1,3}[ .-]?|\([0-9]{2,4}\) ?)[0-9]{2,4}[ .-]"
             r"[0-9]{3,4}(?:[ .-]?[0-9]{2,4})?(?![0-9A-Za-z])",
}
FURTHER_GATES = {
    "email": r"[\[(](?:at|AT)[\])]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[./][0-9]{4}",
    "phone": r"00[0-9]|\([0-9]{2,4}\)",
}
CUES = (
    "(?i)(mail|e-mail|courriel|correo|contact|kontakt|phone|tel|call|mobile|fax|telefon|teléfono|"
    "card|karte|carte|tarjeta|visa|ip|host|server|address|adresse)[^A-Za-z0-9]*$"
)
DECOYS = (
    r"(?i)(?<![a-z])(order|invoice|no|nr|ref|reference|version|release|build|isbn|serial|pages?|"
    r"bestell[a-z]*|rechnung[a-z]*|seiten?|commande|facture|pedido|factura|ticket|mac|eui|ratio|"
    r"model|part|item|batch|lot)[^A-Za-z0-9]*$"
)
# ----------------------------------------------------------------------------


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, n - i, F.lit(1)).cast("int")
        double = digit * 2
        return total + F.when(i % 2 == 0, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    n = F.char_length(digits)
    if kind == "ip":
        def small(part: Column) -> Column:
            part = F.ltrim(part, F.lit("0"))
            return (F.char_length(part) <= 2) | (part.between("100", "255")
                                                 & (F.char_length(part) == 3))

        return F.forall(F.split(match, "[.]"), small)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def valid_further(kind: str, match: Column) -> Column:
    """The check of further forms: of IPv6 addresses eight groups, else that of the kind."""
    if kind == "ip":
        return match.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    return valid(kind, match)


def _side(character: Column) -> Column:
    return (F.when(character == "", 0).when(character.rlike(r"\s"), 1)
            .when(character.rlike(r"[0-9]"), 2).when(character.rlike(r"\p{L}"), 3).otherwise(4))


FEATURES = ("length", "dots", "breaks", "left", "right", "cue", "decoy", "opening", "first",
            "widest", "tail", "loose")


def _candidates(text: Column, spans_found: Column, kind: str) -> Column:
    """Further spans with what the trees see, format and context, and with the check."""

    def one(s: Column) -> Column:
        match = s["match"]
        before = F.substr(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1,
                          F.least(s["start"], F.lit(CONTEXT)))
        parts = F.transform(F.regexp_extract_all(match, F.lit("[A-Za-z0-9]+"), F.lit(0)),
                            lambda p: F.char_length(p))
        return F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
            s["end"].alias("end"), valid_further(kind, match).alias("valid"),
            F.least((F.char_length(match) / 4).cast("int"), F.lit(10)).alias("length"),
            F.least(F.regexp_count(match, F.lit(r"\.")), F.lit(4)).alias("dots"),
            F.least(F.regexp_count(match, F.lit("[ ()/-]")), F.lit(4)).alias("breaks"),
            _side(F.substr(before, F.char_length(before), F.lit(1))).alias("left"),
            _side(F.substr(text, s["end"] + 1, F.lit(1))).alias("right"),
            before.rlike(CUES).cast("int").alias("cue"),
            before.rlike(DECOYS).cast("int").alias("decoy"),
            F.when(match.rlike("^[3-6]"), 0).when(match.rlike("^[0-9]"), 1)
            .when(match.rlike("^[^A-Za-z]"), 2).when(match.rlike("^[A-Z]"), 3).otherwise(4)
            .alias("opening"),
            F.least(F.element_at(parts, 1), F.lit(6)).alias("first"),
            F.least(F.array_max(parts), F.lit(8)).alias("widest"),
            F.when(match.rlike("[0-9]$"), 0).when(match.rlike("[^A-Za-z][A-Z][a-z]+$"), 1)
            .when(match.rlike("[^A-Za-z][a-z]{2,3}$"), 2).otherwise(3).alias("tail"),
            match.rlike(r"[^ ]\. ").cast("int").alias("loose"))

    return F.transform(spans_found, one)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base spans that pass their check, further candidates with features.

    One pass over the texts.
    """
    body = F.col("_text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit(""))
                       .alias("_text"))
    for name, patterns, gates in (("_base", BASE, GATES), ("_more", FURTHER, FURTHER_GATES)):
        rows = rows.select("*", *[
            spans.found_where(body.rlike(gates[k]), body, patterns[k]).alias(f"{name}_{k}")
            for k in KINDS])

    def right(kind: str) -> Column:
        return spans.of_kind(F.filter(f"_base_{kind}", lambda s: valid(kind, s["match"])),
                             KINDS.index(kind))

    return rows.select(
        "doc_id", F.concat(*[right(k) for k in KINDS]).alias("base"),
        F.concat(*[_candidates(body, F.col(f"_more_{k}"), k) for k in KINDS]).alias("further"))


def labelled(spark: SparkSession) -> dict[int, np.ndarray]:
    """Per kind: rows of features, label and part of the made sentences' candidates.

    Only candidates that pass the check are learnt from, so it can't be what
    the trees learn. Part 1 is held out.
    """
    made = pii_samples.sentences()
    truth = {number: (KINDS.index(kind), start, end, true)
             for number, _, kind, start, end, true in made}
    docs = spark.createDataFrame([(m[0], m[1]) for m in made], "doc_id int, text string")
    found = candidates(docs).select("doc_id", F.explode("further").alias("c")).where("c.valid")
    rows: dict[int, list] = {kind: [] for kind in range(len(KINDS))}
    # As many rows as there are made sentences.
    for r in found.select("doc_id", "c.*").orderBy("doc_id", "start", "kind").collect():
        kind, start, end, true = truth[r["doc_id"]]
        label = true and (r["kind"], r["start"], r["end"]) == (kind, start, end)
        rows[r["kind"]].append([*[r[f] for f in FEATURES], label, r["doc_id"] // len(KINDS) % 2])
    return {kind: np.array(own, dtype=np.int64) for kind, own in rows.items()}


def train(rows: dict[int, np.ndarray]) -> dict[int, tuple[boosting.Model, float]]:
    """Per kind: the model, and the margin from which held-out precision is high enough."""
    out = {}
    for kind, table in rows.items():
        bins, label, held = table[:, :-2], table[:, -2], table[:, -1] == 1
        model = boosting.fit(bins[~held], label[~held], trees=20, depth=3)
        centres, rates = boosting.isotonic(model.margin(bins[held]), label[held])
        if rates[-1] >= PRECISION:
            # Where the line through the calibrated rates reaches it.
            at = int(np.argmax(rates >= PRECISION))
            before = slice(max(at - 1, 0), at + 1)
            out[kind] = (model, float(np.interp(PRECISION, rates[before], centres[before])))
    return out


def quality(spark: SparkSession) -> dict[str, tuple[float, float]]:
    """Held-out precision and recall of the further forms, per kind."""
    rows = labelled(spark)
    out = {}
    for kind, (model, least) in train(rows).items():
        held = rows[kind][rows[kind][:, -1] == 1]
        picked, label = model.margin(held[:, :-2]) >= least, held[:, -2] == 1
        both = int((picked & label).sum())
        out[KINDS[kind]] = both / max(int(picked.sum()), 1), both / int(label.sum())
    return out


def spans_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base and further spans (start, kind, end), kinds numbered as listed.

    Base spans pass the check of their kind. Of the further candidates those
    are added that pass it, reach the threshold of their kind and overlap no
    base span; of overlapping ones the first. The trees and thresholds come
    from made sentences only, so a text's spans depend on nothing else.
    """
    found = stage(candidates(docs, doc_id, text), "pii-candidates")
    models = train(labelled(docs.sparkSession))

    def kept(c: Column) -> Column:
        columns = [c[f] for f in FEATURES]
        fine = [(c["kind"] == kind) & (model.expression(columns) >= least)
                for kind, (model, least) in models.items()]
        return c["valid"] & reduce(lambda a, b: a | b, fine, F.lit(False))

    def plain(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))

    chosen = found.select("doc_id", "base", F.transform(
        F.filter("further", kept), plain).alias("_more"))
    return chosen.select("doc_id", "base", spans.leftmost(
        spans.apart_from(F.col("_more"), F.col("base"))).alias("further"))


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_<kind> and base_sha256 of the base spans, all spans as text.

    Null and empty texts: no spans. Null ids are carried. Repeated rows are
    reported each. No rows give no rows; further columns are ignored.
    """
    found = spans_of(docs, doc_id, text)
    return found.select(
        "doc_id",
        *spans.counts("base", KINDS),
        F.sha2(spans.written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        spans.written(F.concat("base", "further"), KINDS).alias("spans"))


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text with every span replaced by its kind in angle brackets."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    found = spans_of(docs.withColumn("_key", F.struct(F.col(doc_id), F.col(text))), "_key", text)
    rows = found.select("doc_id.*", spans.leftmost(F.concat("base", "further")).alias("_spans"))
    rows = rows.withColumnRenamed(text, "_text")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def add(done: Column, s: Column) -> Column:
        gap = F.substr(body, done["at"] + 1, s["start"] - done["at"])
        return F.struct(s["end"].alias("at"), F.concat(
            done["out"], gap, F.element_at(names, s["kind"] + 1)).alias("out"))

    result = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add,
                         lambda d: F.concat(d["out"], F.substr(
                             body, d["at"] + 1, F.char_length(body) - d["at"])))
    return rows.select(F.col(doc_id).alias("doc_id"), result.alias("text"))
