"""Secrets: base patterns, and a battery of randomness tests for tokens of any form.

DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierpick.llm import spans
from tierpick.session import stage

KINDS = ("assign", "access", "hex")
RATE = 0.05  # of false discoveries, in each class of length
BANDS = (20, 24, 32, 40, 64)  # lengths at which a class begins
LEVELS = tuple(RATE / 2**i for i in range(40))  # of p-values, largest first

# --- fixed values -----------------------------------------------------------
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?"""
              r"[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
GATES = {"assign": "(?i:pass|secret|token|api)", "access": "AKIA", "hex": "[0-9a-f]{24}"}
# Whole runs of 20 or more characters of the usual encodings, with padding where nothing follows
# it. Those that hold a digit and a letter are tokens; runs of letters alone are ordinary words, an
# additional check.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}+(?![A-Za-z0-9+/_=-]))?+"
TOKEN_GATE = r"[A-Za-z0-9+/_-]{20}"
WORD = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z]{20,}+(?![A-Za-z0-9+/_=-])"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "letters": "abcdefghijklmnopqrstuvwxyz",
}
# ----------------------------------------------------------------------------


def encoding(token: Column) -> Column:
    """The smallest usual alphabet that has all characters of the token."""
    return (
        F.when(token.rlike("^[A-Za-z]+$"), "letters")
        .when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$"), "lower36")
        .when(token.rlike("^[A-Za-z0-9]+$"), "base62")
        .otherwise("base64"))


def _codes(token: Column) -> Column:
    """Places of the characters in the alphabet; url-safe characters stand for + and /."""
    kind = encoding(token)
    plain = F.rtrim(F.translate(token, "-_", "+/"), F.lit("="))
    text = F.when(kind.isin("hex", "lower36", "letters"), F.lower(plain)).otherwise(plain)
    alphabet = F.lit(ALPHABETS["base64"])
    for name in ("hex", "base32", "lower36", "base62", "letters"):
        alphabet = F.when(kind == name, ALPHABETS[name]).otherwise(alphabet)
    return _once(F.struct(F.split(text, "").alias("all"), alphabet.alias("alphabet")), lambda x:
                 F.transform(x["all"], lambda c: F.instr(x["alphabet"], c) - 1))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution from 0 on (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    series = F.lit(1.330274429)
    for c in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
        series = series * t + c
    return F.exp(-z * z / 2) * 0.3989422804014327 * series * t


def p_value(codes: Column, size: Column) -> Column:
    """How likely a random token of the alphabet deviates at least as much.

    Three tests, each against its own null distribution, for which the least
    p-value counts three times: chi-squared of the counts of symbols (too
    uneven only; a gamma with the exact mean and variance), the number of runs
    above and below the alphabet's middle, and the correlation of neighbours
    (both normal, two-sided). Steps of the first two are halved for
    continuity. Two passes over the codes, however long they are.
    """
    real, zero = "double", F.lit(0.0)

    def count(done: Column, c: Column) -> Column:
        run = F.when(c == done["last"], done["run"] + 1).otherwise(1.0)
        # A run that grows from r - 1 to r adds 2 r - 1 to the sum of squares.
        return F.struct(c.alias("last"), run.alias("run"),
                        (done["squares"] + 2 * run - 1).alias("squares"))

    def walk(done: Column, c: Column) -> Column:
        high = (c * 2 >= size).cast(real)
        c = c.cast(real)
        return F.struct(
            c.alias("last"), high.alias("high"),
            (done["turns"] + (high != done["high"]).cast(real)).alias("turns"),
            (done["above"] + high).alias("above"), (done["total"] + c).alias("total"),
            (done["squares"] + c * c).alias("squares"),
            (done["products"] + c * done["last"]).alias("products"))

    def judge(s: Column) -> Column:
        n, first = s["n"], s["first"]
        w = s["walk"]
        chi = (s["squares"] - 1) * size / n - n  # half a step of 2 size / n less
        shape, mean = (size - 1) * n / (2 * (n - 1)), size - 1
        # Wilson and Hilferty: the cube root of a gamma is nearly normal.
        uneven = (F.pow(F.greatest(chi / mean, zero), 1 / 3) - (1 - 1 / (9 * shape))) * F.sqrt(
            9 * shape)
        above, below = w["above"], n - w["above"]
        # The first code always counts as a turn.
        expected = 2 * above * below / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        runs = F.when(spread > 0, F.greatest(F.abs(w["turns"] - expected) - 0.5, zero)
                      / F.sqrt(spread)).otherwise(99.0)
        middle = w["total"] / n
        variance = w["squares"] - n * middle * middle
        products = w["products"] - middle * (2 * w["total"] - first - w["last"]) + (
            n - 1) * middle * middle
        serial = F.when(variance > 0, F.abs(products / variance + 1 / n) * F.sqrt(n)).otherwise(
            99.0)
        tails = F.transform(F.array(uneven, runs, serial), lambda z, i: _tail(
            F.greatest(z, zero)) * F.when(i == 0, 1.0).otherwise(2.0))
        return F.least(3 * F.array_min(tails), F.lit(1.0))

    none = F.lit(-1.0)
    sums = F.struct(
        F.size(codes).cast(real).alias("n"), F.element_at(codes, 1).cast(real).alias("first"),
        F.aggregate(F.sort_array(codes), F.struct(
            F.lit(-1).alias("last"), zero.alias("run"), zero.alias("squares")), count,
            lambda d: d["squares"]).alias("squares"),
        F.aggregate(codes, F.struct(
            zero.alias("last"), none.alias("high"), zero.alias("turns"), zero.alias("above"),
            zero.alias("total"), zero.alias("squares"), zero.alias("products")), walk)
        .alias("walk"))
    return _once(sums, judge)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _band(length: Column) -> Column:
    band = F.lit(-1)
    for i, least in enumerate(BANDS):
        band = F.when(length >= least, i).otherwise(band)
    return band


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base spans, tokens (start, kind, end, band, p) and words (band, p).

    One pass over the texts. Tokens are named by their encoding: hex, or else
    access.
    """
    body = F.col("_text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit(""))
                       .alias("_text"))
    rows = rows.select("*", *[
        spans.found_where(body.rlike(GATES[k]), body, BASE[k]).alias(f"_{k}") for k in KINDS],
        body.rlike(TOKEN_GATE).alias("_long"))
    rows = rows.select(
        "*", F.filter(
            spans.found_where(F.col("_long"), body, TOKEN),
            lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]")).alias("_tokens"),
        F.when(F.col("_long"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
        .otherwise(F.array().cast("array<string>")).alias("words"))
    value = r"""^[^:=]*+[:=]\x20*+["']?"""
    fine = {
        "assign": lambda s: F.char_length(F.regexp_replace(s["match"], value, "")) >= 6,
        "access": lambda s: F.char_length(s["match"]) >= 20,
        "hex": lambda s: F.char_length(s["match"]) >= 24,
    }
    base = F.concat(*[spans.of_kind(F.filter(f"_{k}", fine[k]), i) for i, k in enumerate(KINDS)])
    return rows.select(
        "doc_id", base.alias("base"),
        F.transform(spans.apart_from(F.col("_tokens"), base), lambda s: F.struct(
            s["start"].alias("start"),
            F.when(encoding(s["match"]) == "hex", 2).otherwise(1).alias("kind"),
            s["end"].alias("end"), *_tested(s["match"]))).alias("tokens"),
        F.transform("words", lambda w: F.struct(*_tested(w))).alias("words"))


def _tested(token: Column) -> list[Column]:
    sizes = F.lit(64.0)
    for name in ("hex", "base32", "lower36", "base62", "letters"):
        sizes = F.when(encoding(token) == name, float(len(ALPHABETS[name]))).otherwise(sizes)
    p = _once(F.struct(_codes(token).alias("codes"), sizes.alias("size")),
              lambda x: p_value(x["codes"], x["size"]))
    return [_band(F.char_length(token)).alias("band"), p.alias("p")]


def limits(found: DataFrame) -> dict[int, float]:
    """Per class of length the largest p-value at which tokens are not random.

    Benjamini and Hochberg's step-up on the tokens themselves, on the grid of
    LEVELS: of those called not random at most RATE are random. Where ordinary
    words of the same length pass so often that more than RATE of the passing
    tokens might be such words, the level is raised. It never exceeds RATE, so
    a token with a larger p-value is random in any corpus.
    """
    def counted(name: str) -> DataFrame:
        rows = found.select(F.explode(name).alias("t")).select("t.*")
        return rows.groupBy("band").agg(F.count("*").alias("n"), F.array(*[
            F.count_if(F.col("p") <= x) for x in LEVELS]).alias("low"))

    # A row per class each.
    words = {r["band"]: r for r in counted("words").collect()}
    out = {}
    for r in counted("tokens").collect():
        n, low = r["n"], r["low"]
        step = [i for i, x in enumerate(LEVELS) if x * n <= RATE * low[i]]
        at = min(step, default=len(LEVELS) - 1)
        w = words.get(r["band"])
        while w and at > 0 and (w["n"] - w["low"][at]) / w["n"] * n > RATE * (n - low[at]):
            at -= 1
        out[r["band"]] = LEVELS[at]
    return out


def spans_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base and further spans (start, kind, end), kinds numbered as listed."""
    found = stage(candidates(docs, doc_id, text), "secret-candidates")
    passed = limits(found)

    def random(s: Column) -> Column:
        level = F.lit(RATE)
        for k, most in passed.items():
            level = F.when(s["band"] == k, most).otherwise(level)
        return s["p"] > level

    further = F.transform(F.filter("tokens", random), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select("doc_id", "base", further.alias("further"))


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_<kind> and base_sha256 of the base spans, all spans as text.

    Null and empty texts: no spans. Null ids are carried. Repeated rows are
    reported each. No rows give no rows; further columns are ignored.
    """
    found = spans_of(docs, doc_id, text)
    return found.select(
        "doc_id", *spans.counts("base", KINDS),
        F.sha2(spans.written(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        spans.written(F.concat("base", "further"), KINDS).alias("spans"))
