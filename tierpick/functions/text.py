"""Name handling and message text."""

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierpick.config import NAME_ALIASES
from tierpick.functions.numbers import round_exact

# Latin letters that do not decompose into base letter + accent.
_SINGLE = {
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D",
    "ð": "d", "Ð": "D", "ı": "i", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T",
}
_MULTI = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "…": "...",
}
_PUNCTUATION = {
    "‘": "'", "’": "'", "‚": ",", "‛": "'", "“": '"', "”": '"', "„": '"', "′": "'", "″": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "\u00a0": " ",
}
_ACCENTED = (range(0x00C0, 0x0250), range(0x1E00, 0x1F00))


def accent_table() -> tuple[str, str]:
    """Accented Latin letters and punctuation with their plain form, position by position."""
    pairs = _SINGLE | _PUNCTUATION
    for letter, plain in _decomposed():
        if len(plain) == 1 and letter not in _MULTI:
            pairs.setdefault(letter, plain)
    return "".join(pairs), "".join(pairs.values())


def _decomposed():
    """Latin letters with the ASCII letters that they decompose into."""
    for code in (c for codes in _ACCENTED for c in codes):
        parts = unicodedata.normalize("NFKD", chr(code))
        parts = (_MULTI.get(p, _SINGLE.get(p, p)) for p in parts)
        plain = "".join(p for p in parts if p.isascii() and p.isalpha())
        if plain:
            yield chr(code), plain


def multi_letters() -> dict[str, str]:
    """Letters that become several."""
    return {letter: plain for letter, plain in _decomposed() if len(plain) > 1} | _MULTI


def fold_ascii(text: Column) -> Column:
    """Replace accented Latin letters and typographic punctuation, inside the JVM.

    Accents that stand as characters of their own go.
    """
    accented, plain = accent_table()
    folded = F.regexp_replace(F.translate(text, accented, plain), r"\p{Mn}+", "")
    for letter, plain_letters in multi_letters().items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain_letters))
    return folded


def alias_name(name: Column, chain=NAME_ALIASES, whole: bool = False) -> Column:
    """Apply the ordered replacements.

    By default each one replaces every occurrence of a substring; with
    ``whole`` only a name that equals the left side is replaced.
    """
    for old, new in chain:
        if whole:
            name = F.when(name == old, F.lit(new)).otherwise(name)
        else:
            name = F.replace(name, F.lit(old), F.lit(new))
    return name


def full_name(first: Column, last: Column) -> Column:
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def name_key(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit("")))


def place_or_common(place: Column, common: Column) -> Column:
    """Place name, or the common name where the place is one blank."""
    return F.when(place == " ", common).otherwise(place)


def first_filled(*texts: Column) -> Column:
    """First text that is neither null nor empty, else the last one."""
    return reduce(
        lambda rest, text: F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(rest),
        reversed(texts[:-1]),
        texts[-1],
    )


def fixed(number: Column, digits: int) -> Column:
    """Number as text with ``digits`` decimals."""
    return F.format_string(f"%.{digits}f", round_exact(number, digits))


def percent_or_text(stat: Column) -> Column:
    """``12.34%`` where the value is a number, else the value as it is."""
    number = stat.try_cast("double")
    return F.when(number.isNotNull(), F.concat(fixed(number, 2), F.lit("%"))).otherwise(
        F.coalesce(stat.cast("string"), F.lit(""))
    )


def scorer_text(name: Column, goals: Column) -> Column:
    return F.format_string("%s (%d)", name, goals)


# Heading of the pick list.
PICK_LIST_HEAD = "Tims | Name | Team | Probability\n" + "-" * 40 + "\n"


def pick_line(tims: Column, name: Column, team: Column, stat: Column) -> Column:
    def text(column):
        return F.coalesce(column.cast("string"), F.lit(""))

    return F.concat(
        text(tims), F.lit(" | "), text(name), F.lit(" | "), text(team), F.lit(" | "),
        percent_or_text(stat), F.lit("\n"),
    )


def greeting(display_name: Column) -> Column:
    shown = F.coalesce(display_name, F.lit(""))
    return F.when(shown != "", F.concat(F.lit("Hey "), shown, F.lit(",\n\n"))).otherwise("")
