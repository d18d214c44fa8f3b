"""Labelled sentences for the further forms of personal data: true values and look-alikes.

No table labels personal data. The sentences are made from a fixed seed and are
the same in every run, so a text gets the same spans beside any other rows.
"""

import random

SAMPLES = 8000  # sentences, a quarter per kind
SEED = 20
DISAGREE = 0.03  # share of sentences whose context speaks against the label

# --- fixed values -----------------------------------------------------------
NEUTRAL = ("at {} now", "{}", "see {} today.", "we had ({}) before", "dann {} und mehr",
           "puis {} encore", "luego {} otra vez", "left, {}, right", "x {} y")
CUED = {
    "email": ("mail {} soon", "E-Mail: {}", "courriel {}", "correo: {}", "contact {}.",
              "Kontakt {} bitte"),
    "ip": ("host {} is up", "server: {}", "IP {}", "address {}.", "Adresse {}", "adresse {}"),
    "card": ("card {}", "Karte: {}", "carte {}", "tarjeta {}", "Visa {} please"),
    "phone": ("call {} now", "Tel. {}", "phone: {}", "Telefon {}", "teléfono {}", "mobile {}"),
}
DECOY = {
    "email": ("lot {}", "item {} ok", "Seite {}", "page {}", "ticket {}"),
    "ip": ("mac {}", "EUI {}", "ratio {}", "serial {}", "version {}"),
    "card": ("order {}", "invoice: {}", "Rechnung {}", "commande {}", "pedido {}", "ref. {}",
             "ISBN {}", "serial {}"),
    "phone": ("order {}", "Bestellung {}", "facture {}", "pages {}", "No. {}", "version {}",
              "batch {}", "model {}"),
}
WORDS = ("lunch", "noon", "school", "home", "cost", "item", "met", "start", "then", "they", "left",
         "work", "night", "sold", "held", "seen")
NAMES = ("ana", "jane", "k.lee", "otto", "info", "m-roux", "sales", "p_diaz", "li99", "dr.kern")
DOMAINS = ("firm", "mail", "uni-ulm", "acme", "shop24", "sub.corp", "web")
ENDINGS = ("org", "com", "net", "de", "fr", "es", "io", "info")
# ----------------------------------------------------------------------------


def with_check_digit(digits: str) -> str:
    """The digits and the one that makes their Luhn sum right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 - i % 2)
        total += v - 9 if v > 9 else v
    return digits + str(-total % 10)


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _email(rng: random.Random, true: bool) -> str:
    at = rng.choice(("[at]", "(at)", "[AT]", "(AT)"))
    if true:
        dot = rng.choice((".", " . ", " [dot] ", "[dot]", " (dot) ", "(DOT)"))
        space = rng.choice(("", " "))
        return f"{rng.choice(NAMES)}{space}{at}{space}{rng.choice(DOMAINS)}{dot}{rng.choice(ENDINGS)}"
    first, second, third = (rng.choice(WORDS) for _ in range(3))
    return rng.choice((
        f"{first} {at} {second}. {third.capitalize()}", f"{first} {at} {second}. {third}",
        f"{rng.randint(1, 99)} {at} {rng.randint(1, 99)}.{_number(rng, 2)}",
        f"{first} {at} {rng.randint(1, 12)}.{_number(rng, 2)}"))


def _ip(rng: random.Random, true: bool) -> str:
    hexes = "0123456789abcdef" if rng.random() < 0.6 else "0123456789ABCDEF"
    if true:
        first = rng.choice(("2001", "2a02", "fd00", "fe80", "2606"))
        rest = ["".join(rng.choice(hexes) for _ in range(rng.choice((1, 1, 2, 3, 4, 4, 4))))
                for _ in range(7)]
        return ":".join([first, *rest])
    kind = rng.random()
    if kind < 0.5:
        return ":".join("".join(rng.choice(hexes) for _ in range(2)) for _ in range(8))
    top = 9 if kind < 0.75 else 99
    return ":".join(str(rng.randint(0, top)) for _ in range(8))


def _card(rng: random.Random, true: bool) -> str:
    # Of other numbers a tenth has the right check digit by chance.
    digits = (with_check_digit(rng.choice("3456") + _number(rng, 14)) if true
              else rng.choice("01234567891278") + _number(rng, 15))
    sign = rng.choice("./") if true else rng.choice("..././")
    return sign.join(digits[i:i + 4] for i in range(0, 16, 4))


def _phone(rng: random.Random, true: bool) -> str:
    sign = rng.choice(" .-")
    if true:
        if rng.random() < 0.5:
            return f"({rng.choice('23456789')}{_number(rng, 2)}) {_number(rng, 3)}-{_number(rng, 4)}"
        country = rng.choice(("1", "33", "34", "44", "49", "351"))
        return f"00{country}{sign}{_number(rng, 3)}{sign}{_number(rng, 3)}{sign}{_number(rng, 3)}"
    if rng.random() < 0.5:
        return f"({rng.randint(1900, 2030)}) {_number(rng, 3)}-{_number(rng, 4)}"
    return f"00{_number(rng, 3)}{sign}{_number(rng, 4)}{sign}{_number(rng, 4)}"


VALUES = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}


def sentences() -> list[tuple[int, str, str, int, int, bool]]:
    """(number, text, kind, start, end, whether the value is personal data)."""
    rng = random.Random(SEED)
    out = []
    for number in range(SAMPLES):
        kind = list(VALUES)[number % len(VALUES)]
        true = rng.random() < 0.5
        value = VALUES[kind](rng, true)
        spoken = true != (rng.random() < DISAGREE)
        frames = (CUED if spoken else DECOY)[kind]
        frame = rng.choice(NEUTRAL if rng.random() < 0.4 else frames)
        start = frame.index("{}")
        out.append((number, frame.format(value), kind, start, start + len(value), true))
    return out
