import hashlib
import random
import re

from tierpick.llm import pii, secrets

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRETS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
              r"([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m.group())
    return {
        "email": lambda: True,
        "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
        "assign": lambda: len(m.group(2)) >= 6,
        "access": lambda: len(m.group()) >= 20,
        "hex": lambda: len(m.group()) >= 24,
    }[kind]()


def compare(got, rows, patterns):
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, text in rows:
        spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(patterns.items())
                       for m in re.finditer(p, text or "") if holds(kind, m))
        listed = [f"{kind}:{a}:{b}" for a, _, b, kind in spans]
        r = by_id[i]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), (i, text)
        for k, kind in enumerate(patterns):
            assert r[f"n_{kind}"] == sum(s[1] == k for s in spans)
        assert set(listed) <= set(r.spans.split(","))


def test_pii_base_spans_like_brute_force(documents):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab1 23.4@+-()x_é😀\n09%") for _ in range(rng.randint(0, 80))))
            for i in range(400)]
    rows += [(3000 + i, "".join(rng.choice("a@.b_c-") for _ in range(40))) for i in range(150)]
    rows += [(4000 + i, "".join(rng.choice("0123456789 -+.") for _ in range(60)))
             for i in range(300)]
    rows += [(9000, None), (9001, ""), (9003, "1" * 30_000), (9004, "a" * 30_000),
             (9002, "a@b.c_x@y.z 4111 1111 1111 1111 1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1"),
             (9005, "a." * 10_000 + "@" + "a." * 10_000 + "b"), (9006, "+1 " * 10_000)]
    compare(pii.digest(documents(*rows)).collect(), rows, PII)


def test_pii_adds_further_forms_it_has_learnt(documents):
    rng = random.Random(3)
    rows = [(i, f"phone: +1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)} x") for i in
            range(300)] + [(i, f"sum +1 {i}") for i in range(300, 400)]
    rows += [(1000, "call (555) 123-4567 now")]
    got = {r.doc_id: r for r in pii.digest(documents(*rows)).collect()}
    assert got[1000].spans == "phone:5:19" and got[1000].n_phone == 0
    assert got[350].spans == ""


def test_pii_adds_each_further_form(documents):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        card = f"4{rng.randrange(10**14):014d}"
        card += next(c for c in "0123456789" if luhn(card + c))
        rows += [(i, f"phone: +1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)} x"),
                 (1000 + i, f"from 10.{i % 250}.0.1 on, mail a{i}@b.org, card {card} x")]
    forms = {"email": "ab [at] cd [dot] org", "ip": "2001:db8:0:0:8:800:200C:417A",
             "card": "4111.1111.1111.1111", "phone": "(555) 123-4567"}
    planted = [(5000 + k, f"at {form} now") for k, form in enumerate(forms.values())]
    wrong = [(6000, "at 4111.1111.1111.1112 now"), (6001, "at 1:2:3:4:5:6:7 now")]
    got = {r.doc_id: r.spans for r in pii.digest(documents(*rows, *planted, *wrong)).collect()}
    for k, (kind, form) in enumerate(forms.items()):
        assert got[5000 + k] == f"{kind}:3:{3 + len(form)}"
    assert got[6000] == got[6001] == ""
    text = {r.doc_id: r.text for r in pii.redacted(
        documents(*rows, *planted, clashing=False)).collect()}
    assert text[5001] == "at <ip> now"


def test_pii_spans_are_the_same_beside_any_rows(documents):
    rows = [(1, "jane [at] firm [dot] org"), (2, "we met [at] noon. Then we left"),
            (3, "mac 00:1b:44:11:3a:b7:00:01"), (4, "sold 3 (at) 12.50 each"),
            (5, "server fd00:1:22:abcd:0:9:8f:1234"), (6, "Tel. 0049 301 234 567")]
    more = [(100 + i, f"a{i}@b.org and +1 555 123 {4000 + i}") for i in range(400)]
    alone = {r.doc_id: r.spans for r in pii.digest(documents(*rows)).collect()}
    among = {r.doc_id: r.spans for r in pii.digest(documents(*rows, *more)).collect()}
    assert alone == {1: "email:0:24", 2: "", 3: "", 4: "", 5: "ip:7:33", 6: "phone:5:21"}
    assert all(among[i] == s for i, s in alone.items())


def test_pii_trees_tell_true_values_from_look_alikes(spark):
    rows = pii.labelled(spark)
    assert all(0 < t[:, -2].mean() < 1 for t in rows.values())  # both labels pass the check
    got = pii.quality(spark)
    assert set(got) == set(pii.KINDS)
    for kind, (precision, recall) in got.items():
        assert precision >= 0.95 and recall >= 0.9, (kind, precision, recall)


def test_redaction_replaces_spans(documents):
    rows = [(1, "Write to é.a@b.org or b@c.de, from 10.0.0.1!"), (2, None), (3, "nothing")]
    got = {r.doc_id: r.text for r in pii.redacted(documents(*rows, clashing=False)).collect()}
    assert got == {1: "Write to é<email> or <email>, from <ip>!", 2: "", 3: "nothing"}


def test_secrets_base_spans_like_brute_force(documents):
    rng = random.Random(2)
    parts = ["token", "Secret", "apikey", "API_KEY", "=", ":", " ", '"', "ab", "12", "AKIA",
             "ABCDEFGH", "0123456789abcdef", "é", ".", "\n", "=="]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(600)]
    rows += [(9000, None), (9001, ""), (9003, "f" * 30_000), (9004, "token " * 10_000),
             (9005, "AKIA" * 5_000), (9006, "token" + " " * 30_000 + "= abcdefgh")]
    compare(secrets.digest(documents(*rows)).collect(), rows, SECRETS)


def test_battery_adds_random_tokens_not_patterned_ones(documents):
    rng = random.Random(4)
    letters = secrets.ALPHABETS["base64"]
    ordinary = ["".join(rng.choice(["ta", "ti", "to", "na", "ne", "ra"]) for _ in range(16))
                for _ in range(400)]
    keys = ["".join(rng.choice(letters[:62]) for _ in range(36)) for _ in range(40)]
    keys = [k for k in keys if any(c.isdigit() for c in k)]
    rows = [(i, f"{w} said") for i, w in enumerate(ordinary)]
    rows += [(1000 + i, f"x {k} y") for i, k in enumerate(keys)]
    rows += [(2000, "x " + "xz1" * 12 + " y"), (2001, "x zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1 y")]
    got = {r.doc_id: r for r in secrets.digest(documents(*rows)).collect()}
    found = sum(got[1000 + i].spans == "access:2:38" for i in range(len(keys)))
    assert found >= 0.8 * len(keys)
    assert all(got[i].spans == "" for i in [*range(400), 2000, 2001])


def test_random_keys_are_judged_alike_without_words_of_their_length(documents):
    rng = random.Random(8)
    sets = {"base64": secrets.ALPHABETS["base64"], "base62": secrets.ALPHABETS["base62"],
            "lower36": secrets.ALPHABETS["lower36"], "hex": "0123456789ABCDEF"}
    keys = ["".join(rng.choice(letters) for _ in range(n)) for letters in sets.values()
            for n in (24, 40, 64, 180) for _ in range(25)]
    slugs = [f"the-{a}-of-the-{b}-in-the-town-{i}" for i in range(20)
             for a, b in [rng.sample(["house", "garden", "station", "theatre", "teacher"], 2)]]
    rows = [(i, f"x {k} y") for i, k in enumerate([*keys, *slugs])]
    got = {r.doc_id: r.spans for r in secrets.digest(documents(*rows)).collect()}
    found = [i for i in range(len(keys)) if got[i].endswith(f":2:{2 + len(keys[i])}")]
    assert len(found) >= 0.95 * len(keys)
    assert all(got[len(keys) + i] == "" for i in range(len(slugs)))
    # Alone in its corpus a key is found as well.
    p = {r.doc_id: r.tokens[0].p for r in secrets.candidates(documents(*rows)).collect()}
    assert all(p[i] > secrets.RATE for i in found[:1])
    assert secrets.digest(documents(rows[found[0]])).first().spans == got[found[0]]
    # A random key falls below a p-value about as often as that says, not more.
    low = sum(p[i] <= 0.1 for i in range(len(keys)))
    assert low <= 0.15 * len(keys)


def test_keys_in_assignments_addresses_and_at_any_length(documents):
    rng = random.Random(11)

    def key(n):
        return "".join(rng.choice(secrets.ALPHABETS["base62"]) for _ in range(n))

    forms = [("AWS_SECRET_ACCESS_KEY=", 38, "\n"), ("SIGNING_KEY=", 40, ""),
             ("https://a.b/?sig=", 44, "&x=1"), ("x ", 228, " y"), ("x ", 5_000, " y"), ("name: h.", 43, "."), ("x ", 42, "== y"),
             ("x ", 40, "=5")]
    rows, want = [], {}
    for i, (before, n, after) in enumerate(forms * 6):
        k = key(n)
        rows.append((i, before + k + after))
        pad = 2 if after.startswith("==") else 0
        want[i] = f"access:{len(before)}:{len(before) + n + pad}"
    parts = [key(36), key(120), key(43)]
    rows.append((1000, "jwt " + ".".join(parts)))
    got = {r.doc_id: r.spans for r in secrets.digest(documents(*rows)).collect()}
    for form in range(len(forms)):
        found = [got[i] == want[i] for i in range(form, len(forms) * 6, len(forms))]
        assert sum(found) >= 5, forms[form]
    tokens = {r.doc_id: r.tokens for r in secrets.candidates(documents(*rows)).collect()}
    assert [(t.start, t.end) for t in tokens[1000]] == [(4, 40), (41, 161), (162, 205)]
    # A run of any length is one candidate, in linear time.
    long = [(1, "a1-" * 100_000), (2, key(200_000))]
    assert [len(r.tokens) for r in secrets.candidates(documents(*long)).collect()] == [1, 1]


def test_no_documents(documents):
    assert pii.digest(documents().limit(0)).count() == 0
    assert secrets.digest(documents().limit(0)).count() == 0
