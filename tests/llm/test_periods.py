import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from tierpick.llm import periods


def brute_force(words):
    """All runs by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def repetitive(rng):
    alphabet, words = rng.choice([1, 2, 3, 5]), []
    for _ in range(rng.randint(0, 6)):
        root = [rng.randrange(alphabet) for _ in range(rng.randint(1, rng.choice([3, 9, 20, 45])))]
        root = root * 3 if rng.random() < 0.3 else root
        words += (root * rng.randint(1, 12))[:rng.randint(1, 400)]
    return [f"w{x}" for x in words][:500]


def expected(key, text):
    words = text.encode().split() if text else []
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_force(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_runs_equal_those_of_trying_all_periods():
    rng = random.Random(11)
    for _ in range(300):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 5))]
        assert periods.runs_of(texts) == [brute_force(words) for words in texts]


@pytest.mark.parametrize("root, times, found", [
    (["a"], 23, []), (["a"], 24, [(0, 24, 1)]),
    (list("abcdefg"), 3, []), (list("abcdefgh"), 3, [(0, 24, 8)]),
    ([str(i) for i in range(100)], 3, [(0, 300, 100)]),
    (["a", "a", "b"] * 20 + ["c"], 3, [(0, 60, 3), (61, 60, 3), (122, 60, 3), (0, 183, 61)]),
])
def test_bounds_and_runs_within_runs(root, times, found):
    assert periods.runs_of([root * times])[0] == sorted(found)


def test_texts_do_not_run_into_each_other():
    assert periods.runs_of([["a"] * 20, ["a"] * 20]) == [[], []]


def test_a_very_long_text_of_one_word_is_one_run():
    assert periods.runs_of([["x"] * 300_000])[0] == [(0, 300_000, 1)]


def test_query_against_brute_force(documents, monkeypatch):
    monkeypatch.setattr(periods, "BATCH_WORDS", 700)
    rng = random.Random(3)
    texts = [" ".join(repetitive(rng)) for _ in range(120)]
    texts += [None, "", " \t\n ", "one", "É x " * 30, "a\x0bb\x1cc " * 40, "z" * 100_000]
    rows = list(enumerate(texts)) + [(None, "q " * 30), (7, texts[7]), (7, texts[7])]
    frame = documents(*rows)
    got = periods.digest(periods.find(periods.with_planted(frame)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                           "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        (expected(k, t) for k, t in rows), key=str)


def test_empty_table_and_collapsed_text(documents):
    assert periods.find(documents((1, "a")).limit(0)).count() == 0
    row = periods.find(documents((1, "start " + "again and " * 20 + "end"))).first()
    assert row["collapsed"] == "start again and end"
    assert [tuple(r) for r in row["runs"]] == [(1, 40, 2)]
