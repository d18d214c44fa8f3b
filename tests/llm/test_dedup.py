import hashlib
import string
from collections import defaultdict

import pytest

from tierpick.llm import dedup

ROWS = [(1, "Ab c"), (2, "aB C"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 100_000),
        (8, "X" * 100_000), (9, "alone"), (None, "alone"), (10, " ab c"), (11, "twice"),
        (11, "twice"), (12, "ab c ")] + [(100 + i, "Hot TEXT") for i in range(40)]


def lower(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[lower(text)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        ids = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        for place, i in enumerate(ids):
            out.append((i, keep, len(ids), place == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limits", [(20_000, 100), (1, 3), (10, 1)])
def test_groups_like_brute_force_however_hot_texts_are_split(documents, monkeypatch, limits):
    monkeypatch.setattr(dedup, "MOST_HOT", limits[0])
    monkeypatch.setattr(dedup, "LEAST_HOT", limits[1])
    got = dedup.exact_groups(documents(*ROWS)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(ROWS)


def test_common_starts_are_no_copies(documents):
    start = "y" * 200
    rows = [(i, start + str(i // 2)) for i in range(20)]
    assert sorted(map(tuple, dedup.exact_groups(documents(*rows)).collect()), key=repr) == brute(rows)


def test_keep_one_keeps_each_text_once_with_all_columns(documents):
    docs = documents(*ROWS)
    kept = dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {(r._key, r._id) for r in kept.collect()} == {("k", 1)}
    got = sorted((r.doc_id, lower(r.text)) for r in kept.collect())
    assert got == sorted((i, t) for t, i in {
        lower(t): max(j for j, u in ROWS if lower(u) == lower(t) and j is not None)
        for _, t in ROWS}.items())


def test_no_documents(documents):
    assert dedup.exact_groups(documents().limit(0)).count() == 0
