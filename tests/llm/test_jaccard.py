import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tierpick.llm import jaccard
from tierpick.llm.components import components
from tierpick.llm.words import Reader

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    lists: dict = {}
    for i, s in sets.items():
        for g in s:
            lists.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in lists[g] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_copies(seed=3, n=200):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[rng.choice(words) for _ in range(rng.randint(20, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            text[rng.choice([0, 1, -1, -2, rng.randrange(len(text))])] = rng.choice(words)
        text = text[rng.randint(0, 6):] if rng.random() < 0.3 else text
        text += [rng.choice(words) for _ in range(rng.randint(0, 8))] if rng.random() < 0.3 else []
        rows.append((i, " ".join(text)))
    return rows + [(1000, None), (1001, ""), (1002, "  \n"), (1003, "A b"), (1004, "a  B"),
                   (1005, "a"), (1006, "a b c d e"), (1007, "A b\tc d e"),
                   (1008, "long " * 30_000)]


@pytest.mark.parametrize("hot, block, group", [(256, 512, 4 << 20), (4, 7, 300)])
def test_components_like_brute_force(documents, monkeypatch, hot, block, group):
    monkeypatch.setattr(jaccard, "LOCALLY_HOT", hot)
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", group)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard.similar_groups(documents(*rows)).collect()}
    assert got == brute(rows)


def test_exactly_at_the_limit(documents):
    one = [f"a{i}" for i in range(49)]  # 45 shingles; 40 are shared by both: 40 / 50
    two = one[:44] + [f"b{i}" for i in range(5)]
    three = one[:43] + [f"c{i}" for i in range(6)]
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(three))]
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(documents(*rows)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()} == {1: 1, 2: 1, 3: 3}


def test_keep_one_and_empty_table(documents):
    rows = near_copies(5, 60)
    docs = documents(*rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        i for i, (_, c) in brute(rows).items() if i == c)
    assert jaccard.similar_groups(docs.limit(0)).count() == 0


def test_keep_one_of_rows_without_ids(documents):
    one, other = "a b c d e f g h", "k l m n o p q r"
    rows = [(1, one), (None, one), (None, other), (None, other.upper()), (None, None), (2, ""),
            (3, "s t u v w"), (3, "s t u v w")]
    got = jaccard.keep_one(documents(*rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted(
        [(1, one), (0, other), (0, other.upper()), (0, ""), (2, ""), (3, "s t u v w"),
         (3, "s t u v w")])
    assert {(r._key, r._id) for r in got} == {("k", 1)}


def test_word_hashes_are_those_of_words():
    rng = random.Random(9)
    texts = ["".join(rng.choice("aB é\t\nc.😀 ") for _ in range(rng.randint(0, 40)))
             for _ in range(300)] + ["", " ", "x"]
    reader, by_word = Reader(), {}
    for row, data, offsets in reader.chunks(pa.array([None, *texts])):
        words, starts, ends, bounds = reader.read(data, offsets)
        for i in range(len(offsets) - 1):
            want = re.findall("[^\x20\x09-\x0d]+", (["", *texts][row + i]).translate(LOWER))
            own = words[bounds[i]:bounds[i + 1]].tolist()
            assert len(own) == len(want)
            for w, h in zip(want, own):
                assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_suffix_bound_is_an_upper_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 200, rng.integers(1, 80))).astype(np.uint64)
                for _ in range(2))
        assert jaccard._most_in_common(a, b) >= len(np.intersect1d(a, b))


def test_components_of_paths_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [
        (200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.component for r in components(
        spark.createDataFrame(links, "u long, v long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {
        i: 200 for i in (200, 201, 202)}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
