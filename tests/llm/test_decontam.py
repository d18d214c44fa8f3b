import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tierpick.llm import decontam


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def shingles(words, size):
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)] or [tuple(words)]


def brute(docs, items):
    out = {}
    for i, doc in enumerate(docs):
        for j, item in enumerate(items):
            size = min(5, len(item))
            if not item or len(doc) < size:
                continue
            best = max(similarity(shingles(doc[s:s + len(item)], size), shingles(item, size))
                       for s in range(max(1, len(doc) - len(item) + 1)))
            if best >= 0.8:
                out[i, j] = round(best, 9)
    return out


def made(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "ab"]
    items = [[rng.choice(words) for _ in range(rng.choice([2, 4, 5, 6, 12, 30, 31, 45, 60]))]
             for _ in range(30)]
    docs = []
    for _ in range(100):
        doc = []
        for _ in range(rng.randint(0, 4)):
            doc += [rng.choice(words) for _ in range(rng.randint(0, 30))]
            part = list(rng.choice(items))
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.choice([0, len(part) - 1, rng.randrange(len(part))])
                change = rng.random()
                if change < 0.5:
                    part[k] = rng.choice(words)
                elif change < 0.75:
                    part.insert(k, rng.choice(words))
                elif len(part) > 1:
                    del part[k]
            doc += part
        docs.append(doc)
    return docs, items


def tables(spark, documents, docs, items):
    rng = random.Random(1)
    rows = [(i, rng.choice([", ", " ", "\n"]).join(d).replace("É", rng.choice("Éé")).replace(
        "ab", rng.choice(["AB", "ab"]))) for i, d in enumerate(docs)]
    bench = spark.createDataFrame(
        [(j, " ".join(x), "x") for j, x in enumerate(items)] + [(900, None, "x"), (901, "", "x")],
        "item_id long, text string, doc_id string")
    return documents(*rows, (1000, None), (1001, ""), (1002, "q " * 50_000)), bench


def test_windows_like_brute_force_in_blocks_of_items(spark, documents, monkeypatch):
    docs, items = made()
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 13)
    found, bench = tables(spark, documents, docs, items)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9)
           for r in decontam.contaminated(found, bench).collect()}
    want = brute(docs, items)
    assert got == want and len(set(want.values())) > 3


def test_clean_keeps_the_rest_with_all_columns(spark, documents):
    docs, items = made(6)
    found, bench = tables(spark, documents, docs, items)
    bad = {i for i, _ in brute(docs, items)}
    kept = decontam.clean(found, bench)
    assert kept.columns == found.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        ({*range(len(docs))} - bad) | {1000, 1001, 1002})


def test_repeated_shingles_are_found_at_any_cosine():
    words = [f"w{i}" for i in range(196)]
    item, doc = words + ["x"] * 24, words + ["y"] * 24
    assert similarity(shingles(item, 5), shingles(doc, 5)) == 0.8
    plain = words + [f"z{i}" for i in range(24)]
    for a, b in ((item, doc), (plain, doc), (item, plain)):
        found = list(decontam.Benchmark([7], [" ".join(a)]).search(pa.array([" ".join(b)])))
        assert [(f[0], f[1], f[2]) for f in found] == [(0, 7, 0.8)]


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 256, (300, 16), dtype=np.uint8)
    index = decontam.HammingIndex(items, radius=40)
    for _ in range(200):
        probe = np.unpackbits(items[rng.integers(300)])
        probe[rng.choice(128, rng.integers(0, 50), replace=False)] ^= 1
        probe = np.packbits(probe)
        apart = np.unpackbits(items ^ probe, axis=1).sum(axis=1)
        assert index.search(probe).tolist() == np.flatnonzero(apart <= 40).tolist()


def test_empty_tables(spark, documents):
    docs, items = made(7)
    found, bench = tables(spark, documents, docs[:5], items)
    assert decontam.contaminated(found, bench.limit(0)).count() == 0
    assert decontam.contaminated(found.limit(0), bench).count() == 0
    assert decontam.clean(found, bench.limit(0)).count() == 8
