import random
from collections import defaultdict

import pytest

from tierpick.llm import preferences


def brute(chosen, rejected):
    """Sides by pair: lists of (role, text)."""
    out = []
    for pair in {*chosen, *rejected}:
        c, r = chosen.get(pair, []), rejected.get(pair, [])
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        for part, turns, first in (("prompt", c[:n], 0), ("chosen", c[n:], n),
                                   ("rejected", r[n:], n)):
            at = 0
            for place, (role, text) in enumerate(turns, first):
                shown = f"<|{role or ''}|>\n{text or ''}\n"
                learnt = part != "prompt" and role == "assistant"
                out.append((pair, part, place, role, shown, at,
                            at + len(role) + 5 if learnt else None,
                            at + len(shown) if learnt else None))
                at += len(shown)
    return sorted(out, key=repr)


def rows_of(sides):
    return [(p, i, role, text) for p, turns in sides.items() for i, (role, text) in enumerate(turns)]


@pytest.mark.parametrize("block", [1024, 2])
def test_pairs_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(preferences, "BLOCK", block)
    rng = random.Random(1)
    turns = [("user", "hi"), ("assistant", "é😀"), ("system", None), (None, "x"),
             ("assistant", ""), ("assistant", "long " * 50)]
    chosen = {p: [rng.choice(turns) for _ in range(rng.randint(0, 9))] for p in range(60)}
    rejected = {p: chosen[p][:rng.randint(0, 9)] + [rng.choice(turns)
                for _ in range(rng.randint(0, 4))] for p in range(5, 65) if p < 60}
    chosen = {p: t for p, t in chosen.items() if t}
    schema = "pair_id long, place long, role string, text string"
    got = preferences.format_pairs(
        spark.createDataFrame(rows_of(chosen), schema).repartition(3),
        spark.createDataFrame(rows_of(rejected), schema)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(chosen, rejected)


def test_conversations(spark):
    rng = random.Random(2)
    table, chosen = [], defaultdict(list)
    for c in range(40):
        for turn in range(rng.randint(1, 8)):
            row = (c, turn, rng.choice(["user", "assistant", "system"]),
                   rng.choice(["a", "b c", None, "", "é"]))
            table += [row] * rng.choice([1, 1, 1, 2])
    table += [(None, 0, "user", "lost")]
    for c, _, role, text in sorted(table, key=lambda r: (r[0] or 0, r[1], r[2], r[3] is not None,
                                                         r[3] or "")):
        if c is not None or text != "lost":
            chosen[c].append((role, text))
    rejected = {}
    for c, turns in chosen.items():
        learnt = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        if learnt and learnt[-1] > 0:
            source = learnt[-2] if len(learnt) > 1 else learnt[-1] - 1
            rejected[c] = turns[:learnt[-1]] + [("assistant", turns[source][1])]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 AS place", "'p' AS part", "0 AS pair_id").repartition(3)
    got = preferences.formatted(df).collect()
    assert sorted(map(tuple, got), key=repr) == brute(chosen, rejected)
    assert preferences.formatted(df.limit(0)).count() == 0
