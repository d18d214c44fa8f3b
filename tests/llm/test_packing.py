import random
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tierpick.llm import packing


def best_fit(lengths, capacity):
    rest = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rest) if r >= length]
        if fits:
            rest[min(fits, key=lambda i: rest[i])] -= length
        else:
            rest.append(capacity - length)
    return sorted(rest)


def test_plan_gives_the_sequences_of_best_fit_piece_by_piece():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 37, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
        filled = defaultdict(list)
        for length, _, n, sequence, per, offset in packing.plan(Counter(lengths), capacity):
            for k in range(n):
                filled[sequence + k // per].append((offset + k % per * length, length))
        rest = []
        for content in filled.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            rest.append(capacity - at)
        assert sorted(rest) == best_fit(lengths, capacity)


def test_segment_tree_finds_the_tightest():
    tree, rng, open_ = packing.RemainingCapacities(100), random.Random(2), set()
    for _ in range(2000):
        x, on = rng.randint(0, 100), rng.random() < 0.4
        tree.set(x, on)
        open_.add(x) if on else open_.discard(x)
        least = rng.randint(0, 100)
        assert tree.tightest(least) == min((o for o in open_ if o >= least), default=None)


def test_ids_are_those_of_the_tokenizer():
    path = packing.tokenizer_path()
    whole, encode = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ["", " ", "It's we'll don't  x\ty", "naïve café's 12'3 ½ ² ª ß ǆ « »!?", "İstanbul ΑΣ",
             "a <|endoftext|> b", "é \x1c \x85 \xa0 z", "日本語 text 😀", "a" * 5000]
    for text in texts * 2:
        ids = np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        assert encode(text) == ids.tobytes()


def test_cache_of_bounded_size(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 3)
    path = packing.tokenizer_path()
    one, rng = packing.Encoder(path), random.Random(3)
    whole = Tokenizer.from_file(path)
    for _ in range(30):
        text = " ".join(rng.choice(["ab", "cd.", "e-f", "gh", "ij!", "kl"]) for _ in range(6))
        ids = np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        assert one(text) == ids.tobytes()


def test_pack_is_whole_and_gapless(documents):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 90)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "z " * 300), (103, "same"), (103, "same"), (None, "n")]
    got = packing.pack(documents(*docs), capacity=64).collect()
    encode = packing.Encoder(packing.tokenizer_path())
    want = Counter()
    for i, text in docs:
        ids = encode(text or "") + b"\x01\0\0\0"
        for k in range(0, len(ids), 256):
            part = ids[k:k + 256]
            want[i, k // 256, k // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for content in sequences.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) == len(best_fit([r.length for r in got], 64))


def test_no_documents(documents):
    assert packing.pack(documents().limit(0)).count() == 0


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen, real, before = [], packing.stage, spark.conf.get(name)
    monkeypatch.setattr(
        packing, "stage", lambda df, to: seen.append(int(spark.conf.get(name))) or real(df, to))
    found = packing.pack(spark.range(3).selectExpr("id AS doc_id", "'a b' AS text"))
    assert seen == [packing.TEXTS_AT_ONCE] and spark.conf.get(name) == before
    assert found.count() == 3
    assert "whole" not in vars(packing.Encoder(packing.tokenizer_path()))  # loaded when needed


def test_worker_keeps_its_encoder_for_later_tasks(spark, tmp_path):
    folder, real = str(tmp_path), packing.Encoder

    class Counted(real):
        def __init__(self, path):
            tempfile.mkstemp(dir=folder)
            super().__init__(path)

    tasks = 6 * spark.sparkContext.defaultParallelism
    docs = spark.range(0, 3 * tasks, 1, tasks).selectExpr("id AS doc_id", "'a b' || id AS text")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "Encoder", Counted)
        found = packing.pieces(docs).collect()
    assert len({r._task for r in found}) == tasks and len(found) == 3 * tasks
    assert 0 < len(list(tmp_path.iterdir())) < tasks


def test_new_words_of_several_texts_are_tokenized_together(monkeypatch):
    path = packing.tokenizer_path()
    whole, encode, calls = Tokenizer.from_file(path), packing.Encoder(path), []
    real = encode._ids
    monkeypatch.setattr(encode, "_ids", lambda *a: calls.append(a[1]) or real(*a))
    texts = ["one two.", "", "two. three", "日本 <|endoftext|>", "a <|endoftext|> b", "four, 12's"] * 2
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
            for t in texts]
    assert list(encode.each(texts)) == want
    assert len(calls) == 1 + 4  # new words once, texts with special tokens each for itself
    monkeypatch.setattr(packing, "LEARNT_AT_ONCE", 10)
    assert list(packing.Encoder(path).each(iter(texts))) == want


def test_words_in_use_outlive_the_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 4)
    encode, learnt = packing.Encoder(packing.tokenizer_path()), Counter()
    real = encode._learn_words
    monkeypatch.setattr(encode, "_learn_words", lambda new: learnt.update(new) or real(new))
    for i in range(40):
        encode("often. " + new_word(i))
        assert len(encode.known) <= 4 + 4 and len(encode.old) <= 4 + 4
    assert learnt["often"] == 1 and len(learnt) == 42


def new_word(i):
    return "xy" + chr(97 + i % 26) + chr(97 + i // 26)
