import random
import zlib

import numpy as np
import pytest

from tierpick.llm import boosting, toxicity

BAD = ["blorg", "snarfing", "vexwad", "krunt"]


def made(n=900, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(rng.randint(2, 6)):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text), toxic))
    return rows


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def scored(spark):
    rows = made()
    docs = spark.createDataFrame(
        [(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "a b", "x"),
         (5002, "word " * 40_000, "x"), (5003, rows[0][1], "x"), (5003, rows[0][1], "x")],
        "doc_id long, text string, toxic string")
    labels = spark.createDataFrame(
        [(i, y) for i, _, y in rows] + [(7, None), (9999, 1)], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.score(docs, labels).collect()


def test_held_out_accuracy(scored):
    rows, _, _, got = scored
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 6
    assert all(r.held_out == held_out(r.doc_id) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [(by_id[i].score, y) for i, _, y in rows if held_out(i)]
    score, label = map(np.array, zip(*held))
    rank = score.argsort().argsort()
    ones = label.sum()
    auc = (rank[label == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(label) - ones))
    assert auc > 0.97
    predicted = score >= 0.7
    assert predicted[label == 1].mean() > 0.85 and predicted[label == 0].mean() < 0.03
    assert by_id[5000].score == by_id[5001].score < 0.5 and by_id[5002].predicted == 0


def test_held_out_labels_change_nothing(scored):
    _, docs, labels, got = scored
    other = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - toxic ELSE toxic END "
        "AS toxic")
    again = toxicity.score(docs, other).collect()
    assert sorted(again, key=repr) == sorted(got, key=repr)


def test_keep_civil_drops_the_predicted(scored):
    _, docs, labels, got = scored
    kept = toxicity.keep_civil(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(
        repr(r.doc_id) for r in got if not r.predicted)


def test_no_labels_one_label_no_documents(scored):
    _, docs, labels, _ = scored
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    ones = labels.selectExpr("doc_id", "1 AS toxic")
    assert {r.score for r in toxicity.score(docs, ones).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_obfuscated_words_are_undone():
    words = toxicity.Words()
    text = np.frombuffer(b"tr@sh 1d10t s-t.u*p_id end. - a", dtype=np.uint8)
    data, offsets = words.undone(text, np.array([0, 12, len(text)]))
    assert data.tobytes() == b"trash idiot stupid end. - a"
    assert offsets.tolist() == [0, 12, len(data)]


def test_isotonic_is_the_monotone_mean():
    rng = np.random.default_rng(1)
    margin = rng.normal(size=400)
    label = (rng.random(400) < 1 / (1 + np.exp(-2 * margin))).astype(int)
    centres, rates = boosting.isotonic(margin, label)
    assert (np.diff(centres) >= 0).all() and (np.diff(rates) >= 0).all()
    assert abs(np.interp(margin, centres, rates).mean() - label.mean()) < 0.03


def test_trees_learn_an_interaction(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    bins = rng.integers(0, 4, (500, 3))
    label = ((bins[:, 0] > 1) ^ (bins[:, 2] > 2)).astype(int)
    model = boosting.fit(bins, label, trees=30, depth=2)
    assert ((model.margin(bins) > 0) == label).mean() > 0.95
    rows = spark.createDataFrame(bins.tolist(), "a int, b int, c int")
    got = [r[0] for r in rows.select(model.expression([F.col(x) for x in "abc"])).collect()]
    assert np.allclose(got, model.margin(bins))
