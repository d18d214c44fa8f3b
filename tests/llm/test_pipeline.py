import corpus_pipeline
import pytest

from tierpick.llm import decontam, dedup, jaccard, queries, toxicity


@pytest.fixture
def tables(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words[:60])
    docs = [(1, base), (2, base.upper()), (3, base + " w61"), (4, " ".join(words[70:120])),
            (5, "note " + " ".join(words[200:230]) + " end"), (6, None), (7, ""),
            (8, " ".join(words[300:340]))]
    bad = [(100 + i, f"you idiot moron scum {i} trash") for i in range(60)]
    fine = [(200 + i, " ".join(words[(7 * i) % 380:(7 * i) % 380 + 12]) + f" {i}") for i in range(60)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs + bad + fine],
                          "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(words[200:230]))], "item_id long, text string"
                          ).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in fine],
                          "doc_id long, quality int, toxic int"
                          ).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_drop_what_they_should_and_keep_the_rest(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, ids, left = docs.columns, {r.doc_id for r in docs.collect()}, []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, tables)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        left.append(ids - now)
        ids = now
    assert left[0] == {100 + i for i in range(60)}
    assert left[1] == {1, 6} and left[2] == {3} and left[3] == {5}
    got = corpus_pipeline.run(spark, tables).collect()
    assert {r.doc_id for r in got} == ids and {2, 4, 7, 8} <= ids


def test_stages_are_the_operators_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination",
        "best-fit packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    for operator in (toxicity.keep_civil, dedup.keep_one, jaccard.keep_one, decontam.clean):
        assert operator.__doc__
