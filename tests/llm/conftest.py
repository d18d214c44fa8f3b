import corpus_pipeline  # noqa: F401  (makes the package known to Python workers)
import pytest

CLASHING = {"_id": "1L", "_norm": "'x'", "n": "7", "hash": "'h'", "set_id": "0L", "score": "0D",
            "start": "3", "part": "'p'", "count": "9", "_key": "'k'", "toxic": "5", "source": "'s'"}


@pytest.fixture
def documents(spark):
    """Documents with further columns whose names clash with those used inside."""

    def make(*rows, clashing=True):
        df = spark.createDataFrame(list(rows), "doc_id long, text string").repartition(3)
        return df.selectExpr("*", *[f"{v} AS {k}" for k, v in CLASHING.items()]) if clashing else df

    return make
