"""Weight search and replay from a training extract."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierpick.config import BOUNDS
from tierpick.operators import picks, search
from tierpick.operators.grid import steps_of
from tierpick.operators.scoring import coerce_tier
from tierpick.sources.tables import complete_rows


def training_rows(extract: DataFrame) -> DataFrame:
    """Complete rows with a date and a valid tier."""
    rows = complete_rows(extract)
    return rows.withColumn("tims", coerce_tier(F.col("tims"))).withColumn(
        "date", F.col("date").cast("date")
    )


def find_weights(extract: DataFrame, order: list[str], step_percent: float = 5,
                 tie: str = "first", bounds=BOUNDS) -> DataFrame:
    """Best weights over all labelled dates; the grid has int(100 / step_percent) steps."""
    candidates = search.search_input(training_rows(extract), order, bounds)
    return search.search(
        candidates, steps_of(step_percent), order, tie, step=step_percent / 100
    )


def replay_accuracy(extract: DataFrame, order: list[str], since=None, **kw) -> DataFrame:
    """Accuracy of fixed weights, overall and by tier."""
    made = picks.replay(training_rows(extract), order, since=since, keep=["scored"], **kw)
    return picks.accuracy(made)
