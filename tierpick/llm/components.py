"""Connected components of links, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierpick.session import stage


def _state(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
                    .alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """From links (u, v) the rows (node, component); a component is its smallest node.

    A round looks at least labels only, which are aggregated before they are
    shuffled, so a node with very many links is no group of its own. The number
    of rounds grows with the logarithm of the longest path. Nodes without links
    don't occur. Each round is written, and the rounds end when one changes
    nothing.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stage(edges.where("u != v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_low"))
        large = (
            both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.least("u", "_low").alias("v")).distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("_low"))
        small = large.join(low, "u").where("v != _low").select(
            F.col("v").alias("u"), F.col("_low").alias("v"))
        edges = stage(small.unionByName(low.select("u", F.col("_low").alias("v"))).distinct(),
                      "components")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
