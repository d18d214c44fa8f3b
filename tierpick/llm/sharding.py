"""Shards of a weighted tree: hash draws at every level, from the regions down."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierpick.operators.skew import number_rows

RACKS_PER_REGION = 2
SHARDS_PER_RACK = 2
LEVELS = 3  # region, rack, shard

Tree = Sequence[tuple[int, int, int, float]]


def even_tree(shards: int) -> list[tuple[int, int, int, float]]:
    """(region, rack, shard, weight) of shards filled in rack by rack, all of weight 1."""
    return [(s // (SHARDS_PER_RACK * RACKS_PER_REGION), s // SHARDS_PER_RACK, s, 1.0)
            for s in range(shards)]


def grown(tree: Tree, weight: float = 1.0) -> list[tuple[int, int, int, float]]:
    """The tree with one more shard, in a region and rack of its own."""
    region, rack, shard = (max((leaf[level] for leaf in tree), default=-1) + 1
                           for level in range(LEVELS))
    return [*tree, (region, rack, shard, weight)]


def draw(key: Column, level: int, node: int, weight: float) -> Column:
    """Exponential draw with rate ``weight`` from a hash of the key, the level and the node."""
    place = F.lit(LEVELS * node + level).cast("long")
    bits = F.shiftrightunsigned(F.xxhash64(key, place), 11)
    return -F.log((bits + 0.5) * F.lit(2.0 ** -53)) / F.lit(float(weight))


def _descend(key: Column, leaves: Tree, level: int) -> Column:
    if level == LEVELS:
        return F.lit(leaves[0][2])
    nodes: dict[int, list] = {}
    for leaf in sorted(leaves):
        nodes.setdefault(leaf[level], []).append(leaf)
    below = [_descend(key, own, level + 1) for own in nodes.values()]
    if len(nodes) == 1:
        return below[0]
    winner = F.least(*[
        F.struct(draw(key, level, node, sum(leaf[3] for leaf in own)).alias("draw"),
                 F.lit(node).alias("node")) for node, own in nodes.items()])["node"]
    *first, last = zip(nodes, below)
    chosen = last[1]
    for node, shard in reversed(first):
        chosen = F.when(winner == node, shard).otherwise(chosen)
    return chosen


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key: the least draw wins among the regions, then among the racks of that
    region, then among the shards of that rack. Only the children of winners are drawn.

    A node draws with the weight of its subtree, by a hash of its own, so every
    node gets keys by its weight. A node whose weight grows takes keys from its
    siblings only, one whose weight falls gives keys to them only; keys stay
    where they are below nodes whose weights, and those of their ancestors and
    their siblings, do not change. What enters a subtree is dealt to all of
    it by its own draws; so a new shard takes rows only into itself if it gets
    a region of its own (``grown``).
    Nodes are told apart by level and number. A shard without weight gets no
    rows. Equal draws go to the smaller number.
    """
    leaves = [leaf for leaf in tree if leaf[3] > 0]
    if not leaves:
        raise ValueError("no shard has weight")
    return _descend(key, leaves, 0)


def assign(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``key``: the id and the number of shards decide. ``grown_shard`` is the
    place with one more shard, which gets a region of its own: either the same
    or the new one. Slots are gapless per shard in order of id, numbered
    through a range-sorted table, so no task sees a whole shard.

    Null text: size 1, checksum 0. Null id: hashed like any other value.
    Repeated rows get slots of their own. No rows give no rows; further
    columns are ignored.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = F.col(doc_id)
    tree = even_tree(shards)
    rows = docs.select(
        key.alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, tree).cast("int").alias("shard"),
        shard_of(key, grown(tree)).cast("int").alias("grown_shard"))
    placed = number_rows(rows, ["shard", "doc_id", "text_crc32", "size"], out="_number")
    first = placed.groupBy("shard").agg(F.min("_number").alias("_first"))
    # One row per shard.
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard",
        (F.col("_number") - F.col("_first")).alias("slot"), "grown_shard")
