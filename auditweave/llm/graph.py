"""Connected components of link tables, by hooking and pointer jumping in joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.base import cut


def _jump(parent: DataFrame) -> DataFrame:
    """Every node's parent's parent."""
    up = parent.select(F.col("id").alias("root"), F.col("root").alias("next"))
    return parent.join(up, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b): root is the smallest id it is connected with.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by doubling, and keeps the
    links between different ends. Tables are cut to files between rounds; nothing is collected but their emptiness.
    """
    edges, levels = links.select("a", "b"), []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("root")), "hooks")
        while True:
            jumped = cut(_jump(parent), "jumps")
            parent = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        levels.append(parent)
        ends = lambda c: parent.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
        edges = cut(edges.join(ends("a"), "a").join(ends("b"), "b").where("a_root <> b_root").select(
            F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            break
    found = levels[0]
    for level in levels[1:]:
        found = found.join(level.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select(
            "id", F.coalesce("next", "root").alias("root"))
    return found
