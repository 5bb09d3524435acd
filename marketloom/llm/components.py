"""Connected components of a link table, distributed, by large-star and small-star rounds.

Each round hangs every node's larger neighbours, then all its neighbours, on the smallest one; it
takes a few rounds (logarithmic in practice) until every node points at the smallest of its
component. A round only groups links by node: the smallest neighbour comes from a partial
aggregate, so a node with very many links is summed before the shuffle, and links of a hot node meet
no single task but through a join that adaptive execution splits. The rounds' tables are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import kept


def _star(links: DataFrame, large: bool) -> DataFrame:
    """`links` (u, v): per node u the smallest of itself and its neighbours takes the others."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    if large:
        return hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    others = hung.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, left: str, right: str, rows: int | None = None, rounds: int = 64) -> DataFrame:
    """rows: about how many links there are, where that is known. `node`, `component` (its smallest node) of every node in a link between different nodes."""
    table = links.filter(F.col(left) != F.col(right)).select(F.col(left).alias("u"), F.col(right).alias("v")).distinct()
    table, state = kept(table, rows), None
    for _ in range(rounds):
        # a stable sum of hashes says that no link moved
        now = tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return table.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state, table = now, kept(_star(_star(table, True), False), now[0])
    raise RuntimeError(f"components did not settle in {rounds} rounds")
