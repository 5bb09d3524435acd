"""Exact ranks and quantiles without collecting a group into one task.

Equal values collapse to one counted row before the shuffle; the distinct values of a group
are cut into value ranges by a bounded-size sketch, ranked inside each range, and shifted by
the totals of the lower ranges. One group may hold most of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from marketloom.session import keep

#: Distinct values that one task ranks, and the most ranges that a group is cut into.
VALUES_PER_RANGE = 50_000
MOST_RANGES = 1024


def ordered_values(df: DataFrame, keys: Sequence[str], value: str, per_range: int = VALUES_PER_RANGE) -> DataFrame:
    """Distinct values per group with `_c` (copies), `_hi` (rank of the last copy), `_n` (rows
    of the group) and `_range` (value range, ascending). A group gets as many ranges as it has
    `per_range` distinct values, MOST_RANGES at most.

    The counted values are kept: cutting, ranking and totals each read them, and the plan that
    produced `df` must not run once per reader."""
    counts = keep(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    levels = F.percentile_approx(value, [i / MOST_RANGES for i in range(1, MOST_RANGES)], 5000).alias("_levels")
    parts = F.least(F.lit(MOST_RANGES), F.ceil(F.col("_values") / per_range)).cast("int")
    pick = lambda i: F.get("_levels", (i * MOST_RANGES / F.col("_parts")).cast("int") - 1)
    chosen = F.when(F.col("_parts") > 1, F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), pick)).otherwise(F.slice("_levels", 1, 0))
    edges = counts.groupBy(*keys).agg(levels, F.count(F.lit(1)).alias("_values")).withColumn("_parts", parts).select(*keys, chosen.alias("_cuts"))
    placed = counts.join(edges, list(keys)).withColumn(
        "_range", F.size(F.filter("_cuts", lambda e: e < F.col(value)))
    ).drop("_cuts")
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        placed.groupBy(*keys, "_range")
        .agg(F.sum("_c").alias("_t"))
        .withColumn("_n", F.sum("_t").over(Window.partitionBy(*keys)))
        .withColumn("_below", F.coalesce(F.sum("_t").over(below), F.lit(0)))
        .drop("_t")
    )
    return (
        placed.withColumn("_in", F.sum("_c").over(inside))
        .join(totals, [*keys, "_range"])
        .withColumn("_hi", F.col("_below") + F.col("_in"))
        .drop("_in", "_below")
    )


def with_avg_rank(df: DataFrame, keys: Sequence[str], value: str, rank: str, count: str) -> DataFrame:
    """1-based rank with ties averaged; null values keep a null rank."""
    ranked = ordered_values(df, keys, value).select(
        *keys, value, (F.col("_hi") - (F.col("_c") - 1) / 2.0).alias(rank), F.col("_n").alias(count)
    )
    return df.join(ranked, [*keys, value], "left")


def quantile_edges(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles per group as an array column `edges`."""
    ordered = ordered_values(df, keys, value)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    spots = ordered.groupBy(*keys).agg(F.max("_n").alias("_n0")).withColumn("_q", wanted)
    pos = F.col("_q.p") * (F.col("_n0") - 1)
    spots = spots.select(
        *keys, F.col("_q.k").alias("_k"), F.floor(pos).alias("_lo"), F.ceil(pos).alias("_up"), (pos - F.floor(pos)).alias("_w")
    )
    # the few wanted positions per group travel as one array; each value tests its own span
    wants = spots.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "_lo", "_up", "_w"))).alias("_wants"))
    first = F.col("_hi") - F.col("_c")  # 0-based position of the first copy
    hit = lambda at: (at >= first) & (at < F.col("_hi"))
    found = (
        ordered.join(wants, list(keys))
        .withColumn("_hits", F.filter("_wants", lambda s: hit(s["_lo"]) | hit(s["_up"])))
        .filter(F.size("_hits") > 0)
        .select(*keys, value, "_hi", "_c", F.inline("_hits"))
    )
    part = F.when(hit(F.col("_lo")), F.col(value) * (1 - F.col("_w"))).otherwise(F.lit(0.0)) + F.when(
        hit(F.col("_up")), F.col(value) * F.col("_w")
    ).otherwise(F.lit(0.0))
    return (
        found.groupBy(*keys, "_k")
        .agg(F.sum(part).alias("_e"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_k", "_e"))).alias("_l"))
        .select(*keys, F.transform("_l", lambda s: s["_e"]).alias("edges"))
    )
