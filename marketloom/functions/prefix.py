"""Running sums over groups of any size, and interval overlap of two running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def inside_chunk(keys: Sequence[str], chunk: str, order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def earlier_chunks(keys: Sequence[str], chunk: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)


def with_prefix_sums(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Each `out: value` of `sums` summed up to and including the row, in (chunk, order) order.

    Every (key, chunk) is summed on its own and shifted by the totals of the earlier chunks, so
    a hot key is spread over its chunks; only one row per chunk is ordered per key. All sums
    share one pass and one join.
    """
    run, before = inside_chunk(keys, chunk, order), earlier_chunks(keys, chunk)
    base = df.select("*", *[v.cast("double").alias(f"_v_{o}") for o, v in sums.items()])
    totals = base.groupBy(*keys, chunk).agg(*[F.sum(f"_v_{o}").alias(f"_t_{o}") for o in sums])
    offsets = totals.select(*keys, chunk, *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0.0)).alias(f"_o_{o}") for o in sums])
    local = base.select(*df.columns, *[F.sum(f"_v_{o}").over(run).alias(f"_l_{o}") for o in sums])
    return local.join(offsets, [*keys, chunk]).select(*df.columns, *[(F.col(f"_o_{o}") + F.col(f"_l_{o}")).alias(o) for o in sums])


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: str = "cell") -> DataFrame:
    """Rows of both sides whose [lo, hi) intervals overlap, per key.

    Both sides carry `lo`, `hi` and the key's `cell` width (a few mean interval lengths). An
    interval is listed in every cell it touches, and a pair is kept only in the cell where its
    overlap starts. The number of listings grows with rows, whatever the distribution of
    lengths, and a hot key is spread over its cells.
    """

    def listed(df: DataFrame) -> DataFrame:
        cells = F.sequence(F.floor(F.col("lo") / F.col(cell)), F.floor(F.col("hi") / F.col(cell)))
        return df.withColumn("_at", F.explode(cells))

    l = listed(left)
    r = listed(right)
    r = r.select(*keys, "_at", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in (*keys, cell)])
    start = F.greatest(F.col("lo"), F.col("r_lo"))
    end = F.least(F.col("hi"), F.col("r_hi"))
    return (
        l.join(r, [*keys, "_at"])
        .filter((end > start) & (F.floor(start / F.col(cell)) == F.col("_at")))
        .withColumn("overlap", end - start)
        .drop("_at", cell)
    )
