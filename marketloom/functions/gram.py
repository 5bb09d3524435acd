"""Pairwise moments of many series by blocked matrix products.

Joining a universe with itself on the date would send rows x members through the shuffle.
Here every series is hashed to a block, each pair of blocks is one group, and a group holds
two blocks of history (bounded by block size x dates). Only the finished pair rows leave.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_SCHEMA = "a string, b string, n long, sx double, sy double, sxx double, syy double, sxy double"


def block_pairs(df: DataFrame, key: str, at: str, value: str, block: int = 128, within: str | None = None) -> DataFrame:
    """Rows (p, q, series, at, value): each row once per block pair that needs its block. With `within` only the
    series of one group are paired, and the rows carry the group as `g`."""
    blocks = F.greatest(F.ceil(F.col("_members") / block), F.lit(1)).cast("int").alias("_blocks")
    rows = df.select(F.col(key).alias("series"), F.col(at).alias("at"), F.col(value).alias("value"), F.col(within).alias("g") if within else F.lit("").alias("g"))
    members = rows.select("g", "series").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("_members")).select("g", blocks)
    # without groups the counts are one row
    counted = rows.join(members, "g") if within else rows.crossJoin(F.broadcast(members.drop("g")))
    return (
        counted
        .withColumn("_own", F.pmod(F.xxhash64("series"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "g",
            F.least("_own", "_other").alias("p"),
            F.greatest("_own", "_other").alias("q"),
            F.col("_own").alias("own"),
            "series",
            "at",
            "value",
        )
    )


def wide(pdf: pd.DataFrame) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Series names and (dates x series) matrices of the two blocks of a group."""
    p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
    grid = pdf.pivot(index="at", columns="series", values="value").sort_index()
    owner = pdf.drop_duplicates("series").set_index("series")["own"]
    left = sorted(s for s in grid.columns if owner[s] == p)
    right = sorted(s for s in grid.columns if owner[s] == q)
    return left, right, grid[left].to_numpy(float), grid[right].to_numpy(float)


def _moments(pdf: pd.DataFrame) -> pd.DataFrame:
    left, right, x, y = wide(pdf)
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(float), my.astype(float)
    parts = {"n": mx.T @ my, "sx": x.T @ my, "sy": mx.T @ y, "sxx": (x * x).T @ my, "syy": mx.T @ (y * y), "sxy": x.T @ y}
    out = pd.DataFrame({"a": np.repeat(left, len(right)), "b": np.tile(right, len(left))})
    for name, m in parts.items():
        out[name] = m.ravel()
    out["n"] = out["n"].round().astype("int64")
    swap = out["a"] > out["b"]
    if pdf["p"].iloc[0] == pdf["q"].iloc[0]:
        return out[~swap]
    # blocks are hashed, so order the names of a pair here
    flipped = out[swap].rename(columns={"a": "b", "b": "a", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"})
    return pd.concat([out[~swap], flipped[out.columns]])


def per_block(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str, at: str, value: str, block: int = 128) -> DataFrame:
    return block_pairs(df, key, at, value, block).groupBy("p", "q").applyInPandas(fn, schema)


def _group_moments(pdf: pd.DataFrame) -> pd.DataFrame:
    return _moments(pdf).assign(g=pdf["g"].iloc[0])


def pair_moments(df: DataFrame, key: str, at: str, value: str, block: int = 128, within: str | None = None) -> DataFrame:
    """One row per pair a <= b with the sums over the dates both series have; adds `cov`, `corr`. With `within`
    (a text column) pairs are made inside each of its groups only."""
    if within is None:
        out = per_block(df, _moments, PAIR_SCHEMA, key, at, value, block)
    else:
        blocks = block_pairs(df, key, at, value, block, within)
        out = blocks.groupBy("g", "p", "q").applyInPandas(_group_moments, PAIR_SCHEMA + ", g string").withColumnRenamed("g", within)
    n = F.col("n")
    cxy = F.col("sxy") - F.col("sx") * F.col("sy") / n
    cxx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    cyy = F.col("syy") - F.col("sy") * F.col("sy") / n
    return out.withColumn("cov", F.when(n > 1, cxy / (n - 1))).withColumn(
        "corr", F.when((n > 1) & (cxx > 0) & (cyy > 0), cxy / F.sqrt(cxx * cyy))
    )
