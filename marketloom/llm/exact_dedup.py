"""Exact de-duplication with a heavy-hitter split.

A Misra-Gries pass (`freqItems`, the counter algorithm of Karp, Schenker and Papadimitriou) names
at most 1/support digests that can be frequent. Their exact counts and smallest ids come from one
partial aggregate; this table of bounded size is broadcast, and the copies of a frequent text are
decided where they are read. Only the other rows are shuffled by digest, and a group of those
is smaller than `support` of the rows.

Cases: a null text counts as empty; rows with a null id come last among equal texts, and stay only
where no row with an id exists; a row repeated with id and text stays once; an empty table gives an
empty table; columns of the input that carry a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import SPACE, free_names, kept, text_or_empty

RESULTS = ("keep_id", "group_size", "kept", "text_sha256")
#: Share of the rows above which a digest surely becomes a candidate; 1/SUPPORT bounds the broadcast.
SUPPORT = 0.001


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def heavy_groups(digests: DataFrame, id_col: str, support: float = SUPPORT) -> DataFrame:
    """`_digest`, `_heavy_id`, `_heavy_size` of candidate digests, counted exactly: 1/support rows at most.

    Candidates that are not frequent do no harm: their figures are exact as well."""
    found = digests.select("_digest").freqItems(["_digest"], support)
    candidates = found.select(F.explode(found.columns[0]).alias("_digest"))
    mine = digests.join(F.broadcast(candidates), "_digest", "left_semi")
    return mine.groupBy("_digest").agg(F.min(id_col).alias("_heavy_id"), F.count(F.lit(1)).alias("_heavy_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """Every row of `docs` with `keep_id`, `group_size`, `kept` and `text_sha256`."""
    docs = docs.drop(*[c for c in docs.columns if c in RESULTS])
    key, heavy_id, heavy_size, rank = free_names(docs, "_key", "_heavy_id", "_heavy_size", "_rank")
    digests = kept(docs.select(F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("_digest")))
    heavy = heavy_groups(digests, "_id", support).toDF(key, heavy_id, heavy_size)
    rows = docs.withColumn(key, digest(F.col(text_col))).join(F.broadcast(heavy), key, "left")
    is_copy = F.col(heavy_size).isNotNull() & F.coalesce(F.col(id_col) != F.col(heavy_id), F.col(heavy_id).isNotNull())
    mine = [F.col(c) for c in docs.columns]
    decided = rows.filter(is_copy).select(
        *mine,
        F.col(heavy_id).alias("keep_id"),
        F.col(heavy_size).alias("group_size"),
        F.lit(False).alias("kept"),
        F.col(key).alias("text_sha256"),
    )
    group = Window.partitionBy(key)
    rest = (
        rows.filter(~is_copy)
        .withColumn(rank, F.row_number().over(group.orderBy(F.col(id_col).asc_nulls_last())))
        .select(
            *mine,
            F.coalesce(heavy_id, F.min(id_col).over(group)).alias("keep_id"),
            F.coalesce(heavy_size, F.count(F.lit(1)).over(group)).alias("group_size"),
            (F.col(rank) == 1).alias("kept"),
            F.col(key).alias("text_sha256"),
        )
    )
    return rest.unionByName(decided)
