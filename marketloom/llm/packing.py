"""Best-fit packing by minimum bin slack.

A document is its token ids and one end id; longer ones are cut into pieces of the sequence length.
Full pieces are sequences of their own. The others are stored once, dealt out in turn to groups of
about `group_pieces`, and each group is packed by itself, so no task sees more than a group: for a bin,
the longest piece left is placed, and a subset-sum table over the lengths left, kept as bits of one
integer per length, finds the fullest combination for the space beside it, which is then removed.

Cases: a null text is an empty document, which is one piece holding the end id; rows with a null or
repeated id are packed like any other; equal pieces are told apart by their place in the group; an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import arrow_rows, kept, text_or_empty
from marketloom.llm.pieces import encoder

CAPACITY = 2048
#: Pieces packed together. Larger groups gain under a thousandth of a sequence per piece.
GROUP_PIECES = 4_096
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; `with_ids` adds the piece's ids as little-endian unsigned 32-bit bytes."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")

    def rows(batches):
        encode = encoder(path, False).encode
        for batch in batches:
            ids, bounds = encode(batch.column(1))
            made = []
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                data = np.append(ids[a:b], np.uint32(end_id)).astype("<u4", copy=False)
                for i, at in enumerate(range(0, len(data), capacity)):
                    part = data[at : at + capacity].tobytes()
                    made.append((doc, i, at, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            yield made

    plain = docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias(text_col))
    return arrow_rows(plain, [id_col, text_col], rows, PIECES + (", ids binary" if with_ids else ""), 2000, raw=True)


def fullest(counts: dict[int, int], space: int) -> list[int]:
    """Lengths, no more of each than `counts` has, whose sum is the largest that `space` holds."""
    if space <= 0:
        return []
    mask = (1 << (space + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= space), reverse=True):
        for _ in range(min(counts[length], space // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
        if reach >> space & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def minimum_slack_bins(lengths: list[int], capacity: int = CAPACITY) -> Iterator[list[int]]:
    """Bins of positions into `lengths`; each holds the longest piece left and its fullest company."""
    at: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        at.setdefault(lengths[i], []).append(i)
    counts = {n: len(v) for n, v in at.items()}
    order = sorted(at)

    def take(length: int) -> int:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
        return at[length].pop()

    while counts:
        while order[-1] not in counts:
            order.pop()
        first = order[-1]
        bin_ = [take(first)]
        bin_ += [take(n) for n in fullest(counts, capacity - first)]
        yield bin_


def pack(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`parts` (with `doc_id`, `piece`, `length`) with `sequence_id` and `offset`."""
    parts = kept(parts)
    short = F.col("length") < capacity
    groups = max(1, -(-parts.filter(short).count() // group_pieces))
    columns = parts.columns

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start")])
        lengths = table.column("length").to_pylist()
        sequence, offset = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
        base = table.column("_group")[0].as_py() << 32
        for number, bin_ in enumerate(minimum_slack_bins(lengths, capacity)):
            place = 0
            for i in bin_:
                sequence[i], offset[i] = base + number, place
                place += lengths[i]
        return table.select(columns).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = parts.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    packed = (
        parts.filter(short)
        .withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
        .groupBy("_group")
        .applyInArrow(fill, schema)
    )
    # full pieces need no company: numbers above those of any group, apart by task
    full = parts.filter(~short).select(
        *columns,
        (F.lit((groups + 1) << 32) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(full)


def best_fit_packing(docs: DataFrame, **options) -> DataFrame:
    """Pieces of all documents with their place: see `pieces` and `pack`."""
    return pack(pieces(docs, **options), options.get("capacity", CAPACITY))
