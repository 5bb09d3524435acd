"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64-bit majority votes over XXH64 values of the 4-word shingles. Equal fingerprints
collapse to one before anything is compared. Two fingerprints within `radius` bits agree on at least
`shared` of radius + shared blocks of bits, so every fingerprint enters one lane per choice of
`shared` blocks, keyed by their bits: no close pair misses each other, and no pair of the whole table
is formed. A lane's members are cut into tiles; tiles are compared with numpy exclusive-or
and bit counts, and a pair of tiles whose ranges of population counts lie further apart than the
radius is skipped. A lane with more than `tile` members is split: a tile then holds one
population count (or a share of it), and tile pairs within the radius are dealt out to
tasks of their own. A task turns the links it finds into a spanning forest before it returns
them, so a group of near copies never becomes all its pairs.

Cases: a text without words (null, empty, white space) has fingerprint zero and links like any
other; fewer than four words make one shingle; rows with a null id get a fingerprint and a component
that is the smallest id reachable (null where none is); an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import arrow_rows, free_name, kept, written
from marketloom.llm.components import connected_components

BITS = 64
RADIUS = 4
SHARED = 2
TILE = 8192
SHINGLE = 4
SEED = 42


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - SHINGLE + 1)
    hash_ = xxhash.xxh64_intdigest
    spans = zip(starts[:last].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist(), strict=True)
    values = np.array([hash_(joined[a:b], SEED) for a, b in spans], "<u8")
    votes = np.zeros(BITS, "int64")
    for at in range(0, len(values), 4096):
        part = values[at : at + 4096]
        votes += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(votes * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `fp` (the fingerprint as a signed 64-bit number)."""

    def rows(groups):
        for group in groups:
            yield [(doc, (f := fingerprint(text)) - (f >> 63 << 64)) for doc, text in group]

    return arrow_rows(docs, [id_col, text_col], rows, "doc_id bigint, fp bigint")


def _blocks(radius: int, shared: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + shared blocks that cover all bits."""
    count = radius + shared
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _lanes(radius: int, shared: int):
    """Lane key columns of `fp`: one per choice of blocks."""
    blocks = _blocks(radius, shared)
    out = []
    for lane, chosen in enumerate(combinations(range(len(blocks)), shared)):
        key = F.lit(lane).cast("long")
        for i in chosen:
            shift, mask = blocks[i]
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask))
            key = F.shiftleft(key, mask.bit_length()).bitwiseOR(part)
        out.append(key)
    return out


def _forest(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> None:
    """Hangs the trees of linked positions together; `parent` points at roots afterwards."""
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def close_links(own: np.ndarray, other: np.ndarray | None, radius: int, tile: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links within `own`, or between `own` and `other`, as pairs of values.

    Both are sorted by population count; a pair of tiles is skipped where their ranges of
    counts lie further apart than the radius."""
    values = own if other is None else np.concatenate([own, other])
    counts = np.bitwise_count(values).astype("int16")
    parent = np.arange(len(values))
    n, m = len(own), len(values)
    for r in range(0, n, tile):
        r_end = min(n, r + tile)
        first = r if other is None else n
        for c in range(first, n if other is None else m, tile):
            c_end = min(n if other is None else m, c + tile)
            if counts[c] - counts[r_end - 1] > radius or counts[r] - counts[c_end - 1] > radius:
                continue
            near = np.bitwise_count(values[r:r_end, None] ^ values[None, c:c_end]) <= radius
            i, j = np.nonzero(near)
            _forest(i + r, j + c, parent)
    roots = np.flatnonzero(parent != np.arange(m))
    return [(int(values[i]), int(values[parent[i]])) for i in roots]


def _short_run_links(keys: np.ndarray, values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest within runs of equal keys, for many short runs at once: neighbours at distance 1, 2, ..."""
    parent, lag = np.arange(len(keys)), 1
    alive = np.arange(len(keys))
    while True:
        alive = alive[alive + lag < len(keys)]
        alive = alive[keys[alive] == keys[alive + lag]]
        if not len(alive):
            break
        near = alive[np.bitwise_count(values[alive] ^ values[alive + lag]) <= radius]
        _forest(near, near + lag, parent)
        lag += 1
    roots = np.flatnonzero(parent != np.arange(len(keys)))
    return list(zip(values[roots].tolist(), values[parent[roots]].tolist(), strict=True))


#: Runs of at most this many members are compared together, longer ones tile by tile.
SHORT_RUN = 32


def _run_links(keys: np.ndarray, sides: np.ndarray, values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of whole runs; rows are sorted by key. Long runs go tile by tile."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([cuts, [len(keys)]]))
    long_runs = sizes > SHORT_RUN
    split = sides >= 0
    whole = np.repeat(long_runs, sizes) | split
    found = _short_run_links(keys[~whole], values[~whole], radius)
    for at, size in zip(cuts.tolist(), sizes.tolist(), strict=True):
        if not whole[at]:
            continue
        v, s = values[at : at + size], sides[at : at + size]
        order = np.argsort(np.bitwise_count(v), kind="stable")
        v, s = v[order], s[order]
        two = s[0] >= 0 and (s != s[0]).any()
        found += close_links(v[s == 0], v[s == 1], radius) if two else close_links(v, None, radius) if (s <= 0).all() else []
    return found


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def links(prints: DataFrame, radius: int = RADIUS, shared: int = SHARED, tile: int = TILE) -> DataFrame:
    """(`a`, `b`) between different fingerprints within the radius: enough to connect all that are close.

    prints: distinct `fp`."""
    spark = prints.sparkSession
    keyed = prints.select("fp", F.explode(F.array(*_lanes(radius, shared))).alias("key")).withColumn(
        "pop", F.bit_count("fp").cast("int")
    )
    sizes = keyed.groupBy("key", "pop").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.groupBy("key").agg(F.sum("n").alias("lane")).filter(F.col("lane") > tile)
    large = kept(sizes.join(large.select("key"), "key", "left_semi"))
    home = F.col("key").alias("key"), F.lit(-1).cast("long").alias("pair"), F.lit(-1).alias("side"), "fp"
    plain = keyed.join(large.select("key").distinct(), "key", "left_anti").select(*home)
    members = plain
    if not large.isEmpty():
        # tile (pop, share): a tile meets itself and the tiles above it in (pop, share) order within the radius
        shares = large.select("key", "pop", F.ceil(F.col("n") / tile).cast("int").alias("shares"))
        neighbours = shares.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("pop", "shares"))).alias("by_pop"))
        mine = (
            keyed.join(neighbours, "key")
            .withColumn("share", F.pmod(F.xxhash64("fp"), F.element_at("by_pop", F.col("pop"))).cast("int"))
            .withColumn("near", F.explode(F.sequence(F.col("pop") - radius, F.col("pop") + radius)))
            .withColumn("near_shares", F.element_at("by_pop", F.col("near")))
            .filter(F.col("near_shares").isNotNull())
            .withColumn("near_share", F.explode(F.sequence(F.lit(0), F.col("near_shares") - 1)))
        )
        tile_no = lambda pop, share: F.col(pop).cast("long") * F.lit(1 << 24) + F.col(share)
        own, near = tile_no("pop", "share"), tile_no("near", "near_share")
        pair = F.xxhash64("key", F.least(own, near), F.greatest(own, near)).bitwiseAND(F.lit((1 << 62) - 1))
        members = plain.unionByName(
            mine.select("key", pair.alias("pair"), F.when(own <= near, 0).otherwise(1).cast("int").alias("side"), "fp")
        )

    def find(batches):
        rest = None
        for batch in batches:
            key = np.asarray(batch.column(0)).astype("int64")
            pair, side = np.asarray(batch.column(1)).astype("int64"), np.asarray(batch.column(2)).astype("int64")
            value = np.asarray(batch.column(3)).astype("int64").view("uint64")
            if rest is not None:
                key, pair, side, value = (np.concatenate(x) for x in zip(rest, (key, pair, side, value), strict=True))
            same = (key == key[-1]) & (pair == pair[-1])
            start = len(key) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = key[start:], pair[start:], side[start:], value[start:]
            if start:
                yield from emit(key[:start], pair[:start], side[:start], value[:start])
        if rest is not None:
            yield from emit(*rest)

    def emit(key, pair, side, value):
        # runs of (key, pair): one number per run
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
        found = _run_links(np.cumsum(new), np.where(pair < 0, -1, side), value, radius)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_signed(x) for x in a], pa.int64()), pa.array([_signed(x) for x in b], pa.int64())], names=["a", "b"]
            )

    dealt = members.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "pair")
    return dealt.sortWithinPartitions("key", "pair").mapInArrow(find, "a bigint, b bigint")


def _components(classes: DataFrame, radius: int, shared: int) -> DataFrame:
    """`classes` (distinct `fp`) with `component`, the smallest fingerprint reachable."""
    nodes = connected_components(links(classes.select("fp"), radius, shared), "a", "b", classes.count())
    # fingerprints without a link are components of their own
    return classes.join(nodes, F.col("fp") == F.col("node"), "left").select(
        *classes.columns, F.coalesce("component", "fp").alias("component")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shared: int = SHARED
) -> DataFrame:
    """`doc_id`, `fingerprint`, `component_id` of every row."""
    prints = kept(fingerprints(docs, id_col, text_col))
    classes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), prints.count())
    placed = _components(classes, radius, shared)
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = placed.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shared: int = SHARED
) -> DataFrame:
    """One row of `docs` for each group of near-duplicates, unchanged: the one of smallest id, null ids last.

    Rows are told apart by a number that is stored with them, so repeated ids do no harm."""
    row = free_name(docs, "_row")
    stored = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-dedup")
    prints = kept(fingerprints(stored, row, text_col).withColumnRenamed("doc_id", row))
    ids = stored.select(row, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("_at"))
    classes = kept(prints.join(ids, row).groupBy("fp").agg(F.min("_at").alias("_at")), prints.count())
    first = _components(classes, radius, shared).groupBy("component").agg(F.min("_at").alias("_at"))
    return stored.join(first.select(F.col("_at.row").alias(row)), row, "left_semi").select(*docs.columns)
