"""Near copies at a word-shingle similarity: wide SimHash fingerprints, tiled comparison, exact check.

A text's fingerprint has 128 bits: majority votes over two hashes of each of its distinct shingles. At Jaccard similarity j two texts
differ in about acos(2j / (1 + j)) / pi of the bits. A lane is a fixed random choice of bits; fingerprints that agree
in a lane's bits meet there. Bits per lane follow from the number of fingerprints and lanes from the similarity and `recall`, so that
a pair at the similarity shares a lane with that probability at one deviation beyond its mean distance. A lane's members are compared tile by tile
with exclusive-or and bit counts, tiles sorted by population count; tile pairs further apart than the radius are skipped. A
lane with more members than a tile is dealt out by pairs of tiles.

What a task finds leaves it as a spanning forest of true links, so a group of near copies never becomes all its
pairs. Links are checked exactly, by the texts' shingle sets, and join if they reach `similarity`.

Lanes miss some links. Those between groups still apart come from an exact search: sets of similarity t share one of the
first n - ceil(t n) + 1 of their n shingles in any common order, so texts meet at these shingles and are checked likewise,
unless parities of their shingles in buckets already differ in more bits than such texts have shingles apart.

Texts are never shuffled whole but those of a link: rows are picked where they are scanned, by bitmaps of bounded size.

Cases: texts are lower-cased (A-Z) and split at ASCII white space; fewer words than a shingle make one shingle; texts without words are equal;
rows with null or repeated ids are rows of their own; the row of smallest id stays, null ids last; more columns stay as they are; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
import random

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import arrow_rows, free_name, kept, let, marked, words_of, written
from marketloom.llm.components import connected_components

BITS = 128
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9
TILE = 4096
SEED = 42
#: Deviations of the number of differing bits: links nearer than the mean less SURE need no check, those beyond the mean plus REACH are none.
SURE, REACH = 2.0, 1.7
#: Shingles that more than COMMON texts are known to hold come last in the order of shingles, COMMON_TOKENS of them at most; they change the work,
#: not the pairs. A task lists the shingles that LISTED or more of the texts it holds at a time have, CHUNK shingles of texts at least.
COMMON, COMMON_TOKENS, LISTED, CHUNK = 32, 20_000, 4, 1 << 20
#: Runs of at most this many rows are compared together.
SHORT = 32


def share_of_bits(similarity: float) -> float:
    """The expected share of differing bits at a Jaccard similarity of sets of equal size."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def bounds(similarity: float) -> tuple[int, int]:
    """(surely near, possibly near): numbers of differing bits."""
    p = share_of_bits(similarity)
    mean, deviation = BITS * p, math.sqrt(BITS * p * (1 - p))
    return int(mean - SURE * deviation), math.ceil(mean + REACH * deviation)


def lane_bits(fingerprints: int, similarity: float, recall: float) -> list[list[int]]:
    """The bits of every lane. Lanes hold about 2^8 unrelated fingerprints at any size of the corpus."""
    p = share_of_bits(similarity)
    p += math.sqrt(p * (1 - p) / BITS)
    width = min(max(12, int(math.log2(max(fingerprints, 1))) - 8), 40)
    lanes = math.ceil(math.log(1 - recall) / math.log(1 - (1 - p) ** width))
    r = random.Random(SEED)
    return [sorted(r.sample(range(BITS), width)) for _ in range(lanes)]


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles: every word is hashed once, a shingle is a polynomial in its words' hashes."""
    known = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    of_words = np.fromiter(map(known.__getitem__, words), "<u8", len(words))
    size = min(shingle, len(words))
    last = len(words) - size + 1
    out = np.zeros(last, "<u8")
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + of_words[k : k + last]
    return np.unique(_mixed(out))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def fingerprint_of(first: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of the majority votes over a text's shingle hashes."""
    if not len(first):
        return 0, 0
    second = _mixed(first * np.uint64(0x9E3779B97F4A7C15))  # the second hash is a mix of the first
    out = []
    for half in (first, second):
        votes = np.zeros(64, "int64")
        for at in range(0, len(half), 4096):
            votes += np.unpackbits(half[at : at + 4096].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
        out.append(int(np.packbits(votes * 2 > len(half), bitorder="little").view("<i8")[0]))
    return out[0], out[1]


def text_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; none without words."""
    words = (text or "").encode().lower().split()
    return shingle_hashes(words, shingle) if words else np.zeros(0, "<u8")


def wide_fingerprint(text: str | None, shingle: int = SHINGLE) -> tuple[int, int]:
    """Two signed 64-bit halves."""
    return fingerprint_of(text_hashes(text, shingle))


def spanning_links(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links (a, b) that hang trees of `parent` together, a link for each; `parent` points at roots afterwards."""
    out_a, out_b = [], []
    while len(a):
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        out_a.append(a[first])
        out_b.append(b[first])
        parent[high[first]] = low[first]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
    empty = np.zeros(0, "int64")
    return np.concatenate(out_a or [empty]), np.concatenate(out_b or [empty])


def tile_links(own: np.ndarray, other: np.ndarray | None, radius: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the true links within `own`, or between `own` and `other` (rows of two 64-bit halves): the linked rows and their distances."""
    values = own if other is None else np.concatenate([own, other])
    pops = np.bitwise_count(values).sum(1, dtype="int16")
    n, m = len(own), len(values)
    # either side in the order of its population counts
    order = np.argsort(pops[:n], kind="stable")
    if other is not None:
        order = np.concatenate([order, n + np.argsort(pops[n:], kind="stable")])
    values, pops = values[order], pops[order]
    parent, links = np.arange(m), []
    for r in range(0, n, tile):
        r_end = min(n, r + tile)
        stop = n if other is None else m
        for c in range(r if other is None else n, stop, tile):
            c_end = min(stop, c + tile)
            if pops[c] - pops[r_end - 1] > radius or pops[r] - pops[c_end - 1] > radius:
                continue
            apart = np.bitwise_count(values[r:r_end, None, 0] ^ values[None, c:c_end, 0])
            apart += np.bitwise_count(values[r:r_end, None, 1] ^ values[None, c:c_end, 1])
            i, j = np.nonzero(apart <= radius)
            if c == r and other is None:
                once = i < j
                i, j = i[once], j[once]
            if not len(i):
                continue
            # the nearest pairs first, so that a forest is of links as sure as can be
            for low, high in ((0, radius // 2), (radius // 2 + 1, radius)):
                d = apart[i, j]
                at = (d >= low) & (d <= high)
                links.append(spanning_links(i[at] + r, j[at] + c, parent))
    a, b = (np.concatenate(x) if x else np.zeros(0, "int64") for x in zip(*links, strict=True)) if links else (np.zeros(0, "int64"),) * 2
    return values[a], values[b], np.bitwise_count(values[a] ^ values[b]).sum(1, dtype="int64")


LINKS = "a0 bigint, a1 bigint, b0 bigint, b1 bigint, apart int"


def lane_links(prints: DataFrame, lanes: list[list[int]], radius: int, tile: int = TILE) -> DataFrame:
    """Links (`a0`, `a1`, `b0`, `b1`, `apart`) between distinct fingerprints (`f0`, `f1`) that share a lane, enough to connect all within the radius."""

    def key(lane: int, bits: list[int]) -> Column:
        # a hash of the chosen bits: lanes that share a value by chance are compared together, which loses nothing
        masks = [sum(1 << b % 64 for b in bits if b // 64 == half) for half in (0, 1)]
        chosen = [F.col(c).bitwiseAND(F.lit(m - (m >> 63 << 64)).cast("long")) for c, m in zip(("f0", "f1"), masks, strict=True)]
        return F.xxhash64(F.lit(lane), *chosen)

    keyed = prints.select("f0", "f1", F.explode(F.array(*[key(i, bits) for i, bits in enumerate(lanes)])).alias("lane"))
    # lanes are as many as their keys; only those beyond a tile are listed
    large = keyed.groupBy("lane").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
    large = written(large.select("lane", F.ceil(F.col("n") / tile).cast("int").alias("parts")), "near-lanes")
    dealt = keyed.join(large, "lane", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("f0", "f1"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = dealt.select("lane", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "f0", "f1")

    def rows(batches):
        unit, held = None, []
        for batch in batches:
            columns = [np.asarray(batch.column(k)).astype("int64") for k in range(6)]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                name = tuple(int(c[a]) for c in columns[:3])
                if name != unit and held:
                    yield found(unit, held)
                    held = []
                unit = name
                held.append([c[a:b] for c in columns[3:]])
        if held:
            yield found(unit, held)

    def found(unit, held):
        part, f0, f1 = (np.concatenate(c) for c in zip(*held, strict=True))
        if len(part) < 2:
            return []
        values = np.column_stack([f0, f1]).view("uint64")
        own, other = (values, None) if unit[1] == unit[2] else (values[part == unit[1]], values[part == unit[2]])
        if other is not None and not (len(own) and len(other)):
            return []
        a, b, apart = tile_links(own, other, radius)
        return list(zip(*a.view("int64").T.tolist(), *b.view("int64").T.tolist(), apart.tolist(), strict=True)) if len(a) else []

    ordered = units.repartition("lane", "i", "j").sortWithinPartitions("lane", "i", "j")
    out = arrow_rows(ordered, ["lane", "i", "j", "part", "f0", "f1"], rows, LINKS, 65536, raw=True)
    return out.filter("a0 <> b0 or a1 <> b1")


def shingle_set(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of the distinct shingles of a text."""

    def cut(words: Column) -> Column:
        last = F.greatest(F.size(words) - shingle, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, F.lit(shingle)), " ")))

    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return let(words_of(lower), lambda words: F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(cut(words))))


def needed(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """The least number of common shingles of two sets with so many shingles together."""
    return np.ceil(similarity / (1 + similarity) * sizes - 1e-9).astype("int64")


def often(chunk: list[np.ndarray]) -> list[tuple]:
    """(null, shingle, texts, null) of the shingles that several of these texts hold."""
    tokens, n = np.unique(np.concatenate([*chunk, np.zeros(0, "<u8")]), return_counts=True)
    many = n >= LISTED
    return [(None, t, k, None) for t, k in zip(tokens[many].view("int64").tolist(), n[many].tolist(), strict=True)]


def prefix_of(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in an order that all texts share, common ones (sorted) last: texts of that similarity have one of them in common."""
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def sketch_of(hashes: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in buckets, two buckets a shingle at least and a power of two in all."""
    bits = 1 << max(9, (2 * len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(bits - 1)).view("int64"), minlength=bits)
    return np.packbits((counts & 1).astype("u1")).tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """A number of shingles that lie in one of two sets only, by their sketches: each such shingle turns one bit, so there are no fewer."""
    x, y = sorted((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype="int64"))


def prefixes(texts: DataFrame, row: str, text_col: str, common: np.ndarray, similarity: float, shingle: int = SHINGLE) -> DataFrame:
    """(`node`, `n`, `tokens`, `sketch`) of every text that has words: its number of shingles, its prefix and its parities."""

    def rows(groups):
        for group in groups:
            hashed = [(r, text_hashes(text, shingle)) for r, text in group]
            yield [(r, len(h), prefix_of(h, common, similarity).view("int64"), sketch_of(h)) for r, h in hashed if len(h)]

    return arrow_rows(texts, [row, text_col], rows, "node bigint, n int, tokens array<bigint>, sketch binary")


def meeting_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (node, comp, n, pos) of one shingle, or between two parts of its rows, that lie in different
    components and can still have the similarity: from the shared shingle on, no more are common than either has left."""
    left = [x[np.argsort(left[1], kind="stable")] for x in left]
    whole = right is None
    right = left if whole else [x[np.argsort(right[1], kind="stable")] for x in right]
    out = []
    for r in range(0, len(left[0]), tile):
        na, ca, la, pa = (x[r : r + tile] for x in left)
        for c in range(r if whole else 0, len(right[0]), tile):
            nb, cb, lb, pb = (x[c : c + tile] for x in right)
            if ca[0] == ca[-1] == cb[0] == cb[-1]:
                continue
            room = np.minimum((la - pa)[:, None], (lb - pb)[None, :])
            i, j = np.nonzero((ca[:, None] != cb[None, :]) & (room >= needed(la[:, None] + lb[None, :], similarity)))
            if whole and c == r:
                i, j = i[i < j], j[i < j]
            out.append((np.minimum(na[i], nb[j]), np.maximum(na[i], nb[j])))
    a, b = zip(*out, strict=True) if out else ((), ())
    empty = np.zeros(0, "int64")
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def missed_pairs(sets: DataFrame, similarity: float, tile: int = TILE) -> DataFrame:
    """Pairs (`a`, `b` of `node`) of texts in different components (`comp`) among which are all that have the similarity.

    A pair of that similarity shares a shingle of its prefixes (`tokens`, see `prefix_of`), whichever order the shingles have. Shingles whose rows
    lie in one component are dropped where they are scanned; one with more rows than a tile is dealt out by pairs of tiles."""
    keyed = sets.select("node", "comp", "n", F.posexplode("tokens").alias("pos", "token"))
    met = keyed.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    met = written(met.filter("low <> high").select("token", F.ceil(F.col("rows") / tile).cast("int").alias("parts")), "near-tokens")
    keyed = marked(keyed, "token", met.select("token"), "_met").filter("_met").drop("_met")
    dealt = keyed.join(met, "token").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = dealt.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "comp", "n", "pos")

    def rows(batches):
        rest = None
        for batch in batches:
            columns = [np.asarray(batch.column(k)).astype("int64") for k in range(8)]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            last = np.all([c == c[-1] for c in columns[:3]], axis=0)
            start = len(last) - int(last.sum())  # rows are sorted, so those of the last unit stand at the end
            rest = [c[start:] for c in columns]
            yield from found([c[:start] for c in columns])
        if rest is not None:
            yield from found(rest)

    def found(columns):
        if not len(columns[0]):
            return
        new = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
        cuts = np.flatnonzero(np.concatenate([[True], new]))
        sizes = np.diff(np.concatenate([cuts, [len(columns[0])]]))
        small = np.repeat((sizes <= SHORT) & (columns[1][cuts] == columns[2][cuts]), sizes)
        unit, (node, comp, n, pos) = np.repeat(np.arange(len(cuts)), sizes)[small], (c[small] for c in columns[4:])
        alive, lag = np.arange(len(unit)), 1
        while True:
            # neighbours at distance 1, 2, ... of many short runs at once
            alive = alive[alive + lag < len(unit)]
            alive = alive[unit[alive] == unit[alive + lag]]
            if not len(alive):
                break
            x, y = alive, alive + lag
            good = (comp[x] != comp[y]) & (np.minimum(n[x] - pos[x], n[y] - pos[y]) >= needed(n[x] + n[y], similarity))
            x, y = node[x[good]], node[y[good]]
            yield list(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))
            lag += 1
        for at, size in zip(cuts.tolist(), sizes.tolist(), strict=True):
            if small[at]:
                continue
            i, j, part, *values = (c[at : at + size] for c in columns[1:])
            if i[0] == j[0]:
                a, b = meeting_pairs(values, None, similarity)
            else:
                own = part == i[0]
                a, b = meeting_pairs([v[own] for v in values], [v[~own] for v in values], similarity) if own.any() and not own.all() else (own[:0], own[:0])
            yield list(zip(a.tolist(), b.tolist(), strict=True))

    ordered = units.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    pairs = arrow_rows(ordered, ["token", "i", "j", "part", "node", "comp", "n", "pos"], rows, "a bigint, b bigint", 65536, raw=True)
    return possible(pairs.distinct(), sets, similarity)


def possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs without those whose sketches say that too many shingles lie in one text only."""

    def rows(groups):
        for group in groups:
            most = [na + nb - 2 * int(needed(np.array(na + nb), similarity)) for _, _, na, nb, _, _ in group]
            yield [(a, b) for (a, b, _, _, x, y), m in zip(group, most, strict=True) if least_apart(x, y) <= m]

    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
    return arrow_rows(pairs, ["a", "b", "na", "nb", "sa", "sb"], rows, "a bigint, b bigint")


def _checked(pairs: DataFrame, stored: DataFrame, row: str, text_col: str, similarity: float, shingle: int) -> DataFrame:
    """The pairs (`a`, `b` of `row`) whose texts have that Jaccard similarity of shingles."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias(row)).distinct(), "near-wanted")
    texts = marked(stored.select(row, text_col), row, wanted, "_wanted").filter("_wanted").join(wanted, row, "left_semi")
    sets = written(texts.select(row, shingle_set(F.col(text_col), shingle).alias("s")), "near-sets")
    left, right = (sets.select(F.col(row).alias(c), F.col("s").alias(f"s{c}")) for c in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return both.filter((union == 0) | (F.col("common") >= similarity * union - 1e-9)).select("a", "b")


def one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    recall: float = RECALL,
    tile: int = TILE,
) -> DataFrame:
    """One row of `docs`, unchanged, for each group of near copies: texts linked by a chain of pairs that have the similarity, all of them.
    `recall` is the share of links that the lanes find; the rest is found by shared shingles. Runs jobs: fingerprints, links and groups are stored as
    they are made."""
    row = free_name(docs, "_row")
    stored = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-copies", "zstd")

    def rows(groups):
        chunk, size = [], 0
        for group in groups:
            hashed = [(r, text_hashes(text, shingle)) for r, text in group]
            yield [(r, *fingerprint_of(h), xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63)) for r, h in hashed]
            chunk += [h for _, h in hashed]
            size += sum(len(h) for _, h in hashed)
            if size >= CHUNK:
                yield often(chunk)
                chunk, size = [], 0
        yield often(chunk)

    # rows without `r` list shingles: f0 is the shingle, f1 the number of texts
    made = kept(arrow_rows(stored, [row, text_col], rows, "r bigint, f0 bigint, f1 bigint, s bigint"))
    prints = made.filter("r is not null")
    # a class of equal shingle sets is named by its first row, and so is one of equal fingerprints in the lanes
    classes = kept(prints.groupBy("f0", "f1", "s").agg(F.min("r").alias("node")))
    named = kept(classes.groupBy("f0", "f1").agg(F.min("node").alias("node")))
    radius = bounds(similarity)[1]
    lanes = lane_bits(named.count(), similarity, recall)
    ends = {c: named.select(F.col("f0").alias(f"{c}0"), F.col("f1").alias(f"{c}1"), F.col("node").alias(c)) for c in ("a", "b")}
    met = lane_links(named, lanes, radius, tile).distinct()
    met = kept(met.join(ends["a"], ["a0", "a1"]).join(ends["b"], ["b0", "b1"]).select("a", "b"))
    near = kept(_checked(met, stored, row, text_col, similarity, shingle))
    groups = connected_components(near, "a", "b")
    # lanes find most links at little cost; those they miss between groups still apart are found by shared shingles
    many = made.filter("r is null").groupBy("f0").agg(F.sum("f1").alias("n")).filter(F.col("n") > COMMON)
    many = many.orderBy(F.desc("n"), "f0").limit(COMMON_TOKENS)  # a bounded list; it only sets the order
    common = np.sort(np.array([r["f0"] for r in many.collect()], "int64").view("uint64"))
    nodes = classes.select("node").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
    sets = written(prefixes(stored, row, text_col, common, similarity, shingle).join(nodes, "node"), "near-prefixes")
    missed = kept(missed_pairs(sets, similarity, tile))
    more = _checked(missed, stored, row, text_col, similarity, shingle)
    whole = connected_components(near.unionByName(more), "a", "b")
    named = prints.join(classes, ["f0", "f1", "s"]).join(whole, "node", "left").select("r", F.coalesce("component", "node").alias("component"))
    named = kept(named)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("r")).alias("at")
    first = named.join(stored.select(F.col(row).alias("r"), order), "r").groupBy("component").agg(F.min("at").alias("at"))
    dropped = named.join(first, "component").filter("r <> at.r").select(F.col("r").alias(row))
    dropped = written(dropped, "near-dropped")
    gone = free_name(stored, "_gone")
    known = marked(stored, row, dropped, gone)
    perhaps = known.filter(gone).join(dropped, row, "left_anti")
    return known.filter(~F.col(gone)).unionByName(perhaps).select(*docs.columns)
