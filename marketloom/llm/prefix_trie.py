"""Conversations rebuilt with shared openings, and the prefix trie of their turns.

Turns are dictionary-encoded (one integer per distinct role and text), a conversation is the array of its
turns' integers, and equal conversations collapse to one sequence. Sequences are dealt out by
range in lexicographic order; each range is cut into shards of at most `shard_turns` turns. A shard becomes a
ternary search tree, filled median first so that it is balanced, and walked iteratively (no recursion), leaves
before tops, for members, children, leaves and savings. Only nodes on the paths of a shard's first and last sequence can
occur in other shards: those boundary nodes are merged by their path, and what lies below them is summed along
the two paths, each merged node counted by the first shard that has it.

Cases: turns of a conversation are ordered by turn (null first), role and text, so equal turn numbers and repeated
rows have a defined order and all count; null roles and texts are empty; rows without `conv_id` belong to no
conversation and are left out; a conversation without any turn left is a member of the root; an empty table has no nodes; more
columns are ignored. The ids of one conversation (8 bytes a turn) are handled in one task, and the member ids of one
sequence pass one task as a sorted stream in constant memory, as a digest of their list must.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import arrow_rows, kept, text_or_empty

#: Turns of a shard, at most (a longer conversation is a shard by itself); about 100 bytes each in a worker.
SHARD_TURNS = 200_000
FAMILY = 100
OPENINGS = 6
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
ROOT = ""


def encoded_turns(turns: DataFrame) -> DataFrame:
    """`conv_id`, `place` (from 1), `id` of the turn's role and text, `chars` of its text."""
    said = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", text_or_empty(F.col("role")).alias("role"), text_or_empty(F.col("text")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    key = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    placed = kept(said.select("conv_id", F.row_number().over(order).alias("place"), key.alias("key"), F.char_length("text").alias("chars")))
    # the dictionary is stored before it is read, so an id does not depend on a task's second run
    known = kept(placed.select("key").distinct().select("key", F.monotonically_increasing_id().alias("id")))
    return placed.join(known, "key").select("conv_id", "place", "id", "chars")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes over from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % OPENINGS


def rebuilt(encoded: DataFrame) -> DataFrame:
    """`conv_id` and `turns`, the (id, chars) of every rebuilt conversation in order."""
    own = encoded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "chars"))).alias("own"))
    # first turns are few a conversation; the join by family meets at most FAMILY rows with one
    given = own.select(F.col("conv_id").alias("first"), F.slice("own", 1, OPENINGS - 1).alias("opening")).filter(F.col("first") % FAMILY == 0)
    h = shared_turns(F.col("conv_id")).cast("int")
    both = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY).join(given, "first", "left")
    opening = F.slice(F.coalesce("opening", F.slice("own", 1, 0)), F.lit(1), h)
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    plain = lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))
    return both.select("conv_id", F.transform(F.concat(opening, rest), plain).alias("turns"))


def distinct_sequences(conversations: DataFrame) -> DataFrame:
    """`ids`, `chars`, `n` members, `conv_id` (the smallest), `ends` (digest of the members' ids) of every distinct sequence."""
    members = kept(conversations.withColumn("key", F.unhex(F.sha2(F.array_join(F.transform("turns", lambda t: t["id"].cast("string")), ","), 256))))
    one = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns"))

    def digests(batches):
        key, state = None, None
        for group in batches:
            made = []
            for k, conv in group:
                if k == key:
                    state.update(b",%d" % conv)
                    continue
                if key is not None:
                    made.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(b"%d" % conv)
            yield made
        if key is not None:
            yield [(key, state.hexdigest())]

    ordered = members.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    ends = arrow_rows(ordered, ["key", "conv_id"], digests, "key binary, ends string", 4096)
    parts = [F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: t["chars"]).alias("chars")]
    return one.join(ends, "key").select(*parts, "n", "conv_id", "ends")


class TernaryTree:
    """A ternary search tree over integer sequences; a node is a distinct prefix, node 0 the empty one.

    `low` and `high` lead to siblings with smaller and larger ids, `down` to the first child."""

    def __init__(self):
        self.key, self.chars = array("q"), array("q")
        self.low, self.high, self.down = array("q"), array("q"), array("q")
        self.n, self.conv, self.ends = array("q"), array("q"), {}
        self._node(0, 0)

    def _node(self, key: int, chars: int) -> int:
        for column, value in ((self.key, key), (self.chars, chars), (self.low, 0), (self.high, 0), (self.down, 0), (self.n, 0), (self.conv, 0)):
            column.append(value)
        return len(self.key) - 1

    def path(self, ids: Sequence[int], chars: Sequence[int] | None = None) -> list[int]:
        """Nodes of the sequence from the top; those missing are made if `chars` is given."""
        at, out = 0, [0]
        for i, key in enumerate(ids):
            links, parent, node = self.down, at, self.down[at]
            while node and self.key[node] != key:
                links = self.low if key < self.key[node] else self.high
                parent, node = node, links[node]
            if not node:
                if chars is None:
                    raise KeyError(key)
                node = links[parent] = self._node(key, chars[i])
            at = node
            out.append(at)
        return out

    def insert(self, ids: Sequence[int], chars: Sequence[int], n: int, conv: int, ends: str) -> None:
        at = self.path(ids, chars)[-1]
        self.n[at], self.conv[at], self.ends[at] = n, conv, ends

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """(node, parent, depth), every node before those below it."""
        stack = [(0, -1, 0)]
        while stack:
            node, parent, depth = stack.pop()
            yield node, parent, depth
            for sibling in (self.high[node], self.low[node]):
                if sibling:
                    stack.append((sibling, parent, depth))
            if self.down[node]:
                stack.append((self.down[node], node, depth + 1))


def median_order(n: int) -> Iterator[int]:
    """0..n-1, the middle of every range before its halves."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            ranges += [(mid + 1, b), (a, mid)]


def shard_nodes(rows: Sequence[tuple]) -> Iterator[tuple]:
    """Nodes of a shard: rows (ids, chars, n, conv_id, ends) in lexicographic order of ids.

    Yields (arm, depth, path, parent_path, chars, conv_id, parent_conv_id, n, children, leaves, saved, ends). `arm` is null for
    inner nodes, whose figures are whole; 0, 1, 2 for nodes on both paths, on the first and on the last
    sequence's: their children, leaves and savings are those below inner children alone."""
    tree = TernaryTree()
    for i in median_order(len(rows)):
        tree.insert(*rows[i])
    edge: dict[int, tuple[int, str]] = {}
    first, last = tree.path(rows[0][0]), tree.path(rows[-1][0])
    for arm, nodes in ((1, first), (2, last)):
        name = ROOT
        for depth, node in enumerate(nodes):
            if depth:
                name = hashlib.sha256(f"{name},{tree.key[node]}".encode()).hexdigest()
            edge[node] = (0 if node in edge else arm, name)
    size = len(tree.key)
    parents, depths, order = array("q", bytes(8 * size)), array("q", bytes(8 * size)), array("q")
    for node, parent, depth in tree.walk():
        parents[node], depths[node] = parent, depth
        order.append(node)
    n, conv = array("q", tree.n), array("q", tree.conv)
    children, leaves, saved = (array("q", bytes(8 * size)) for _ in range(3))
    whole = array("b", bytes(size))  # 1 where members of the node are known
    for node in range(size):
        whole[node] = 1 if tree.n[node] else 0
    for node in reversed(order):
        inner = node not in edge
        if inner:
            leaves[node] = leaves[node] or 1
            saved[node] += (n[node] - 1) * tree.chars[node]
        parent = parents[node]
        if parent < 0:
            continue
        n[parent] += n[node]
        conv[parent] = min(conv[parent], conv[node]) if whole[parent] else conv[node]
        whole[parent] = 1
        if inner:
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    for node in order:
        parent = parents[node]
        arm, name = edge.get(node, (None, None))
        above = edge[parent][1] if parent in edge else None
        own = (tree.chars[node], conv[node], conv[parent] if parent >= 0 else None, n[node], children[node], leaves[node], saved[node])
        yield arm, depths[node], name, above, *own, tree.ends.get(node)


NODES = (
    "shard bigint, arm int, depth bigint, path string, parent_path string, chars bigint, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)


def trie_shards(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of all shards, see `shard_nodes`."""

    def rows(groups):
        task = TaskContext.get().partitionId()
        shard, turns, number = [], 0, 0
        for group in groups:
            for row in group:
                if shard and turns + len(row[0]) + 1 > shard_turns:
                    yield from numbered(shard_nodes(shard), (task << 32) + number)
                    shard, turns, number = [], 0, number + 1
                # typed arrays: a list of Python integers takes four times the memory
                shard.append((array("q", row[0]), array("q", row[1]), *row[2:]))
                turns += len(row[0]) + 1
        if shard:
            yield from numbered(shard_nodes(shard), (task << 32) + number)

    def numbered(nodes, shard):
        made = []
        for node in nodes:
            made.append((shard, *node))
            if len(made) == 4096:
                yield made
                made = []
        yield made

    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sequences.repartitionByRange(parts, "ids").sortWithinPartitions("ids")
    return arrow_rows(ordered, ["ids", "chars", "n", "conv_id", "ends"], rows, NODES, 256)


def merged_edges(edges: DataFrame) -> DataFrame:
    """One row per boundary node over all shards: `path`, `parent_path`, `depth` and the figures of the whole node."""
    one = edges.groupBy("path").agg(
        *[F.first(c).alias(c) for c in ("parent_path", "depth", "chars")],
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"),
        F.max("ends_sha256").alias("ends_sha256"),
        F.min(F.struct("shard", "arm")).alias("owner"),
    )
    # a boundary child is one child, in however many shards it occurs
    shared = edges.filter(F.col("parent_path").isNotNull()).select("path", "parent_path").distinct()
    shared = shared.groupBy(F.col("parent_path").alias("path")).agg(F.count(F.lit(1)).alias("shared"))
    whole = one.join(shared, "path", "left").withColumn("n_children", F.col("inner") + F.coalesce("shared", F.lit(0)))
    whole = kept(whole.drop("inner", "shared"))
    mine = F.struct("shard", "arm") == F.col("owner")
    own = edges.select("path", "shard", "arm", "depth", "n_leaves", "saved_tokens").join(whole.select("path", "chars", "n_convs", "n_children", "owner"), "path")
    own = own.select(
        "path",
        "shard",
        "arm",
        "depth",
        (F.col("n_leaves") + F.when(mine & (F.col("n_children") == 0), 1).otherwise(0)).alias("leaves"),
        (F.col("saved_tokens") + F.when(mine, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)).alias("saved"),
    )
    below = Window.partitionBy("shard", "arm").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    arms = own.filter("arm > 0").groupBy("shard").agg(F.sum("leaves").alias("arm_leaves"), F.sum("saved").alias("arm_saved"))
    summed = own.select("path", "shard", "arm", F.sum("leaves").over(below).alias("leaves"), F.sum("saved").over(below).alias("saved"))
    stem = lambda c: F.when(F.col("arm") == 0, F.coalesce(c, F.lit(0))).otherwise(0)
    totals = summed.join(arms, "shard", "left").groupBy("path")
    totals = totals.agg(F.sum(F.col("leaves") + stem("arm_leaves")).alias("n_leaves"), F.sum(F.col("saved") + stem("arm_saved")).alias("saved_tokens"))
    return whole.join(totals, "path")


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_of(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per trie node of `distinct_sequences`."""
    nodes = kept(trie_shards(sequences, shard_turns))
    edges = nodes.filter(F.col("arm").isNotNull())
    whole = kept(merged_edges(edges))
    tops = whole.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("top"))
    boundary = whole.join(tops, "parent_path", "left").withColumn("parent_conv_id", F.col("top"))
    # a node below a boundary node asks its own shard for the merged parent, so the root's children stay spread
    above = edges.join(whole.select("path", F.col("conv_id").alias("top")), "path").select("shard", F.col("path").alias("parent_path"), "top")
    inner = nodes.filter(F.col("arm").isNull())
    inner = inner.join(above, ["shard", "parent_path"], "left").withColumn("parent_conv_id", F.coalesce("top", "parent_conv_id"))
    ends = F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256")
    return boundary.select(*COLUMNS).unionByName(inner.select(*COLUMNS)).select(*COLUMNS[:-1], ends)


def conversation_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The prefix trie of the rebuilt conversations of `turns` (conv_id, turn, role, text), one row per node."""
    return trie_of(kept(distinct_sequences(rebuilt(encoded_turns(turns)))), shard_turns)
