import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from marketloom.llm.prefix_trie import TernaryTree, conversation_trie, median_order

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id bigint, turn int, role string, text string, shard string, path string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(set)
    for p in nodes:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in nodes.items()
    )


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def talks(seed, n, most, words):
    r = random.Random(seed)
    rows = []
    for c in range(0, n):
        for turn in range(r.randint(1, most)):
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(words), "x", "y"))
    return rows


@pytest.mark.parametrize("shard_turns", [1, 7, 200_000])
def test_equals_brute_force_over_many_shards(spark, shard_turns):
    rows = talks(1, 230, 7, ["a", "bé", "", None, "ccc"])
    rows += [(300 + i, t, "user", "same", "", "") for i in range(40) for t in range(3)]
    rows += [(700, t, "user", "long", "", "") for t in range(400)]
    # equal turn numbers, turns without numbers, repeated rows, rows without a conversation
    rows += [(801, None, "user", "b", "", ""), (801, None, "user", "a", "", ""), (801, 3, None, None, "", ""), (801, 3, None, None, "", "")]
    rows += [(None, 1, "user", "lost", "", ""), (800, None, None, "z" * 50_000, "", "")]
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA), shard_turns)) == brute(rows)


def test_absent_openings_leave_members_of_the_root(spark):
    rows = [(c, 0, "user", "one", "", "") for c in range(110, 160)]
    want = brute(rows)
    assert found(conversation_trie(spark.createDataFrame(rows, SCHEMA))) == want
    assert want[0][7] != hashlib.sha256(b"").hexdigest()


def test_empty_table(spark):
    assert found(conversation_trie(spark.createDataFrame([], SCHEMA))) == []


def test_tables_agree_with_brute_force(spark, folder):
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    assert found(conversation_trie(table, 50)) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_tree_is_balanced_and_walked_without_recursion():
    rows = [([i], [1], 1, i, "") for i in range(4095)]
    tree = TernaryTree()
    for i in median_order(len(rows)):
        tree.insert(*rows[i])
    steps, node = 0, tree.down[0]
    while node:
        steps, node = steps + 1, tree.low[node]
    assert steps == 12
    deep = TernaryTree()
    deep.insert(range(50_000), [1] * 50_000, 1, 0, "")
    assert sum(1 for _ in deep.walk()) == 50_001
