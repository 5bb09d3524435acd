"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from marketloom.llm import components, exact_dedup, simhash


def test_exact_dedup(docs):
    r = random.Random(1)
    rows = [(i, r.choice(["a  b", "a\nb", "c", "", None, " ", f"own {i}"])) for i in range(400)]
    rows += [(1000 + i, "hot\ttext") for i in range(500)] + [(None, "hot text"), (None, "only null"), (None, "only null"), (7, "same"), (7, "same")]
    df = docs(rows, extra=("kept", "_digest", "group_size", "_key")).withColumn("note", F.lit(1))
    got = exact_dedup.exact_dedup(df, support=0.2).select("doc_id", "text", "keep_id", "group_size", "kept", "text_sha256", "note").collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    assert len(got) == len(rows)
    for x in got:
        plain = re.sub(r"[\x20\x09-\x0d]+", " ", x.text or "")
        ids = [i for i in groups[plain] if i is not None]
        assert (x.keep_id, x.group_size) == (min(ids) if ids else None, len(groups[plain]))
        assert x.text_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert not x.kept or x.doc_id == x.keep_id
    assert sum(x.kept for x in got) == len(groups)
    assert len({x.text_sha256 for x in got if x.kept}) == len(groups)
    assert exact_dedup.exact_dedup(docs([])).collect() == []


def test_heavy_groups_are_exact(spark, docs):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    digests = docs(rows).select("doc_id", exact_dedup.digest(F.col("text")).alias("_digest"))
    found = {r._digest: (r._heavy_id, r._heavy_size) for r in exact_dedup.heavy_groups(digests, "doc_id", 0.01).collect()}
    assert found[hashlib.sha256(b"hot").hexdigest()] == (0, 1000)
    assert len(found) <= 100


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_texts):
    for t in odd_texts:
        assert simhash.fingerprint(t) == slow_print(t), repr(t)


def by_brute_force(values, radius):
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(root(i), set()).add(v)
    return sorted(map(sorted, groups.values()))


def near_values(n, seed):
    """Fingerprints in chains and clouds about a few centres, and single ones."""
    r = random.Random(seed)
    out = set()
    for _ in range(n // 8):
        v = r.getrandbits(64)
        for _ in range(8):
            out.add(v)
            for _ in range(r.randint(1, 7)):
                v ^= 1 << r.randrange(64)
    return sorted(out | {0, 1, 3, 2**64 - 1})


def connected(spark, values, **options):
    prints = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "fp long")
    nodes = components.connected_components(simhash.links(prints, **options), "a", "b").collect()
    place = {r.node: r.component for r in nodes}
    groups = {}
    for v in values:
        s = v - (v >> 63 << 64)
        groups.setdefault(place.get(s, s), set()).add(v)
    return sorted(map(sorted, groups.values()))


def test_links_lose_none(spark):
    values = near_values(400, 4)
    want = by_brute_force(values, 4)
    assert any(len(g) > 2 for g in want)
    assert connected(spark, values) == want
    assert connected(spark, values, shared=1) == want


def test_links_of_split_lanes(spark):
    """Lanes beyond the tile size go to tasks by tile pair, with nothing lost."""
    r = random.Random(9)
    base = r.getrandbits(64)
    values = set()
    while len(values) < 300:
        v = base
        for _ in range(r.randint(0, 6)):
            v ^= 1 << r.randrange(40)
        values.add(v)
    values = sorted(values)
    assert connected(spark, values, tile=20) == by_brute_force(values, 4)


def test_tiles(spark):
    values = np.array(near_values(600, 8), "uint64")
    values = values[np.argsort(np.bitwise_count(values), kind="stable")]
    for tile in (7, 64, 512):
        edges = simhash.close_links(values, None, 4, tile)
        assert all((a ^ b).bit_count() <= 64 for a, b in edges)
        place = {int(v): int(v) for v in values}

        def root(v, place=place):
            while place[v] != v:
                v = place[v]
            return v

        for a, b in edges:
            place[root(a)] = root(b)
        groups = {}
        for v in place:
            groups.setdefault(root(v), set()).add(v)
        assert sorted(map(sorted, groups.values())) == by_brute_force([int(v) for v in values], 4)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30))


def test_near_duplicates(docs):
    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = [r.choice(words) for _ in range(300)]
        rows.append((3 * i, " ".join(text)))
        text[r.randrange(300)] = "changed"
        rows.append((3 * i + 1, " ".join(text)))
        rows.append((3 * i + 2, " ".join(text).upper()))
    rows += [(900, ""), (901, None), (902, " \n"), (None, "w1 w2")]
    got = simhash.near_duplicates(docs(rows, extra=("fp", "a"))).collect()
    prints = {i: slow_print(t) for i, t in rows}
    groups = by_brute_force(sorted(set(prints.values())), 4)
    least = {v: min((i for i, p in prints.items() if p in g and i is not None), default=None) for g in groups for v in g}
    assert len(got) == len(rows)
    for x in got:
        assert x.fingerprint == f"{prints[x.doc_id]:016x}" and x.component_id == least[prints[x.doc_id]]
    assert simhash.near_duplicates(docs([])).collect() == []
