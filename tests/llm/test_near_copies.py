import os
import random

import numpy as np
import pytest

from marketloom.llm import near_copies as nc


def shingles(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_pairs(texts, similarity=0.8):
    """All pairs of texts with that similarity, by an inverted index over shingles."""
    sets, index = [shingles(t) for t in texts], {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    close = {(a, b) for rows in index.values() if len(rows) < 400 for k, a in enumerate(rows) for b in rows[k + 1 :]}
    return [(a, b) for a, b in close if jaccard(sets[a], sets[b]) >= similarity]


def edited(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"edit{r.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def made():
    r = random.Random(2)
    rows, pairs = [], []
    for g in range(150):
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(60, 300))]
        rows.append(" ".join(words))
        rows.append(edited(r, words, max(1, len(words) * r.choice([2, 10, 18, 60]) // 1000)))
    rows += [" ".join(f"u{r.randint(0, 9000)}" for _ in range(r.randint(20, 200))) for _ in range(300)]
    return rows


@pytest.mark.parametrize("tile", [50, 4096])
def test_recall_and_precision_against_brute_force(spark, docs, made, tile):
    pairs = brute_pairs(made)
    kept = {r["doc_id"] for r in nc.one_of_each(docs(list(enumerate(made))), tile=tile).collect()}
    lost = [b for a, b in pairs if a in kept and b in kept]
    assert len(pairs) > 80 and len(lost) <= 0.1 * len(pairs)
    partners = {i for p in brute_pairs(made, 0.7) for i in p}
    assert all(i in kept for i in range(len(made)) if i not in partners)


def components_of(n, pairs):
    group = list(range(n))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        group[y] = x
    return {top(i) for i in range(n)}


@pytest.mark.parametrize(("tile", "common"), [(3, 2), (4096, 32)])
def test_every_link_is_found_and_no_other(spark, docs, made, tile, common, monkeypatch):
    """Also where lanes find few links, shingles are common and their rows are dealt out."""
    monkeypatch.setattr(nc, "COMMON", common)
    r = random.Random(5)
    base = [f"c{i}" for i in range(40)]
    texts = made[:300] + [edited(r, base, r.choice([0, 1, 2])) for _ in range(40)] + [" ".join(base[: r.randint(4, 12)]) for _ in range(20)]
    texts += [f"x y z {' '.join(base)} {r.random()} {r.random()}" for _ in range(10)]
    kept = {r["doc_id"] for r in nc.one_of_each(docs(list(enumerate(texts))), tile=tile, recall=0.3).collect()}
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert kept == components_of(len(texts), pairs)


def test_tables_recall(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not mounted")
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = {}
    for r in table.orderBy("doc_id").collect():
        rows.setdefault(" ".join((r["text"] or "").split()), r["doc_id"])
    texts, ids = list(rows), list(rows.values())
    pairs = brute_pairs(texts)
    kept = {r["doc_id"] for r in nc.one_of_each(table).collect()}
    caught = sum(not (ids[a] in kept and ids[b] in kept) for a, b in pairs)
    assert caught >= 0.9 * len(pairs)
    alone = set(ids) - {ids[i] for p in brute_pairs(texts, 0.7) for i in p}
    gone = alone - kept
    assert len(gone) <= 0.002 * len(alone)


def shuffled(spark):
    """Bytes that the session has written for shuffles."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    executors = spark._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_texts_are_not_shuffled(spark, docs):
    """Few texts have links, so few are shuffled; shingles travel as prefixes only."""
    r = random.Random(4)
    texts = [" ".join(f"{r.getrandbits(256):x}" for _ in range(200)) for _ in range(600)]
    texts += [t + " end" for t in texts[:5]]
    table = docs(list(enumerate(texts)))
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r["doc_id"] for r in nc.one_of_each(table).collect()} == set(range(600))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 0.7 * sum(map(len, texts))


def test_sketches_never_exceed_the_difference():
    r = np.random.default_rng(8)
    for n, m, both in [(1, 1, 0), (5, 4, 4), (480, 480, 430), (480, 600, 300), (3000, 260, 250), (20_000, 16_001, 16_000)]:
        h = r.integers(0, 2**63, n + m - both, dtype="u8")
        a, b = np.sort(h[:n]), np.sort(h[n - both :])
        assert nc.least_apart(nc.sketch_of(a), nc.sketch_of(b)) <= n + m - 2 * both
    far = r.integers(0, 2**63, (2, 480), dtype="u8")
    assert nc.least_apart(*map(nc.sketch_of, far)) > 960 - 2 * nc.needed(np.array(960), 0.8)


def test_pairs_that_meet_but_are_far_apart_are_not_checked(spark, docs, monkeypatch):
    """Texts of half the same words share shingles of their prefixes; their sets of shingles are not gathered."""
    r = random.Random(6)
    half = [f"h{i}" for i in range(200)]
    texts = [" ".join([*half, *(f"o{r.random()}" for _ in range(150))]) for _ in range(40)]
    seen, checked = [], nc._checked
    monkeypatch.setattr(nc, "_checked", lambda pairs, *a: seen.append(pairs.count()) or checked(pairs, *a))
    assert nc.one_of_each(docs(list(enumerate(texts)))).count() == 40
    assert seen[1] == 0


def test_odd_rows(spark, docs, odd_texts):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(None, long), (7, long + " end"), (7, "one two"), (7, "ONE two"), (3, None), (2, " "), (1, ""), (None, None), (9, "one two three")]
    got = {(r["doc_id"], (r["text"] or "").lower()) for r in nc.one_of_each(docs(rows, ("_row", "f0", "a"))).collect()}
    assert got == {(1, ""), (7, long + " end"), (7, "one two"), (9, "one two three")}
    assert nc.one_of_each(docs([])).collect() == []
    assert len(nc.one_of_each(docs([(i, t) for i, t in enumerate(odd_texts)])).collect()) <= len(odd_texts)


def test_spanning_links_are_true_links_of_all_components():
    r = np.random.default_rng(1)
    for _ in range(30):
        n = 40
        a, b = r.integers(0, n, 60), r.integers(0, n, 60)
        parent = np.arange(n)
        la, lb = nc.spanning_links(a, b, parent)
        given = set(zip(a.tolist(), b.tolist()))
        assert set(zip(la.tolist(), lb.tolist())) <= given
        again = np.arange(n)
        nc.spanning_links(la, lb, again)
        assert (again == parent).all() and len(la) == n - len(set(parent.tolist()))


def test_tiles_skip_nothing_within_the_radius():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, (300, 2), dtype=np.uint64)
    flips = base.copy()
    for row in flips:
        for bit in r.choice(128, r.integers(0, 30), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    values = np.concatenate([base, flips])
    a, b, apart = nc.tile_links(values, None, 26, 32)
    assert (np.bitwise_count(a ^ b).sum(1) == apart).all() and (apart <= 26).all()
    near = {tuple(sorted((tuple(x), tuple(y)))) for x, y in zip(a.tolist(), b.tolist())}
    want = {tuple(sorted((tuple(x), tuple(y)))) for x, y in zip(base.tolist(), flips.tolist()) if 0 < sum((p ^ q).bit_count() for p, q in zip(x, y)) <= 26}
    assert want <= near
