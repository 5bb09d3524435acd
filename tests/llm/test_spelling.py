import random
import re
import zlib
from collections import Counter

import pytest

from marketloom.llm.spelling import near_pairs, spelling_variants, variants

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")
UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute_vocabulary(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(UPPER)):
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(n_of):
    out = []
    form = {}
    for w, n in n_of.items():
        others = [o for o in n_of if near(w, o)]
        best = min(others, key=lambda o: (-n_of[o], o), default=None)
        form[w] = best if best is not None and n_of[best] >= 2 * n else None
        out.append([w, form[w], None, n, len(others), n_of[form[w]] if form[w] else None])
    for row in out:
        at = row[0]
        while form[at]:
            at = form[at]
        row[2] = at
    return sorted(map(tuple, out))


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def words(seed, n, letters, low, high):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(low, high))): r.choice([3, 3, 4, 7, 20, 100]) for _ in range(n)}


@pytest.mark.parametrize("tile", [1, 7, 2048])
def test_equals_brute_force(spark, tile):
    n_of = words(1, 400, "ab", 5, 9) | words(2, 200, "aéΩ中𝒳", 5, 6) | {"a" * 300: 5, "a" * 299: 20, "a" * 298 + "b": 9}
    df = spark.createDataFrame(list(n_of.items()), "word string, n bigint")
    assert found(variants(df, tile)) == brute(n_of)


def test_near_pairs_by_both_kinds_of_block():
    every = [w for w in words(4, 300, "ab", 5, 7)]
    want = {frozenset((a, b)) for a in every for b in every if near(a, b)}
    got = []
    for length in range(5, 9):
        for by_start in (True, False):
            head = (length - 1) // 2
            tail = length - 1 - head
            blocks = {}
            for w in every:
                if len(w) in (length, length - 1):
                    blocks.setdefault(w[:head] if by_start else w[-tail:], []).append(w)
            for block in blocks.values():
                for i, j in near_pairs(block, block, length, by_start, True):
                    got += [frozenset((block[x], block[y])) for x, y in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got)) and set(got) == want


def test_texts(spark, docs):
    r = random.Random(9)
    stems = ["Walking", "walkin", "wålking", "talking", "étaient", "etaient", "small", "smalls", "smal"]
    rows = [(i, " ".join(r.choice(stems) + r.choice(["", ".", "7", "É"]) for _ in range(60))) for i in range(120)]
    rows += [(None, "nullid nullid nullid, walking"), (3, None), (4, ""), (5, "x" * 60_000 + " " + "talking " * 5000), (5, "again again"), (5, "again")]
    n_of = brute_vocabulary(rows)
    assert any(len(w) == 6 and "walking".startswith(w[:3]) for w in n_of)
    assert found(spelling_variants(docs(rows, ("word", "n")))) == brute(n_of)


def test_empty_table(spark, docs):
    assert found(spelling_variants(docs([]))) == []
    assert found(spelling_variants(docs([(1, "only short words")]))) == []


def test_chain_of_forms_has_one_root(spark):
    n_of = {"aaaaa" + "b" * i: 3 * 2**i for i in range(9)}
    rows = {r["word"]: r["root"] for r in variants(spark.createDataFrame(list(n_of.items()), "word string, n bigint")).collect()}
    assert set(rows.values()) == {"aaaaa" + "b" * 8}


def test_tables_agree_with_brute_force(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    n_of = brute_vocabulary([tuple(r) for r in table.collect()])
    # the definition, by deleting one code point of either word
    holes = {}
    for w in n_of:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    close = {w: set() for w in n_of}
    for w in n_of:
        for i in range(len(w)):
            close[w] |= holes[(w[:i], w[i + 1 :])] - {w}
            shorter = w[:i] + w[i + 1 :]
            if shorter in n_of:
                close[w].add(shorter)
                close[shorter].add(w)
    rows = found(spelling_variants(table))
    assert [(r[0], r[3], r[4]) for r in rows] == sorted((w, n, len(close[w])) for w, n in n_of.items())
    for word, form, _, n, _, form_n in rows:
        best = min(close[word], key=lambda o: (-n_of[o], o), default=None)
        assert form == (best if best and n_of[best] >= 2 * n else None)
        assert form_n == (n_of[form] if form else None)
