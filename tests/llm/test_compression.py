import math
import random

import pytest
import zstandard

from marketloom.llm.compression import BLOCK, LEVEL, Sizes, fit, quality_scores

GOOD = "the river runs past old towns and quiet fields where people grow barley and keep bees".split()


def clean(r, n):
    return " ".join(r.choice(GOOD) for _ in range(n))


def junk(r, n):
    return " ".join(r.choice(GOOD).upper() + r.choice(["$$$", "!!", "***"]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    rows = [(i, clean(r, r.randint(20, 300)) if i % 4 else junk(r, r.randint(20, 300)), "x", "y") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string, half string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(800)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_held_out_documents(spark, tables):
    docs, labels = tables
    rows = quality_scores(docs, fit(docs, labels)).collect()
    assert len(rows) == 800
    kept_out = [r for r in rows if r["held_out"]]
    assert 100 < len(kept_out) < 250
    assert all(r["predicted"] == int(r["doc_id"] % 4 > 0) and 0 <= r["score"] <= 1 for r in kept_out)


def test_held_out_labels_are_never_read(spark, tables):
    from marketloom.llm.toxicity import held_out

    docs, labels = tables
    flipped = labels.withColumn("quality", (labels["quality"] == held_out(labels["doc_id"]).cast("int")).cast("int"))
    turned = flipped.withColumn("quality", 1 - flipped["quality"])
    want = {r["doc_id"]: r["score"] for r in quality_scores(docs, fit(docs, labels)).collect()}
    assert {r["doc_id"]: r["score"] for r in quality_scores(docs, fit(docs, turned)).collect()} == want


def test_features_equal_direct_compression():
    r = random.Random(5)
    text = clean(r, 3000) + "é" * 5000
    good, bad = clean(r, 500).encode(), junk(r, 500).encode()
    data, totals = text.encode(), []
    for d in (good, bad, b""):
        known = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if d else None
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        totals.append(sum(len(coder.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)))
    g, b, own = totals
    assert Sizes(good, bad).features(text) == pytest.approx(((g - b) / (g + b), own / len(data), math.log(len(data))))


def test_odd_rows(spark, tables, docs, odd_texts):
    train, labels = tables
    model = fit(train, labels)
    rows = [(None, "a"), (1, None), (1, None), (2, "")] + [(10 + i, t) for i, t in enumerate(odd_texts)] + [(5, clean(random.Random(1), 100_000))]
    found = quality_scores(docs(rows, ("score", "Half")), model).collect()
    assert len(found) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in found)
    empty = {round(r["score"], 12) for r in found if r["doc_id"] in (1, 2)}
    assert len(empty) == 1


def test_without_labels_of_both_kinds(spark, tables, docs):
    train, labels = tables
    alone = fit(train, labels.filter("quality = 1"))
    assert {r["score"] for r in quality_scores(docs([(1, "a"), (2, None)]), alone).collect()} == {1.0}
    none = fit(train, labels.limit(0))
    assert [r["score"] for r in quality_scores(docs([(1, "a")]), none).collect()] == [0.5]
    assert quality_scores(docs([]), none).collect() == []
    assert quality_scores(docs([]), fit(docs([]), labels)).collect() == []


def test_sample_is_bounded(spark, tables):
    from marketloom.llm.compression import labelled_sample

    train, labels = tables
    n = labelled_sample(train, labels, "doc_id", "text", 100).count()
    assert 50 < n < 150


def test_tables_held_out_accuracy(spark):
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not mounted")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    bad = [r for r in rows if not r["quality"]]
    good = [r for r in rows if r["quality"]]
    assert sum(r["predicted"] == 0 for r in bad) >= 0.9 * len(bad)
    assert sum(r["predicted"] for r in good) >= 0.995 * len(good)
