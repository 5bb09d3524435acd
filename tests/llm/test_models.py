"""Fitted operators: toxic segments and page text, and the pipeline that joins operators."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import html_tree, toxicity


def slow_segments(scores):
    """Ruzzo and Tompa's definition: the best segment, then the same on either side of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] + 1e-9):
                best = (i, j + 1, total)
    if best is None:
        return []
    a, b, s = best
    right = [(x + b, y + b, z) for x, y, z in slow_segments(scores[b:])]
    return [*slow_segments(scores[:a]), (a, b, s), *right]


def test_maximal_segments():
    r = random.Random(1)
    for _ in range(300):
        # odd multiples of powers keep sums apart, so that no tie depends on order
        scores = [r.choice([-1, 1]) * (r.random() + 0.01) for _ in range(r.randint(0, 14))]
        got, want = toxicity.maximal_segments(scores), slow_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for _, _, s in got], [s for _, _, s in want])


def test_compressed_scan_equals_full_scan():
    r = random.Random(2)
    toxic, other = np.zeros(64, "int32"), np.zeros(64, "int32")
    for w in ("bad", "vile"):
        toxic[toxicity.token_classes(w, 64)] = 50
    scores = toxicity.TokenScores(toxic, other, 0.1)
    for _ in range(50):
        text = " ".join(r.choice(["bad", "vile", "calm", "blue", "x"]) for _ in range(r.randint(0, 30)))
        ((n, found),) = scores.segments([text])
        (full,) = scores.of([text])
        assert n == len(full) == len(text.split())
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in toxicity.maximal_segments(full.tolist())]
        hits = [w for w, x in zip(text.split(), full, strict=True) if x > 0]
        assert len(hits) == len(set(hits)) == len({"bad", "vile"} & set(text.split()))
    assert [n for n, _ in scores.segments(["", " ", " bad  x ", "\n"])] == [0, 0, 2, 0]


@pytest.fixture(scope="module")
def toxic_rows():
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("lum", "ner", "tog", "wix", "pal") for b in ("a", "en", "ist", "or", "um", "ly")]
    rows, marks = [], {}
    for i in range(1200):
        text = [r.choice(words) for _ in range(r.randint(5, 120))]
        marks[i] = int(r.random() < 0.2)
        if marks[i]:
            for _ in range(3):
                text[r.randrange(len(text))] = r.choice(["scoundrel", f"vrax{r.choice(['is', 'en', 'o', 'um', 'ert'])}"])
        rows.append((i, " ".join(text)))
    return rows, marks


def test_toxicity(spark, docs, toxic_rows):
    rows, marks = toxic_rows
    rows = [*rows, (5000, None), (5001, ""), (5002, " \n"), (None, "scoundrel and vraxen"), (3, rows[3][1]), (5003, "vraxotten " + "luma " * 9), (5004, "palum " * 20_000)]
    df = docs(rows, extra=("score", "toxic", "half"))
    labels = spark.createDataFrame([*marks.items(), (7, 1 - marks[7]), (None, 1), (8, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = toxicity.toxicity_scores(df, model).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x.held_out and x.doc_id in marks and x.doc_id != 7]
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert sum(x.predicted == marks[x.doc_id] for x in held) >= 0.97 * len(held)
    by_id = {x.doc_id: x for x in got}
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    assert by_id[None].predicted == 1 and by_id[5003].predicted == 1  # an ending never seen
    assert not any(by_id[i].predicted for i in (5000, 5001, 5002, 5004))
    passages = toxicity.toxic_passages(df, model).filter("doc_id = 5003").collect()
    assert [(x.start, x.end) for x in passages] == [(0, 1)]
    kept = toxicity.without_toxic(df, model)
    assert kept.schema == df.schema
    assert kept.count() == sum(x.predicted == 0 for x in got)
    # other rows' labels, and those held out, make no difference
    other = labels.filter(~toxicity.held_out(F.col("doc_id")) | F.col("doc_id").isNull())
    again = toxicity.fit(df, other)
    assert (again.slope, again.offset, again.scale) == (model.slope, model.offset, model.scale)


def test_toxicity_without_labels(spark, docs, toxic_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = docs(toxic_rows[0][:20])
    assert {x.score for x in toxicity.toxicity_scores(df, toxicity.fit(df, none)).collect()} == {0.0}
    empty = docs([])
    assert toxicity.toxicity_scores(empty, toxicity.fit(empty, none)).collect() == []


def page(i, marked=True):
    r = random.Random(i)
    line = lambda n: " ".join(r.choice("stone river lamp &amp; cloud green paper walks".split()) for _ in range(n)).capitalize() + "."
    body = [line(r.randint(1, 9)), *[line(r.randint(1, 60)) for _ in range(r.randint(1, 9))]]
    main = "article" if marked else "div"
    links = "".join(f'<li><a href="/{k}">{line(1)}</a></li>' for k in range(6))
    extra = r.choice(["", f"<aside><p>{line(20)}</p></aside>", f'<div class="comments"><p>{line(20)}</p></div>', f"<form>{line(3)}<button>Go</button></form>"])
    html_ = (
        f'<!DOCTYPE html><html><head><title>{body[0]}</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body><nav><ul>{links}</ul></nav>'
        f'<!-- <p>ad</p> --><div class="ad">{line(12)}</div><{main}><h1>{body[0]}</h1><p><b>{body[1]}<br><p>'
        + "</p>\n<p>".join(body[2:])
        + f"</p>{extra}</{main}><footer>&copy; {line(5)}</footer></body></html>"
    )
    import html

    return html_, "\n".join(html.unescape(b) for b in body)


def test_page_text(spark):
    pages = [(i, f"u{i}", page(i)[0]) for i in range(300)]
    odd = [(900, None, None), (901, "u", ""), (902, "u", "no markup"), (903, "u", "<<p"), (None, "u", page(1)[0]), (1, "again", page(1)[0]), (904, "u", "<p>" * 3000)]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("features", F.lit(2))
    model = html_tree.fit(df)
    got = html_tree.main_texts(df, model).collect()
    assert len(got) == len(pages) + len(odd)
    for x in got:
        assert x.n_chars == len(x.text)
        if x.page_id is None or x.page_id < 900:
            assert x.text == page(1 if x.page_id is None else x.page_id)[1]
    assert all(x.text == "" for x in got if x.page_id in (900, 901, 904))
    # without landmarks most pages are still found
    found = sum(model.text(page(i, False)[0]) == page(i, False)[1] for i in range(300, 400))
    assert found >= 60
    none = df.limit(0)
    assert html_tree.main_texts(none, html_tree.fit(none)).collect() == []


def test_marginals_equal_brute_force():
    model = html_tree.TreeModel(np.random.default_rng(1).normal(size=html_tree.FEATURES), np.random.default_rng(2).normal(size=(3, 2, 2)))
    nodes = html_tree.parse("<div>a<p>b<article>c</article></div><nav>d<ul><li>e<li>f</ul></nav>")
    own, marks = html_tree.features(nodes)
    unary = [model.weights[html_tree.hashed(a + b)].sum() for a, b in zip(own, marks, strict=True)]
    kinds = [html_tree.edge_kind(n) for n in nodes]
    total, content = 0.0, np.zeros(len(nodes))
    for mask in range(1 << len(nodes)):
        y = [mask >> i & 1 for i in range(len(nodes))]
        weight = np.exp(sum(u for u, v in zip(unary, y, strict=True) if v) + sum(model.edges[kinds[i], y[nodes[i].parent], y[i]] for i in range(1, len(nodes))))
        total += weight
        content += weight * np.array(y)
    assert np.allclose(model.marginals(nodes), content / total)


def test_parser_repairs():
    texts = lambda page: [t for n in html_tree.parse(page) for _, t in n.runs]
    assert texts("<p><b>one<br>more<p>two</p>&lt;three&gt;") == ["<three>", "one more", "two"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d") == ["d", "a", "b", "c"]
    assert texts("<style>x</style><p>a<script>if (a < b) '</p>'</script>b") == ["a", "b"]
    assert texts("<p title='a>b'>x</i>y</div>z") == ["xyz"]


def test_pipeline(spark, folder, tmp_path):
    import corpus_pipeline
    from marketloom.llm import bpe, exact_dedup
    from tests.llm.test_near_copies import brute_pairs

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = seen
        seen = stage(spark, before, folder)
        assert seen.columns == docs.columns
        seen.write.parquet(f"{tmp_path}/{n}")
        seen = spark.read.parquet(f"{tmp_path}/{n}")
        ids, had = {r.doc_id for r in seen.collect()}, {r.doc_id: r.text for r in before.collect()}
        assert ids <= had.keys()
        if n == 0:
            clean = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic = 0").collect()} & had.keys()
            assert len(clean - ids) <= 0.01 * len(clean)
        elif n == 1:
            assert ids == {r.keep_id for r in exact_dedup.exact_dedup(before).collect()}
        elif n == 2:
            order = sorted(had)
            pairs = [(order[a], order[b]) for a, b in brute_pairs([had[i] for i in order])]
            partners = {order[i] for p in brute_pairs([had[i] for i in order], 0.7) for i in p}
            assert sum(a in ids and b in ids for a, b in pairs) <= 0.1 * len(pairs)
            assert had.keys() - ids <= partners
        else:
            assert ids == had.keys() and not any("@mail" in r.text for r in seen.collect())
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == ids
    assert bpe.encode_texts(seen).count() == len(ids)


@pytest.mark.parametrize(
    "page",
    [
        "<p>kept</p><div " + 'data-k="v" ' * 10_000,
        "<p>kept</p>" + "<a " * 300_000,
        "<p>kept</p>" + "<div '\" " * 100_000,
        "<p>kept</p>" + "<span>" * 60_000 + "</div>" * 60_000,
        "<p>kept</p>" + "<b><span>" * 60_000 + "</b>" * 60_000,
        "<p>kept</p>" + "<span>" * 60_000 + "<li></li>" * 60_000,
        "<p>kept</p>" + "<script></script " * 60_000,
        "<p>kept</p>" + "<article>" * 60_000,
    ],
    ids=["quotes", "openings", "mixed", "stray", "inline", "items", "scripts", "nested"],
)
def test_pages_end_whatever_they_hold(page):
    start = time.time()
    nodes = html_tree.parse(page)
    html_tree.own_labels(nodes)
    assert time.time() - start < 2
    assert [t for n in nodes for _, t in n.runs][0] == "kept"


def test_truncated_tag_is_dropped():
    assert [t for n in html_tree.parse('<p>one</p><p>two<div class="x') for _, t in n.runs] == ["one", "two"]
    assert [t for _, t in sorted(r for n in html_tree.parse('<p title="a>b">one <b>two</b></p>three') for r in n.runs)] == ["one two", "three"]
