"""Chat formatting, quality rules and personal data against plain Python."""

import hashlib
import math
import random
import time
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from marketloom.llm import chat, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain_chat(turns, size):
    out = {}
    seen = sorted({(c, t, r or "unknown", x or "") for c, t, r, x in turns}, key=lambda s: (str(s[0]), s[1] is not None, s[1] or 0, s[2], s[3]))
    speakers = {(c, r) for c, _, r, _ in seen if r != "system"}
    for c, t, r, x in seen:
        part = -1 if t is None else t // size
        for s in {s for k, s in speakers if k == c}:
            name = "assistant" if r == s else "system" if r == "system" else f"user name={r}"
            text, mask, n = out.get((c, s, part), ("", [], 0))
            text += f"<|{name}|>\n"
            body = f"{x}<|end|>\n"
            if r == s:
                mask = [*mask, (len(text), len(text) + len(body))]
            out[c, s, part] = (text + body, mask, n + 1)
    return out


def test_chat_perspectives(spark):
    r = random.Random(4)
    turns = [(r.randrange(20), r.choice([None, *range(12)]), r.choice(["ann", "bob", "cy", "system", None]), r.choice(["hi", "né", "", None, "x" * 500])) for _ in range(600)]
    turns += turns[:30] + [(99, 0, "system", "rules"), (None, 1, "ann", "no id"), (None, 2, "system", "s")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("speaker", F.lit(1)).withColumn("part", F.lit(1))
    got = {(x.conv_id, x.speaker, x.part): x for x in chat.perspectives(df, turns_per_part=4).collect()}
    want = plain_chat(turns, 4)
    assert got.keys() == want.keys()
    for key, (text, mask, n) in want.items():
        assert (got[key].rendered, [tuple(s) for s in got[key].mask], got[key].n_turns) == (text, mask, n)
        assert got[key].masked_chars == sum(b - a for a, b in mask)
    assert chat.perspectives(df.limit(0)).collect() == []


def plain_figures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def bucket_of(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return (seed - (seed >> 63 << 64)) % quality.BUCKETS


def grams(text):
    words = WORD.findall(text or "")
    return [bucket_of([w]) for w in words] + [bucket_of(p) for p in zip(words, words[1:])]


def test_quality(docs, spark, odd_texts):
    r = random.Random(8)
    good = ["".join(r.choice(["the ", "of ", "sea ", "and ", "wind ", "rose\n"]) for _ in range(r.randint(12, 90))) for _ in range(60)]
    junk = [t.replace(" ", "%%% ") for t in good[:15]]
    phrase = "one two three four five six "
    texts = [*odd_texts, *good, *junk, phrase * 2 + "x " * 3, phrase * 2 + " ".join(map(str, range(80))), "a\na\n \na", "one two three four"]
    rows = list(enumerate(texts)) + [(None, "no id at all"), (5, "twice " * 12), (5, "twice " * 12)]
    first = len(odd_texts)
    labels = spark.createDataFrame(
        [(first + i, 1) for i in range(40)] + [(first + 70, 0), (first + 3, 1), (first + 41, 1), (first + 41, 0), (None, 1), (7, None)], "doc_id long, quality int"
    )
    got = quality.quality(docs(rows, extra=("kept", "n_words", "_ratios")), labels).collect()
    raw = Counter(g for _, t in rows for g in grams(t))
    trusted = {first + i for i in range(40)}
    target = Counter(g for i, t in rows if i in trusted for g in grams(t))
    n, m, b = sum(raw.values()), sum(target.values()), quality.BUCKETS
    ratio = lambda g: math.log((target[g] + 1) / (m + b)) - math.log((raw[g] + 1) / (n + b))
    assert len(got) == len(rows)
    for x in got:
        figures = plain_figures(x.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == figures, repr(x.text)[:80]
        failed = figures[0] < 10 or 100 * figures[4] > 20 * figures[0]
        g = grams(x.text)
        mean = sum(map(ratio, g)) / len(g) if g else None
        assert x.base_failed == failed
        assert x.llr is None if mean is None else abs(x.llr - mean) < 1e-9
        assert x.kept == (not failed and mean >= quality.THRESHOLD)
    by_id = {x.doc_id: x for x in got}
    assert all(by_id[first + i].llr > by_id[first + 60 + i].llr for i in range(15))
    flat = quality.quality(docs(rows[:5]), labels.limit(0)).collect()
    assert all(x.llr in (None, 0.0) for x in flat)
    assert quality.quality(docs([]), labels).collect() == []


def luhn(d):
    return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(v):
    return re.sub("[^0-9]", "", v)


PLAIN = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda v: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda v: luhn(digits(v))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda v: 8 <= len(digits(v)) <= 15),
)


def plain_spans(text):
    return [(kind, m.start(), m.end()) for kind, p, ok in PLAIN for m in p.finditer(text or "") if ok(m.group())]


def pii_texts():
    r = random.Random(12)
    parts = ["a@b.co", "x@y", "é", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+1 2", "@", ".", "-", " ", "\n", "7", "a.b", "b.c.d@e.f.g", "%", "0000.01.1.1", "", "😀"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(700)]
    long = ["1 " * 20_000, "a@" + "b." * 20_000 + "c", "x" * 50_000 + "@", "1" * 30_000, "1." * 20_000, "+1" + "-" * 20_000, "a@b.c" * 3000]
    return [*texts, *long, "", None, " "]


def test_pii_base_spans(docs):
    rows = list(enumerate(pii_texts())) + [(None, "me@a.bc"), (1, "twice 1.1.1.1"), (1, "twice 1.1.1.1")]
    got = pii.pii_report(docs(rows, extra=("base", "terms", "_base"))).collect()
    want = Counter()
    for i, t in rows:
        s = plain_spans(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want[i, *(sum(k == x for k, _, _ in s) for x in ("email", "ip", "card", "phone")), hashlib.sha256(said.encode()).hexdigest(), said] += 1
    assert Counter((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256, x.spans) for x in got) == want
    assert pii.pii_report(docs([])).collect() == []


def disclosing_docs():
    """A surname that only ever stands beside one address, in different surroundings, among common words."""
    r = random.Random(3)
    words = ["market", "river", "garden", "window", "letter", "forest", "summer", "music"]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, some(30)) for i in range(200)]
    rows += [(1000 + i, f"{some(10)} Write to Zylberstein at john@mail.example.com {some(9)}") for i in range(6)]
    rows += [(2000 + i, "copied text beside copy@mail.example.com Quirrell ends") for i in range(50)]
    return rows


def test_disclosing_terms(docs):
    rows = disclosing_docs()
    got = {x.doc_id: x for x in pii.pii_report(docs(rows)).collect()}
    texts = dict(rows)
    for i in range(1000, 1006):
        kind, start, end = got[i].spans.split(",")[-1].split(":")
        marked = [texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[i].spans.split(",") if s.startswith("term")]
        assert kind == "term" and texts[i][int(start) : int(end)] in marked
        assert "Zylberstein" in marked and not {"market", "river", "garden"} & set(marked)
    # copies of one passage are one piece of evidence
    assert all(got[i].n_term == 0 for i in [*range(200), *range(2000, 2050)])


def test_sanitise(docs):
    rows = [*disclosing_docs(), (1, None), (2, "a 1.2.3.4 b +1 (017) 555-7713 c"), (3, "no data"), (None, "x@y.zz")]
    df = docs(rows, extra=("_row", "lang")).withColumn("n_chars", F.char_length("text").cast("long"))
    clean = pii.sanitise(df, length_col="n_chars")
    assert clean.schema == df.schema
    got = {(x.doc_id, x.n_chars): x.text for x in clean.collect()}
    assert len(clean.collect()) == len(rows)
    assert got[2, len("a [IP] b [PHONE] c")] == "a [IP] b [PHONE] c" and got[3, 7] == "no data" and got[1, None] is None
    assert (None, len("[EMAIL]")) in got
    assert all("Zylberstein" not in t and "[EMAIL]" in t for (i, _), t in got.items() if i is not None and 1000 <= i < 1006)


def prose(r, n):
    return " ".join(r.choice(["market", "river", "garden", "window", "letter", "forest", "summer", "music"]) for _ in range(n))


def marked(docs, rows):
    """Lower-case words under a term span, by document."""
    text = dict(rows)
    spans = {x.doc_id: [s.split(":") for s in x.spans.split(",") if s] for x in pii.pii_report(docs(rows)).collect()}
    return {i: {text[i][int(a) : int(b)].lower() for k, a, b in found if k == "term"} for i, found in spans.items()}


def test_few_texts_disclose(docs):
    """Two texts are evidence where the value, or the part it shares with others, is rare; copies and one text are none."""
    r = random.Random(5)
    rows = [(i, prose(r, 40)) for i in range(2500)]
    rows += [(3000 + i, f"{prose(r, 30)} Okonjo {prose(r, 9)} okonjo@mail.example.com") for i in range(2)]
    rows += [(4000 + i, f"{prose(r, 30)} Brannagh {prose(r, 9)} desk{i}@small.example.org") for i in range(2)]
    rows += [(5000 + i, f"{prose(r, 30)} Tolland {prose(r, 9)} 10.20.30.{i}") for i in range(2)]
    rows += [(6000 + i, "a copied text about Quirrell who has copy@other.example.net") for i in range(9)]
    rows += [(7000, f"{prose(r, 30)} Ashgrove ashgrove@lone.example.net")]
    got = marked(docs, rows)
    assert all(got[i] == {name} for at, name in ((3000, "okonjo"), (4000, "brannagh"), (5000, "tolland")) for i in (at, at + 1))
    assert not any(got[i] for i, _ in rows if i < 3000 or i >= 6000)


def test_terms_far_from_the_value(docs):
    """A text and a value meet anywhere in a document, and a disclosing term is a span wherever it stands."""
    r = random.Random(6)
    rows = [(i, prose(r, 40)) for i in range(1000)]
    rows += [(2000 + i, f"Zylberstein {prose(r, 60)} zylberstein {prose(r, 60)} john@mail.example.com {prose(r, 60)} Zylberstein") for i in range(8)]
    rows += [(3000, f"{prose(r, 30)} Zylberstein {prose(r, 30)}")]
    assert all((i >= 2000) == (names == {"zylberstein"}) for i, names in marked(docs, rows).items())
    clean = {x.doc_id: x.text for x in pii.sanitise(docs(rows)).collect()}
    assert not any("zylberstein" in text.lower() for text in clean.values())
    assert all(clean[i] == t for i, t in rows if i < 2000)


def test_pii_many_values_in_one_text(docs):
    r = random.Random(11)
    names = ["".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(5000)]
    book = " ".join(f"{n} {n}@host{i % 700}.org;" for i, n in enumerate(names))
    rows = [(1, "list one " + book), (2, "list two " + book)] + [(10 + i, f"plain words here {i}") for i in range(4000)]
    start = time.time()
    got = {x.doc_id: x for x in pii.pii_report(docs(rows)).collect()}
    assert time.time() - start < 60
    assert got[1].n_email == got[2].n_email == 5000
    # a name that stands beside its address in both lists, and nowhere else, discloses it
    assert got[1].n_term == got[2].n_term == len(names) + 1 and got[10].n_term == 0


def test_pii_rebuilt_in_parts(docs):
    """Spans over the borders of parts, one after another, and in a text of wide characters."""
    r = random.Random(5)
    for n in (40, 300):
        text = "".join(r.choice("ab é𝒳") for _ in range(9000))
        cuts = sorted(r.sample(range(9000), 2 * n))
        spans = list(zip(cuts[::2], cuts[1::2]))
        df = docs([(1, text)]).select("text", F.from_json(F.lit(str([{"start": a, "end": b, "kind": "ip"} for a, b in spans]).replace("'", '"')), "array<struct<kind:string,start:int,end:int>>").alias("s"))
        out, clean = df.select(pii.outside(F.col("text"), F.col("s")), pii.sanitised_text(F.col("text"), F.col("s"), F.array().cast(pii.TERMS))).first()
        want, tagged = list(text), list(text)
        for a, b in spans:
            want[a:b] = " " * (b - a)
            tagged[a:b] = ["[IP]"] + [""] * (b - a - 1)
        assert out == "".join(want) and clean == "".join(tagged)


def test_pii_copies_are_no_evidence(docs):
    """A person named beside a value in three different texts among 1,000 is found; one in copies of one text is not."""
    rows = [(i, f"text number {i} about nothing in particular") for i in range(1000)]
    rows += [(2000 + i, f"case {i} of Zylberstein, write to z.berg@corp.example today") for i in range(3)]
    rows += [(3000 + i, "note by Quentworth, write to quent@other.example today") for i in range(40)]
    got = {x.doc_id: x for x in pii.pii_report(docs(rows)).collect()}
    spans = lambda i: [s.split(":") for s in got[i].spans.split(",") if s]
    words = lambda i: {rows_by[i][int(a) : int(b)] for k, a, b in spans(i) if k == "term"}
    rows_by = dict(rows)
    assert "Zylberstein" in words(2000) and "Quentworth" not in words(3000)
    assert len(got) == len(rows) and words(5) == set()


def test_pii_distinct_texts_keep_one_of_each(docs):
    rows = [(i, f"only {i}") for i in range(300)] + [(1000 + i, "the same") for i in range(50)] + [(None, None), (None, None)]
    found = pii.written(pii.found_spans(docs(rows)), "pii")
    texts, first = pii.distinct_texts(found)
    assert texts.count() == first.count() == 302
    assert texts.select("digest").distinct().count() == 302
