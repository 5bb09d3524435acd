"""Encoding, packing and token files against the libraries and brute force."""

import base64
import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from marketloom.llm import bpe, packing, token_files
from marketloom.llm.common import mounted
from marketloom.llm.pieces import ChunkEncoder


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def rank_library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunk_encoder_equals_library(name, spaced, odd_texts):
    texts = [t or "" for t in odd_texts]
    texts += ["a <|endoftext|> b", "<|startoftext|>", "x<|ENDOFTEXT|>y ", "<|endoftext|><|endoftext|>", "a  <|endoftext|>\n \n b" * 300]
    coder, whole = ChunkEncoder(public_tokenizers.path(name), spaced, limit=200), library(name)
    for at in range(0, len(texts), 16):
        part = texts[at : at + 16]
        ids, bounds = coder.encode(pa.array(part, pa.string()))
        for text, a, b in zip(part, bounds, bounds[1:], strict=False):
            assert ids[a:b].tolist() == whole(text), repr(text[:60])
    assert coder.encode(pa.array([], pa.string()))[1].tolist() == [0]


def plain_merge(data, ranks):
    """Merge the pair of smallest rank, the leftmost first, until no pair has a rank."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            break
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(ranks[p] for p in parts)


def test_merges_with_ranks_in_any_order(tmp_path):
    """A merged piece may outrank what is still waiting, which vocabularies in merge order never show."""
    r = random.Random(1)
    for turn in range(20):
        pieces = {bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(40)}
        names = [bytes([c]) for c in b"abc"] + sorted(pieces)
        numbers = r.sample(range(3000), len(names))
        path = tmp_path / f"{turn}.tiktoken"
        path.write_text("".join(f"{base64.b64encode(n).decode()} {k}\n" for n, k in zip(names, numbers, strict=True)))
        coder, ranks = bpe.BytePairs(str(path)), dict(zip(names, numbers, strict=True))
        for _ in range(30):
            data = bytes(r.choice(b"abc") for _ in range(r.randint(1, 40)))
            assert coder.merge(data) == ((ranks[data],) if data in ranks else plain_merge(data, ranks))
        assert not coder.buckets and not any(coder.words)


def test_bpe_equals_library_on_long_pretokens(rank_library):
    coder, r = bpe.byte_pairs(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(3)
    for text in ("a" * 20_000, "ab" * 5_000, "".join(r.choice("abcde") for _ in range(20_000))):
        ids = coder.encode(text)
        assert ids == rank_library.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_bpe_round_trip(docs, odd_texts, rank_library):
    rows = list(enumerate(odd_texts)) + [(None, "no id"), (3, "again"), (3, "again")]
    df = docs(rows, extra=("ids", "n_tokens"))
    want = sorted(
        (str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in rows
        for ids in [rank_library.encode_ordinary(t or "")]
    )
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(df).collect())
    assert got == want
    decoded = bpe.decode_ids(bpe.encode_texts(df)).collect()
    assert sorted(bytes(r.data) for r in decoded) == sorted((t or "").encode() for _, t in rows)


def test_fullest_equals_brute_force():
    r = random.Random(5)
    for _ in range(200):
        lengths = [r.randint(1, 20) for _ in range(r.randint(0, 9))]
        space = r.randint(0, 40)
        best = max(sum(c) for k in range(len(lengths) + 1) for c in combinations(lengths, k) if sum(c) <= space)
        counts = {n: lengths.count(n) for n in lengths}
        chosen = packing.fullest(counts, space)
        assert sum(chosen) == best
        assert all(chosen.count(n) <= counts[n] for n in chosen)


def test_packing(docs, odd_texts):
    rows = list(enumerate(odd_texts)) + [(None, "no id"), (5, "a"), (5, "a")]
    whole = library("word_bpe_49k.json")
    got = packing.best_fit_packing(docs(rows, extra=("length", "_group"))).collect()
    want = []
    for i, t in rows:
        ids = np.array([*whole(t), 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((str(i), k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 1


def test_packing_in_many_groups(spark, docs):
    r = random.Random(2)
    frame = spark.createDataFrame(
        [(i, 0, 0, r.randint(1, 1200), i) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    got = packing.pack(frame, group_pieces=400).collect()
    used = {}
    for x in got:
        used[x.sequence_id] = used.get(x.sequence_id, 0) + x.length
    assert len(got) == 3000 and max(used.values()) <= 2048
    assert len(used) <= 1.02 * sum(used.values()) / 2048 + 8


def test_token_files(spark, docs, odd_texts, tmp_path):
    rows = list(enumerate(odd_texts)) + [(None, "no id")]
    whole = library("byte_bpe_50k.json")
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*whole(t), 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    df = docs(rows, extra=("start", "part")).repartition(5)
    got = token_files.token_files(df, f"file://{tmp_path}/t", parts=4).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    # the flat files, joined in name order, are the ids
    flat = b"".join(p.read_bytes() for p in sorted((tmp_path / "t").glob("[0-9]*.bin")))
    assert np.frombuffer(flat, "<u2").tolist() == [x for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]) for x in [*whole(t), 0]]
    with pytest.raises(ValueError):
        mounted("hdfs://host/x")


def test_empty_tables(docs, tmp_path):
    empty = docs([])
    assert bpe.round_trip_digests(empty).collect() == []
    assert packing.best_fit_packing(empty).collect() == []
    assert token_files.token_files(empty, f"file://{tmp_path}/e").collect() == []


def test_documents_leave_the_tasks_that_read_them(spark, docs, tmp_path):
    """No document row is broadcast or joined: the bases are in the manifest before files are read."""
    df = docs([(i, f"text {i}") for i in range(400)]).repartition(6)
    out = token_files.token_files(df, f"file://{tmp_path}/t", parts=5)
    plan = out._jdf.queryExecution().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan
    above = plan[plan.index("Optimized Logical Plan") :].split("MapInArrow")[0]
    assert "Window" not in above
    rows = sorted(out.collect())
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(400)]
    assert out.rdd.getNumPartitions() > 1
