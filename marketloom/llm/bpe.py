"""Byte-level BPE with a hierarchical-bitmap rank queue.

The parts of a pre-token form a linked list over byte positions. Every neighbouring pair that has a
merge rank puts its left position into the bucket of that rank; a hierarchical bitmap of the ranks in
use gives the smallest one by find-first-set. The leftmost position of that bucket is merged,
unless the pair there has changed meanwhile (a stale entry, which is skipped), and the two new
pairs enter their buckets. A pre-token of n bytes takes O(n log n) steps whatever its length.

Pre-tokens come from the pattern of the vocabulary. Texts are cut at spaces, which no pre-token spans, and each
distinct chunk of a batch is looked up once in a bounded cache of the Python worker. Cases: a null text is empty and has no ids; special tokens are plain
text; any text decodes to its own bytes.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import arrow_rows, text_or_empty
from marketloom.llm.pieces import Generations, closing_punctuation, cut_at_spaces, spoken

#: Chunks per generation of the cache; two generations are held.
CACHE_LIMIT = 600_000
WORD_BITS = 8  # a bitmap word has 256 bits
WORD_MASK = (1 << WORD_BITS) - 1


class BytePairs:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        # the queue: bits of the ranks in use, word by word, and the places that wait under each rank
        self.words = [0] * ((max(self.tokens) >> WORD_BITS) + 1)
        self.buckets: dict[int, int | list[int]] = {}
        self.known = Generations(CACHE_LIMIT)
        self.bare: dict[str, tuple[int, ...]] = {}  # pre-tokens without a space before them

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return (whole,)
        words, buckets, used = self.words, self.buckets, 0  # used: bits of the words that are not zero
        n = len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [ranks.get(data[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        waiting = [(rank, i) for i, rank in enumerate(pair) if rank is not None]
        while True:
            for rank, i in waiting:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = i
                    word = rank >> WORD_BITS
                    words[word] |= 1 << (rank & WORD_MASK)
                    used |= 1 << word
                elif type(bucket) is int:
                    buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
                else:
                    heappush(bucket, i)
            # the smallest rank, by the first bit set on either level, and its leftmost place
            while used:
                word = (used & -used).bit_length() - 1
                bits = words[word]
                low = bits & -bits
                rank = (word << WORD_BITS) + low.bit_length() - 1
                bucket = buckets[rank]
                if type(bucket) is int:
                    i = bucket
                else:
                    i = heappop(bucket)
                if type(bucket) is int or not bucket:
                    del buckets[rank]
                    words[word] = bits ^ low
                    if bits == low:
                        used &= used - 1
                if pair[i] == rank:
                    break
            else:
                break
            j = after[i]
            end = after[j]
            after[i] = end
            pair[j] = pair[i] = None
            waiting = []
            if end < n:
                before[end] = i
                made = pair[i] = ranks.get(data[i : after[end]])
                if made is not None:
                    waiting.append((made, i))
            left = before[i]
            if left >= 0:
                made = pair[left] = ranks.get(data[left:end])
                if made is not None:
                    waiting.append((made, left))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : after[i]]])
            i = after[i]
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.find(text) for i in self.merge(part.encode())]

    def _bare(self, part: str) -> tuple[int, ...]:
        if part not in self.bare:
            if len(self.bare) >= CACHE_LIMIT // 3:
                self.bare.clear()
            self.bare[part] = self.merge(part.encode())
        return self.bare[part]

    def encode_chunks(self, texts: pa.Array) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
        """Ids of distinct chunks, and the chunks of all texts by number with the texts' bounds."""
        chunks, index, bounds, heads = cut_at_spaces(texts)
        keys, closed, tails = closing_punctuation(chunks, lambda cores: pc.utf8_is_alpha(cores).to_numpy(zero_copy_only=False))
        known = self.known
        for key in known.missing(keys):
            known.now[key] = self._joined(spoken(key))
        ids = list(map(known.now.__getitem__, keys))
        for i, tail in zip(closed, tails, strict=True):
            ids[i] += self._joined(tail)
        ids += [tuple(self.encode(text)) if whole else self._joined(text) for whole, text in heads]
        return ids, index, bounds

    def _joined(self, text: str) -> tuple[int, ...]:
        """Ids of a short text; pre-tokens that do not open with a space are few and kept apart."""
        parts = self.find(text)
        if len(parts) == 1 and text[:1] == " ":
            return self.merge(text.encode())
        ids: tuple[int, ...] = ()
        for part in parts:
            ids += self.merge(part.encode()) if part[:1] == " " else self._bare(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    """One coder per Python worker and rank file."""
    return BytePairs(path)


def _path(vocabulary: str | None) -> str:
    return vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")


def _strings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias(text_col))


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """`doc_id`, `ids` of every text."""
    path = _path(vocabulary)

    def rows(batches):
        coder = byte_pairs(path)
        for batch in batches:
            ids, index, bounds = coder.encode_chunks(batch.column(1))
            index = index.tolist()
            spans = zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
            yield [(doc, list(chain.from_iterable(map(ids.__getitem__, index[a:b])))) for doc, a, b in spans]

    return arrow_rows(_strings(docs, id_col, text_col), [id_col, text_col], rows, "doc_id bigint, ids array<int>", 256, raw=True)


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """`doc_id`, `data` (the bytes) of every id list; null ids give no bytes."""
    path = _path(vocabulary)

    def rows(groups):
        coder = byte_pairs(path)
        for group in groups:
            yield [(doc, coder.decode(ids or [])) for doc, ids in group]

    return arrow_rows(encoded, [id_col, ids_col], rows, "doc_id bigint, data binary", 64)


def round_trip_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """`doc_id`, `n_tokens`, digests of the ids as decimal text and of the bytes decoded from them."""
    path = _path(vocabulary)

    def rows(batches):
        coder = byte_pairs(path)
        decimal = {i: str(i).encode() for i in coder.tokens}
        for batch in batches:
            ids, index, bounds = coder.encode_chunks(batch.column(1))
            # every id is decoded through the table, once per distinct chunk
            said = [b" ".join(map(decimal.__getitem__, c)) for c in ids]
            data = [coder.decode(c) for c in ids]
            sizes = np.fromiter(map(len, ids), "int64", len(ids))[index]
            totals = np.concatenate([[0], np.cumsum(sizes)])[bounds]
            # an empty head has no ids, and so no separator behind it
            index = index.tolist()
            made = []
            spans = zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), np.diff(totals).tolist(), strict=True)
            for doc, a, b, n in spans:
                own = index[a:b]
                listed = b" ".join(map(said.__getitem__, own if ids[own[0]] else own[1:]))
                decoded = b"".join(map(data.__getitem__, own))
                made.append((doc, n, hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield made

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return arrow_rows(_strings(docs, id_col, text_col), [id_col, text_col], rows, schema, 2000, raw=True)
