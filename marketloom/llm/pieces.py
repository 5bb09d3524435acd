"""Whole-text encoding with a library tokenizer through a cache of short chunks.

A text is cut at single spaces and line ends (byte-level vocabularies, where they open the next pre-token) or at
any ASCII white space (lower-case vocabularies, which drop it); no pre-token spans such a cut, so the
ids of the chunks, joined, are the ids of the text. Arrow cuts the texts of a batch and numbers their distinct
chunks; only these are looked up, in a bounded cache of the Python worker. New chunks are
encoded many at a time: words of letters, with any closing punctuation taken off, are whole pre-tokens and need no
pattern; the others go through the full tokenizer. Byte-level texts in which a space lies beside other white
space are encoded whole, and so are texts that hold the content of an added token (such as an end-of-text mark), which the
library makes that token.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Chunks per generation of the cache; two generations are held.
CACHE_LIMIT = 450_000
#: Closing punctuation; no apostrophe, which may open a pre-token of letters.
TAIL = ".,;:!?)]}#*$%&|"
#: A space beside other white space, or white space beyond ASCII's common six, of which tokenizers differ on
#: whether it joins a run (RE2 syntax).
UNCUT = r"[ ][\t-\r ]|[\t-\r][ ]|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A line end that is part of a run, too.
LINE_RUN = r"[\t-\r][\t-\r]"
#: How byte-level vocabularies write a space, and how lower-case ones end a word.
SPACE_BYTE, WORD_END = "\u0120", "</w>"
#: A control character that is one token of its own between two spaces.
_MARK = "\x02"


def cut_at_spaces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, list[tuple[bool, str]]]:
    """Distinct chunks, the number of each chunk in text order, the texts' bounds in it, and the heads.

    A chunk stands for itself with a space before it, or, where it begins with a line end, for itself alone. The
    first place of a text belongs to its head, which is numbered behind the chunks: (False, what stands
    before its first cut) or (True, the whole uncut text)."""
    whole = set(np.flatnonzero(pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False)).tolist())
    uncut = {i: texts[i].as_py() for i in whole}
    if whole:
        texts = pa.array(["" if i in whole else t for i, t in enumerate(texts.to_pylist())], pa.string())
    # a cut before every line end, where each is white space by itself
    runs = pc.match_substring_regex(texts, LINE_RUN)
    sent = pc.if_else(runs, texts, pc.replace_substring(texts, "\n", " \n"))
    distinct, index, bounds = _numbered(pc.split_pattern(sent, " "))
    first = bounds[:-1]
    before = distinct.take(pa.array(index[first])).to_pylist()
    heads = [(i in whole, uncut.get(i, head)) for i, head in enumerate(before)]
    index[first] = len(distinct) + np.arange(len(heads), dtype="int32")
    return distinct, index, bounds, heads


def spoken(chunk: str) -> str:
    """The text that a chunk stands for."""
    return chunk if chunk[:1] == "\n" else " " + chunk


def _numbered(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    bounds = lists.offsets.to_numpy().astype("int64")
    numbered = lists.flatten().dictionary_encode()
    return numbered.dictionary, numbered.indices.to_numpy(zero_copy_only=False).copy(), bounds - bounds[0]


def closing_punctuation(chunks: pa.Array, letters: Callable[[pa.Array], np.ndarray]) -> tuple[list[str], list[int], list[str]]:
    """The key of each chunk, and the places and tails of those with a tail.

    Where a chunk is a word of letters (by `letters`) and closing punctuation, the key is the word and the tail a
    pre-token of its own; any other chunk is its own key."""
    cores = pc.utf8_rtrim(chunks, TAIL)
    words = letters(cores)
    keys = pc.if_else(pa.array(words), cores, chunks).to_pylist()
    closed = np.flatnonzero(words & (pc.binary_length(chunks).to_numpy() != pc.binary_length(cores).to_numpy()))
    places = closed.tolist()
    tails = [c[len(keys[i]) :] for i, c in zip(places, chunks.take(pa.array(closed)).to_pylist(), strict=True)]
    return keys, places, tails


class Generations:
    """A bounded cache in two generations: what is used again survives when the older one is dropped."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def missing(self, keys: list[str]) -> list[str]:
        """The keys without a value, once each; the others are in `now` afterwards."""
        now, old = self.now, self.old
        fresh = list(dict.fromkeys([k for k in keys if k not in now]))
        if len(now) + len(fresh) > self.limit:
            self.old, self.now = old, now = now, {}
            fresh = list(dict.fromkeys(keys))
        if old:
            now.update((k, old[k]) for k in fresh if k in old)
            fresh = [k for k in fresh if k not in now]
        return fresh


class ChunkEncoder:
    """Ids of whole texts.

    spaced: white space is part of the tokens (byte-level); otherwise it only separates words and
    letters are lower-cased by the tokenizer."""

    def __init__(self, path: str, spaced: bool, limit: int = CACHE_LIMIT):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced, self.limit = spaced, limit
        # ids as little-endian unsigned 32-bit bytes
        self.known = Generations(limit)
        self.bare: dict[str, bytes] = {}  # pieces without a space before them
        # words of letters alone: the same model behind a cut at line ends
        self.plain = Tokenizer(self.tokenizer.model)
        bytes_only = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), bytes_only])
        size = self.tokenizer.get_vocab_size()
        self.opens, self.ends, self.mark = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i], self.ends[i] = token[:1] == SPACE_BYTE, token.endswith(WORD_END)
        self.mark[np.frombuffer(self._whole(_MARK), "<u4")] = True
        self.line_end = self._whole("\n")
        # added tokens may be matched after the normaliser, so in any case
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _bare(self, texts: list[str]) -> list[bytes]:
        """Ids of pieces without a space before them; closing punctuation is a pre-token of its own after letters."""
        parts = []
        for text in texts:
            core = text.rstrip(TAIL)
            parts.append((core, text[len(core) :]) if core.isalpha() else (text, ""))
        fresh = {p for both in parts for p in both}.difference(self.bare)
        if len(self.bare) + len(fresh) > self.limit // 3:
            self.bare.clear()
            fresh = {p for both in parts for p in both}
        made = list(fresh)
        for part, found in zip(made, self.tokenizer.encode_batch_fast(made, add_special_tokens=False), strict=True):
            self.bare[part] = np.array(found.ids, "<u4").tobytes()
        return [self.bare[core] + self.bare[tail] for core, tail in parts]

    def _chunk(self, chunk: str) -> bytes:
        return self._whole(spoken(chunk) if self.spaced else chunk)

    def _letters(self, cores: pa.Array) -> np.ndarray:
        """Which chunks are one pre-token of letters that the normaliser only lower-cases."""
        letters = pc.utf8_is_alpha(cores).to_numpy(zero_copy_only=False)
        if not self.spaced:
            wide = np.flatnonzero(letters & ~pc.string_is_ascii(cores).to_numpy(zero_copy_only=False))
            far = [i for i, c in zip(wide.tolist(), cores.take(pa.array(wide)).to_pylist(), strict=True) if max(c) >= "\u0250" or "\u0130" in c]
            letters[far] = False
        return letters

    def _learn(self, fresh: list[str]) -> None:
        """Caches new keys: words of letters, and chunks of any other kind."""
        letters = self._letters(pa.array(fresh, pa.string())).tolist()
        words = [c for c, yes in zip(fresh, letters, strict=True) if yes]
        for at in range(0, len(words), 1000):
            self._learn_words(words[at : at + 1000])
        others = [c for c, yes in zip(fresh, letters, strict=True) if not yes]
        if self.spaced:
            lines = [c for c in others if c[:1] == "\n"]
            self.known.now.update(zip(lines, [self.line_end + ids for ids in self._bare([c[1:] for c in lines])], strict=True))
            others = [c for c in others if c[:1] != "\n"]
        for at in range(0, len(others), 1000):
            self._learn_others(others[at : at + 1000])

    def _store(self, chunks: list[str], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        if len(starts) != len(chunks):
            raise AssertionError("the library cut other chunks than were sent")
        data = ids.tobytes()
        self.known.now.update(zip(chunks, [data[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], strict=True))

    def _learn_words(self, part: list[str]) -> None:
        sent = " " + "\n ".join(part) if self.spaced else "\n".join(part).lower()
        ids = np.array(self.plain.encode_batch_fast([sent], add_special_tokens=False)[0].ids, "<u4")
        if self.spaced:
            starts = np.flatnonzero(self.opens[ids]).tolist()
            self._store(part, ids, starts, [*starts[1:], len(ids)])
        else:
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            self._store(part, ids, [0, *ends[:-1]], ends)

    def _learn_others(self, part: list[str]) -> None:
        clear = [c for c in part if c and _MARK not in c]
        self.known.now.update((c, self._chunk(c)) for c in part if not c or _MARK in c)
        if not clear:
            return
        sent = " " + " ".join(clear) if self.spaced else f" {_MARK} ".join(clear)
        ids = np.array(self.tokenizer.encode_batch_fast([sent], add_special_tokens=False)[0].ids, "<u4")
        if self.spaced:
            starts = np.flatnonzero(self.opens[ids]).tolist()
            ends = [*starts[1:], len(ids)]
        else:
            cuts = np.flatnonzero(self.mark[ids])
            starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
        if len(starts) == len(clear):
            self._store(clear, ids, starts, ends)
        else:
            self.known.now.update((c, self._chunk(c)) for c in clear)

    def _looked_up(self, chunks: pa.Array) -> list[bytes]:
        """The ids of distinct chunks. A word with closing punctuation is looked up as two pre-tokens."""
        keys, closed, tails = closing_punctuation(chunks, self._letters)
        fresh = self.known.missing(keys)
        if fresh:
            self._learn(fresh)
        found = list(map(self.known.now.__getitem__, keys))
        kinds = list(set(tails))
        ids = dict(zip(kinds, self._bare(kinds), strict=True))
        for i, tail in zip(closed, tails, strict=True):
            found[i] += ids[tail]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without nulls), one after another, and their texts+1 bounds."""
        held = self._with_added_tokens(texts)
        if not held:
            return self._encode(texts)
        rest = pa.array(["" if i in held else t for i, t in enumerate(texts.to_pylist())], pa.string())
        flat, bounds = self._encode(rest)
        parts = [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for i, ids in held.items():
            parts[i] = ids
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _with_added_tokens(self, texts: pa.Array) -> dict[int, np.ndarray]:
        """Place and ids of the texts that may hold an added token's content, by the plain library call."""
        lower, held = pc.utf8_lower(texts), set()
        for content in self.added:
            held.update(np.flatnonzero(pc.match_substring(lower, content).to_numpy(zero_copy_only=False)).tolist())
        if not held:
            return {}
        self.tokenizer.encode_special_tokens = False
        try:
            return {i: np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4") for i in sorted(held)}
        finally:
            self.tokenizer.encode_special_tokens = True

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, "int64")
        if self.spaced:
            distinct, index, bounds, heads = cut_at_spaces(texts)
            bare = iter(self._bare([t for whole, t in heads if not whole]))
            found = self._looked_up(distinct) + [self._whole(t) if whole else next(bare) for whole, t in heads]
        else:
            distinct, index, bounds = _numbered(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
            found = self._looked_up(distinct)
        sizes = np.fromiter(map(len, found), "int32", len(found)) // 4
        flat, starts = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes, dtype="int32") - sizes
        each = sizes[index]
        ends = np.cumsum(each, dtype="int32")
        places = np.repeat(starts[index] - (ends - each), each)
        places += np.arange(len(places), dtype="int32")
        return flat[places], np.concatenate([[0], ends.astype("int64")])[bounds]


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> ChunkEncoder:
    """One encoder per Python worker and vocabulary; its cache lives as long as the worker."""
    return ChunkEncoder(path, spaced)
