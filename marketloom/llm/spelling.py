"""Groups of spelling variants: all pairs of words that differ by one edit, by dense prefix-suffix tiling.

Two words are one inserted, deleted or replaced code point apart if their common prefix and their common suffix
reach the longer one's length less one together. So with that length l either the first (l-1)//2 code points or the last
l-1-(l-1)//2 are common: words meet in blocks of equal l and equal start, or equal l and equal end. A block
is cut into tiles of about `tile` words by a hash, and each pair of tiles is compared at once: padded matrices of code
points, from the left for the common prefixes and from the right for the common suffixes. A pair found in both kinds of block
counts in the first. Of every tile pair only one row per word leaves: its number of near words and the best of them.

Words follow their forms (a near word at least twice as frequent) to a root by pointer jumping: counts at least double at every
step, so rounds grow with the logarithm of the logarithm of the largest count.

Cases: a null text has no words; rows with a null id are counted, nothing is deleted from their words; a run that loses its only code point is empty and
too short; ties go to the smallest word in code-point order; repeated rows count again; an empty table gives an empty
table; more columns are ignored; words of any length and letters beyond the given range are compared alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import arrow_rows, kept, written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELETE_MOD = 97
LEAST_CHARS = 5
LEAST_COUNT = 3
#: Words of a tile; a tile pair is compared in strips of this many cells at most.
TILE = 2048
CELLS = 1 << 20


def _misspelt(run: Column, doc: Column) -> Column:
    """The run, without one code point where the checksum of document and run says so."""
    h = F.crc32(F.concat(doc.cast("string"), F.lit(":"), run).cast("binary"))

    def cut(h: Column) -> Column:
        at = (h % F.char_length(run)).cast("int")
        return F.when(h % DELETE_MOD == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)

    return cut(h)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`word`, `n` of the words of all texts that are long and frequent enough."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0))
    each = docs.select(F.col(id_col).alias("doc"), F.explode(runs).alias("run"))
    words = each.select(_misspelt(F.col("run"), F.col("doc")).alias("word")).filter(F.char_length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def block_keys(word: Column) -> Column:
    """The blocks of a word: as the longer (or equally long) and as the shorter one of a pair, by start and by end."""

    def keys(length: Column) -> list[Column]:
        head = F.floor((length - 1) / 2).cast("int")
        tail = length - 1 - head
        start = F.concat(length.cast("string"), F.lit("<"), F.substring(word, F.lit(1), head))
        end = F.concat(length.cast("string"), F.lit(">"), F.substring(word, F.char_length(word) - tail + 1, tail))
        return [start, end]

    size = F.char_length(word)
    return F.array(*keys(size), *keys(size + 1))


def tiles(words: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs of tiles to compare: `block`, `words`, `counts` of the left tile and `words2`, `counts2` of the right (null: the left with itself)."""
    keyed = words.select(F.explode(block_keys(F.col("word"))).alias("block"), "word", "n")
    sizes = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    sizes = written(sizes.select("block", F.ceil(F.col("size") / tile).cast("int").alias("parts")), "spelling-blocks")
    dealt = keyed.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    made = dealt.groupBy("block", "parts", "part").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("w"))
    # a tile meets every later tile of its block; a pair of tiles is one group of two rows
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    sides = made.filter("parts > 1").select("block", "part", "w", other)
    low, high = F.least("part", "other"), F.greatest("part", "other")
    pairs = sides.select("block", low.alias("i"), high.alias("j"), F.struct("part", "w").alias("side"))
    pairs = pairs.groupBy("block", "i", "j").agg(F.sort_array(F.collect_list("side")).alias("sides"))
    # a tile whose partner got no words by the hash has nothing to meet
    pairs = pairs.filter((F.col("i") == F.col("j")) | (F.size("sides") == 2))
    pairs = pairs.select("block", F.col("sides")[0]["w"].alias("w"), F.get("sides", F.lit(1))["w"].alias("w2"))
    alone = made.filter("parts = 1").select("block", "w", F.lit(None).cast(made.schema["w"].dataType).alias("w2"))
    both = alone.unionByName(pairs)
    part = lambda c, f: F.transform(c, lambda x: x[f])
    return both.select(
        "block", part("w", "word").alias("words"), part("w", "n").alias("counts"), part("w2", "word").alias("words2"), part("w2", "n").alias("counts2")
    )


def matrix(words: list[str], width: int, right: bool = False) -> np.ndarray:
    """Code points of the words, padded with zeros to `width` on the right, or on the left if `right`."""
    place = str.rjust if right else str.ljust
    data = "".join([place(w, width, "\0") for w in words])
    try:
        return np.frombuffer(data.encode("latin-1"), "u1").reshape(len(words), width)
    except UnicodeEncodeError:
        return np.frombuffer(data.encode("utf-32-le"), "<u4").reshape(len(words), width)


def near_pairs(left: list[str], right: list[str], length: int, by_start: bool, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in `left`, in `right`) of the pairs one edit apart whose longer word has `length` code points and is in
    `left` (of two equally long words any, once if `same`), for the block kind: pairs with a common start, or all others."""
    head = (length - 1) // 2
    tops = np.array([i for i, w in enumerate(left) if len(w) == length], "int64")
    sizes = np.array([len(w) for w in right], "int64")
    if not len(tops) or not len(right):
        return
    whole = [left[i] for i in tops]
    a, b = matrix(whole, length), matrix(right, length)
    c, d = matrix(whole, length, True), matrix(right, length, True)
    known = head if by_start else 0
    strip = max(1, CELLS // len(right))
    for at in range(0, len(tops), strip):
        rows = slice(at, at + strip)
        # common prefixes, column by column, while any pair still agrees; a start block agrees on its key
        alive = np.ones((len(a[rows]), len(right)), bool)
        common = np.full(alive.shape, known, "int16")
        for k in range(known, length):
            alive &= a[rows, k, None] == b[None, :, k]
            if not alive.any():
                break
            common += alive
        # common suffixes; an end block agrees on its key
        tail = 0 if by_start else length - 1 - head
        alive = np.ones(alive.shape, bool)
        suffix = np.full(alive.shape, tail, "int16")
        for k in range(tail, length):
            alive &= c[rows, length - 1 - k, None] == d[None, :, length - 1 - k]
            if not alive.any():
                break
            suffix += alive
        hit = common + suffix >= length - 1
        if not by_start:
            hit &= common < head
        hit &= common < length  # a word is not near itself
        i, j = np.nonzero(hit)
        i = tops[at + i]
        if same:
            # two words of one tile and of equal length are met twice
            once = (sizes[j] < length) | (i < j)
            i, j = i[once], j[once]
        if len(i):
            yield i, j


def _compared(batch: pa.RecordBatch) -> list[tuple]:
    """Per tile pair and word with near words: word, their number, the best one's count and the best one."""
    out = []
    for block, words, counts, words2, counts2 in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
        by_start = "<" in block
        length = int(block.split("<" if by_start else ">", 1)[0])
        same = words2 is None
        both = [(words, counts, words, counts)] if same else [(words, counts, words2, counts2), (words2, counts2, words, counts)]
        found: dict[str, list] = {}
        for k, (left, n_left, right, n_right) in enumerate(both):
            # of equally long words of two tiles the first direction sees all
            others = [w for w in right if len(w) < length] if k else right
            n_others = [n for w, n in zip(right, n_right, strict=True) if len(w) < length] if k else n_right
            for i, j in near_pairs(left, others, length, by_start, same):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    for word, n, other in ((left[x], n_others[y], others[y]), (others[y], n_left[x], left[x])):
                        best = found.get(word)
                        if best is None:
                            found[word] = [1, n, other]
                        else:
                            best[0] += 1
                            if n > best[1] or (n == best[1] and other < best[2]):
                                best[1:] = n, other
        out += [(word, *best) for word, best in found.items()]
    return out


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """`word`, `n_near`, `best_n`, `best` of the words that have near words."""

    def rows(groups):
        for group in groups:
            yield _compared(group)

    found = arrow_rows(tiles(words, tile), ["block", "words", "counts", "words2", "counts2"], rows, "word string, near bigint, best_n bigint, best string", 64, raw=True)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    each = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return each.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """`word`, `root` from `word`, `form`: every word's last form, by pointer jumping."""
    at = kept(forms.select("word", F.col("form").alias("root")))
    while True:
        after = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = kept(at.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if jumped.filter("moved").isEmpty():
            return jumped.select("word", "root")
        at = jumped.select("word", "root")


def variants(words: DataFrame, tile: int = TILE) -> DataFrame:
    """`word`, `n`, `n_near`, `form`, `form_n`, `root` of every row of `words` (word, n)."""
    frequent = F.col("best_n") >= 2 * F.col("n")
    near = words.join(near_words(words, tile), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n")
    )
    near = kept(near)
    ends = roots(near.filter(F.col("form").isNotNull()))
    return near.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` of the vocabulary of the texts."""
    return variants(kept(vocabulary(docs, id_col, text_col)), tile).select("word", "form", "root", "n", "n_near", "form_n")
