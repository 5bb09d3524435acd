"""Toxic passages by maximum-scoring segments.

Training. A bounded sample of labelled documents (copies of a text count once) is counted by token
and by the token's first 3, 4 and 5 letters, each as a hashed class with the numbers of toxic and other documents that
hold it. A token's log-odds, against the base rate, are those of a chain of Dirichlet posteriors: the prior of the
3-letter class is the base rate, the prior of each longer class the posterior of the shorter one, so an unseen
ending is judged by its stem. Every token pays `drift`, which makes the expected score negative; a word that
comes again in a text only pays, since repeats are no new evidence.

Scoring. A linear scan (Ruzzo and Tompa) finds all maximal scoring segments of a text. By the theory of
Karlin and Altschul the number of chance segments of score S in n tokens is E = K n exp(-lambda S):
lambda is the root of the token scores' moment equation and K comes from the mean best score, both
over the other documents of the sample. The best segment's -ln E is mapped to a probability by a
two-parameter logistic fit on the sample; there each half is scored with the counts of the other half.

What is sent to the executors has a fixed size (`buckets` pairs of counts). Cases: null and blank texts have no
token and score as texts without any segment; a document with several labels is toxic if one says
so; without labelled documents of both kinds every score is the share of toxic labels (0 without
any); rows with null or repeated ids are scored like any other; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import arrow_rows, bounded_batches, text_or_empty, written
from marketloom.llm.pieces import Generations

BUCKETS = 1 << 20
#: Labelled documents that the model is fitted on, at most: the ones whose ids hash lowest.
SAMPLE_DOCUMENTS = 20_000
STEMS = (3, 4, 5)
#: Strength of a Dirichlet prior, in documents.
PRIOR = 8.0
DRIFT = 1.5
LIMIT = 6.0
#: Evidence beyond this makes no difference to a probability.
MOST = 40.0
#: Chunks per generation of a worker's cache.
CACHE_LIMIT = 100_000
EULER = 0.5772156649
#: Segments per sampled document that the fit looks at; their evidence alone reaches MOST.
TOP = 64
FOLDS = 5

_LETTERS = re.compile(r"[^\W\d_]+")


def token_classes(token: str, buckets: int = BUCKETS) -> list[int]:
    """Hashed classes of a token, from the shortest stem to the token itself."""
    stems = [f"{n}{token[:n]}" for n in STEMS if len(token) > n]
    return [zlib.crc32(s.encode()) % buckets for s in [*stems, "=" + token]]


def tokens(chunk: str) -> list[str]:
    return _LETTERS.findall(chunk.lower())


def maximal_segments(scores: Sequence[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in order; linear time."""
    low, high, first, last, link = [], [], [], [], []
    total = 0.0
    for i, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        begin, start = total, i
        total += x
        while True:
            j = len(low) - 1
            # segments between a segment and its link begin no lower than it
            while j >= 0 and low[j] >= begin:
                j = link[j]
            if j < 0 or high[j] >= total:
                break
            begin, start = low[j], first[j]
            for column in (low, high, first, last, link):
                del column[j:]
        for column, value in zip((low, high, first, last, link), (begin, total, start, i + 1, j), strict=True):
            column.append(value)
    return [(a, b, h - w) for a, b, h, w in zip(first, last, high, low, strict=True)]


class TokenScores:
    """Log-odds of chunks of text from class counts; a bounded cache serves repeated chunks."""

    def __init__(self, toxic: np.ndarray, other: np.ndarray, rate: float, drift: float = DRIFT, prior: float = PRIOR):
        self.toxic, self.other, self.rate, self.drift, self.prior = toxic, other, min(max(rate, 1e-6), 1 - 1e-6), drift, prior
        self.known = Generations(CACHE_LIMIT)

    def token(self, token: str) -> float:
        share = self.rate
        for k in token_classes(token, len(self.toxic)):
            t = int(self.toxic[k])
            share = (t + self.prior * share) / (t + int(self.other[k]) + self.prior)
        lift = math.log(share / (1 - share)) - math.log(self.rate / (1 - self.rate))
        return max(-LIMIT, min(LIMIT, lift)) - self.drift

    def values(self, chunks: list[str]) -> np.ndarray:
        """One score per distinct chunk: that of its highest token."""
        for chunk in self.known.missing(chunks):
            self.known.now[chunk] = max(map(self.token, tokens(chunk)), default=-self.drift)
        return np.fromiter(map(self.known.now.__getitem__, chunks), "float64", len(chunks))

    def of(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Per text the scores of its chunks between white space; a chunk that comes again only pays the drift."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        bounds = lists.offsets.to_numpy().astype("int64")
        numbered = lists.flatten().dictionary_encode()
        index = numbered.indices.to_numpy(zero_copy_only=False)
        chunks = numbered.dictionary.to_pylist()
        blank = np.array([not c for c in chunks], bool)
        scores = self.values(chunks)[index]
        out = []
        for a, b in zip((bounds[:-1] - bounds[0]).tolist(), (bounds[1:] - bounds[0]).tolist(), strict=True):
            # white space at either end leaves an empty piece there
            a, b = (a + 1 if a < b and blank[index[a]] else a), b
            b = b - 1 if a < b and blank[index[b - 1]] else b
            own = scores[a:b]
            hits = np.flatnonzero(own > 0)
            if len(hits) > 1:
                _, first = np.unique(index[a + hits], return_index=True)
                again = np.ones(len(hits), bool)
                again[first] = False
                own = own.copy()
                own[hits[again]] = -self.drift
            out.append(own)
        return out

    def segments(self, texts: Sequence[str]) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """Per text the number of chunks and the maximal segments; what lies between two positive chunks is one step."""
        return [(len(scores), compressed_segments(scores)) for scores in self.of(texts)]


def compressed_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """`maximal_segments` with the chunks between two positive ones as one step."""
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    before = np.concatenate([[0.0], np.cumsum(scores)])
    steps = np.empty(2 * len(hits) - 1)
    steps[::2] = scores[hits]
    steps[1::2] = before[hits[1:]] - before[hits[:-1] + 1]
    found = maximal_segments(steps.tolist())
    return [(int(hits[a // 2]), int(hits[(b - 1) // 2]) + 1, s) for a, b, s in found]


@dataclass(frozen=True)
class ToxicityModel:
    toxic: np.ndarray
    other: np.ndarray
    rate: float
    scale: float  # lambda
    size: float  # K
    slope: float
    offset: float

    def scorer(self) -> TokenScores:
        return TokenScores(self.toxic, self.other, self.rate)

    def evidence(self, n: int, score: float) -> float:
        """-ln of the number of chance segments as high as `score` in n tokens."""
        return self.scale * score - math.log(self.size * max(n, 1))

    def total(self, n: int, segments: Iterable[float]) -> float:
        each = [self.evidence(n, s) for s in segments] or [self.evidence(n, 0.0)]
        return min(sum(e for e in each if e > 0) or max(each), MOST)

    def probability(self, total: float) -> float:
        if not self.slope:
            return self.rate
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * total + self.offset))))

    def score(self, scores: TokenScores, texts: Sequence[str | None]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """Per text the probability, and the segments that chance gives less than once in such a text."""
        out = []
        for n, found in scores.segments([t or "" for t in texts]):
            total = self.total(n, [s for _, _, s in found])
            out.append((self.probability(total), [x for x in found if self.evidence(n, x[2]) > 0]))
        return out


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, documents: int) -> DataFrame:
    """`text`, `toxic`, `half` of distinct texts among at most `documents` labelled rows that are not held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").groupBy(F.xxhash64("text").alias("hash"))
    return rows.agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"), (F.pmod("hash", F.lit(2))).cast("int").alias("half"))


def class_counts(sample: DataFrame, buckets: int) -> DataFrame:
    """`class`, and the documents with it by half and label (c00, c01, c10, c11); at most `buckets` rows."""

    def rows(groups):
        for group in groups:
            seen = []
            for text, toxic, half in group:
                own = {k for t in set(tokens(text)) for k in token_classes(t, buckets)}
                seen.append(np.fromiter(own, "int64", len(own)) * 4 + (2 * half + (toxic > 0)))
            classes, place = np.unique(np.concatenate(seen) >> 2, return_inverse=True)
            table = np.bincount(place * 4 + (np.concatenate(seen) & 3), minlength=4 * len(classes)).reshape(-1, 4)
            yield list(zip(classes.tolist(), *table.T.tolist(), strict=True))

    names = [f"c{h}{t}" for h in (0, 1) for t in (0, 1)]
    partial = arrow_rows(sample, ["text", "toxic", "half"], rows, "class int, " + ", ".join(f"{n} bigint" for n in names), 1024)
    return partial.groupBy("class").agg(*[F.sum(n).cast("int").alias(n) for n in names])


def moment_root(scores: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with weighted mean exp(lambda * score) = 1; 1.0 where the scores have none."""
    if not len(scores) or scores @ weights >= 0 or scores.max() <= 0:
        return 1.0
    weights = weights / weights.sum()
    excess = lambda x: np.exp(np.clip(x * scores, -50, 50)) @ weights - 1
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset, by Newton steps towards Platt's softened targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    rows, theta = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ theta, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2), rows.T @ (target - p) - 1e-3 * theta)
        theta += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    documents: int = SAMPLE_DOCUMENTS,
    buckets: int = BUCKETS,
) -> ToxicityModel:
    spark = docs.sparkSession
    sample = written(training_sample(docs, labels, id_col, text_col, documents), "toxicity-sample")
    counted = class_counts(sample, buckets).toArrow().to_pandas()
    table = np.zeros((4, buckets), "int32")
    for row, name in enumerate(("c00", "c01", "c10", "c11")):
        table[row, counted["class"]] = counted[name]
    sizes: dict[tuple[int, bool], int] = {}
    for r in sample.groupBy("half", (F.col("toxic") > 0).alias("toxic")).count().collect():
        sizes[r["half"], r["toxic"]] = r["count"]
    n_toxic, n_other = (sum(v for (_, t), v in sizes.items() if t == want) for want in (True, False))
    rate = n_toxic / max(1, n_toxic + n_other)
    flat = ToxicityModel(table[1] + table[3], table[0] + table[2], rate, 1.0, 1.0, 0.0, 0.0)
    if any(not sizes.get((h, t)) for h in (0, 1) for t in (True, False)):
        return flat
    sent = spark.sparkContext.broadcast(table)

    def rows(groups):
        # each half is judged by the other half's counts
        scorers = [TokenScores(sent.value[3 - 2 * h], sent.value[2 - 2 * h], rate) for h in (0, 1)]
        for group in groups:
            made = []
            for h in (0, 1):
                mine = [(text, toxic) for text, toxic, half in group if half == h]
                for (_, toxic), scores in zip(mine, scorers[h].of([t for t, _ in mine]), strict=True):
                    bins = np.bincount(np.clip((scores + 8) * 8, 0, 127).astype(int), minlength=128)
                    best = sorted((s for _, _, s in compressed_segments(scores)), reverse=True)[:TOP]
                    made.append((int(toxic > 0), len(scores), best, bins.tolist()))
            yield made

    judged = arrow_rows(sample, ["text", "toxic", "half"], rows, "toxic int, n bigint, segments array<double>, bins array<bigint>")
    bins = judged.filter("toxic = 0").select(F.posexplode("bins").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect()
    documents_ = judged.select("toxic", "n", "segments").toArrow().to_pydict()
    sent.unpersist()
    weights = np.array([b["n"] for b in bins], "float64")
    scale = moment_root(np.array([(b["bin"] + 0.5) / 8 - 8 for b in bins]), weights)
    toxic, n = np.array(documents_["toxic"]), np.maximum(documents_["n"], 1)
    best = np.array([max(s, default=0.0) for s in documents_["segments"]])
    calm = toxic == 0
    size = float(np.exp(np.mean(scale * best[calm] - np.log(n[calm])) - EULER))
    shaped = replace(flat, scale=scale, size=size)
    totals = np.array([shaped.total(k, s) for k, s in zip(n.tolist(), documents_["segments"], strict=True)])
    slope, offset = logistic_fit(totals, toxic)
    return replace(shaped, slope=slope, offset=offset)


def _scored(docs: DataFrame, model: ToxicityModel, id_col: str, text_col: str, rows, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(groups):
        model = sent.value
        scores = model.scorer()
        for group in groups:
            found = model.score(scores, [text for _, text in group])
            yield [x for (doc, _), one in zip(group, found, strict=True) for x in rows(doc, *one)]

    return arrow_rows(docs, [id_col, text_col], run, schema, 1000)


def toxic_passages(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `start`, `end` (chunks between white space, end exclusive), `passage_score` of every significant segment."""
    rows = lambda doc, _, found: [(doc, a, b, s) for a, b, s in found]
    return _scored(docs, model, id_col, text_col, rows, "doc_id bigint, start int, end int, passage_score double")


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted`, `n_passages` of every row."""
    rows = lambda doc, p, found: [(doc, p, int(p >= 0.5), len(found))]
    scored = _scored(docs, model, id_col, text_col, rows, "doc_id bigint, score double, predicted int, n_passages bigint")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, unchanged, whose score lies below one half."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]):
        model = sent.value
        scores = model.scorer()
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = model.score(scores, part.column(place).to_pylist())
                yield part.filter(pa.array([p < 0.5 for p, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
