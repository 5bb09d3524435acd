"""Quality by compression: which of two zstandard dictionaries, of good and of bad text, fits a text better.

Training. Of a bounded sample of labelled documents (copies of a text count once) pieces of text fill one
dictionary per label. A text is cut into blocks of `BLOCK` bytes, so that its own past does not outweigh the
dictionary, and every block of the whole text is compressed with both. The difference of the sums of sizes, over their
total, is the evidence; a logistic map calibrates it together with the size without a dictionary per byte (a text that
only repeats itself is small under both) and the logarithm of the length. The map is fitted on the sample, each half compressed with the
dictionaries of the other half.

What is sent to the executors has a fixed size (two dictionaries). Cases: null and empty texts have no blocks, zero
evidence and a calibrated score like any other; a document with several labels is bad if one says so; without labelled
documents of both kinds in both halves every score is the share of good labels (0.5 without any); rows with null or repeated
ids are scored like any other; more columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import arrow_rows, text_or_empty, written
from marketloom.llm.toxicity import held_out

#: Labelled documents that the classifier is fitted on, about: those whose ids hash below a bound.
SAMPLE_DOCUMENTS = 20_000
DICTIONARY_BYTES = 1 << 18
#: Characters of a piece; a document gives its pieces in turn with the others, in the order of a hash.
PIECE = 400
BLOCK = 2048
LEVEL = 3
GOOD_AT = 0.3
_SCALE = 1 << 30


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, documents: int) -> DataFrame:
    """`text`, `good`, `half`, `hash` of distinct texts among about `documents` labelled rows that are not held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("good"))
    # a bound on the hash, from the number of labels, bounds the sample without a sort in one task
    bound = _SCALE * min(1.0, documents / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(_SCALE)) < int(bound))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("hash")).agg(
        F.min("good").alias("good"), F.min("text").alias("text"), F.pmod("hash", F.lit(2)).cast("int").alias("half")
    )


def _pieces(text: Column) -> Column:
    """First, middle and last piece; short texts give themselves once."""
    size = F.char_length(text)
    at = lambda start: F.substring(text, start + 1, F.lit(PIECE))
    cut = F.array(at(F.lit(0)), at(F.floor((size - PIECE) / 2).cast("int")), at((size - PIECE).cast("int")))
    return F.when(size < 3 * PIECE, F.array(at(F.lit(0)))).otherwise(cut)


def dictionary_text(sample: DataFrame, size: int) -> dict[tuple[int, int], bytes]:
    """Bytes of pieces by (half, good); about `size` of each, the pieces of lowest hash."""
    pieces = sample.select("half", "good", "hash", F.posexplode(_pieces(F.col("text"))).alias("turn", "piece")).filter("piece <> ''")
    order = Window.partitionBy("half", "good").orderBy("turn", F.xxhash64("hash"), "hash")
    room = F.coalesce(F.sum(F.octet_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = pieces.withColumn("before", room).filter(F.col("before") < size)
    parts: dict[tuple[int, int], list] = {}
    for r in chosen.collect():
        parts.setdefault((r["half"], r["good"]), []).append((r["before"], r["piece"]))
    # what stands last in a dictionary is cheapest to refer to: the order decides nothing but ties
    return {key: "\n".join(p for _, p in sorted(rows)).encode() for key, rows in parts.items()}


class Sizes:
    """Compressed sizes of texts with and without dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        # frames without header fields: only content is compared
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        kind = zstandard.DICT_TYPE_RAWCONTENT
        self.coders = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), **plain) for d in (good, bad)]
        self.coders.append(zstandard.ZstdCompressor(**plain))

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Evidence for bad (normalised difference), own size per byte, logarithm of the length."""
        data = (text or "").encode()
        if not data:
            return 0.0, 0.0, 0.0
        good = bad = own = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            sizes = [len(c.compress(block)) for c in self.coders]
            good, bad, own = good + sizes[0], bad + sizes[1], own + sizes[2]
        return (good - bad) / (good + bad), own / len(data), math.log(len(data))


def logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the last one free) of a logistic regression by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    rows, theta = np.column_stack([(x - mean) / scale, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ theta, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(len(theta)), rows.T @ (y - p) - 1e-2 * theta)
        theta += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, theta


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    rate: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def sizes(self) -> Sizes:
        return Sizes(self.good, self.bad)

    def probability(self, features: Sequence[float]) -> float:
        """Of a good text."""
        if self.weights is None:
            return self.rate
        z = float(((np.array(features) - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    documents: int = SAMPLE_DOCUMENTS,
    size: int = DICTIONARY_BYTES,
) -> CompressionModel:
    """Runs jobs: the sample is stored, its pieces and its features (three numbers a document) come to the driver."""
    sample = written(labelled_sample(docs, labels, id_col, text_col, documents), "quality-sample")
    counts = {(r["half"], r["good"]): r["count"] for r in sample.groupBy("half", "good").count().collect()}
    total = sum(counts.values())
    rate = sum(n for (_, good), n in counts.items() if good) / total if total else 0.5
    parts = dictionary_text(sample, size)
    if any(not parts.get((h, g)) for h in (0, 1) for g in (0, 1)):
        return CompressionModel(b"", b"", rate)
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def rows(groups):
        # each half is compressed with the other half's dictionaries
        coders = [Sizes(sent.value[1 - h, 1], sent.value[1 - h, 0]) for h in (0, 1)]
        for group in groups:
            yield [(good, *coders[half].features(text)) for text, good, half in group]

    judged = arrow_rows(sample, ["text", "good", "half"], rows, "good int, evidence double, own double, length double").toArrow().to_pandas()
    sent.unpersist()
    fitted = logistic_fit(judged[["evidence", "own", "length"]].to_numpy(), judged["good"].to_numpy("float64"))
    # the final dictionaries hold half of each half's pieces
    whole = [b"".join(parts[h, g][: size // 2] for h in (0, 1)) for g in (1, 0)]
    return CompressionModel(*whole, rate, *fitted)


def quality_scores(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted`, `evidence` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(groups):
        model = sent.value
        sizes = model.sizes() if model.weights is not None else None
        for group in groups:
            made = []
            for doc, text in group:
                features = sizes.features(text) if sizes else (0.0, 0.0, 0.0)
                p = model.probability(features)
                made.append((doc, p, int(p >= GOOD_AT), features[0]))
            yield made

    scored = arrow_rows(docs, [id_col, text_col], rows, "doc_id bigint, score double, predicted int, evidence double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")
