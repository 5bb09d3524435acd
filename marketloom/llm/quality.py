"""Quality rules and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed to `buckets` classes. Their frequencies over the
trusted target (documents labelled good) and over the raw corpus (all documents) are two smoothed
multinomials; a document's score is the mean, over its n-grams, of the logarithm of target over raw.
Every document is kept or dropped by the same fixed threshold, unless a base rule fails first.
The counts of a task are one row per bucket before they are shuffled, and what is broadcast is
one row of `buckets` numbers.

Cases: null and blank texts have no words, fail the base rules and score null; a document labelled
good and bad at once is not trusted; without any trusted document both multinomials are flat in
their ratio and all scores are zero; rows repeated in the table count each time; an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import SPACE_CHARS, free_names, let, text_or_empty, words_of

BUCKETS = 1 << 14
#: Labelled documents that the target is estimated from, at most: the ones whose ids hash lowest.
TARGET_DOCUMENTS = 20_000
#: Mean log-ratio below which a document is dropped.
THRESHOLD = -0.075
SMOOTHING = 1.0
WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def bucket(*words: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", documents: int = TARGET_DOCUMENTS) -> DataFrame:
    """Ids of documents whose every label is good; a bounded table, chosen by the hash of the id."""
    good = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min("quality").alias("quality"))
    return good.filter("quality = 1").select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(documents)


def bucket_counts(docs: DataFrame, text_col: str, target: Column, buckets: int = BUCKETS) -> DataFrame:
    """`bucket`, `raw`, `target`: occurrences of its n-grams in all rows and in those of `target`."""
    words = docs.select(target.alias("_target"), words_of(F.col(text_col)).alias("_words")).filter(F.size("_words") > 0)
    pairs = words.select("_target", F.inline(F.arrays_zip(F.col("_words").alias("word"), F.slice("_words", F.lit(2), F.size("_words")).alias("next"))))
    pairs = pairs.toDF("_target", "word", "next")
    one, two = bucket(F.col("word"), buckets=buckets), F.when(F.col("next").isNotNull(), bucket(F.col("word"), F.col("next"), buckets=buckets))
    grams = pairs.select("_target", F.explode(F.array(one, two)).alias("bucket")).filter(F.col("bucket").isNotNull())
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum(F.col("_target").cast("long")).alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: `ratios`, the logarithm of target over raw frequency by bucket."""
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")
    )
    gathered = filled.agg(
        F.sum("raw").alias("_raw"), F.sum("target").alias("_target"), F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("_all")
    )
    share = lambda n, total: (n + smoothing) / (total + smoothing * buckets)
    ratio = lambda x: F.log(share(x["target"], F.col("_target")) / share(x["raw"], F.col("_raw")))
    none = F.transform("_all", lambda x: F.lit(0.0))
    return gathered.select(F.when(F.col("_target") > 0, F.transform("_all", ratio)).otherwise(none).alias("ratios"))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of `size` words found at least twice in the array.

    Distinct hashes prove distinct windows; only where hashes repeat are the windows themselves
    sorted, neighbours compared and the places of repeated ones laid over each other."""
    at = lambda n: F.sequence(F.lit(0), n - size)

    def exact(w: Column) -> Column:
        window = lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, size)).alias("w"), i.alias("i"))

        def places(s: Column) -> Column:
            text = lambda j: F.get(s, j)["w"]
            same = lambda j: F.coalesce(text(j) == text(j - 1), F.lit(False)) | F.coalesce(text(j) == text(j + 1), F.lit(False))
            hits = F.filter(F.sequence(F.lit(0), F.size(s) - 1), same)
            return F.sort_array(F.transform(hits, lambda j: F.get(s, j)["i"]))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        cover = lambda acc, i: F.struct(
            (acc["n"] + i + size - F.greatest(acc["end"], i)).alias("n"), (i + size).alias("end")
        )
        sorted_windows = F.sort_array(F.transform(at(F.size(w)), window))
        return let(sorted_windows, lambda s: F.aggregate(places(s), start, cover, lambda acc: acc["n"]))

    def probe(w: Column) -> Column:
        hashes = F.transform(at(F.size(w)), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(w)))

    return F.when(F.size(words) < size, F.lit(0)).otherwise(probe(words))


def mean_ratio(words: Column, ratios: Column, buckets: int = BUCKETS) -> Column:
    """Mean of the ratios of a text's words and word pairs; null without words."""
    n = F.size(words)

    def add(acc: Column, i: Column) -> Column:
        word, following = F.get(words, i), F.get(words, i + 1)
        pair = F.when(i + 1 < n, F.get(ratios, bucket(word, following, buckets=buckets))).otherwise(F.lit(0.0))
        return acc + F.get(ratios, bucket(word, buckets=buckets)) + pair

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), add)
    return F.when(n > 0, total / (2 * n - 1))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACE_CHARS)) != "")
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    target_documents: int = TARGET_DOCUMENTS,
) -> DataFrame:
    """Every row of `docs` with the base figures, `llr`, `base_failed` and `kept`."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")
    docs = docs.drop(*[c for c in docs.columns if c in names])
    good = trusted_ids(labels.select("doc_id", "quality"), documents=target_documents).withColumnRenamed("doc_id", "_good")
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(good), F.col("_id") == F.col("_good"), "left")
    ratios = log_ratios(bucket_counts(marked, "_text", F.col("_good").isNotNull(), buckets), buckets)
    text = text_or_empty(F.col(text_col))
    llrs, found = free_names(docs, "_ratios", "_figures")
    figures = let(
        words_of(F.col(text_col)),
        lambda w: let(
            F.col(llrs),
            lambda r: F.struct(
                F.size(w).cast("long").alias("n_words"),
                repeated_words(w).cast("long").alias("n_repeat_words"),
                mean_ratio(w, r, buckets).alias("llr"),
            ),
        ),
    )
    # one row of a fixed number of ratios meets every document
    scored = docs.join(F.broadcast(ratios.select(F.col("ratios").alias(llrs)))).select(*docs.columns, figures.alias(found))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        scored.select(
            *docs.columns,
            F.col(f"{found}.n_words"),
            without(text, SPACE_CHARS).cast("long").alias("word_chars"),
            (F.char_length(text) - without(text, SYMBOLS)).cast("long").alias("n_symbols"),
            duplicate_lines(text).cast("long").alias("n_dup_lines"),
            F.col(f"{found}.n_repeat_words"),
            F.col(f"{found}.llr"),
        )
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))
    )
