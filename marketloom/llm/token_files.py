"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A part is two files in a shared folder: `NNNNN.bin`, the ids of its documents one after another, and
`NNNNN.idx`, the number of documents and documents+1 offsets (in ids) as little-endian unsigned
64-bit integers, then the ids of the documents as signed 64-bit integers and one byte per document
that is 0 where the document id is null. Documents lie in ascending id order over the parts; the
first token of a part is the prefix sum of the sizes of the parts before it. Files are written
under a name of their own and then renamed, so a repeated or speculative task does no harm.

Cases: a null text is an empty document (the end id alone); null ids come first; equal ids keep an
order by text; an empty table has no parts and no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import arrow_rows, kept, mounted, shared_folder, text_or_empty
from marketloom.llm.pieces import encoder

MANIFEST = "part int, n_docs bigint, n_tokens bigint, bin string, idx string"
READ = "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def id_type(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = 0,
    parts: int | None = None,
) -> DataFrame:
    """Writes the files below `folder` (a mounted, shared one) and returns the manifest, one row per part."""
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    place = mounted(folder)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(batches):
        coder = encoder(path, True)
        kind = np.dtype(id_type(coder.tokenizer.get_vocab_size()))
        part = TaskContext.get().partitionId()
        os.makedirs(place, exist_ok=True)
        own = os.path.join(place, f".{part:05d}-{uuid.uuid4().hex}")
        ids, sizes = [], []
        with open(f"{own}.bin", "wb") as out:
            for batch in batches:
                flat, bounds = coder.encode(batch.column(1))
                tokens = np.insert(flat.astype(kind), bounds[1:], kind.type(end_id))
                out.write(tokens.tobytes())
                ids += batch.column(0).to_pylist()
                sizes.append(np.diff(bounds) + 1)
        if not ids:
            os.remove(f"{own}.bin")
            return
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<u8")
        with open(f"{own}.idx", "wb") as out:
            out.write(np.array([len(ids)], "<u8").tobytes() + offsets.tobytes())
            out.write(np.array([0 if i is None else i for i in ids], "<i8").tobytes())
            out.write(bytes(i is not None for i in ids))
        names = [os.path.join(place, f"{part:05d}{end}") for end in (".bin", ".idx")]
        for name, end in zip(names, (".bin", ".idx"), strict=True):
            os.replace(own + end, name)
        yield [(part, len(ids), int(offsets[-1]), *names)]

    ordered = (
        docs.select(F.col(id_col), text_or_empty(F.col(text_col)).alias(text_col))
        .repartitionByRange(parts, F.col(id_col).asc_nulls_first())
        .sortWithinPartitions(F.col(id_col).asc_nulls_first(), text_col)
    )
    return kept(arrow_rows(ordered, [id_col, text_col], rows, MANIFEST, 2000, raw=True))


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with `base`, the ids in all parts before. One row per file: the small table is what one task orders."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, manifest: DataFrame, id_bytes: int = 2) -> DataFrame:
    """One row per document, read from the memory-mapped files: place among all ids, size, checksum.

    The bases are summed before files are read, so no row of a document is joined or leaves the task that reads it."""

    def rows(groups):
        for group in groups:
            for part, n, bin_, idx, base in group:
                head = np.memmap(idx, "<u8", "r", 0, (n + 2,))
                if int(head[0]) != n:
                    raise ValueError(f"{idx} holds {int(head[0])} documents, not {n}")
                offsets = head[1:].astype("int64")
                ids = np.memmap(idx, "<i8", "r", 8 * (n + 2), (n,))
                given = np.memmap(idx, "u1", "r", 8 * (2 * n + 2), (n,))
                tokens = np.memmap(bin_, f"<u{id_bytes}", "r")
                for at in range(0, n, 4096):
                    made = []
                    for i in range(at, min(n, at + 4096)):
                        a, b = int(offsets[i]), int(offsets[i + 1])
                        sum_ = zlib.crc32(tokens[a:b].astype("<u4").tobytes())
                        made.append((part, int(ids[i]) if given[i] else None, base + a, b - a, sum_))
                    yield made

    # one file is one row here: deal the files out, so that tasks read a few each
    spread = with_bases(manifest).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part")
    return arrow_rows(spread, ["part", "n_docs", "bin", "idx", "base"], rows, READ)


def token_files(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the files and returns, read back from them, `doc_id`, `start`, `n_tokens`, `ids_crc32`."""
    spark = docs.sparkSession
    manifest = write_token_files(docs, folder or shared_folder(spark, "token-files"), **options)
    size = encoder(options.get("vocabulary") or public_tokenizers.path("byte_bpe_50k.json"), True).tokenizer.get_vocab_size()
    found = read_token_files(spark, manifest, np.dtype(id_type(size)).itemsize)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
