"""Helpers that several operators share: shared storage, written tables, Arrow row streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import cut_lineage, shared_dir

#: ASCII white space, the only characters that separate words here.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below `spark.checkpoint.dir`, as a URI."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def mounted(uri: str) -> str:
    """The path of a shared folder that every machine has mounted; other stores are refused."""
    scheme, sep, rest = uri.partition(":")
    if not sep or uri.startswith("/"):
        return uri
    if scheme != "file":
        raise ValueError(f"memory-mapped files need a mounted folder, got {uri}")
    return "/" + rest.lstrip("/")


#: Rows of a small stored table that share a file.
ROWS_PER_FILE = 200_000


def kept(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows, stored once in the shared checkpoint folder; a lost executor loses none of them.

    rows: about how many narrow rows there are, where that is known, so that few rows lie in few files."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    return cut_lineage(df)


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder; for rows that carry whole texts."""
    spark = df.sparkSession
    folder = shared_folder(spark, label)
    df.write.option("compression", compression).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Bits of a bitmap of keys: eight a key between these bounds (16 MB at most).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def marked(df: DataFrame, key: str, keys: DataFrame, mark: str) -> DataFrame:
    """`df` with the boolean `mark`: true wherever `keys` (one stored bigint column of that name) holds the row's key, and for a few others.

    The keys are a broadcast bitmap of bounded size, so rows that meet none are told where they are scanned and need no shuffle."""
    bits = min(max(LEAST_BITS, 1 << (8 * keys.count()).bit_length()), MOST_BITS)
    place = F.pmod(F.xxhash64(F.lit(bits), F.col(key)), F.lit(bits)) + 1
    bucket, map_ = free_names(df, "_bucket", "_map")
    at = F.bitmap_bit_position(place)
    maps = keys.groupBy(F.bitmap_bucket_number(place).alias(bucket)).agg(F.bitmap_construct_agg(at).alias(map_))
    byte = F.conv(F.hex(F.substring(map_, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = df.withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(maps), bucket, "left")
    return known.withColumn(mark, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(bucket, map_)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a bound value: `value` is computed once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text; none for null and for white space alone."""
    trimmed = F.trim(text_or_empty(text), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until it clashes with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_names(df: DataFrame, *names: str) -> list[str]:
    return [free_name(df, name) for name in names]


#: Rows and bytes of an Arrow batch. Whole texts are handed to Python, so bytes are what bounds a worker.
BATCH_ROWS = 2_000
BATCH_BYTES = "16m"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold so many rows and bytes at most (a longer row is a batch by itself)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def arrow_rows(
    df: DataFrame,
    columns: Sequence[str],
    rows: Callable[[Iterator], Iterable[list[tuple]]],
    schema: str,
    group: int = 256,
    raw: bool = False,
) -> DataFrame:
    """`rows` over the tuples of `columns`, batch by batch inside a task.

    It gets an iterator of lists of at most `group` tuples (raw: of Arrow batches of so many rows) and yields
    lists of output tuples, so a task never holds more than one Arrow batch and one group."""
    bounded_batches(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    target = pa.schema([pa.field(f.name, _arrow_type(f.dataType.simpleString())) for f in out])

    def run(batches):
        def groups():
            for batch in batches:
                for at in range(0, batch.num_rows, group):
                    part = batch.slice(at, group)
                    yield part if raw else list(zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True))

        for made in rows(groups()):
            for at in range(0, len(made), 4096):
                cut = made[at : at + 4096]
                columns_out = list(zip(*cut, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns_out, target, strict=True)], schema=target)

    return df.select(*columns).mapInArrow(run, out)


def _arrow_type(name: str) -> pa.DataType:
    simple = {
        "bigint": pa.int64(),
        "int": pa.int32(),
        "string": pa.string(),
        "double": pa.float64(),
        "float": pa.float32(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
    }
    if name.startswith("array<"):
        return pa.list_(_arrow_type(name[6:-1]))
    return simple[name]
