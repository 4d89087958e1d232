"""Intermediate tables in the folder that all executors share, and the columns most operators read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from footfall.session import fresh_folder


def saved(rows: DataFrame, purpose: str, codec: str = "snappy") -> DataFrame:
    """The rows, written once and read back: a lost executor costs no earlier work, and nothing is computed twice."""
    folder = fresh_folder(rows.sparkSession, purpose)
    rows.write.option("compression", codec).parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


_BUCKET_BYTES = 128 << 20


@contextmanager
def bucketed(rows: DataFrame, purpose: str, columns: list[str], buckets: int) -> Iterator[DataFrame]:
    """As ``saved``, in buckets of ``columns``: joins by them need not send these rows again.

    The catalog knows the table only inside the ``with`` block. Joins by which it is made drop rows early.
    """
    spark = rows.sparkSession
    folder = fresh_folder(spark, purpose)
    table = "footfall_" + folder.rsplit("-", 1)[1]
    with filtered_joins(spark):
        rows.write.bucketBy(buckets, *columns).option("path", folder).saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def buckets_for(spark: SparkSession, size: int) -> int:
    """As many as a shuffle has partitions, and more where these would hold over 128 MB each of ``size`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _BUCKET_BYTES))


_PART = 1 << 20


def parts_of(sizes: np.ndarray, most: int = _PART) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of at most ``most`` bytes together; a larger row is a range by itself."""
    at, total = 0, 0
    for n, size in enumerate(sizes.tolist()):
        if n > at and total + size > most:
            yield at, n
            at, total = n, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def _small_batches(spark: SparkSession) -> None:
    """Rows go to Python 8 MB at a time where the session has no other wish; the 64 MB of the default are held several
    times over, for each task, as they pass."""
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, "8m")


def by_text(rows: DataFrame, kind: str, reader: Callable[[], Callable], together: bool = False) -> DataFrame:
    """The rows with the columns ``kind`` in place of ``text``: what ``reader()`` says of each whole text.

    A Python worker turns one text at a time into a Python string and hands results on after every MB of text, so it
    holds no batch of strings or results. With ``together``, ``reader()`` is given the list of a MB's texts.
    """
    added = StructType.fromDDL(kind)
    kept = [c for c in rows.columns if c != "text"]
    fields = list(to_arrow_schema(added))
    _small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            texts = batch.column("text")
            for at, end in parts_of(_sizes(texts)):
                part = texts.slice(at, end - at)
                found = zip(*(read(part.to_pylist()) if together else [read(x.as_py()) for x in part]))
                new = [pa.array(list(x), f.type) for x, f in zip(found, fields)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, end - at) for c in kept), *new], [*kept, *(f.name for f in fields)])

    return rows.mapInArrow(run, StructType([*rows.select(kept).schema.fields, *added.fields]))


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) + 64


def by_row(rows: DataFrame, kind: str, reader: Callable[[], Callable[..., tuple | None]], sized: str) -> DataFrame:
    """A row of the columns ``kind`` for each row for which ``reader()`` gives one, from all its columns in order.

    As ``by_text``, but for rows that hold something else; ``sized`` is the column that makes them large.
    """
    fields = to_arrow_schema(StructType.fromDDL(kind))
    _small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            for at, end in parts_of(_sizes(batch.column(sized))):
                given = zip(*(c.slice(at, end - at) for c in batch.columns))
                found = [x for row in given if (x := read(*(_plain(v) for v in row))) is not None]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*found), fields)], schema=fields)

    return rows.mapInArrow(run, kind)


def _plain(value: pa.Scalar):
    """Lists as arrays, which need no object per number."""
    if not isinstance(value, pa.ListScalar):
        return value.as_py()
    return None if value.values is None else value.values.to_numpy(zero_copy_only=False)


def told(kind: str, reader: Callable[[], Callable[[list[str | None]], list[tuple]]]) -> Callable[[Column], Column]:
    """A function of a text column that gives a struct ``kind``; texts are read a MB at a time."""
    struct = pa.struct(list(to_arrow_schema(StructType.fromDDL(kind))))

    @F.arrow_udf(StructType.fromDDL(kind))
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = reader()
        for texts in batches:
            parts = []
            for at, end in parts_of(_sizes(texts)):
                columns = zip(*read(texts.slice(at, end - at).to_pylist()))
                parts.append(pa.StructArray.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, struct)], fields=list(struct)))
            yield pa.concat_arrays(parts) if parts else pa.array([], struct)

    return of


@contextmanager
def filtered_joins(spark: SparkSession):
    """Here Spark drops rows by a Bloom filter of the other side's keys before it sends them to a join.

    It does so by itself for scans of over 10 GB; the filter has at most 8 MB, whatever the other side's size.
    """
    wanted = {"applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1TB", "expectedNumItems": "4000000", "numBits": str(1 << 26)}
    names = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in wanted.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; one without id always is."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_hash(*columns: str) -> Column:
    """Tells rows apart in a sample: of rows equal in these columns one is as good as another."""
    return F.xxhash64(*columns)


def least_hashed(rows: DataFrame, group: str, each: int) -> DataFrame:
    """At most ``each`` rows of each value of ``group``: those least by a hash of their ``id``.

    Only rows whose hash lies below little more than the share that is wanted (by eight standard deviations) are ever
    sorted, so the work of the sorting task is bounded by the sample, not by the rows. The product is one of doubles: of
    a group of over 2^23 rows a bigint would not hold it.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    few = rows.withColumn("_place", place).join(F.broadcast(counts), group).where(F.col("_place").cast("double") * F.col("_n") < F.lit((each + 8.0 * each**0.5 + 16) * (1 << 40)))
    order = Window.partitionBy(group).orderBy("_place", "id")
    return few.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= each).drop("_place", "_n", "_rank")
