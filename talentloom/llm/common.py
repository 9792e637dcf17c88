"""Helpers shared by the operators of this package."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are what lies between ASCII white space; ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def id_crc(doc_id: str = "doc_id") -> Column:
    """CRC-32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*columns: str) -> Column:
    """128 bits as text that name the values of some columns; a null is not an empty text."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (1, 2)])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a session on one machine may set its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile
            folder = tempfile.mkdtemp(prefix="talentloom-llm-")
        context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; the copy lies in the shared checkpoint folder and goes with its DataFrame."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the global row number (0, 1, ...) in the given order.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the sizes of the partitions
    before. Only one count per partition is gathered. Rows equal in all of ``order`` are dealt apart by a last, arbitrary
    key, so repeated rows do not meet in one task.
    """
    ordered = df.withColumn("_spread", F.monotonically_increasing_id())
    keys = [*order, F.col("_spread")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = cut(ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_spread")
                .withColumn("_at", F.monotonically_increasing_id()))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = table.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (table.join(F.broadcast(starts), F.shiftright("_at", 33) == F.col("_part"))
            .withColumn(name, F.col("_start") + place).drop("_at", "_part", "_start"))


def text_batches(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Record batches cut to a few rows, so that a worker holds a bounded number of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
