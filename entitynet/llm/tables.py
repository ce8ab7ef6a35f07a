"""What the operators share: reading tables, slicing texts into bounded pieces of work."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitynet.session import cut, scratch

#: Characters of text that a Python task works on at once; a longer text is one piece of work.
SLICE_CHARS = 1_500_000
#: Bytes of a batch between the JVM and a Python task, which both hold a few times over; a larger row is a batch.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound of an Arrow batch to ``BATCH_BYTES``; a lower one stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Return the memory that this worker has freed: a worker runs the tasks of all stages, and each would add its own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``limit`` bytes of ``column`` (one row at least)."""
    give_back()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text is divisible by five; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front what no column of ``df`` is called (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Numbered:
    """A written copy of a table whose rows have numbers, to be cut down by decisions on those numbers.

    A number names its partition and the place in it. Every task writes its partition to
    the bucket of that name, so texts are written once and never shuffled: decisions are
    gathered into one row a partition (as many numbers as a partition has rows at most) and
    brought to the bucket. Numbers come from a written table, so a lost executor changes none.
    """

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.columns, self.row, self.part = docs.columns, unused(docs, "_row"), unused(docs, "_part")
        numbered = docs.withColumn(self.row, F.monotonically_increasing_id()).withColumn(self.part, F.shiftright(self.row, 33))
        self.name, path = f"rows_{uuid.uuid4().hex}", scratch(spark)
        numbered.write.bucketBy(max(1, docs.rdd.getNumPartitions()), self.part).option("path", path).saveAsTable(self.name)
        self.table = spark.table(self.name)

    def text(self) -> DataFrame:
        """(_row, doc_id, text) of every row."""
        return self.table.select(F.col(self.row).alias("_row"), "doc_id", "text")

    def _met(self, rows: DataFrame, value: str | None, how: str) -> DataFrame:
        pair = F.struct("_row", F.lit(0).alias("_value") if value is None else F.col(value).alias("_value"))
        # A written table has no partitioning of its own, so it is brought to the buckets and not the texts to it; hashed, not sorted.
        by_part = cut(rows.groupBy(F.shiftright("_row", 33).alias("_in")).agg(F.map_from_entries(F.collect_list(pair)).alias("_decided")))
        return self.table.alias("t").join(by_part.hint("shuffle_hash").alias("d"), F.col(f"t.{self.part}") == F.col("d._in"), how)

    def text_of(self, rows: DataFrame, value: str) -> DataFrame:
        """(_value, text) of the rows in ``rows`` (_row, ``value``); the numbers in ``rows`` are distinct."""
        return self._met(rows, value, "inner").select(F.col("d._decided")[F.col(f"t.{self.row}")].alias("_value"), F.col("t.text").alias("text")).where(
            F.col("_value").isNotNull())

    def without(self, rows: DataFrame) -> DataFrame:
        """The table's own columns of all rows but those in ``rows`` (_row, distinct)."""
        left = self._met(rows, None, "left").where(F.col("d._decided").isNull() | ~F.map_contains_key("d._decided", F.col(f"t.{self.row}")))
        return left.select(*[F.col(f"t.`{c}`") for c in self.columns])
