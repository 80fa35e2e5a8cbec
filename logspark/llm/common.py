"""Shared steps of the operators: document columns, scratch tables and batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from logspark.session import save_and_read, save_in_buckets, ship

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bits of one map of a filter of ids, and of a whole filter: 16 to 32 an id as long as the most allow it.
MAP_BITS, LEAST_BITS, MOST_BITS = 1 << 15, 1 << 20, 1 << 27


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, stored with a ``__row`` of its own for each row: ids may be null or repeat."""
    return save_and_read(docs.withColumn("__row", F.monotonically_increasing_id()), f"{name}-rows")


def flag_among(rows: DataFrame, key: str, ids: DataFrame, flag: str, most: int = MOST_BITS) -> DataFrame:
    """``rows`` with the boolean ``flag``: true wherever ``key`` is among the first column of ``ids``, and by chance for a few others.

    The ids go to all tasks as maps of bits, 16 MB in all at most however many there are, so the rows stay where they are: a shuffle after it moves
    flagged rows only. ``ids`` is read twice.
    """
    bits = min(most, max(LEAST_BITS, 1 << math.ceil(math.log2(16 * max(ids.count(), 1)))))
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits))
    at = ids.select(slot(ids.columns[0]).alias("slot")).select((F.col("slot") / MAP_BITS).cast("long").alias("__map"), (F.col("slot") % MAP_BITS).alias("bit"))
    maps = at.repartition("__map").groupBy("__map").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    placed = rows.withColumn("__slot", slot(key)).withColumn("__map", (F.col("__slot") / MAP_BITS).cast("long"))
    byte = F.substring("__bits", (F.col("__slot") % MAP_BITS / 8).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("__slot") % 8).cast("int"))
    return placed.join(F.broadcast(maps), "__map", "left").select(*rows.columns, F.coalesce(bit == 1, F.lit(False)).alias(flag))


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """Run ``fn`` on every Arrow batch; it yields dictionaries of columns."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch):
                    yield pa.RecordBatch.from_pydict(out, schema=target)

    ship(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def map_partitions(df: DataFrame, schema: str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """Run ``fn`` once on the batches of every partition; it yields dictionaries of columns."""

    def run(batches):
        for out in fn(batches):
            yield pa.RecordBatch.from_pydict(out, schema=target)

    ship(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], object]) -> DataFrame:
    """The rows of ``df`` for which ``fn`` of their Arrow batch gives true, with all their columns."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(fn(batch), pa.bool_()))

    ship(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def let(then, **values: F.Column) -> F.Column:
    """``then`` applied to a struct of ``values``, each computed once."""
    return F.transform(F.array(F.struct(*(c.alias(k) for k, c in values.items()))), then)[0]


def count_words(text) -> F.Column:
    r"""Number of runs without white space (`[^\x20\x09-\x0D]+`); 0 for null."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def words(text) -> F.Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(spaced, " "), "")


__all__ = ["DOCUMENT_COLUMNS", "count_words", "documents", "flag_among", "keep_rows", "let", "map_batches", "map_partitions", "numbered", "save_and_read", "save_in_buckets", "table", "words"]
