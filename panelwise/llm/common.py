"""Helpers the operators share: scratch tables, columns of any table, lookups of hot keys, Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.sources import store

SALTS = 32
SLICE_BYTES = 1 << 18
BATCH_ROWS = 1_000


def scratch(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write the rows into the shared folder and read them back.

    Cuts the lineage and fixes values such as generated ids: a lost executor
    costs a new read of the files, not a new run of what made them.
    """
    path = store.new_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame) -> DataFrame:
    """The same frame; its session hands Python at most 1,000 rows at a time, so long texts fit into a worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that working columns cannot clash with them."""
    return F.struct(*[col(c).alias(c) for c in df.columns])


def lookup(rows: DataFrame, key: str, salt: str, found: DataFrame) -> DataFrame:
    """Inner join of `found`, one row a key, to rows of which many may share a key.

    Each key is first joined to the salts it occurs with, and rows then meet it
    by key and salt, so a key with a third of all rows is spread over the salts.
    """
    spread = rows.select(key, salt).distinct().join(found, key)
    return rows.join(spread, [key, salt])


def strings(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """As 32-bit strings without nulls (null counts as empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.type != pa.string():
        array = array.cast(pa.string())
    return pc.fill_null(array, "") if array.null_count else array


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of about `most` bytes in `column` or of one row."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for row, n in enumerate(lengths.tolist()):
        if size and size + n > most:
            yield batch.slice(begin, row - begin)
            begin, size = row, 0
        size += n
    yield batch.slice(begin)
