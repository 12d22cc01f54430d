"""Published tables: where they live, how they are written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would lose data with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="panelwise-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/panelwise/{app}/{name}-{uuid.uuid4().hex[:12]}"


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def publish(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    cluster_by: list[str] | None = None,
    year: str | None = None,
    as_dealt: bool = False,
) -> DataFrame:
    """Write a table to a path of its own, once, and return it as read back.

    With `as_dealt` the tasks that made the rows write them, without another
    exchange: for tables from tasks that hold many rows of each partition. `year` replaces that year's partition in place, for tables that nobody reads
    meanwhile; `republish` leaves the old rows to their readers.
    """
    if year is None:
        _laid_out(df, partition_by or [], cluster_by or [], as_dealt=as_dealt).parquet(path)
    else:
        rows = df.where(F.col("academic_year") == year)
        writer = _laid_out(rows, partition_by or [], cluster_by or []).mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    return read_table(df.sparkSession, path, df.schema)


def _laid_out(
    df: DataFrame, partition_by: list[str], cluster_by: list[str], version: str | None = None, as_dealt: bool = False
):
    """A writer with its rows in place.

    Unless rows stay as they are dealt, output is rebalanced so files come out at the advisory size whatever the
    skew between years. With `cluster_by`, files hold ranges of these columns
    in order, so that statistics and Bloom filters rule out nearly all row
    groups for one value.
    """
    place = [*partition_by, *cluster_by]
    if cluster_by:
        df = df.repartitionByRange(*place).sortWithinPartitions(*place)
    elif partition_by and not as_dealt:
        df = df.hint("rebalance", *partition_by)
    if version is not None:
        df, partition_by = df.withColumn(VERSION, F.lit(version)), [*partition_by, VERSION]
    writer = df.write.mode("errorifexists" if version is None else "append")
    for column in cluster_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer.partitionBy(*partition_by) if partition_by else writer


# --- versioned tables: data folders that are never written twice, and a list of them that is made last

VERSION = "version"
_LISTS = "_versions"
_END = "end"


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _lists(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the lists of a table, also of those still being written, the latest first."""
    fs, place = _file_system(spark, path)
    folder = place(f"{path}/{_LISTS}")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted((int(name) for name in names if name.isdigit()), reverse=True)


def _folders(spark: SparkSession, path: str, number: int) -> list[str] | None:
    """Data folders of a list; None where it has no end yet."""
    fs, place = _file_system(spark, path)
    stream = fs.open(place(f"{path}/{_LISTS}/{number:012d}"))
    try:
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()
    return lines[:-1] if lines[-1] == _END else None


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a table that can be read, the latest first."""
    return [n for n in _lists(spark, path) if _folders(spark, path, n) is not None]


def read_version(spark: SparkSession, path: str, schema=None, version: int | None = None) -> DataFrame:
    """A version of a table, the latest by default. Later versions do not change what the frame reads."""
    path = path.rstrip("/")
    known = versions(spark, path)
    if version is None and known:
        version = known[0]
    if version not in known:
        raise FileNotFoundError(f"no such version of {path}")
    folders = _folders(spark, path, version)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if not folders:
        if schema is None:
            raise FileNotFoundError(f"{path} has no rows and needs a schema")
        return spark.createDataFrame([], schema)
    df = reader.option("basePath", path).parquet(*[f"{path}/{folder}" for folder in folders])
    return df.drop(VERSION)


def republish(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    only: dict | None = None,
    cluster_by: list[str] | None = None,
) -> DataFrame:
    """Make the next version of a table and return it as read back.

    `only` replaces the rows of one partition, such as one year, and keeps the
    folders of all others. Data goes to new folders first; the list of folders
    that make up the version is created last. A run that fails before leaves
    the old version as it was, and files that nobody lists. Two writers cannot
    make the same version.
    """
    spark, path, partition_by = df.sparkSession, path.rstrip("/"), partition_by or []
    if only:
        for column, value in only.items():
            df = df.where(F.col(column) == F.lit(value))
    taken, readable = _lists(spark, path), versions(spark, path)
    number = taken[0] + 1 if taken else 1
    mark = f"{number:012d}-{uuid.uuid4().hex[:8]}"
    _laid_out(df, partition_by, cluster_by or [], mark).parquet(path)
    fs, place = _file_system(spark, path)
    root = fs.makeQualified(place(path)).toString().rstrip("/") + "/"
    found = fs.globStatus(place(path + "/*" * len(partition_by) + f"/{VERSION}={mark}")) or []
    folders = [status.getPath().toString().removeprefix(root) for status in found]
    if only and readable:
        gone = "/".join(f"{column}={only[column]}" for column in partition_by if column in only) + "/"
        folders += [old for old in _folders(spark, path, readable[0]) if not old.startswith(gone)]
    stream = fs.create(place(f"{path}/{_LISTS}/{number:012d}"), False)
    try:
        stream.write("\n".join([*sorted(folders), _END]).encode())
    finally:
        stream.close()
    return read_version(spark, path, df.schema, number)


def is_key(df: DataFrame, key: list[str]) -> bool:
    """Whether no two rows share a key. Checked once where a table is published, from its key columns."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty()


def append(df: DataFrame, path: str, stamp: str | None = None) -> None:
    """Append rows, with the write time in column `stamp` if given."""
    if stamp:
        df = df.withColumn(stamp, F.current_timestamp())
    df.write.mode("append").parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple, parts: int, **options) -> DataFrame:
    """Parallel read of a table from a warehouse, split on a numeric key."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=key,
            lowerBound=bounds[0],
            upperBound=bounds[1],
            numPartitions=parts,
            **options,
        )
        .load()
    )
