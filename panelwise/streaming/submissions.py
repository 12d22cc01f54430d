"""Submissions as a stream: validated against the published gap table as they arrive, each once.

Repeated deliveries are dropped by a state store keyed by the submission, which
forgets ids after a time limit counted from their arrival. Each micro-batch is one
partition of a versioned table, replaced as a whole if the batch runs again, so a
restart adds nothing twice and readers never see half a batch. The gap table is cut
to the years of the batch before the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelwise.operators.proposals import judge_submissions, split_valid, with_message
from panelwise.sources import store
from panelwise.sources.schemas import SUBMISSIONS

REMEMBERED = "7 days"
YEAR_LABEL = r"^\d{4}-\d{2}$"


def read_submissions(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Submission files as a stream."""
    return spark.readStream.schema(SUBMISSIONS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_each(submissions: DataFrame, remembered: str = REMEMBERED) -> DataFrame:
    """Valid submissions without those whose id has arrived before, within the time limit; one without an id
    repeats another if all its columns do."""
    valid, _ = split_valid(submissions)
    same = F.when(F.col("submission_id").isNull(), F.xxhash64(*submissions.columns))
    # arrival times never go back, so no submission counts as late, however old it is
    arrived = valid.withColumns({"_arrived": F.current_timestamp(), "_same": same}).withWatermark("_arrived", remembered)
    return arrived.dropDuplicatesWithinWatermark(["submission_id", "_same"]).drop("_arrived", "_same")


def judged(submissions: DataFrame, gapped: DataFrame) -> DataFrame:
    """Valid submissions with decision, context and message."""
    return judge_submissions(submissions, gapped).transform(with_message)


def in_years_of(batch: DataFrame, gapped: DataFrame) -> DataFrame:
    """The gap table cut to the years that a batch names: a few labels, which reach the scan as a partition filter."""
    named = batch.select("academic_year").where(F.col("academic_year").rlike(YEAR_LABEL)).distinct()
    return gapped.where(F.col("academic_year").isin([r.academic_year for r in named.collect()]))


def batch_writer(gapped: DataFrame, path: str, stamp: str | None = None) -> Callable[[DataFrame, int], None]:
    """Judge a micro-batch and make it a partition of the table at `path`; running it again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            rows = judged(batch, in_years_of(batch, gapped))
            if stamp:
                rows = rows.withColumn(stamp, F.current_timestamp())
            store.republish(rows.withColumn("batch", F.lit(number)), path, ["batch"], {"batch": number})
        finally:
            batch.unpersist()

    return write


def append_judged(
    submissions: DataFrame, gapped: DataFrame, path: str, checkpoint: str, stamp: str | None = None, once: bool = True
) -> StreamingQuery:
    """Judge a stream of submissions into a table. With `once`, what is there is processed and the query ends."""
    writer = once_each(submissions).writeStream.foreachBatch(batch_writer(gapped, path, stamp))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def quarantined_stream(submissions: DataFrame) -> DataFrame:
    """Submissions outside the allowed range."""
    return split_valid(submissions)[1]


def append_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to plain files. With `once`, what is there is processed and the query ends."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
