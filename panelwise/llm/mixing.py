"""Mix of sources to target weights by capped water-filling, in DataFrame operations only.

Sources in order of code points, null last, weigh 1, 2, 3, repeating. Targets
share all words by weight and stop at `epochs` times their source; what a source
cannot take is shared again by weight until none is above. The level is found in
closed form: by rising cap for a weight, sources are full as long as the share of
what is left reaches their cap.

A source whose target is r times its size takes every document floor(r) times and
one more time the first documents, in the order of a seeded hash, whose words
make up the rest; a source's words come within one document of its target. The
order is summed up by 4,096 hash buckets a source, so a source with a third of
all rows is spread over its buckets.

Null texts and texts without words have size 0 and add nothing. A null source is
a source. Repeated rows are rows of their own; rows that differ in the text only
are told apart by its hash. Extra columns are carried along untouched. An empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import col, scratch, whole_row

EPOCHS = 3
SEED = 17
WEIGHTS = 3
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: int = SEED, payload: Column | None = None) -> DataFrame:
    """doc_id, source, size in words and the hash order of each row, with the payload if given."""
    size = F.coalesce(F.regexp_count(col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    source = col("source").cast("string")
    rows = docs.select(
        col("doc_id").alias("doc_id"),
        source.alias("source"),
        F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source)).alias("skey"),
        size.alias("size"),
        F.xxhash64(col("text")).alias("tie"),
        *([payload.alias("row")] if payload is not None else []),
    )
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size"))
    return rows.withColumn("place", place).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))


def targets(rows: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Per source: skey, source_size, target. One row a source, by windows over the sources alone."""
    sizes = rows.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    weight = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(WEIGHTS)) + 1
    big = "decimal(38,0)"
    shares = sizes.withColumn("w", weight.cast("bigint")).select(
        "*", (F.col("source_size") * epochs).cast(big).alias("cap"), F.sum("source_size").over(Window.partitionBy()).cast(big).alias("total")
    )
    # caps for a weight, on a common denominator
    rising = Window.orderBy(F.col("cap") * F.lit(6) / F.col("w"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    placed = shares.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(big).alias("taken"),
        F.sum("w").over(after).cast(big).alias("weights"),
    )
    full = (F.col("total") - F.col("taken")) * F.col("w") >= F.col("cap") * F.col("weights")
    everywhere = Window.partitionBy()
    level = placed.withColumn("full", full).select(
        "*",
        F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everywhere), F.lit(0)).cast(big).alias("given"),
        F.sum(F.when(~F.col("full"), F.col("w"))).over(everywhere).cast(big).alias("open"),
    )
    share = (F.col("w") * (F.col("total") - F.col("given"))).cast("double") / F.col("open").cast("double")
    return level.select("skey", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def repeats(rows: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """Rows of `sized` with source_size, target and the times the mix takes each."""
    by_bucket = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = (
        by_bucket.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("words_before"))
        .join(targets(rows, epochs), "skey")
        .withColumn("whole", whole)
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    inside = Window.partitionBy("skey", "bucket").orderBy("place", "tie").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("words_in", F.sum("size").over(inside)).join(plan, ["skey", "bucket"])
    middle = F.col("words_before") + F.col("words_in") - F.col("size") / 2
    more = (F.col("size") > 0) & (middle < F.col("rest"))
    return summed.withColumn("times", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int"))


def mix_report(docs: DataFrame, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken."""
    rows = scratch(sized(docs, seed), "sizes")
    return repeats(rows, epochs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")
    )


def mix(docs: DataFrame, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as it is taken."""
    taken = repeats(sized(docs, seed, whole_row(docs)), epochs).where("times > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).select("row.*")
