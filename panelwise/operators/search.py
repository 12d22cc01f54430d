"""Substring search through trigrams: posting blocks per trigram, intersected, then verified.

A text of three characters or more can only stand where all its trigrams stand, so
the schools that hold all of them are few, and only these are looked at. The index
has a row per field, trigram and block of schools (by a hash of the id), so no list
grows with the number of schools of a common trigram. Files hold ranges of trigrams
and are skipped for all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
ORDER = ["gram", "field", "block"]
BLOCK_ROWS = 4_096
FIELDS = ("school_id", "school_name")


def grams(text: Column) -> Column:
    """Distinct trigrams of a lower-cased text; none for a shorter one."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    return F.when(F.length(low) >= GRAM, F.array_distinct(F.transform(places, lambda i: low.substr(i, F.lit(GRAM)))))


def postings(schools: DataFrame) -> DataFrame:
    """Posting blocks: (gram, field, block, school_ids), sorted ids in each block. Publish them clustered by `ORDER`."""
    blocks = max(1, -(-schools.count() // BLOCK_ROWS))
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), grams(F.col(name)).alias("grams")) for name in FIELDS])
    return (
        schools.select("school_id", F.pmod(F.xxhash64("school_id"), F.lit(blocks)).alias("block"), F.inline(pairs))
        .select("school_id", "block", "field", F.explode("grams").alias("gram"))
        .groupBy("gram", "field", "block")
        .agg(F.sort_array(F.collect_set("school_id")).alias("school_ids"))
    )


def text_grams(spark: SparkSession, text: str) -> list[str]:
    """Trigrams of a searched text, lower-cased as the index is."""
    return spark.range(1).select(grams(F.lit(text)).alias("g")).first().g or []


def candidates(index: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids of the schools that hold all wanted trigrams in one field."""
    held = index.where(F.col("gram").isin(wanted)).groupBy("field", "block").agg(F.collect_list("school_ids").alias("lists"))
    every = F.aggregate(F.slice("lists", 2, len(wanted)), F.get("lists", F.lit(0)), F.array_intersect)
    return held.where(F.size("lists") == len(wanted)).select(F.explode(every).alias("school_id")).distinct()


def search(schools: DataFrame, index: DataFrame, text: str) -> DataFrame:
    """Schools whose id or name contains the text, whatever the case; short texts by a scan."""
    needle = F.lower(F.lit(text))
    contains = F.contains(F.lower("school_id"), needle) | F.contains(F.lower("school_name"), needle)
    if len(text) < GRAM:
        return schools.where(contains)
    wanted = text_grams(schools.sparkSession, text)
    return schools.join(candidates(index, wanted), "school_id", "left_semi").where(contains)
