"""Ranks and running totals over a whole year, without putting a year in one task.

Both rest on the same idea: the order is first summarised into small tables of
cells (distinct scores, then hash buckets inside a score), the windows run over
those tables, and only then does each row pick up its offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.sources import store

# A cell (all rows with one score in one year) may hold most of a year. It is
# split by the first hex digits of md5(school_id), which spreads ids evenly.
TIE_DIGITS = 3
SALT_DIGITS = 2
SALTS = 32
LOG_CELLS = 1024  # cells a unit of the log scale
SUB_CELLS = 4096


def tie_bucket(school_id="school_id", digits: int = TIE_DIGITS) -> Column:
    """First tie-break among equal scores: an even draw by id, then the id itself."""
    return F.substring(F.md5(F.col(school_id)), 1, digits)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL, keeping the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, on, "inner").drop(*[f"_r_{k}" for k in keys])


def score_ranks(df: DataFrame, score: str, year: str, group: str, school_id: str = "school_id") -> DataFrame:
    """RANK over the year, RANK inside the group and PERCENT_RANK over the year, by score descending.

    Distinct rounded scores per year are few, so the windows see at most that
    many rows per year (or per year and group). Rows meet their cell's ranks by
    cell and hash bucket, so a score that most of a group shares is spread over
    256 keys.
    """
    keyed = df.withColumn("_bucket", tie_bucket(school_id, SALT_DIGITS))
    buckets = keyed.groupBy(year, group, score, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    cells = buckets.groupBy(year, group, score).agg(F.sum("_n").alias("_n"))

    by_year = Window.partitionBy(year).orderBy(F.desc(score))
    before = by_year.rowsBetween(Window.unboundedPreceding, -1)
    year_cells = (
        cells.groupBy(year, score)
        .agg(F.sum("_n").alias("_yn"))
        .withColumn("_ybefore", F.coalesce(F.sum("_yn").over(before), F.lit(0)))
        .withColumn("_ytotal", F.sum("_yn").over(Window.partitionBy(year)))
    )
    in_group = Window.partitionBy(year, group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        cells.withColumn("_gbefore", F.coalesce(F.sum("_n").over(in_group), F.lit(0)))
        .join(year_cells, [year, score])
        .select(
            year,
            group,
            score,
            (F.col("_ybefore") + 1).alias("state_rank"),
            (F.col("_gbefore") + 1).alias("district_rank"),
            F.when(F.col("_ytotal") > 1, F.col("_ybefore") / (F.col("_ytotal") - 1))
            .otherwise(F.lit(0.0))
            .alias("percent_rank"),
        )
    )
    spread = join_null_safe(buckets.drop("_n"), ranks, [year, group, score])
    return join_null_safe(keyed, spread, [year, group, score, "_bucket"]).drop("_bucket")


def running_totals(
    df: DataFrame,
    year: str,
    cell: dict[str, bool],
    measures: list[str],
    position: str,
    school_id: str = "school_id",
) -> DataFrame:
    """Position and running sums per year in the order `cell`, tie bucket, school id.

    `cell` maps the ordering columns (never NULL) to True for descending. Three
    levels of prefix sums: cells of a year, buckets of a cell, rows of a
    bucket. Each level's partitions stay small even when one cell holds a third
    of the rows, and every step is a function of the data alone, so a recomputed
    task gives the same answer.

    Adds `position` and, per measure, `<measure>_running`.
    """
    cols = list(cell)
    order = [F.desc(c) if descending else F.asc(c) for c, descending in cell.items()]
    before = (Window.unboundedPreceding, -1)
    through = (Window.unboundedPreceding, Window.currentRow)
    names = ["_n", *[f"_s_{m}" for m in measures]]

    def offsets(table: DataFrame, window, prefix: str) -> DataFrame:
        return table.withColumns(
            {prefix + n: F.coalesce(F.sum(n).over(window), F.lit(0)) for n in names}
        )

    keyed = df.withColumn("_bucket", tie_bucket(school_id))
    buckets = keyed.groupBy(year, *cols, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(m).cast("long").alias(f"_s_{m}") for m in measures]
    )
    cells = buckets.groupBy(year, *cols).agg(*[F.sum(n).alias(n) for n in names])
    cell_offsets = offsets(cells, Window.partitionBy(year).orderBy(*order).rowsBetween(*before), "_c").drop(*names)
    bucket_offsets = offsets(
        buckets, Window.partitionBy(year, *cols).orderBy("_bucket").rowsBetween(*before), "_b"
    ).drop(*names)
    starts = bucket_offsets.join(cell_offsets, [year, *cols]).select(
        year, *cols, "_bucket", *[(F.col("_b" + n) + F.col("_c" + n)).alias("_o" + n) for n in names]
    )

    local = Window.partitionBy(year, *cols, "_bucket").orderBy(school_id)
    out = keyed.withColumns(
        {
            "_l_n": F.row_number().over(local),
            **{f"_l_s_{m}": F.sum(m).over(local.rowsBetween(*through)) for m in measures},
        }
    ).join(starts, [year, *cols, "_bucket"])
    return out.select(
        *df.columns,
        (F.col("_o_n") + F.col("_l_n")).alias(position),
        *[(F.col(f"_o_s_{m}") + F.col(f"_l_s_{m}")).alias(f"{m}_running") for m in measures],
    )


def label_codes(df: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """Position of each label among the sorted distinct labels of its kind: rows (kind, label, code), published.

    Distinct labels are sorted in range partitions; a label's position is its
    place in the partition's share of the kind, after the shares before, so no
    task and no value holds all of them.
    """
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), label.alias("label")) for kind, label in labels.items()])
    distinct = df.select(F.inline(pairs)).distinct()
    ordered = (
        distinct.repartitionByRange("kind", "label")
        .sortWithinPartitions("kind", "label")
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    )
    # written once: a second run could draw other range bounds
    fixed = store.publish(ordered, store.new_path(df.sparkSession, "labels"))
    shares = fixed.groupBy("kind", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("kind").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    placed = fixed.join(shares.select("kind", "_part", offset.alias("_offset")), ["kind", "_part"])
    codes = placed.select("kind", "label", (F.col("_row") + F.col("_offset")).cast("int").alias("code"))
    return store.publish(codes, store.new_path(df.sparkSession, "label_codes"))


def with_code(df: DataFrame, codes: DataFrame, kind: str, label: Column, name: str, school_id: str = "school_id") -> DataFrame:
    """Add a label's code. Rows meet it by label and hash bucket, so a label that most rows share is spread."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    found = codes.where(F.col("kind") == kind).select(F.col("label").alias("_label"), F.col("code").alias(name), salts)
    keyed = df.withColumns({"_label": label, "_salt": F.pmod(F.xxhash64(school_id), F.lit(SALTS)).cast("int")})
    return keyed.join(found, ["_label", "_salt"], "left").drop("_label", "_salt")


def exact_percentiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group, one column per name.

    The built-in exact percentile keeps every distinct value of a group in one
    task. Here the wanted positions are narrowed down by exact counts: first per
    cell of a monotone log scale, then per 4,096th of the range of values that a
    wanted cell really has, and only the distinct values of the cells that are
    left are ordered. A cell of one value is an answer as soon as it is found,
    whatever its rows. Each step shuffles cells, never all distinct values, and
    the wanted cells (two a group and position at most) go to the rows, so
    `groups` are meant for labels, not for keys. Without groups there is one row
    over everything.
    """
    x = F.col(value).cast("double")
    log_cell = F.floor(F.signum(x) * F.log1p(F.abs(x)) * LOG_CELLS).cast("long")
    rows = df.where(F.col(value).isNotNull()).select(*groups, x.alias("_x"), log_cell.alias("_cell0"))

    def both_ends(p: float) -> Column:
        pos = (F.col("_total") - 1) * F.lit(p)
        return F.array(F.floor(pos), F.ceil(pos))

    def inside(ranks, begin, size) -> Column:
        return F.filter(ranks, lambda r: (r >= begin) & (r < begin + size))

    def counted(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*groups, *keys).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")
        )

    def narrowed(cells: DataFrame, above: list[str], cell: str) -> DataFrame:
        """Cells that hold wanted ranks, with the rows before them."""
        ordered = Window.partitionBy(*groups, *above).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
        before = F.sum("_n").over(ordered) - F.col("_n") + F.col("_start")
        return (
            cells.withColumn("_begin", before)
            .withColumn("_ranks", inside("_ranks", F.col("_begin"), F.col("_n")))
            .where(F.size("_ranks") > 0)
            .select(*groups, *above, cell, "_begin", "_total", "_ranks", "_low", "_high")
        )

    def answers(cells: DataFrame) -> DataFrame:
        return cells.select(*groups, F.col("_low").alias("_x"), "_total", F.explode("_ranks").alias("_rank"))

    one_value = F.col("_low") == F.col("_high")
    first = (
        counted(rows, "_cell0")
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*groups)))
        .withColumn("_ranks", F.array_distinct(F.concat(*[both_ends(p) for p in probs.values()])))
        .withColumn("_start", F.lit(0).cast("long"))
        .transform(narrowed, [], "_cell0")
    )
    # two rows a group and position at most
    left = join_null_safe(rows, F.broadcast(first.where(~one_value)), [*groups, "_cell0"])
    share = (F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    left = left.withColumn("_cell1", F.least(F.floor(share * SUB_CELLS), F.lit(SUB_CELLS - 1)))
    keys = [*groups, "_cell0"]
    known = first.select(*keys, F.col("_begin").alias("_start"), "_total", "_ranks")
    second = join_null_safe(counted(left, "_cell0", "_cell1"), F.broadcast(known), keys).transform(narrowed, ["_cell0"], "_cell1")

    keys = [*groups, "_cell0", "_cell1"]
    wanted = second.where(~one_value).select(*keys, F.col("_begin").alias("_start"), "_total", "_ranks")
    last = join_null_safe(left.select(*keys, "_x"), F.broadcast(wanted), keys)
    values = (
        last.groupBy(*keys, "_x")
        .agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("_start", "_total", "_ranks")])
        .withColumns({"_low": F.col("_x"), "_high": F.col("_x")})
        .transform(narrowed, ["_cell0", "_cell1"], "_x")
    )
    hits = answers(first.where(one_value)).unionByName(answers(second.where(one_value))).unionByName(answers(values))
    totals = hits.groupBy(*groups).agg(
        F.max("_total").alias("_total"), F.map_from_entries(F.collect_set(F.struct("_rank", "_x"))).alias("_at")
    )

    def interpolated(p: float) -> Column:
        pos = (F.col("_total") - 1) * F.lit(p)
        low, high = F.col("_at")[F.floor(pos)], F.col("_at")[F.ceil(pos)]
        return low + (high - low) * (pos - F.floor(pos))

    return totals.select(*groups, *[interpolated(p).alias(name) for name, p in probs.items()])
