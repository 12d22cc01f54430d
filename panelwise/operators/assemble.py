"""From drifting yearly files to one longitudinal panel.

All years of a file kind are stacked first and processed together, keyed by
(year, school_id), so the plan has one branch per file kind however many years
there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwise.functions.exprs import count_if, number, ratio, round_half_away

KEYS = ["year", "school_id"]

# Spellings of the key column, columns that only split rows into groups.
KEY_SPELLINGS = ("psuedocode", "pseudocode")
GROUPING_COLUMNS = ("item_desc", "item_group", "item_id")


def clean_name(name: str) -> str:
    name = name.strip().lower()
    for ch in " -/":
        name = name.replace(ch, "_")
    return name


def standardise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def fix_key(df: DataFrame) -> DataFrame:
    """Rename either spelling of the key to school_id."""
    for spelling in KEY_SPELLINGS:
        df = df.withColumnRenamed(spelling, "school_id")
    return df


def drop_grouping(df: DataFrame) -> DataFrame:
    return df.drop(*GROUPING_COLUMNS)


def prepare(df: DataFrame) -> DataFrame:
    """Column-level cleaning of one raw file."""
    return df.transform(standardise_names).transform(fix_key)


def stack_years(frames: dict[str, DataFrame]) -> DataFrame:
    """Union by name over years, with the year as a column.

    Columns that appear in some years only are NULL elsewhere, and their years are
    kept in the column's metadata; a column whose type differs between years
    becomes a string.
    """
    types: dict[str, set] = {}
    for df in frames.values():
        for f in df.schema.fields:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = {name for name, seen in types.items() if len(seen) > 1}

    def aligned(year: str, df: DataFrame) -> DataFrame:
        cols = [F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in df.columns]
        return df.select(F.lit(year).alias("year"), *cols)

    parts = [aligned(year, df) for year, df in sorted(frames.items())]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.select(
        "year", *[in_years(F.col(f"`{c}`"), c, [y for y, df in frames.items() if c in df.columns]) for c in stacked.columns[1:]]
    )


def in_years(value: Column, name: str, years) -> Column:
    """A column that notes the years whose files have it (None: all)."""
    return value.alias(name) if years is None else value.alias(name, metadata={"years": sorted(years)})


def years_of(df: DataFrame, name: str) -> set[str] | None:
    """Years whose files have the column; None if it says nothing, which means all."""
    years = df.schema[name].metadata.get("years")
    return None if years is None else set(years)


def non_null_counts(df: DataFrame) -> dict[str, int]:
    """Non-NULL cells per column, in one pass (one row of column metadata comes back)."""
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return row.asDict()


def drop_null_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Drop columns without a single value; also returns their names."""
    counts = non_null_counts(df)
    dropped = [c for c in df.columns if counts[c] == 0]
    return df.drop(*dropped), dropped


def numeric_columns(df: DataFrame, keys: list[str]) -> dict[str, set[str] | None]:
    """Columns that are numbers, or text in which every value is a number, with the years for which that holds.

    Each year is judged by itself (one aggregate keyed by year): a text cell in
    one year leaves the sums of the others alone. None stands for all years.
    """
    typed = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keys]
    found: dict[str, set[str] | None] = {c: years_of(df, c) for c in typed}
    if texts:
        by = ["year"] if "year" in keys else []
        bad = [count_if(F.col(f"`{c}`").isNotNull() & number(F.col(f"`{c}`")).isNull()).alias(c) for c in texts]
        rows = df.groupBy(*by).agg(*bad).collect()  # one row a year
        for c in texts:
            good, there = {r["year"] if by else None for r in rows if r[c] == 0}, years_of(df, c)
            if len(good) == len(rows):
                found[c] = there
            elif by and good & (there or good):
                found[c] = good & (there or good)
    return {c: found[c] for c in df.columns if c in found}


def sum_by_school(df: DataFrame, columns, keys: list[str] = KEYS) -> DataFrame:
    """Sum numeric columns per key; rows without a school id are left out, all-missing sums are 0.

    `columns` are names, or names with the years that have them as numbers; the
    sum is NULL in other years. Map-side partial sums keep a school with very many
    group rows cheap.
    """

    def total(c: str) -> Column:
        years = columns[c] if isinstance(columns, dict) else None
        value = F.coalesce(F.sum(number(F.col(f"`{c}`"))), F.lit(0.0))
        return in_years(value if years is None else F.when(F.col("year").isin(*years), value), c, years)

    sums = [total(c) for c in columns]
    return df.where(F.col("school_id").isNotNull()).groupBy(*keys).agg(*sums)


def sum_across(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in columns], F.lit(0.0))


def with_suffix_totals(df: DataFrame, tail: str = "") -> DataFrame:
    """Horizontal totals of the `_b` and `_g` columns: total_boys, total_girls, total_enrolment (+ tail)."""
    boys = [c for c in df.columns if c.endswith("_b")]
    girls = [c for c in df.columns if c.endswith("_g")]
    return df.withColumns(
        {f"total_boys{tail}": sum_across(boys), f"total_girls{tail}": sum_across(girls)}
    ).withColumn(f"total_enrolment{tail}", F.col(f"total_boys{tail}") + F.col(f"total_girls{tail}"))


def join_left_suffixed(left: DataFrame, right: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Left join on the keys; a name present on both sides becomes name_x (left) and name_y (right).

    Over stacked years this holds for the years in which both sides have the name;
    in a year in which only one has it, it keeps its name.
    """
    both = [c for c in right.columns if c in left.columns and c not in keys]
    years = {c: (years_of(left, c), years_of(right, c)) for c in both}
    left = left.withColumnsRenamed({c: f"{c}_x" for c in both})
    right = right.withColumnsRenamed({c: f"{c}_y" for c in both})
    joined = left.join(right, keys, "left")
    if "year" not in keys:
        return joined
    out = []
    apart = {c: pair for c, pair in years.items() if pair[0] != pair[1]}
    for c in joined.columns:
        name, side = c[:-2], c[-2:]
        if name not in apart or side not in ("_x", "_y"):
            out.append(F.col(f"`{c}`"))
            continue
        a, b = apart[name]
        clash = b if a is None else a if b is None else a & b
        if clash:
            out.append(in_years(F.when(F.col("year").isin(*clash), F.col(f"`{c}`")), c, clash))
        if side == "_x":
            alone = F.coalesce(F.col(f"`{name}_x`").cast("string"), F.col(f"`{name}_y`").cast("string"))
            only = None if a is None or b is None else (a | b) - clash
            out.append(in_years(F.when(~F.col("year").isin(*clash), alone) if clash else alone, name, only))
    return joined.select(*out)


def enrolment_totals(raw: DataFrame, tail: str, keys: list[str] = KEYS, numeric=None) -> DataFrame:
    """Per-school sums of one enrolment file with its horizontal totals."""
    rows = raw.transform(drop_grouping)
    cols = numeric if numeric is not None else numeric_columns(rows, keys)
    return sum_by_school(rows, cols, keys).transform(with_suffix_totals, tail)


def assemble_master(files: dict[str, DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """Wide master rows: five left joins starting from profile_1.

    `files` maps the six file kinds to prepared frames (of one year, or of all
    years stacked with `year` among the keys).
    """
    by_class = enrolment_totals(files["enrolment_1"], "", keys)
    by_age = enrolment_totals(files["enrolment_2"], "_age", keys)
    parts = [files["profile_1"], files["profile_2"], files["facility"], files["teacher"], by_class, by_age]
    return reduce(lambda a, b: join_left_suffixed(a, b, keys), parts)


def longitudinal(files: dict[str, DataFrame], stage=lambda df: df, writes: bool = False) -> DataFrame:
    """The longitudinal panel without its empty columns.

    Which columns are empty is known only after the joins. `stage` may publish
    the joined rows so that the check and the result read them instead of
    joining twice. If it is known to write them (`writes`), the values are
    counted while they are written, and nothing is read for the check.
    """
    master = assemble_master(files)
    if not writes:
        return drop_null_columns(stage(master))[0]
    seen = Observation()
    stored = stage(master.observe(seen, *[F.count(F.col(f"`{c}`")).alias(c) for c in master.columns]))
    counts = seen.get
    return stored.drop(*[c for c in master.columns if counts[c] == 0])


def quality_audit(master: DataFrame, class_columns: list[str]) -> DataFrame:
    """Data-quality figures, one row per year; `class_columns` are the enrolment cells by class."""
    cells = [c for c in master.columns if c not in KEYS]
    same_age = F.col("total_enrolment") == F.col("total_enrolment_age") if "total_enrolment_age" in cells else F.lit(False)
    null_cells = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in cells])
    return master.groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(F.col("school_id").isNull()).alias("missing_keys"),
        (F.count("school_id") - F.countDistinct("school_id")).alias("duplicate_keys"),
        count_if(F.col("total_enrolment") == sum_across(class_columns)).alias("class_sum_matches"),
        count_if(F.col("total_enrolment") == F.col("total_boys") + F.col("total_girls")).alias("split_matches"),
        count_if(same_age).alias("age_total_matches"),
        round_half_away(ratio(F.sum(null_cells), F.count(F.lit(1)) * len(cells)), 4).alias("null_cell_share"),
    )
