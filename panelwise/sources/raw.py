"""Yearly raw files: six CSV kinds in one folder per year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.operators.assemble import prepare, stack_years

# The file kinds of a year.
KINDS = ("profile_1", "profile_2", "facility", "teacher", "enrolment_1", "enrolment_2")

# Texts that stand for a missing cell.
MISSING = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null", "",
)

YEAR_FOLDERS = "{root}/{year}/{kind}.csv"


def child_folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders directly under a path, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())


def list_years(spark: SparkSession, root: str) -> list[str]:
    """Years found as folder names (`2018-19`, or `year=2018-19`)."""
    names = [n.removeprefix("year=") for n in child_folders(spark, root)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, every column as text; types are declared later. Texts for a missing cell are NULL."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)

    def cell(name: str):
        value = F.col("`" + name.replace("`", "``") + "`")
        return F.when(~value.isin(*MISSING), value).alias(name)

    return df.select(*[cell(c) for c in df.columns])


def read_year(spark: SparkSession, root: str, year: str, layout: str = YEAR_FOLDERS) -> dict[str, DataFrame]:
    """The six prepared files of one year."""
    return {k: prepare(read_csv_text(spark, layout.format(root=root, year=year, kind=k))) for k in KINDS}


def read_all_years(
    spark: SparkSession, root: str, years: list[str] | None = None, layout: str = YEAR_FOLDERS
) -> dict[str, DataFrame]:
    """Per file kind, all years stacked. Headers drift, so each year is read under its own header."""
    years = years or list_years(spark, root)
    by_year = {y: read_year(spark, root, y, layout) for y in years}
    return {k: stack_years({y: by_year[y][k] for y in years}) for k in KINDS}


def read_masters(spark: SparkSession, root: str, exclude: str = "master_longitudinal.csv") -> DataFrame:
    """Yearly master CSVs `master_<year>.csv` stacked, leaving out the longitudinal output itself."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    years = {
        n.removeprefix("master_").removesuffix(".csv"): n
        for n in names
        if n.startswith("master_") and n.endswith(".csv") and n != exclude
    }
    return stack_years({y: read_csv_text(spark, f"{root}/{n}") for y, n in years.items()})
