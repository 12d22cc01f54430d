"""Stand-in data: a panel derived from order tables.

A customer stands for a school, an order year for an academic year, a nation
for a district. Used by the registered queries, the benchmark and the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions.exprs import flag_to_bool
from panelwise.sources.store import is_key, new_path, publish

# A task groups about so many lines, or holds so many school-years; customers with more orders are dealt out in shares.
LINES_A_TASK = 500_000
ROWS_A_TASK = 50_000
HEAVY_ORDERS = 20_000
SHARES = 256

_PUBLISHED: dict[tuple, DataFrame] = {}
_KEYED: dict[tuple, bool] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """School dimension from customers."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").cast("string").alias("school_id"),
            F.col("c_name").alias("school_name"),
            F.col("n_name").alias("district"),
            F.col("c_mktsegment").alias("block"),
            F.col("r_name").alias("management_type"),
            (F.col("c_custkey") % 11 + 1).cast("int").alias("school_category"),
            (F.col("n_nationkey") % 2 + 1).cast("int").alias("rural_urban"),
        )
    )


def order_year_label(year) -> "F.Column":
    return F.concat(
        year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0")
    )


def spread(spark: SparkSession, rows: int, a_task: int) -> int:
    """Tasks that so many rows are dealt to: none gets more to hold when the tables grow."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // a_task))


def deal_finely(spark: SparkSession, rows: int) -> None:
    """Let exchanges start with so many partitions that none holds more when the tables grow.

    Adaptive execution merges small ones to the advisory size again. The number
    is only ever raised, so frames of another folder built before keep theirs.
    """
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    known = int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if spread(spark, rows, ROWS_A_TASK) > known:
        spark.conf.set(name, str(spread(spark, rows, ROWS_A_TASK)))


def priorities(orders: DataFrame) -> "F.Column":
    """The few priority labels in order, as a scalar.

    They are coded by sort order: a minimum of numbers stays in the hash
    aggregation, a minimum of strings would sort every line.
    """
    return orders.agg(F.sort_array(F.collect_set("o_orderpriority"))).scalar()


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their orders, at the customer's task; those of a customer with many orders once a kind, by item."""
    all_orders, all_lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parts = spread(spark, all_lines.count(), LINES_A_TASK)
    # one row per HEAVY_ORDERS orders at most
    heavy = all_orders.groupBy("o_custkey").count().where(F.col("count") > HEAVY_ORDERS)
    orders = all_orders.select(
        "o_orderkey",
        "o_custkey",
        F.year("o_orderdate").alias("y"),
        F.array_position(priorities(all_orders), F.col("o_orderpriority")).cast("int").alias("priority"),
    )
    is_new, is_done = F.col("l_returnflag") == "N", F.col("l_linestatus") == "F"
    repairs = F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
    lines = all_lines.select(
        "l_orderkey",
        "l_suppkey",
        "l_partkey",
        "l_quantity",
        F.coalesce(is_new.cast("int"), F.lit(0)).cast("byte").alias("is_new"),
        F.coalesce(is_done.cast("int"), F.lit(0)).cast("byte").alias("is_done"),
        repairs.cast("byte").alias("repairs"),
    )

    def share(supplier: bool, part: bool, number):
        return F.struct(F.lit(supplier).alias("supplier"), F.lit(part).alias("part"), number.alias("share"))

    def by_item(key: str):
        return F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("int")

    both = F.array(share(True, True, F.lit(0)))
    apart = F.array(share(True, False, by_item("l_suppkey")), share(False, True, by_item("l_partkey")))
    return (
        orders.repartition(parts, "o_orderkey")
        .join(lines.repartition(parts, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .drop("o_orderkey", "l_orderkey")
        .join(F.broadcast(heavy.select(F.col("o_custkey").alias("_heavy"))), F.col("o_custkey") == F.col("_heavy"), "left")
        .select("*", F.inline(F.when(F.col("_heavy").isNotNull(), apart).otherwise(both)))
        .drop("_heavy")
        .repartition(parts, "o_custkey", "share")
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """School-year measures from orders and their lines.

    Lines meet their orders by order, and then go to their customer once, where
    both aggregations run: first per (school, year, kind, item), which makes the
    counts distinct, then per (school, year). A customer with many orders is
    dealt out by item, so it fills no task; the last aggregation sees one row
    per year and share of a customer.
    """
    lines = dealt(spark, sf_dir)

    def item(kind: str, key: str, flag, quantity, score):
        return F.struct(
            F.lit(kind).alias("kind"),
            F.col(key).alias("item"),
            flag.alias("flag"),
            quantity.alias("quantity"),
            score.cast("int").alias("score"),
        )

    items = F.array(
        item("s", "l_suppkey", F.col("is_new"), F.col("l_quantity"), F.col("repairs")),
        item("p", "l_partkey", F.col("is_done"), F.lit(0.0), F.lit(0)),
    )
    # Part items only serve the count of finished parts, so the others end here.
    wanted = ((F.col("kind") == "s") & F.col("supplier")) | ((F.col("kind") == "p") & F.col("part") & (F.col("flag") == 1))
    key = ["o_custkey", "share", "y"]
    per_item = (
        lines.select(*key, "priority", "supplier", "part", F.inline(items))
        .where(wanted)
        .groupBy(*key, "kind", "item")
        .agg(
            F.max("flag").alias("flag"),
            F.sum("quantity").alias("quantity"),
            F.sum("score").alias("score"),
            F.min("priority").alias("priority"),
        )
    )
    supplier, part, flagged = F.col("kind") == "s", F.col("kind") == "p", F.col("flag") == 1

    def distinct(cond):
        return F.count(F.when(cond, 1))

    tasks = spread(spark, table(spark, sf_dir, "lineitem").count(), 4 * LINES_A_TASK)
    per_share = (
        per_item.groupBy(*key)
        .agg(
            F.sum("quantity").alias("quantity"),
            distinct(supplier).alias("suppliers"),
            distinct(supplier & flagged).alias("new_suppliers"),
            distinct(part & flagged).alias("done_parts"),
            F.sum("score").alias("score"),
            F.min("priority").alias("priority"),
        )
        .withColumn("school_id", F.col("o_custkey").cast("string"))
        .repartition(tasks, "school_id")
    )
    return (
        per_share.groupBy("school_id", "o_custkey", "y")
        .agg(
            F.sum("quantity").cast("int").alias("total_enrolment"),
            F.sum("suppliers").cast("int").alias("total_class_rooms"),
            F.nullif(F.sum("new_suppliers"), F.lit(0)).cast("int").alias("usable_class_rooms"),
            F.nullif(F.sum("done_parts"), F.lit(0)).cast("int").alias("total_teachers"),
            F.sum("score").cast("int").alias("classroom_condition_score"),
            F.element_at(priorities(table(spark, sf_dir, "orders")), F.min("priority")).alias("building_condition"),
        )
        .select(
            "school_id",
            order_year_label(F.col("y")).alias("academic_year"),
            "total_enrolment",
            "total_class_rooms",
            "usable_class_rooms",
            "total_teachers",
            "classroom_condition_score",
            "building_condition",
            (F.col("o_custkey") % 2 + 1).cast("int").alias("drinking_water_flag"),
            ((F.col("o_custkey") + F.col("y")) % 3).cast("int").alias("internet_flag"),
        )
    )


def build_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel with the school attributes and the facility codes as surveyed."""
    return panel(spark, sf_dir).join(schools(spark, sf_dir), "school_id")


def decoded(base: DataFrame) -> DataFrame:
    """Wide facts: facility codes as booleans."""
    return base.withColumns(
        {
            "drinking_water_available": flag_to_bool("drinking_water_flag"),
            "internet_available": flag_to_bool("internet_flag"),
        }
    ).drop("drinking_water_flag", "internet_flag")


def build_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide facts the operators start from, straight from the given tables."""
    return decoded(build_base(spark, sf_dir))


def published(
    spark: SparkSession, sf_dir: str, name: str, build, partition_by=None, cluster_by=None, as_dealt=False
) -> DataFrame:
    """A table derived once per session and input folder, written to the shared folder and read from there.

    A session sees a folder as it stood when a table was first derived from it;
    `forget` makes it look again.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _PUBLISHED:
        _PUBLISHED[key] = publish(build(), new_path(spark, name), partition_by, cluster_by, as_dealt=as_dealt)
    return _PUBLISHED[key]


def forget(sf_dir: str) -> None:
    """Derive the tables of this folder anew from now on."""
    for kept in (_PUBLISHED, _KEYED):
        for key in [k for k in kept if k[1] == sf_dir]:
            del kept[key]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, "base")
    known = key in _PUBLISHED
    rows = published(spark, sf_dir, "base", lambda: build_base(spark, sf_dir), ["academic_year"], as_dealt=True)
    if not known:
        deal_finely(spark, rows.count())
    return rows


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide facts from the published base."""
    return decoded(base(spark, sf_dir))


def keyed(spark: SparkSession, sf_dir: str) -> bool:
    """Whether school and year are a key of the facts; looked at once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEYED:
        _KEYED[key] = is_key(facts(spark, sf_dir), ["school_id", "academic_year"])
    return _KEYED[key]


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from the event table; some fall outside the allowed range or name an unknown school-year."""
    year = (F.lit(1995) + F.col("event_id") % 7).cast("int")
    number = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("submission_id"),
        F.col("user_id").cast("string").alias("school_id"),
        order_year_label(year).alias("academic_year"),
        F.when(F.col("event_type") == "error", F.floor("value") * 5)
        .otherwise(F.floor(F.col("value") / 5))
        .cast("int")
        .alias("classrooms_requested"),
        F.floor(number / 12).cast("int").alias("teachers_requested"),
        F.lit(None).cast("string").alias("justification"),
        F.when(F.col("event_type") == "view", "Head Teacher").alias("submitted_by"),
        F.col("ts").alias("submitted_at"),
    )


def raw_files(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The six raw file kinds with untidy headers, all years, as text would hold them."""
    rows = base(spark, sf_dir)
    key = F.col("school_id").alias("Psuedocode")
    year = F.col("academic_year").alias("year")
    start = F.substring("academic_year", 1, 4).cast("int")
    lines = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            order_year_label(F.year("o_orderdate")).alias("year"),
            F.col("o_custkey").cast("string").alias("Psuedocode"),
            "l_returnflag",
            "l_linestatus",
            "l_linenumber",
            "l_quantity",
        )
    )

    def wide(group: str, prefix: str) -> DataFrame:
        cells = {}
        for n in range(1, 8):
            for tail, status in (("B", "O"), ("G", "F")):
                cond = (F.col("l_linenumber") == n) & (F.col("l_linestatus") == status)
                cells[f"{prefix}{n}_{tail}"] = F.sum(F.when(cond, F.col("l_quantity"))).cast("int")
        return lines.groupBy("year", "Psuedocode", F.col("l_returnflag").alias(group)).agg(
            *[c.alias(name) for name, c in cells.items()]
        )

    return {
        "profile_1": rows.select(
            year,
            key,
            F.col("district").alias("District"),
            F.col("block").alias(" Block"),
            F.col("rural_urban").alias("Rural/Urban"),
        ),
        "profile_2": rows.select(
            year,
            key,
            F.col("management_type").alias("Managment"),
            F.col("school_category").alias("School Category"),
            F.col("rural_urban").alias("Location-Code"),
            F.lit(None).cast("string").alias("Remarks"),
        ),
        "facility": rows.select(
            year,
            key,
            F.col("total_class_rooms").alias("Total Class Rooms"),
            F.col("usable_class_rooms").alias("Classrooms In Good Condition"),
            F.floor(F.col("classroom_condition_score") / 2).cast("int").alias("Classrooms Needs Major Repair"),
            (F.col("classroom_condition_score") % 2).alias("Classrooms Needs Minor Repair"),
            F.col("building_condition").alias("Building Status"),
            F.col("drinking_water_flag").alias("Drinking-Water-Available"),
            F.col("internet_flag").alias("Internet"),
            F.nullif(F.col("internet_flag"), F.lit(0)).alias("Func Boys CWSN Friendly"),
            F.lit(None).cast("int").alias("Func Girls CWSN Friendly"),
        ),
        "teacher": rows.select(
            year,
            key,
            F.when(start < 1998, F.col("total_teachers")).alias("Total Teacher"),
            F.when(start >= 1998, F.col("total_teachers")).alias("Total Tch"),
        ),
        "enrolment_1": wide("Item Group", "C"),
        "enrolment_2": wide("Item Id", "Age "),
    }
