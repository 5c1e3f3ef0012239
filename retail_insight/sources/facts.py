"""Purchases made from the order tables: the inputs of the registered queries.

``facts`` is a typed purchase table, ``raw_orders`` and ``raw_purchases`` are
messy text exports of the same orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_insight.sources.partitions import sized


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _purchases(rows: int, line: DataFrame, order: DataFrame, customer: DataFrame, part: DataFrame) -> DataFrame:
    """Order lines, ``rows`` of them, with their order, customer and part.

    Customers are joined to the orders first, so the lines, by far the most
    rows, are never shuffled by customer. That also leaves a shuffle between
    this join and a grouping by customer, without which Spark could not split
    the reducer of a hot customer (adaptive skew join). Parts are joined to the
    lines before their orders, while the lines are narrow, and that join is left
    to Spark, which splits hot parts. The join with the orders, of which none has
    many lines, has tasks by the number of lines.
    """
    orders = sized(order.join(customer, order.o_custkey == customer.c_custkey), rows, "o_orderkey")
    return line.join(part, line.l_partkey == part.p_partkey).join(
        orders, line.l_orderkey == order.o_orderkey
    )


SOURCES = ("lineitem", "orders", "customer", "part")


def _lines(spark: SparkSession, sf_dir: str) -> int:
    """Number of order lines, now; only the footers of the files are read."""
    return table(spark, sf_dir, "lineitem").count()


def _money(name: str):
    return F.col(name).cast("decimal(18,2)")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line in canonical purchase columns."""
    third, quarter = F.col("c_custkey") % 3, F.col("c_custkey") % 4
    return _purchases(_lines(spark, sf_dir), *[table(spark, sf_dir, name) for name in SOURCES]).select(
        F.col("o_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        (F.col("c_custkey") % 110).cast("int").alias("customer_age"),
        F.col("c_mktsegment").alias("gender"),
        F.col("o_orderdate").alias("purchase_ts"),
        F.to_date("o_orderdate").alias("purchase_date"),
        F.col("p_type").alias("product_category"),
        F.col("p_brand").alias("brand"),
        _money("p_retailprice").alias("product_price"),
        F.col("l_quantity").cast("int").alias("quantity"),
        _money("l_extendedprice").alias("total_amount"),
        F.col("o_orderpriority").alias("payment_method"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returns"),
        F.when(third == 0, 0).when(third == 1, 1).alias("churn"),
        F.when(quarter == 0, 1).alias("churn_sparse"),
    )


# The order time and its text in many layouts, as SQL expressions.
ORDER_TIME = "o_orderdate + make_dt_interval(0, 0, CAST(o_orderkey % 1440 AS INT), 0)"
DATE_TEXT = """
    CASE o_orderkey % 7
      WHEN 0 THEN date_format(t, 'M/d/yyyy H:mm')
      WHEN 1 THEN date_format(t, 'M/d/yyyy h:mm a')
      WHEN 2 THEN date_format(t, 'yyyy-MM-dd')
      WHEN 3 THEN date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
      WHEN 4 THEN concat('  ', date_format(t, 'MM/dd/yyyy   HH:mm:ss'))
      WHEN 5 THEN date_format(t, 'dd/MM/yyyy')
      ELSE CASE (o_orderkey DIV 7) % 9
        WHEN 0 THEN date_format(t, "yyyy-MM-dd'T'HH:mm:ss'.125Z'")
        WHEN 1 THEN date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+07:00'")
        WHEN 2 THEN date_format(t, 'yyyy-M-d')
        WHEN 3 THEN date_format(t, 'yyyy-MM-dd H:mm')
        WHEN 4 THEN date_format(t, 'yyyy/MM/dd HH:mm:ss')
        WHEN 5 THEN date_format(t, "M/d/'20' H:mm")
        WHEN 6 THEN date_format(t, "M/d/yyyy H:mm 'or so'")
        WHEN 7 THEN date_format(t, 'yyyy/M/d')
        ELSE 'not a date' END END
"""


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with date and amount as messy text."""
    return (
        table(spark, sf_dir, "orders")
        .withColumn("t", F.expr(ORDER_TIME))
        .select(
            "o_orderkey",
            "o_custkey",
            F.expr(DATE_TEXT).alias("purchase_date_raw"),
            F.expr(
                """
                CASE o_orderkey % 4
                  WHEN 0 THEN concat('$', format_number(o_totalprice, 2))
                  WHEN 1 THEN concat('-', CAST(CAST(o_totalprice AS INT) AS STRING))
                  WHEN 2 THEN 'n/a'
                  ELSE NULL END
                """
            ).alias("total_amount_raw"),
        )
    )


# Columns of the export by the table they are made on, as SQL that both engines
# read alike.
EXPORT_COLUMNS = {
    "orders": {
        "Customer ID": """CASE o_custkey % 5 WHEN 0 THEN concat('0', CAST(o_custkey AS STRING))
            WHEN 1 THEN concat(' ', CAST(o_custkey AS STRING)) WHEN 2 THEN CASE o_orderkey % 2
            WHEN 0 THEN concat('00', CAST(o_custkey AS STRING)) ELSE CAST(o_custkey AS STRING) END
            ELSE CAST(o_custkey AS STRING) END""",
        "Payment Method": "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_orderpriority END",
    },
    "customer": {
        "Customer Name": "c_name",
        "Customer Age": "CAST(c_custkey % 110 AS STRING)",
        "Gender": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END",
        "Churn": "CASE WHEN c_custkey % 4 = 0 THEN '1' ELSE NULL END",
    },
    "part": {
        "Product Category": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END",
        "Product Price": "concat('$', CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING))",
    },
    "lineitem": {
        "Quantity": """CASE WHEN l_linenumber % 3 = 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '.0')
            WHEN l_linenumber % 3 = 1 THEN concat(' ', CAST(CAST(l_quantity AS INT) AS STRING), ' pcs')
            ELSE CAST(CAST(l_quantity AS INT) AS STRING) END""",
        "Total Purchase Amount": """CASE WHEN l_suppkey % 9 = 0 THEN 'n/a'
            WHEN l_suppkey % 9 = 1 THEN concat('(', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING), ')')
            ELSE concat('USD ', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING)) END""",
        "Returns": """CASE WHEN l_returnflag = 'R' THEN '1' WHEN l_returnflag = 'A' THEN '0.0'
            ELSE 'maybe' END""",
    },
}


def _dealt(scan: DataFrame) -> DataFrame:
    """The rows dealt to all cores where they are few: Spark joins small tables in one task.

    A table whose scan has a task for every core is left as it is, as so few
    tasks would grow with the table.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def raw_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as an export: source headers, every value as text."""

    def made_on(name: str) -> DataFrame:
        source = table(spark, sf_dir, name)
        if name == "lineitem":
            source = _dealt(source)
        if name == "orders":
            source = source.withColumn("t", F.expr(ORDER_TIME)).withColumn("Purchase Date", F.expr(DATE_TEXT))
        return source.withColumns({c: F.expr(sql) for c, sql in EXPORT_COLUMNS[name].items()})

    columns = [c for made in EXPORT_COLUMNS.values() for c in made]
    return _purchases(_lines(spark, sf_dir), *[made_on(name) for name in SOURCES]).select(*columns, "Purchase Date")
