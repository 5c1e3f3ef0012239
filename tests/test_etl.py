"""Churn derivation, the whole ETL, and reading and writing tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from retail_insight.operators import churn
from retail_insight.operators.churn import derive_churn
from retail_insight.plans.etl import etl, run_etl, typed_purchases
from retail_insight.sources.tables import (
    dataset_ready,
    default_export_path,
    export_segments,
    read_purchases,
    read_raw,
    write_purchases,
)


def purchases(spark, rows, churn=True):
    df = spark.createDataFrame(rows, "id int, customer_id string, ts string, churn int")
    df = df.withColumn("purchase_ts", F.col("ts").cast("timestamp")).drop("ts")
    return df if churn else df.drop("churn")


def churned(df):
    return {r.id: r.churn for r in df.collect()}


ROWS = [
    (1, "new", "2020-12-31 10:00", None),
    (2, "old", "2020-01-01 10:00", None),
    (3, "old", "2020-07-04 09:00", None),  # 180 days before the newest purchase
    (4, "older", "2020-07-03 23:59", None),
    (5, "given", "2019-01-01 10:00", 0),
    (6, None, "2019-01-01 10:00", None),
    (7, "undated", None, None),
    (8, None, None, 1),
]


def test_churn_by_recency(spark):
    found = churned(derive_churn(purchases(spark, ROWS)))
    assert found == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: None, 7: None, 8: 1}
    assert churned(derive_churn(purchases(spark, ROWS), cutoff_days=179))[2] == 1


def test_absent_churn_counts_as_null(spark):
    found = churned(derive_churn(purchases(spark, ROWS, churn=False)))
    assert found == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: None, 7: None, 8: None}


def test_churn_without_any_date_is_zero(spark):
    undated = [(i, c, None, f) for i, c, _, f in ROWS]
    assert churned(derive_churn(purchases(spark, undated))) == {
        1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 1,
    }


def test_churn_with_hot_and_missing_customers(spark, monkeypatch):
    """Customer 0 holds a third of the rows, missing ids another third."""
    monkeypatch.setattr(churn, "HOT_ROWS", 1000)
    df = spark.range(0, 60_000, 1, 16).select(
        "id",
        F.when(F.col("id") % 3 == 0, 0)
        .when(F.col("id") % 3 == 1, F.col("id") % 5000 + 1)
        .alias("customer_id"),
        F.expr("timestamp'2020-01-01' + make_dt_interval(CAST(id % 400 AS INT))").alias("purchase_ts"),
    )
    keys = derive_churn(df)
    wanted = (
        df.groupBy("customer_id").agg(F.max("purchase_ts").alias("last"))
        .withColumn("wanted", (F.datediff(F.lit("2021-02-03").cast("date"), "last") > 180).cast("int"))
        .where("customer_id IS NOT NULL")
    )
    joined = keys.join(wanted, "customer_id", "left")
    assert keys.count() == 60_000
    assert joined.where("NOT (churn <=> wanted)").count() == 0
    shuffle_only = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in shuffle_only.items():
        spark.conf.set(key, value)
    try:
        shuffled = derive_churn(df)
        sizes = [r["count"] for r in shuffled.groupBy(F.spark_partition_id()).count().collect()]
        # Hashing by customer alone would put a third of the rows in one place.
        assert sum(sizes) == 60_000 and max(sizes) < 18_000
        assert shuffled.exceptAll(keys).count() == 0
    finally:
        for key in shuffle_only:
            spark.conf.unset(key)


EXPORT = [
    ("1", "Ann", "34", None, "9/8/2020 9:38 PM", "Toys", "$10.00", "3.0", "$30.00", "Card", "1", None, "x"),
    ("2", "Bob", "abc", "M", "2020-09-08T14:30:00Z", None, "1e2", "2", "(200)", None, "0.0", "1", "y"),
    ("2", "Bob", "51", "M", "not a date", "Books", "n/a", "x", None, "Cash", "maybe", None, None),
]
HEADERS = [
    "Customer ID", "Customer Name", "Customer Age", "Gender", "Purchase Date", "Product Category",
    "Product Price", "Quantity", "Total Purchase Amount", "Payment Method", "Returns", "Churn", "Note",
]


@pytest.fixture(scope="module")
def export(spark):
    return spark.createDataFrame(EXPORT, ", ".join(f"`{h}` string" for h in HEADERS))


def test_etl_types_and_values(export):
    df = etl(export)
    assert dict(df.dtypes) == {
        "customer_id": "bigint", "customer_name": "string", "customer_age": "double", "gender": "string",
        "purchase_date_raw": "string", "product_category": "string", "product_price": "double",
        "quantity": "int", "total_amount": "double", "payment_method": "string", "returns": "int",
        "churn": "int", "Note": "string", "purchase_ts": "timestamp", "purchase_date": "date",
    }
    found = [r.asDict() for r in df.orderBy("customer_id", "customer_age").collect()]
    assert found[0] == {
        "customer_id": 1, "customer_name": "Ann", "customer_age": 34.0, "gender": "unknown",
        "purchase_date_raw": "9/8/2020 9:38 PM", "product_category": "Toys", "product_price": 10.0,
        "quantity": 3, "total_amount": 30.0, "payment_method": "Card", "returns": 1, "churn": 0,
        "Note": "x", "purchase_ts": dt.datetime(2020, 9, 8, 21, 38), "purchase_date": dt.date(2020, 9, 8),
    }
    assert [found[2][c] for c in ("purchase_ts", "customer_age", "quantity", "churn")] == [None, 51.0, None, 0]
    bob = found[1]
    assert bob["product_category"] == bob["payment_method"] == "unknown"
    assert (bob["product_price"], bob["total_amount"], bob["churn"]) == (100.0, 200.0, 1)


def test_churn_is_left_alone_when_mostly_known(export):
    known = export.withColumn("Churn", F.when(F.col("Customer Name") == "Bob", "1"))
    found = {r.customer_id: r.churn for r in etl(known).collect()}
    assert found == {1: None, 2: 1}


def test_churn_is_derived_at_more_than_half_unknown(spark):
    base = spark.createDataFrame([("1", "1/1/2020", "1"), ("2", "1/1/2020", None)], "`Customer ID` string, `Purchase Date` string, Churn string")
    assert sorted((r.customer_id, r.churn) for r in etl(base).collect()) == [(1, 1), (2, None)]
    more = base.union(spark.createDataFrame([("3", "1/2/2020", None)], base.schema))
    assert sorted((r.customer_id, r.churn) for r in etl(more).collect()) == [(1, 1), (2, 0), (3, 0)]


def test_customer_id_stays_text_unless_all_are_whole(export):
    mixed = export.withColumn("Customer ID", F.concat(F.lit("C"), "Customer ID"))
    assert dict(etl(mixed).dtypes)["customer_id"] == "string"


def test_etl_without_dates(spark, export):
    with pytest.warns(UserWarning, match="no purchase date"):
        df = etl(export.drop("Purchase Date"))
    assert dict(df.dtypes)["purchase_ts"] == "timestamp"
    assert {(r.purchase_ts, r.purchase_date, r.churn) for r in df.collect()} == {(None, None, 0), (None, None, 1)}


def test_etl_without_churn_column(export):
    assert {r.churn for r in etl(export.drop("Churn")).collect()} == {0}


def test_customers_are_needed_only_to_derive_churn(export):
    nameless = export.drop("Customer ID")
    known = nameless.withColumn("Churn", F.lit("1"))
    assert {r.churn for r in etl(known).collect()} == {1}
    with pytest.raises(ValueError, match="customer_id"):
        etl(nameless.drop("Churn"))


def test_ids_are_typed_before_they_are_grouped(spark):
    rows = [("7", "1/1/2020"), ("07", "12/31/2020"), (" 7", "6/1/2019"), ("8", "1/1/2020")]
    raw = spark.createDataFrame(rows, "`Customer ID` string, `Purchase Date` string")
    found = {(r.customer_id, r.churn) for r in etl(raw).collect()}
    assert found == {(7, 0), (8, 1)}


def test_export_is_read_once(spark, export, folder):
    export.write.option("header", True).csv(f"{folder}/csv")
    df = etl(read_raw(spark, f"{folder}/csv"))
    assert "FileScan csv" not in df._jdf.queryExecution().executedPlan().toString()


def test_etl_of_nothing(export):
    df = etl(export.limit(0))
    assert df.count() == 0 and "churn" in df.columns


def test_etl_of_its_own_output(export):
    once = etl(export)
    again = etl(once.drop("purchase_ts", "purchase_date"))
    # The second run trims the blank that a trailing Z has left in the text.
    columns = [F.trim(c).alias(c) if c == "purchase_date_raw" else c for c in sorted(once.columns)]
    assert once.select(columns).exceptAll(again.select(columns)).count() == 0
    assert dict(once.dtypes) == dict(again.dtypes)


def test_typed_rows_keep_absent_columns_absent(spark):
    df = typed_purchases(spark.createDataFrame([("4",)], "Quantity string"))
    assert df.columns == ["quantity", "purchase_ts", "purchase_date"]


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_csv_to_table_and_back(spark, export, folder):
    export.write.option("header", True).csv(f"{folder}/csv")
    assert set(dict(read_raw(spark, f"{folder}/csv").dtypes).values()) == {"string"}
    assert run_etl(spark, f"{folder}/csv", f"{folder}/out") == f"{folder}/out"
    back = read_purchases(spark, f"{folder}/out")
    direct = etl(export)
    assert back.select(direct.columns).exceptAll(direct).count() == 0
    assert back.count() == 3


def test_table_without_any_date_reads_back_typed(spark, export, folder):
    with pytest.warns(UserWarning):
        write_purchases(etl(export.drop("Purchase Date")), f"{folder}/out")
    back = read_purchases(spark, f"{folder}/out")
    assert dict(back.dtypes)["purchase_date"] == "date" and back.count() == 3


def test_date_range_opens_only_its_days(spark, folder):
    df = spark.range(100).select("id", F.expr("date_add(DATE'2020-01-01', CAST(id AS INT))").alias("purchase_date"))
    write_purchases(df, f"{folder}/out")
    some = read_purchases(spark, f"{folder}/out", "2020-01-10", "2020-01-12")
    assert sorted(r.id for r in some.collect()) == [9, 10, 11]
    scan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(purchase_date" in scan
    with pytest.raises(ValueError):
        write_purchases(df.select("id"), f"{folder}/plain")
        read_purchases(spark, f"{folder}/plain", start="2020-01-01")


def test_a_day_with_most_rows_is_written_by_several_tasks(spark, folder):
    df = spark.range(0, 200_000, 1, 8).select(
        "id",
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
        F.when(F.col("id") % 10 == 0, F.expr("date_add(DATE'2020-01-01', CAST(id % 50 AS INT))"))
        .otherwise(F.lit("2020-06-01").cast("date"))
        .alias("purchase_date"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        write_purchases(df, f"{folder}/out")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = read_purchases(spark, f"{folder}/out")
    files = back.select("purchase_date", F.input_file_name()).distinct().groupBy("purchase_date").count()
    per_day = {str(r.purchase_date): r["count"] for r in files.collect()}
    assert back.count() == 200_000
    assert per_day.pop("2020-06-01") > 4
    # A small day is split only when it shares its reducer with the large one.
    assert sum(n == 1 for n in per_day.values()) >= len(per_day) - 1


def test_cached_table_sees_a_new_write(spark, folder):
    path = f"{folder}/out"
    write_purchases(spark.range(3), path)
    cached = read_purchases(spark, path, cache=True)
    assert cached.count() == 3 and cached.storageLevel.useMemory
    write_purchases(spark.range(5), path)
    again = read_purchases(spark, path, cache=True)
    assert again.count() == 5
    again.unpersist()


def test_dataset_ready(spark, folder):
    assert not dataset_ready(spark, f"{folder}/nowhere")
    write_purchases(spark.range(0), f"{folder}/empty")
    assert not dataset_ready(spark, f"{folder}/empty")
    write_purchases(spark.range(1), f"{folder}/full")
    assert dataset_ready(spark, f"{folder}/full")


def test_export_has_five_columns(spark, folder):
    df = spark.sql("SELECT 1 AS customer_id, 2 AS recency_days, 3L AS frequency, 4.0D AS monetary, 0 AS prediction, 'x' AS more")
    export_segments(df, f"{folder}/out")
    assert spark.read.parquet(f"{folder}/out").columns == ["customer_id", "recency_days", "frequency", "monetary", "prediction"]
    with pytest.raises(ValueError):
        export_segments(df.drop("prediction"), f"{folder}/out")
    assert default_export_path("/data/out/") == "/data/out_kmeans_export"
