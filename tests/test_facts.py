"""The raw export: how its rows are dealt, and how it is written."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from retail_insight.operators.churn import derive_churn
from retail_insight.plans import queries
from retail_insight.sources import partitions
from retail_insight.sources.facts import SOURCES, facts, raw_purchases
from retail_insight.sources.tables import read_raw

TABLES = "/root/testdata/sf0.001"


@pytest.fixture
def many_files(spark, tmp_path):
    """The smallest tables, with a file of order lines for every core."""
    for name in SOURCES:
        if name != "lineitem":
            (tmp_path / f"{name}.parquet").symlink_to(f"{TABLES}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    lines = spark.read.parquet(f"{TABLES}/lineitem.parquet").repartition(cores)
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions() == cores
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_export_is_not_dealt_to_a_fixed_number_of_tasks(spark, many_files):
    export = raw_purchases(spark, many_files)
    assert "Repartition" not in plan(export)
    want = raw_purchases(spark, TABLES)
    assert export.exceptAll(want).count() == want.exceptAll(export).count() == 0


def test_few_rows_are_dealt_before_they_grow_wide(spark):
    found = plan(raw_purchases(spark, TABLES))
    assert found.count("Repartition") == 1
    assert found.index("Join") < found.index("Repartition")  # children follow their parents


@pytest.fixture
def many_rows(spark, monkeypatch):
    """Rows for more tasks than the session has shuffle partitions, and no broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    monkeypatch.setattr(partitions, "ROWS_PER_TASK", 300)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def keyed(df):
    """The columns and numbers of tasks of the exchanges by a key in the plan, before it runs."""
    found = re.findall(r"hashpartitioning\((.*), (\d+)\)", df._jdf.queryExecution().executedPlan().toString())
    return {(re.sub(r"#\d+L?", "", columns), int(tasks)) for columns, tasks in found}


def test_tasks_of_the_join_with_the_orders_grow_with_the_lines(spark, many_rows, monkeypatch):
    export = raw_purchases(spark, TABLES)
    tasks = -(-spark.read.parquet(f"{TABLES}/lineitem.parquet").count() // 300)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {("l_orderkey", tasks), ("o_orderkey", tasks)} <= keyed(export)
    assert ("p_partkey", tasks) not in keyed(export)  # Spark splits hot parts only where it deals them itself
    rows = export.collect()
    monkeypatch.undo()
    assert ("l_orderkey", tasks) not in keyed(raw_purchases(spark, TABLES))
    assert sorted(map(str, rows)) == sorted(map(str, raw_purchases(spark, TABLES).collect()))


def test_tasks_of_the_churn_join_grow_with_the_rows(spark, many_rows, monkeypatch):
    purchases = facts(spark, TABLES).withColumn("churn", F.col("churn_sparse"))
    tasks = -(-purchases.count() // 300)
    derived = derive_churn(purchases)
    assert ("customer_id, _spread", tasks) in keyed(derived)
    rows = derived.collect()
    monkeypatch.undo()
    assert sorted(map(str, rows)) == sorted(map(str, derive_churn(purchases).collect()))


def test_export_files_are_packed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "EXPORT_FILE_ROWS", 300, raising=False)
    queries._write_export(spark, TABLES, f"{tmp_path}/csv")
    files = list(Path(f"{tmp_path}/csv").glob("part-*"))
    assert files and all(f.name.endswith(".csv.gz") for f in files)
    back, want = read_raw(spark, f"{tmp_path}/csv"), raw_purchases(spark, TABLES)
    assert back.columns == want.columns
    assert back.exceptAll(want).count() == want.exceptAll(back).count() == 0
    assert back.groupBy("_metadata.file_path").count().agg({"count": "max"}).first()[0] <= 300
