"""Registered queries: each runs one or more operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retail_insight.functions import clean
from retail_insight.operators import daily_states as ds
from retail_insight.operators import overview as ov
from retail_insight.operators import products as pr
from retail_insight.operators import recommend as rec
from retail_insight.operators import segments as seg
from retail_insight.operators.churn import derive_churn
from retail_insight.operators.clustering import scale_features, silhouette
from retail_insight.operators.daily_states import refresh_daily_states
from retail_insight.operators.histogram import age_histogram, grid, histogram, rfm_distribution
from retail_insight.operators.quantiles import describe_metrics, exact_quantiles
from retail_insight.operators.rfm import rfm
from retail_insight.operators.sampling import cluster_examples, hash_sample
from retail_insight.operators.series import fill_month_gaps, monthly_revenue
from retail_insight.plans import reports
from retail_insight.plans.etl import etl, parse_quality, run_etl, typed_purchases
from retail_insight.schema import CATEGORICAL, RFM_METRICS
from retail_insight.sources.facts import facts, raw_orders, raw_purchases, table
from retail_insight.sources.tables import (
    export_segments,
    read_purchases,
    read_raw,
    write_purchases,
)
from retail_insight.sources.versions import publish, read_version, replace_days
from retail_insight.sources.workspace import cut_lineage, new_path

Query = Callable[[SparkSession, str], DataFrame]


# Customers by steps of recency, frequency and monetary value, as SQL that both engines read alike.
LABEL_GROUPS = (
    "CAST(least(floor(recency_days / 40.0), 9) * 100 + least(floor(frequency / 8.0), 9) * 10"
    " + least(floor(monetary / 400000.0), 9) AS INT)"
)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# --- inputs -----------------------------------------------------------------


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    """What the ETL makes of the export: some dates unreadable, some amounts unknown."""
    return etl(raw_purchases(spark, d))


def _dated_rfm(spark: SparkSession, d: str) -> DataFrame:
    return rfm(facts(spark, d), drop_null_ts=True)


def _fixed_customers(spark: SparkSession, d: str) -> DataFrame:
    """RFM with a given cluster, in place of a trained one."""
    return _dated_rfm(spark, d).withColumn("prediction", (F.col("customer_id") % 4).cast("int"))


def _brands(spark: SparkSession, d: str) -> DataFrame:
    """Facts with the brand as category: 25 categories instead of 6."""
    return facts(spark, d).withColumn("product_category", F.col("brand"))


def _brand_profile(spark: SparkSession, d: str) -> DataFrame:
    return pr.product_profile(_brands(spark, d))


def _fixed_brands(spark: SparkSession, d: str) -> DataFrame:
    """Brand profiles with a given cluster: last digit of the brand modulo 3.

    Like the trained clusters, they are computed once and then looked up.
    """
    digit = F.expr("CAST(right(product_category, 1) AS INT)")
    return cut_lineage(_brand_profile(spark, d).withColumn("prediction", digit % 3))


# --- sources and sinks --------------------------------------------------------


def table_summary(spark, d):
    summary = ov.table_summary(facts(spark, d))
    return summary.withColumn("columns", F.array_join("columns", ","))


# A packed CSV file is read by one task, so none gets more rows than that: some 100 MB of text.
EXPORT_FILE_ROWS = 1_000_000


def _write_export(spark, d, path):
    """The messy export as packed CSV, blanks at either end of a field kept."""
    writer = raw_purchases(spark, d).write.option("header", True).option("compression", "gzip")
    writer = writer.option("maxRecordsPerFile", EXPORT_FILE_ROWS)
    for side in ("Leading", "Trailing"):
        writer = writer.option(f"ignore{side}WhiteSpace", False)
    writer.csv(path)


def csv_parquet_round_trip(spark, d):
    """Export to CSV, run the whole ETL on the file, read the table back."""
    src, dst = new_path(spark, "export-csv"), new_path(spark, "purchases")
    _write_export(spark, d, src)
    return _etl_output(read_purchases(spark, run_etl(spark, src, dst)))


def raw_csv_scan(spark, d):
    """The CSV export as it is read: text only, blank fields null."""
    src = new_path(spark, "export-csv")
    _write_export(spark, d, src)
    raw = read_raw(spark, src)
    return raw.select(*[F.col(c).alias(c.lower().replace(" ", "_")) for c in raw.columns])


def purchases_date_range(spark, d):
    """Write the partitioned table and read one year of it back."""
    dst = new_path(spark, "purchases")
    write_purchases(facts(spark, d), dst)
    year = read_purchases(spark, dst, start="1997-01-01", end="1997-12-31")
    return year.groupBy("purchase_date").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_amount").cast("double").alias("revenue")
    )


def cached_purchases(spark, d):
    """A table of few files read through the cache, used for two figures."""
    dst = new_path(spark, "purchases")
    facts(spark, d).write.parquet(dst)
    kept = read_purchases(spark, dst, cache=True)
    newest = kept.agg(F.max("purchase_date")).scalar()
    return kept.groupBy("product_category").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("purchase_date") == newest).alias("on_last_day")
    )


def daily_figures_kept(spark, d):
    """Daily figures kept from a first load, of which a second one, of March 1997, has the changed days computed anew."""
    purchases, kept = new_path(spark, "versions"), new_path(spark, "daily-states")
    every = facts(spark, d).select("purchase_date", "quantity", "total_amount", "returns")
    publish(every, purchases)
    refresh_daily_states(spark, purchases, kept)
    march = every.where("purchase_date BETWEEN '1997-03-01' AND '1997-03-31' AND quantity > 10")
    replace_days(march.withColumn("total_amount", (F.col("total_amount") * 2).cast("decimal(18,2)")), purchases)
    refresh_daily_states(spark, purchases, kept)
    states = read_version(spark, kept)
    return ds.sales_of(states).join(ds.return_rate_of(states), "purchase_date")


# --- cleaning -------------------------------------------------------------------


def clean_money(spark, d):
    return raw_orders(spark, d).select(
        "o_orderkey",
        clean.clean_money(F.col("total_amount_raw")).alias("total_amount"),
    )


def clean_money_parentheses(spark, d):
    amount = F.col("Total Purchase Amount")
    return raw_purchases(spark, d).select(
        amount.alias("amount_raw"),
        clean.clean_money(amount).alias("amount"),
        clean.clean_money(amount, parens_negative=True).alias("amount_signed"),
    )


def clean_quantity(spark, d):
    raw = raw_purchases(spark, d)
    return raw.select(
        F.col("Quantity").alias("quantity_raw"),
        clean.clean_int(F.col("Quantity")).alias("quantity"),
    )


def clean_flags(spark, d):
    raw = raw_purchases(spark, d)
    return raw.select(
        F.col("Returns").alias("returns_raw"),
        clean.clean_flag(F.col("Returns")).alias("returns"),
        clean.clean_flag(F.col("Churn")).alias("churn"),
    )


def normalize_time_text(spark, d):
    return raw_orders(spark, d).select(
        "o_orderkey", clean.normalize_ts_text(F.col("purchase_date_raw")).alias("text")
    )


def _parsed(spark, d, mode):
    text = F.trim(clean.normalize_ts_text(F.col("purchase_date_raw"))).alias("text")
    ts = clean.parse_event_time(F.col("text"), mode=mode)
    parsed = raw_orders(spark, d).select("o_orderkey", text).select("o_orderkey", ts.alias("purchase_ts"))
    return _ntz(
        parsed.select(
            "o_orderkey",
            "purchase_ts",
            clean.event_date(F.col("purchase_ts")).alias("purchase_date"),
            clean.month_start(F.col("purchase_ts")).alias("purchase_month"),
        ),
        "purchase_ts",
    )


def parse_time_prefix(spark, d):
    return _parsed(spark, d, "prefix")


def parse_time_strict(spark, d):
    return _parsed(spark, d, "strict")


def parse_quality_raw(spark, d):
    return _rounded(parse_quality(typed_purchases(raw_purchases(spark, d))), 9, "ts_null_ratio")


def fill_unknown(spark, d):
    renamed = clean.normalize_columns(raw_purchases(spark, d))
    return clean.fill_unknown(renamed, CATEGORICAL).select("customer_id", *CATEGORICAL)


def _etl_output(df: DataFrame) -> DataFrame:
    return _ntz(df, "purchase_ts").select(
        "customer_id",
        "customer_name",
        "customer_age",
        "gender",
        "purchase_date_raw",
        "purchase_ts",
        "purchase_date",
        "product_category",
        "product_price",
        "quantity",
        "total_amount",
        "payment_method",
        "returns",
        "churn",
    )


def etl_purchases(spark, d):
    return _etl_output(etl(raw_purchases(spark, d)))


def etl_purchases_prefix(spark, d):
    """Lenient dates, with the export's own format tried first."""
    raw = raw_purchases(spark, d)
    return _etl_output(etl(raw, ts_format="M/d/yyyy H:mm", mode="prefix", parens_negative=True))


def etl_without_dates(spark, d):
    """An export without a date column: every date is null, and unknown churn becomes 0."""
    df = etl(raw_purchases(spark, d).drop("Purchase Date"))
    return df.select(
        "customer_id", "product_category", "total_amount", "churn", F.col("purchase_date").isNull().alias("undated")
    )


def etl_churn_known(spark, d):
    """An export whose churn is known for most rows: the unknown flags stay unknown."""
    known = F.col("Customer Age").cast("int") % 3
    flag = F.when(known == 0, "0").when(known == 1, "1")
    df = etl(raw_purchases(spark, d).withColumn("Churn", flag))
    return df.select("customer_id", "customer_age", "product_category", "churn")


def churn_from_recency(spark, d):
    sparse = facts(spark, d).withColumn("churn", F.col("churn_sparse"))
    return derive_churn(sparse).select("customer_id", "purchase_date", "product_category", "churn")


# --- overview and trends ----------------------------------------------------------


def kpis(spark, d):
    return ov.kpis(facts(spark, d))


def daily_sales_ma7(spark, d):
    return ov.daily_sales(facts(spark, d))


def top_categories_by_count(spark, d):
    return ov.top_categories(_brands(spark, d))


def top_categories_by_revenue(spark, d):
    return ov.top_categories(_brands(spark, d), by="revenue", n=5)


def top_categories_resorted(spark, d):
    """The ten largest categories by count, put in order of revenue."""
    top = reports.overview(_brands(spark, d))["top_categories_by_revenue"]
    place = F.row_number().over(Window.orderBy(F.desc("revenue"), "product_category"))
    return top.withColumn("place", place)


def payment_mix(spark, d):
    return ov.payment_mix(facts(spark, d))


def payment_counts(spark, d):
    return ov.payment_counts(facts(spark, d))


def daily_return_rate(spark, d):
    return ov.daily_return_rate(_cleaned(spark, d))


def churn_by_gender(spark, d):
    return ov.churn_by_gender(facts(spark, d))


def ages(spark, d):
    return _rounded(age_histogram(facts(spark, d)), 6, "center")


def monthly(spark, d):
    return monthly_revenue(_cleaned(spark, d))


def monthly_revenue_filled(spark, d):
    """Months without a purchase, between each customer's first and last one."""
    by = ["customer_id"]
    return fill_month_gaps(monthly_revenue(facts(spark, d), by), by=by)


# The parts of the overview in long form: the column that names a row, and its figures.
OVERVIEW_PARTS = {
    "summary": (None, ("row_count",)),
    "kpis": (None, ("customers", "categories", "revenue", "return_rate_pct", "churn_rate_pct")),
    "daily_sales": ("purchase_date", ("revenue", "orders", "rev_ma7")),
    "top_categories": ("product_category", ("cnt", "revenue")),
    "payment_mix": ("payment_method", ("cnt", "revenue")),
    "daily_return_rate": ("purchase_date", ("return_rate",)),
    "churn_by_gender": ("gender", ("churn_rate",)),
    "age_histogram": ("bin", ("n",)),
}


def overview_one_scan(spark, d):
    """Every part of the overview report, from one scan, a row for each figure."""
    report = reports.overview(facts(spark, d))
    rows = []
    for part, (item, figures) in OVERVIEW_PARTS.items():
        named = F.col(item) if item else F.lit(None)
        shown = F.explode(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast("double").alias("v")) for c in figures]))
        rows.append(report[part].select(F.lit(part).alias("part"), named.cast("string").alias("item"), shown.alias("f")))
    return reduce(DataFrame.unionAll, rows).select("part", "item", F.col("f.m").alias("measure"), F.col("f.v").alias("value"))


def kpis_cleaned(spark, d):
    return ov.kpis(_cleaned(spark, d))


def _outsized(spark: SparkSession, d: str) -> DataFrame:
    """Purchases of which some have an amount that no decimal holds, as a damaged export gives them."""
    damaged = clean.clean_money(F.lit("1.2676506002282294e30"))
    hit = (F.col("customer_id") % 50 == 7) & (F.dayofmonth("purchase_date") == 3)
    return facts(spark, d).withColumn("total_amount", F.when(hit, damaged).otherwise(F.col("total_amount").cast("double")))


def rfm_grid(spark, d):
    """Customers by recency and monetary value, counted in a grid that a chart can draw."""
    return _rounded(grid(_dated_rfm(spark, d), "recency_days", "monetary", 20), 6, "x_center", "y_center")


def kpis_outsized(spark, d):
    return ov.kpis(_outsized(spark, d))


def daily_sales_outsized(spark, d):
    return ov.daily_sales(_outsized(spark, d))


def rfm_outsized(spark, d):
    return rfm(_outsized(spark, d))


def daily_sales_cleaned(spark, d):
    return ov.daily_sales(_cleaned(spark, d))


def quantity_histogram(spark, d):
    return _rounded(histogram(table(spark, d, "lineitem"), "l_quantity", 40), 6, "center")


# --- RFM ----------------------------------------------------------------------------


def rfm_all(spark, d):
    return rfm(_cleaned(spark, d), drop_null_ts=False)


def rfm_dated(spark, d):
    return rfm(_cleaned(spark, d), drop_null_ts=True)


def rfm_describe(spark, d):
    stats = describe_metrics(_dated_rfm(spark, d), RFM_METRICS)
    return _rounded(stats, 4, "mean", "std", "min", "p25", "p50", "p75", "max")


def amount_quantiles(spark, d):
    wanted = [0.01, 0.5, 0.99]
    q = exact_quantiles(table(spark, d, "lineitem"), "l_extendedprice", wanted)
    return q.select(*[F.round(F.col("quantiles")[i], 4).alias(f"p{round(p * 100)}") for i, p in enumerate(wanted)])


def _rfm_histogram(metric: str) -> Query:
    def query(spark, d):
        return _rounded(rfm_distribution(_dated_rfm(spark, d), metric), 6, "center")

    return query


def rfm_scatter_sample(spark, d):
    return hash_sample(_dated_rfm(spark, d), 0.5, "customer_id")


def rfm_scatter_sample_small(spark, d):
    return hash_sample(_dated_rfm(spark, d), 0.1, "customer_id")


def rfm_training_sample(spark, d):
    return hash_sample(_dated_rfm(spark, d), 0.25, "customer_id")


# --- clusters given ---------------------------------------------------------------------


def scaled_features(spark, d):
    scaled = scale_features(_dated_rfm(spark, d), RFM_METRICS, with_mean=False)
    values = vector_to_array("features")
    return scaled.select(
        "customer_id", *[F.round(values[i], 6).alias(f"{m}_scaled") for i, m in enumerate(RFM_METRICS)]
    )


def scaled_product_features(spark, d):
    scaled = scale_features(_brand_profile(spark, d), pr.PRODUCT_METRICS, with_mean=True)
    values = vector_to_array("features")
    return scaled.select(
        "product_category",
        *[F.round(values[i], 6).alias(f"{m}_scaled") for i, m in enumerate(pr.PRODUCT_METRICS)],
    )


def silhouette_fixed(spark, d):
    scaled = scale_features(_fixed_customers(spark, d), RFM_METRICS, with_mean=False)
    return spark.createDataFrame([(round(silhouette(scaled), 6),)], "silhouette double")


def global_averages(spark, d):
    return _rounded(
        seg.global_averages(_dated_rfm(spark, d)), 4, *[f"global_{m}" for m in RFM_METRICS]
    )


def cluster_profile_fixed(spark, d):
    profile = seg.cluster_profile(_fixed_customers(spark, d))
    return _rounded(profile, 4, *[c for c in profile.columns if c.startswith(("avg", "global", "delta"))])


def cluster_labels_fixed(spark, d):
    """Customers grouped by their own metrics, named by the label rules: all seven names occur."""
    assigned = _dated_rfm(spark, d).withColumn("prediction", F.expr(LABEL_GROUPS).cast("int"))
    return seg.label_clusters(seg.cluster_profile(assigned)).select("prediction", "n_customers", "label")


def segment_detail_fixed(spark, d):
    return seg.segment_detail(_fixed_customers(spark, d))


def segment_export_fixed(spark, d):
    dst = new_path(spark, "segments")
    export_segments(_fixed_customers(spark, d), dst)
    return spark.read.parquet(dst)


def product_profile(spark, d):
    return _rounded(
        _brand_profile(spark, d), 9, "avg_price", "avg_quantity", "avg_returns_rate"
    )


def cluster_contents_fixed(spark, d):
    return pr.cluster_contents(_fixed_brands(spark, d))


def cluster_examples_fixed(spark, d):
    return cluster_examples(_fixed_brands(spark, d)).select("prediction", "product_category")


def category_names_fixed(spark, d):
    return pr.category_names(_fixed_brands(spark, d))


def cluster_ids_fixed(spark, d):
    return pr.cluster_ids(_fixed_brands(spark, d))


def _rounded_metrics(df: DataFrame) -> DataFrame:
    return _rounded(df, 9, "avg_price", "avg_quantity", "avg_returns_rate")


def recommend_item_fixed(spark, d):
    return _rounded_metrics(rec.recommend_for(_fixed_brands(spark, d), "Brand#7"))


def recommend_all_fixed(spark, d):
    return _rounded_metrics(rec.recommend_all(_fixed_brands(spark, d), 5))


def browse_cluster_fixed(spark, d):
    return _rounded_metrics(rec.browse_cluster(_fixed_brands(spark, d), 1, 5))


# --- trained clusters -------------------------------------------------------------------


def _scores(scores: DataFrame) -> DataFrame:
    return _rounded(scores, 4, "silhouette")


def customer_k_scores(spark, d):
    return _scores(seg.segment_customers(_dated_rfm(spark, d)).scores)


def customer_segments(spark, d):
    assigned = seg.segment_customers(_dated_rfm(spark, d)).assigned
    return assigned.select("customer_id", *RFM_METRICS, "prediction")


def _gap_to_nearest(assigned: DataFrame, model, key: str) -> DataFrame:
    """How much farther each row's own centre is than the nearest one: 0 for every key."""
    distances = F.array(
        *[
            F.aggregate(
                F.zip_with(
                    vector_to_array("features"), F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: (a - b) * (a - b)
                ),
                F.lit(0.0),
                lambda s, x: s + x,
            )
            for centre in model.clusterCenters()
        ]
    )
    own = F.element_at("_distances", F.col("prediction") + 1)
    return assigned.withColumn("_distances", distances).select(
        key, F.round(own - F.array_min("_distances"), 6).alias("gap")
    )


def customer_nearest_centre(spark, d):
    """Trained customer clusters against their centres."""
    found = seg.segment_customers(_dated_rfm(spark, d))
    return _gap_to_nearest(found.assigned, found.choice.model, "customer_id")


def product_nearest_centre(spark, d):
    """Trained product clusters against their centres."""
    found = pr.product_clusters(_brand_profile(spark, d))
    return _gap_to_nearest(found.assigned, found.choice.model, "product_category")


def product_nearest_centre_given_k(spark, d):
    found = pr.product_clusters(_brand_profile(spark, d), k=4)
    return _gap_to_nearest(found.assigned, found.choice.model, "product_category")


def _chosen(found, largest: int) -> DataFrame:
    """Per k tried, whether the chosen k scores at least as much; k itself is read from the table."""
    best = F.max("silhouette").over(Window.partitionBy())
    first = F.min(F.when(F.col("silhouette") == best, F.col("k"))).over(Window.partitionBy())
    scored = found.scores.withColumns({"best": best}).withColumn("first", first)
    return scored.select("k", (F.col("first") == found.choice.k).alias("chosen_is_first_best")).where(F.col("k") <= largest)


def customer_k_choice(spark, d):
    """Every k was tried, and the first of the best scores was chosen."""
    return _chosen(seg.segment_customers(_dated_rfm(spark, d)), 8)


def product_k_choice(spark, d):
    return _chosen(pr.product_clusters(_brand_profile(spark, d)), 10)


def _mean_silhouette(assigned: DataFrame) -> Column:
    """The mean silhouette from the size, sum and squared norm of each cluster: one row for each."""
    x = vector_to_array("features")
    dims = range(assigned.select(F.size(x)).first()[0])
    points = assigned.select("prediction", x.alias("x")).withColumn(
        "sq", F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    )
    clusters = points.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("x")[i]) for i in dims]).alias("sums"),
        F.sum("sq").alias("sq"),
    )
    listed = clusters.agg(F.collect_list(F.struct("prediction", "n", "sums", "sq"))).scalar()

    def reach(c: Column) -> Column:  # the sum of the squared distances from a point to the cluster
        dot = F.aggregate(F.zip_with("x", c["sums"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return c["n"] * F.col("sq") - 2 * dot + c["sq"]

    own = F.filter("clusters", lambda c: c["prediction"] == F.col("prediction"))[0]
    others = F.filter("clusters", lambda c: c["prediction"] != F.col("prediction"))
    within, beyond = reach(own) / (own["n"] - 1), F.array_min(F.transform(others, lambda c: reach(c) / c["n"]))
    value = F.when(own["n"] == 1, 0.0).otherwise((beyond - within) / F.greatest(within, beyond))
    return points.withColumn("clusters", listed).agg(F.avg(value)).scalar()


def _score_gaps(spark: SparkSession, found, largest: int) -> DataFrame:
    """How far the score of every k is from a silhouette computed anew: 0 for each."""
    bare = found.assigned.select("features")
    rows = [
        spark.range(1).select(
            F.lit(k).alias("k"),
            F.round(F.abs(_mean_silhouette(found.choice.models[k].transform(bare)) - F.lit(score)), 6).alias("gap"),
        )
        for k, score in found.choice.tried
        if k <= largest
    ]
    return reduce(DataFrame.unionAll, rows)


def customer_score_gaps(spark, d):
    """The scores of all k tried for customers against silhouettes computed anew."""
    return _score_gaps(spark, seg.segment_customers(_dated_rfm(spark, d)), 8)


def product_score_gaps(spark, d):
    """The scores of all k tried for products against silhouettes computed anew."""
    return _score_gaps(spark, pr.product_clusters(_brand_profile(spark, d)), 10)


def customer_segments_totals(spark, d):
    """Every customer is in exactly one trained cluster, whichever that is."""
    assigned = seg.segment_customers(_dated_rfm(spark, d)).assigned
    return assigned.agg(
        F.count("prediction").alias("n_assigned"),
        F.count_distinct("customer_id").alias("n_customers"),
        F.sum("frequency").alias("n_purchases"),
        F.round(F.sum("monetary"), 2).alias("revenue"),
    )


def customer_profiles(spark, d):
    assigned = seg.segment_customers(_dated_rfm(spark, d)).assigned
    return seg.label_clusters(seg.cluster_profile(assigned))


def segment_detail(spark, d):
    return seg.segment_detail(seg.segment_customers(_dated_rfm(spark, d)).assigned)


def segment_scatter(spark, d):
    return seg.scatter(seg.segment_customers(_dated_rfm(spark, d)).assigned)


def segment_export(spark, d):
    dst = new_path(spark, "segments")
    export_segments(seg.segment_customers(_dated_rfm(spark, d)).assigned, dst)
    return spark.read.parquet(dst)


def product_k_scores(spark, d):
    return _scores(pr.product_clusters(_brand_profile(spark, d)).scores)


def product_clusters(spark, d):
    assigned = pr.product_clusters(_brand_profile(spark, d)).assigned
    return assigned.select("product_category", *pr.PRODUCT_METRICS, "prediction")


def product_clusters_totals(spark, d):
    """Every category is in exactly one trained cluster and keeps its profile."""
    contents = pr.cluster_contents(pr.product_clusters(_brand_profile(spark, d)).assigned)
    return contents.agg(
        F.count(F.lit(1)).alias("n_listed"),
        F.count_distinct("product_category").alias("n_categories"),
        F.min("product_category").alias("first_category"),
        F.max("product_category").alias("last_category"),
    )


def product_clusters_given_k(spark, d):
    assigned = pr.product_clusters(_brand_profile(spark, d), k=4).assigned
    return assigned.select("product_category", *pr.PRODUCT_METRICS, "prediction")


def product_pca(spark, d):
    projection = pr.product_pca(pr.product_clusters(_brand_profile(spark, d), k=3).assigned)
    return projection.points.select("product_category", "prediction", "x", "y")


def product_projection(spark, d):
    """Where the projection puts every category."""
    projection = pr.product_pca(scale_features(_brand_profile(spark, d), pr.PRODUCT_METRICS, with_mean=True))
    return _rounded(projection.points.select("product_category", "x", "y"), 5, "x", "y")


def product_explained_variance(spark, d):
    """The share of the variance that each axis of the projection explains."""
    projection = pr.product_pca(scale_features(_brand_profile(spark, d), pr.PRODUCT_METRICS, with_mean=True))
    return _rounded(projection.shares, 6, "share")


QUERIES: dict[str, Query] = {
    "table_summary": table_summary,
    "daily_sales_ma7": daily_sales_ma7,
    "kpis": kpis,
    "top_categories_by_count": top_categories_by_count,
    "top_categories_by_revenue": top_categories_by_revenue,
    "payment_mix": payment_mix,
    "payment_counts": payment_counts,
    "daily_return_rate": daily_return_rate,
    "churn_by_gender": churn_by_gender,
    "age_histogram": ages,
    "quantity_histogram": quantity_histogram,
    "monthly_revenue": monthly,
    "monthly_revenue_filled": monthly_revenue_filled,
    "clean_money": clean_money,
    "clean_money_parentheses": clean_money_parentheses,
    "clean_quantity": clean_quantity,
    "clean_flags": clean_flags,
    "normalize_time_text": normalize_time_text,
    "parse_time_prefix": parse_time_prefix,
    "parse_time_strict": parse_time_strict,
    "parse_quality": parse_quality_raw,
    "fill_unknown": fill_unknown,
    "etl_purchases": etl_purchases,
    "etl_purchases_prefix": etl_purchases_prefix,
    "raw_csv_scan": raw_csv_scan,
    "csv_parquet_round_trip": csv_parquet_round_trip,
    "purchases_date_range": purchases_date_range,
    "daily_figures_kept": daily_figures_kept,
    "derive_churn": churn_from_recency,
    "rfm_all": rfm_all,
    "rfm_dated": rfm_dated,
    "rfm_describe": rfm_describe,
    "amount_quantiles": amount_quantiles,
    "rfm_histogram_recency": _rfm_histogram("recency_days"),
    "rfm_histogram_frequency": _rfm_histogram("frequency"),
    "rfm_histogram_monetary": _rfm_histogram("monetary"),
    "rfm_scatter_sample": rfm_scatter_sample,
    "rfm_scatter_sample_small": rfm_scatter_sample_small,
    "rfm_training_sample": rfm_training_sample,
    "product_profile": product_profile,
    "scaled_features": scaled_features,
    "scaled_product_features": scaled_product_features,
    "silhouette_fixed": silhouette_fixed,
    "global_averages": global_averages,
    "cluster_profile_fixed": cluster_profile_fixed,
    "cluster_labels_fixed": cluster_labels_fixed,
    "segment_detail_fixed": segment_detail_fixed,
    "segment_export_fixed": segment_export_fixed,
    "cluster_contents_fixed": cluster_contents_fixed,
    "cluster_examples_fixed": cluster_examples_fixed,
    "category_names_fixed": category_names_fixed,
    "cluster_ids_fixed": cluster_ids_fixed,
    "recommend_item_fixed": recommend_item_fixed,
    "recommend_all_fixed": recommend_all_fixed,
    "browse_cluster_fixed": browse_cluster_fixed,
    "customer_k_scores": customer_k_scores,
    "customer_segments": customer_segments,
    "customer_segments_totals": customer_segments_totals,
    "customer_nearest_centre": customer_nearest_centre,
    "customer_k_choice": customer_k_choice,
    "product_nearest_centre": product_nearest_centre,
    "product_nearest_centre_given_k": product_nearest_centre_given_k,
    "product_k_choice": product_k_choice,
    "overview_one_scan": overview_one_scan,
    "rfm_grid": rfm_grid,
    "kpis_outsized": kpis_outsized,
    "daily_sales_outsized": daily_sales_outsized,
    "rfm_outsized": rfm_outsized,
    "kpis_cleaned": kpis_cleaned,
    "daily_sales_cleaned": daily_sales_cleaned,
    "customer_profiles": customer_profiles,
    "segment_detail": segment_detail,
    "segment_scatter": segment_scatter,
    "segment_export": segment_export,
    "product_k_scores": product_k_scores,
    "product_clusters": product_clusters,
    "product_clusters_totals": product_clusters_totals,
    "product_clusters_given_k": product_clusters_given_k,
    "product_pca": product_pca,
    "product_projection": product_projection,
    "product_explained_variance": product_explained_variance,
    "customer_score_gaps": customer_score_gaps,
    "product_score_gaps": product_score_gaps,
    "etl_without_dates": etl_without_dates,
    "etl_churn_known": etl_churn_known,
    "cached_purchases": cached_purchases,
    "top_categories_resorted": top_categories_resorted,
}
