"""Segments, product clusters and recommendations."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from retail_insight.operators.clustering import best_k, scale_features, silhouette
from retail_insight.operators.lookup import spread_lookup
from retail_insight.operators.products import (
    candidate_ks,
    category_names,
    cluster_contents,
    cluster_ids,
    product_clusters,
    product_pca,
    product_profile,
)
from retail_insight.operators.recommend import browse_cluster, recommend_all, recommend_for
from retail_insight.operators.sampling import cluster_examples
from retail_insight.operators.segments import (
    cluster_label,
    cluster_profile,
    label_clusters,
    scatter,
    segment_customers,
    segment_detail,
)
from retail_insight.schema import PRODUCT_METRICS


@pytest.fixture(scope="module")
def customers(spark):
    """Three well separated groups of customers."""
    draw = random.Random(5)
    rows = []
    for i in range(300):
        r, f, m = [(10, 40, 9000.0), (200, 5, 500.0), (700, 20, 3000.0)][i % 3]
        rows.append((i, r + draw.randint(0, 9), f + draw.randint(0, 2), m + draw.random()))
    return spark.createDataFrame(rows, "customer_id long, recency_days int, frequency long, monetary double")


@pytest.fixture(scope="module")
def segments(customers):
    return segment_customers(customers)


def test_segments_cover_every_customer_once(customers, segments):
    assert segments.assigned.count() == segments.assigned.select("customer_id").distinct().count() == 300
    assert segments.choice.k == 3
    by_group = segments.assigned.groupBy(F.col("customer_id") % 3).agg(F.count_distinct("prediction").alias("n"))
    assert [r.n for r in by_group.collect()] == [1, 1, 1]


def test_chosen_k_is_the_first_best_score(segments):
    scores = [(r.k, r.silhouette) for r in segments.scores.collect()]
    assert [k for k, _ in scores] == list(range(2, 9))
    assert segments.choice.k == best_k(scores)
    assert segments.choice.score == max(s for _, s in scores)


def test_best_k():
    assert best_k([(2, 0.5), (3, 0.7), (4, 0.7)]) == 3
    assert best_k([(2, math.nan), (3, -1.0), (4, None)]) == 3
    assert best_k([(2, math.nan), (3, math.nan)]) == 2


def test_assignment_is_the_nearest_centre(segments):
    centres = np.array(segments.choice.model.clusterCenters())
    rows = segments.assigned.select(vector_to_array("features").alias("v"), "prediction").collect()
    for r in rows:
        assert ((centres - np.array(r.v)) ** 2).sum(axis=1).argmin() == r.prediction


def test_result_does_not_depend_on_the_layout(customers, segments):
    other = segment_customers(customers.repartition(17).orderBy(F.desc("monetary")))
    assert [(r.k, round(r.silhouette, 9)) for r in other.scores.collect()] == [
        (r.k, round(r.silhouette, 9)) for r in segments.scores.collect()
    ]


def test_small_training_tasks_still_assign_everyone(customers):
    found = segment_customers(customers, ks=[2, 3], rows_per_task=40)
    assert found.assigned.count() == 300 and found.choice.k == 3


def test_customers_without_a_metric_are_left_out(spark, customers):
    extra = spark.createDataFrame([(999, None, 1, 1.0)], customers.schema)
    assert segment_customers(customers.union(extra), ks=[3]).assigned.count() == 300
    with pytest.raises(ValueError, match="no usable rows"):
        segment_customers(extra)


def test_profile_sizes_and_differences(segments):
    rows = cluster_profile(segments.assigned).collect()
    assert [r.prediction for r in rows] == [0, 1, 2] and sum(r.n_customers for r in rows) == 300
    for r in rows:
        assert r.delta_recency == pytest.approx(r.avg_recency - r.global_recency)
    mean = sum(r.avg_monetary * r.n_customers for r in rows) / 300
    assert rows[0].global_monetary == pytest.approx(mean)


def test_labels_of_all_score_combinations(spark):
    values = {"low": 80.0, "mid": 100.0, "high": 120.0}
    combos = list(itertools.product(values, repeat=3))
    df = spark.createDataFrame([(*c, *[values[s] for s in c]) for c in combos], "rs string, fs string, ms string, r double, f double, m double")
    g = F.lit(100.0)
    found = {
        (x.rs, x.fs, x.ms): x.label
        for x in df.withColumn("label", cluster_label(F.col("r"), F.col("f"), F.col("m"), g, g, g)).collect()
    }
    for (r, f, m), label in found.items():
        if (r, f, m) == ("low", "high", "high"):
            wanted = "vip"
        elif f == "low" and r in ("high", "low"):
            wanted = {"high": "at_risk", "low": "new"}[r]
        elif f == "high":
            wanted = "loyal"
        elif m == "high":
            wanted = "big_spender"
        else:
            wanted = "dormant" if r == "high" else "average"
        assert label == wanted, (r, f, m)
    assert len(set(found.values())) == 7


def test_labelled_profile(segments):
    labels = {r.label for r in label_clusters(cluster_profile(segments.assigned)).collect()}
    assert "vip" in labels and len(labels) == 3


def test_detail_and_scatter(segments):
    detail = segment_detail(segments.assigned, 5).collect()
    assert [(r.prediction, r.customer_id) for r in detail] == sorted((r.prediction, r.customer_id) for r in detail)
    points = scatter(segments.assigned)
    assert points.count() == 300 and dict(points.dtypes)["prediction"] == "string"


def test_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    found = [list(r.v) for r in scale_features(df, ["a", "b"], True).select(vector_to_array("features").alias("v")).collect()]
    assert found == [[pytest.approx(-(2**-0.5)), 0.0], [pytest.approx(2**-0.5), 0.0]]


def test_silhouette_against_all_pairs(spark):
    draw = random.Random(1)
    points = [([draw.random(), draw.random()], i % 3) for i in range(40)] + [([9.0, 9.0], 3)]
    df = spark.createDataFrame(points, "v array<double>, prediction int").withColumn("features", array_to_vector("v"))
    total = 0.0
    for i, (x, c) in enumerate(points):
        means = {}
        for d in range(4):
            others = [y for j, (y, e) in enumerate(points) if e == d and j != i]
            if others:
                means[d] = np.mean([((np.array(x) - y) ** 2).sum() for y in others])
        if c in means:
            b = min(v for d, v in means.items() if d != c)
            total += (b - means[c]) / max(means[c], b)
    assert silhouette(df) == pytest.approx(total / len(points), abs=1e-9)


@pytest.fixture(scope="module")
def profile(spark):
    rows = []
    for i in range(30):
        price, quantity, revenue, returns = [(10.0, 1.0, 1000.0, 0.1), (90.0, 5.0, 9000.0, 0.5)][i % 2]
        rows.append((f"cat{i:02d}", price + i * 0.01, quantity, revenue + i, returns + i * 0.001))
    return spark.createDataFrame(rows, "product_category string, " + ", ".join(f"{c} double" for c in PRODUCT_METRICS))


def test_product_profile(spark):
    df = spark.sql(
        """SELECT * FROM VALUES ('a', 1.0D, 2, 10.0D, 0), ('a', 3.0D, 3, NULL, 1), ('b', 5.0D, 1, NULL, 0)
        AS t(product_category, product_price, quantity, total_amount, returns)"""
    )
    assert [tuple(r) for r in product_profile(df).collect()] == [("a", 2.0, 2.5, 10.0, 0.5)]
    with pytest.raises(ValueError):
        product_profile(df.drop("returns"))


@pytest.mark.parametrize("n, ks", [(2, [2]), (3, [2]), (4, [2, 3]), (11, list(range(2, 11))), (500, list(range(2, 11)))])
def test_candidate_ks(n, ks):
    assert candidate_ks(n) == ks


def test_a_single_category_has_no_clusters(profile):
    with pytest.raises(ValueError):
        product_clusters(profile.limit(1))
    with pytest.raises(ValueError, match="no usable rows"):
        product_clusters(profile.limit(0))


def test_automatic_and_given_k(profile):
    auto = product_clusters(profile)
    assert auto.automatic and auto.choice.k == 2
    assert [r.k for r in auto.scores.collect()] == list(range(2, 11))
    given = product_clusters(profile, k=5)
    assert not given.automatic and given.assigned.select("prediction").distinct().count() == 5
    few = profile.orderBy("product_category").limit(4)
    lowered = product_clusters(few, k=9)
    assert lowered.choice.k == 3 and lowered.assigned.count() == 4


def test_equal_categories_get_no_score(spark, profile):
    same = profile.limit(3).select("product_category", *[F.lit(1.0).alias(c) for c in PRODUCT_METRICS])
    found = product_clusters(same)
    assert found.choice.score == -1.0 and found.choice.k == 2
    assert product_clusters(same, k=2).choice.score is None


def test_projection(profile):
    clusters = product_clusters(profile, k=2)
    projection = product_pca(clusters.assigned)
    first, second = projection.variance
    assert 1 >= first >= second >= 0 and first + second <= 1 + 1e-9
    points = projection.points.orderBy("product_category").collect()
    raw = np.array([[r[c] for c in PRODUCT_METRICS] for r in points])
    scaled = (raw - raw.mean(axis=0)) / raw.std(axis=0, ddof=1)
    axes = np.linalg.svd(scaled, full_matrices=False)[2][:2]
    axes = np.array([a if a[abs(a).argmax()] > 0 else -a for a in axes])
    assert np.allclose([[r.x, r.y] for r in points], scaled @ axes.T, atol=1e-6)


@pytest.fixture(scope="module")
def clustered(spark):
    draw = random.Random(11)
    rows = [
        (f"p{i:04d}", *[round(draw.uniform(1, 9), 3) for _ in range(2)], float(draw.randint(1, 400)), draw.random(), 0 if i % 3 else i % 2 + 1)
        for i in range(600)
    ]
    return spark.createDataFrame(rows, "product_category string, " + ", ".join(f"{c} double" for c in PRODUCT_METRICS) + ", prediction int")


def test_contents_have_a_row_per_category(clustered):
    found = [(r.prediction, r.product_category) for r in cluster_contents(clustered).collect()]
    assert len(found) == 600 and found == sorted(found)
    sizes = {r.prediction: r.num_products for r in cluster_contents(clustered).collect()}
    assert sizes == {0: 400, 1: 100, 2: 100}


def test_recommend_all_equals_one_at_a_time(clustered):
    many = {}
    for r in recommend_all(clustered, 4).collect():
        many.setdefault(r.item, []).append((r.rank, r.product_category, r.total_revenue))
    assert len(many) == 600 and all(len(v) == 4 for v in many.values())
    best = [r.product_category for r in browse_cluster(clustered, 0, 3).collect()]
    for item in [*best, "p0000", "p0003", "p0599"]:
        one = [(i + 1, r.product_category, r.total_revenue) for i, r in enumerate(recommend_for(clustered, item, 4).collect())]
        assert sorted(many[item]) == one and item not in [c for _, c, _ in one]


def test_ranking_is_cut_before_the_shuffle(clustered):
    plan = recommend_all(clustered, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and ", Partial" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_lookup_splits_a_hot_cluster_over_reducers(spark):
    items = spark.range(40_000).select(
        "id", F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 7).alias("prediction")
    )
    sizes = items.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    shuffle_only = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in shuffle_only.items():
        spark.conf.set(key, value)
    try:
        joined = spread_lookup(items, sizes, "prediction", "id")
        per_reducer = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key in shuffle_only:
            spark.conf.unset(key)
    assert sum(per_reducer) == 40_000 and max(per_reducer) < 10_000
    assert joined.where("prediction = 0").select("n").distinct().collect()[0].n > 36_000


def test_lonely_and_unknown_items(clustered):
    lonely = clustered.where("product_category = 'p0001'")
    assert recommend_all(lonely).collect() == [] and recommend_for(lonely, "p0001").collect() == []
    with pytest.raises(ValueError, match="unknown category"):
        recommend_for(clustered, "nothing")


def test_browse(clustered):
    rows = browse_cluster(clustered, 1, 30).collect()
    assert len(rows) == 30 and {r.n_more for r in rows} == {70}
    assert [r.total_revenue for r in rows] == sorted((r.total_revenue for r in rows), reverse=True)
    assert {r.n_more for r in browse_cluster(clustered, 1, 200).collect()} == {0}
    assert browse_cluster(clustered, 77).collect() == []


def test_names_ids_and_examples(clustered):
    assert [r[0] for r in cluster_ids(clustered).collect()] == [0, 1, 2]
    names = [r[0] for r in category_names(clustered).collect()]
    assert names == sorted(names) and len(names) == 600
    examples = cluster_examples(clustered, 3).groupBy("prediction").count().collect()
    assert {r.prediction: r["count"] for r in examples} == {0: 3, 1: 3, 2: 3}
    assert cluster_examples(clustered.where("product_category = 'p0001'")).count() == 1


def test_features_must_not_be_null(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(Exception, match="(?i)null"):
        scale_features(df, ["a", "b"], False)


