"""The registered queries in ANSI SQL for an independent engine.

The statements compute each result from the same Parquet tables without using
anything of the Spark side, apart from the texts that define the inputs.
"""

from __future__ import annotations

from retail_insight.plans.queries import LABEL_GROUPS
from retail_insight.sources.facts import EXPORT_COLUMNS

FACTS = """facts AS (
  SELECT o.o_custkey AS customer_id, c.c_name AS customer_name,
         CAST(c.c_custkey % 110 AS INT) AS customer_age, c.c_mktsegment AS gender,
         o.o_orderdate AS purchase_ts, CAST(o.o_orderdate AS DATE) AS purchase_date,
         p.p_type AS product_category, p.p_brand AS brand,
         CAST(p.p_retailprice AS DECIMAL(18,2)) AS product_price,
         CAST(l.l_quantity AS INT) AS quantity,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS total_amount,
         o.o_orderpriority AS payment_method,
         CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS returns,
         CASE c.c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE NULL END AS churn,
         CASE c.c_custkey % 4 WHEN 0 THEN 1 ELSE NULL END AS churn_sparse
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN part p ON l.l_partkey = p.p_partkey)"""

# Facts of which the days of March 1997 came a second time, in part and at twice the amount.
RELOADED = f"""{FACTS}, march AS (
  SELECT purchase_date, 2 * total_amount AS total_amount, returns FROM facts
  WHERE purchase_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' AND quantity > 10),
reloaded AS (
  SELECT purchase_date, total_amount, returns FROM facts
  WHERE purchase_date NOT IN (SELECT purchase_date FROM march) UNION ALL SELECT * FROM march)"""

DATE_TEXT = """CASE o_orderkey % 7
         WHEN 0 THEN strftime(t, '%-m/%-d/%Y %-H:%M')
         WHEN 1 THEN strftime(t, '%-m/%-d/%Y %-I:%M %p')
         WHEN 2 THEN strftime(t, '%Y-%m-%d')
         WHEN 3 THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ')
         WHEN 4 THEN '  ' || strftime(t, '%m/%d/%Y   %H:%M:%S')
         WHEN 5 THEN strftime(t, '%d/%m/%Y')
         ELSE CASE (o_orderkey // 7) % 9
           WHEN 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S.125Z')
           WHEN 1 THEN strftime(t, '%Y-%m-%dT%H:%M:%S+07:00')
           WHEN 2 THEN strftime(t, '%Y-%-m-%-d')
           WHEN 3 THEN strftime(t, '%Y-%m-%d %-H:%M')
           WHEN 4 THEN strftime(t, '%Y/%m/%d %H:%M:%S')
           WHEN 5 THEN strftime(t, '%-m/%-d/20 %-H:%M')
           WHEN 6 THEN strftime(t, '%-m/%-d/%Y %-H:%M or so')
           WHEN 7 THEN strftime(t, '%Y/%-m/%-d')
           ELSE 'not a date' END END"""

RAW_ORDERS = f"""raw_orders AS (
  SELECT o_orderkey, o_custkey, {DATE_TEXT} AS purchase_date_raw,
         CASE o_orderkey % 4
           WHEN 0 THEN '$' || format('{{:,.2f}}', o_totalprice)
           WHEN 1 THEN '-' || CAST(CAST(trunc(o_totalprice) AS INT) AS VARCHAR)
           WHEN 2 THEN 'n/a'
           ELSE NULL END AS total_amount_raw
  FROM (SELECT *, o_orderdate + to_minutes(o_orderkey % 1440) AS t FROM orders))"""

_EXPORT = ",\n         ".join(
    f"{sql} AS {name.lower().replace(' ', '_')}"
    for made in EXPORT_COLUMNS.values()
    for name, sql in made.items()
)
RAW_PURCHASES = f"""raw_purchases AS (
  SELECT {_EXPORT},
         {DATE_TEXT} AS purchase_date
  FROM (SELECT *, o_orderdate + to_minutes(o_orderkey % 1440) AS t
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey))"""


def _money(c: str) -> str:
    return (
        rf"CASE WHEN regexp_matches(trim({c}), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') "
        rf"THEN TRY_CAST(trim({c}) AS DOUBLE) "
        rf"ELSE TRY_CAST(regexp_replace(trim({c}), '[^0-9.\-]', '', 'g') AS DOUBLE) END"
    )


def _signed(c: str) -> str:
    return rf"CASE WHEN regexp_matches(trim({c}), '^\(.*\)$') THEN -abs({_money(c)}) ELSE {_money(c)} END"


def _int(c: str) -> str:
    return f"TRY_CAST(floor({_money(c)}) AS INT)"


def _flag(c: str) -> str:
    return f"TRY_CAST(trunc(TRY_CAST(trim({c}) AS DOUBLE)) AS INT)"


def _ts_text(c: str) -> str:
    return rf"regexp_replace(regexp_replace(trim({c}), 'T|Z$', ' ', 'g'), '\s+', ' ', 'g')"


def _strict(c: str) -> str:
    formats = (
        "%m/%d/%Y %I:%M %p", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S",
        "%d/%m/%Y %H:%M", "%d/%m/%Y %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M",
        "%Y-%m-%d %H:%M:%S.%g", "%Y-%m-%d", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y",
    )
    clock = rf"regexp_replace(trim({_ts_text(c)}), '(:\d\d) ?[+-]\d\d:?\d\d$', '\1')"
    short = ", ".join(f"try_strptime({clock}, {f!r})" for f in ("%m/%d/%y %H:%M", "%m/%d/%y"))
    known = ", ".join(f"try_strptime({clock}, {f!r})" for f in formats)
    return rf"CASE WHEN regexp_matches({clock}, '^\d\d?/\d\d?/\d\d( |$)') THEN coalesce({short}) ELSE coalesce({known}) END"


def _prefix(c: str) -> str:
    timed, day, slashed = r"'^\d+/\d+/\d+ \d+:\d+'", r"'^\d+-\d+-\d+'", r"'^\d+/\d+/\d+'"
    tries = (
        (timed, "%m/%d/%Y %H:%M"), (timed, "%d/%m/%Y %H:%M"), (day, "%Y-%m-%d"),
        (slashed, "%m/%d/%Y"), (slashed, "%d/%m/%Y"),
    )
    text = f"trim({_ts_text(c)})"
    parts = ", ".join(f"try_strptime(regexp_extract({text}, {s}), {f!r})" for s, f in tries)
    return f"coalesce({_strict(c)}, {parts})"


def _parse(expr: str) -> str:
    return f"""WITH {RAW_ORDERS}, parsed AS (
  SELECT o_orderkey, {expr} AS purchase_ts FROM raw_orders)
SELECT o_orderkey, purchase_ts, CAST(purchase_ts AS DATE) AS purchase_date,
       CAST(date_trunc('month', purchase_ts) AS DATE) AS purchase_month FROM parsed"""


def _etl(parse: str, amount: str, price: str) -> str:
    return f"""WITH {RAW_PURCHASES}, typed AS (
  SELECT CAST(trim(customer_id) AS BIGINT) AS customer_id, customer_name,
         TRY_CAST(customer_age AS DOUBLE) AS customer_age, gender,
         {_ts_text('purchase_date')} AS purchase_date_raw, {parse} AS purchase_ts,
         product_category, {price} AS product_price, {_int('quantity')} AS quantity,
         {amount} AS total_amount, payment_method,
         {_flag('returns')} AS returns, {_flag('churn')} AS churn
  FROM raw_purchases),
last AS (SELECT customer_id, max(purchase_ts) AS last_ts FROM typed GROUP BY customer_id),
newest AS (SELECT max(purchase_ts) AS newest_ts FROM typed)
SELECT customer_id, customer_name, customer_age, coalesce(gender, 'unknown') AS gender,
       purchase_date_raw, purchase_ts, CAST(purchase_ts AS DATE) AS purchase_date,
       coalesce(product_category, 'unknown') AS product_category, product_price, quantity,
       total_amount, coalesce(payment_method, 'unknown') AS payment_method, returns,
       coalesce(churn, CASE WHEN date_diff('day', CAST(last_ts AS DATE), CAST(newest_ts AS DATE)) > 180
                            THEN 1 WHEN last_ts IS NOT NULL THEN 0 END) AS churn
FROM typed LEFT JOIN last USING (customer_id) CROSS JOIN newest"""


CLEANED = f"""cleaned AS ({_etl(
    _strict("purchase_date"), _money("total_purchase_amount"), _money("product_price")
)})"""
EXACT = "sum(CAST(total_amount AS DECIMAL(28,6)))"

RFM = """rfm AS (
  SELECT customer_id,
         CAST(date_diff('day', CAST(max(purchase_ts) AS DATE),
              (SELECT CAST(max(purchase_ts) AS DATE) FROM facts)) AS INT) AS recency_days,
         count(*) AS frequency, CAST(sum(total_amount) AS DOUBLE) AS monetary
  FROM facts GROUP BY customer_id)"""

FIXED = """fixed AS (SELECT *, CAST(customer_id % 4 AS INT) AS prediction FROM rfm)"""

PROFILE = """profile AS (
  SELECT brand AS product_category,
         CAST(sum(product_price) AS DOUBLE) / count(product_price) AS avg_price,
         CAST(sum(quantity) AS DOUBLE) / count(quantity) AS avg_quantity,
         CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
         CAST(sum(returns) AS DOUBLE) / count(returns) AS avg_returns_rate
  FROM facts GROUP BY brand)"""

BRANDS = """brands AS (
  SELECT *, CAST(right(product_category, 1) AS INT) % 3 AS prediction FROM profile)"""

UNIT_HASH = "CAST('0x' || substr(md5(concat({key}, '|42')), 1, 8) AS BIGINT) / 4294967296.0"

METRICS = ("recency_days", "frequency", "monetary")
ROUNDED_PRODUCT = """round(avg_price, 9) AS avg_price, round(avg_quantity, 9) AS avg_quantity,
       total_revenue, round(avg_returns_rate, 9) AS avg_returns_rate"""


def _histogram(ctes: str, values: str, bins: str) -> str:
    return f"""WITH {ctes}, v AS ({values}),
s AS (SELECT min(x) AS lo, max(x) AS hi, {bins} AS bins FROM v),
edges AS (
  SELECT CAST(i AS INT) AS bin, lo + i * ((hi - lo) / bins) AS e0,
         CASE WHEN i + 1 = bins THEN hi ELSE lo + (i + 1) * ((hi - lo) / bins) END AS e1,
         i + 1 = bins AS closed
  FROM s, range(0, 1000) r(i) WHERE i < bins)
SELECT bin, round((e0 + e1) / 2, 6) AS center, count(x) AS n
FROM edges LEFT JOIN v ON x >= e0 AND (x < e1 OR (closed AND x <= e1))
GROUP BY bin, e0, e1"""


def _rfm_histogram(metric: str) -> str:
    limit = (
        ""
        if metric == "recency_days"
        else f" WHERE {metric} <= (SELECT quantile_cont({metric}, 0.99) FROM rfm)"
    )
    return _histogram(
        f"{FACTS}, {RFM}", f"SELECT CAST({metric} AS DOUBLE) AS x FROM rfm{limit}", "30"
    )


def _describe(metric: str) -> str:
    x = f"CAST({metric} AS DOUBLE)"
    return f"""SELECT '{metric}' AS metric, count({metric}) AS n, round(avg({x}), 4) AS mean,
       round(stddev_samp({x}), 4) AS std, round(min({x}), 4) AS min,
       round(quantile_cont({x}, 0.25), 4) AS p25, round(quantile_cont({x}, 0.5), 4) AS p50,
       round(quantile_cont({x}, 0.75), 4) AS p75, round(max({x}), 4) AS max FROM rfm"""


SUMMARY_COLUMNS = (
    "customer_id,customer_name,customer_age,gender,purchase_ts,purchase_date,product_category,"
    "brand,product_price,quantity,total_amount,payment_method,returns,churn,churn_sparse"
)

SAMPLE = UNIT_HASH.format(key="customer_id")


def _hash_sample(fraction: float) -> str:
    return f"""WITH {FACTS}, {RFM}
SELECT * FROM rfm WHERE {SAMPLE} < {fraction}"""


PRODUCT = ("avg_price", "avg_quantity", "total_revenue", "avg_returns_rate")
AXES = range(len(PRODUCT))


def _largest_axis(name: str, matrix: str, steps: int = 400) -> str:
    """The eigenvector with the largest eigenvalue by power iteration; its largest loading is positive."""
    turned = ", ".join(" + ".join(f"m.c{i}{j} * v{j}" for j in AXES) + f" AS w{i}" for i in AXES)
    norm = "sqrt(" + " + ".join(f"w{i} * w{i}" for i in AXES) + ")"
    sizes = ", ".join(f"abs(v{i})" for i in AXES)
    cases = " ".join(f"WHEN abs(v{i}) = greatest({sizes}) THEN sign(v{i})" for i in AXES)
    value = " + ".join(f"v{i} * ({' + '.join(f'm.c{i}{j} * v{j}' for j in AXES)})" for i in AXES)
    return f"""{name}_steps AS (
  SELECT 0 AS step, {", ".join(f"CAST({0.5 + 0.1 * i} AS DOUBLE) AS v{i}" for i in AXES)}
  UNION ALL
  SELECT step + 1, {", ".join(f"w{i} / {norm}" for i in AXES)}
  FROM (SELECT step, {turned} FROM {name}_steps, {matrix} m WHERE step < {steps})),
{name} AS (
  SELECT {", ".join(f"v{i} * CASE {cases} END AS v{i}" for i in AXES)}, {value} AS size
  FROM {name}_steps, {matrix} m WHERE step = {steps})"""


PCA = f"""scaled AS (
  SELECT product_category, {", ".join(
    f"({m} - avg({m}) OVER ()) / stddev_samp({m}) OVER () AS x{i}" for i, m in enumerate(PRODUCT))}
  FROM profile),
spread AS (SELECT {", ".join(f"covar_samp(x{i}, x{j}) AS c{i}{j}" for i in AXES for j in AXES)} FROM scaled),
{_largest_axis("first", "spread")},
rest AS (
  SELECT {", ".join(f"c{i}{j} - f.size * f.v{i} * f.v{j} AS c{i}{j}" for i in AXES for j in AXES)}
  FROM spread, first f),
{_largest_axis("second", "rest")}"""


def _score_gap_sql(rows: str, largest: int) -> str:
    return f"""SELECT CAST(k AS INT) AS k, 0.0 AS gap
FROM range(2, {largest} + 1) r(k) WHERE (SELECT {rows}) > {largest}"""


def _etl_columns(changed: str, columns: str) -> str:
    """Some columns of the typed export, with a rule for what was changed in it."""
    return f"""WITH {RAW_PURCHASES}, typed AS (
  SELECT CAST(trim(customer_id) AS BIGINT) AS customer_id, TRY_CAST(customer_age AS DOUBLE) AS customer_age,
         coalesce(product_category, 'unknown') AS product_category,
         {_money('total_purchase_amount')} AS total_amount, {changed} AS churn
  FROM raw_purchases)
SELECT {columns} FROM typed"""


ORACLE: dict[str, str] = {
    "table_summary": f"""WITH {FACTS}
SELECT count(*) AS row_count, 15 AS column_count, '{SUMMARY_COLUMNS}' AS columns FROM facts""",
    "daily_sales_ma7": f"""WITH {FACTS}, daily AS (
  SELECT purchase_date, sum(total_amount) AS revenue, count(*) AS orders
  FROM facts WHERE purchase_date IS NOT NULL GROUP BY purchase_date)
SELECT purchase_date, CAST(revenue AS DOUBLE) AS revenue, orders,
       CAST(sum(revenue) OVER w AS DOUBLE) / count(revenue) OVER w AS rev_ma7
FROM daily WINDOW w AS (ORDER BY purchase_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "kpis": f"""WITH {FACTS}
SELECT count(DISTINCT customer_id) AS customers, count(DISTINCT product_category) AS categories,
       CAST(sum(total_amount) AS DOUBLE) AS revenue,
       round(coalesce(avg(returns), 0) * 100, 2) AS return_rate_pct,
       round(coalesce(avg(churn), 0) * 100, 2) AS churn_rate_pct FROM facts""",
    "top_categories_by_count": f"""WITH {FACTS}
SELECT brand AS product_category, count(*) AS cnt, CAST(sum(total_amount) AS DOUBLE) AS revenue
FROM facts GROUP BY brand ORDER BY cnt DESC, brand LIMIT 10""",
    "top_categories_by_revenue": f"""WITH {FACTS}
SELECT brand AS product_category, count(*) AS cnt, CAST(sum(total_amount) AS DOUBLE) AS revenue
FROM facts GROUP BY brand ORDER BY revenue DESC, brand LIMIT 5""",
    "payment_mix": f"""WITH {FACTS}
SELECT payment_method, count(*) AS cnt, CAST(sum(total_amount) AS DOUBLE) AS revenue
FROM facts GROUP BY payment_method""",
    "payment_counts": f"""WITH {FACTS}
SELECT payment_method, count(*) AS cnt FROM facts GROUP BY payment_method""",
    "daily_return_rate": f"""WITH {CLEANED}
SELECT purchase_date, CAST(sum(returns) AS DOUBLE) / count(returns) AS return_rate
FROM cleaned WHERE purchase_date IS NOT NULL GROUP BY purchase_date""",
    "churn_by_gender": f"""WITH {FACTS}
SELECT gender, CAST(sum(churn) AS DOUBLE) / count(churn) AS churn_rate
FROM facts GROUP BY gender""",
    "age_histogram": _histogram(
        FACTS,
        "SELECT CAST(customer_age AS DOUBLE) AS x FROM facts WHERE customer_age > 0 AND customer_age < 100",
        "CAST(floor(greatest(10, least(40, sqrt(count(*))))) AS INT)",
    ),
    "quantity_histogram": _histogram(
        "q AS (SELECT l_quantity FROM lineitem)", "SELECT l_quantity AS x FROM q", "40"
    ),
    "monthly_revenue": f"""WITH {CLEANED}
SELECT CAST(date_trunc('month', purchase_ts) AS DATE) AS month,
       CAST({EXACT} AS DOUBLE) AS revenue
FROM cleaned WHERE purchase_ts IS NOT NULL GROUP BY 1""",
    "monthly_revenue_filled": f"""WITH {FACTS}, monthly AS (
  SELECT customer_id, CAST(date_trunc('month', purchase_ts) AS DATE) AS month,
         CAST(sum(total_amount) AS DOUBLE) AS revenue
  FROM facts GROUP BY 1, 2),
calendar AS (
  SELECT customer_id, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM monthly GROUP BY customer_id)
SELECT c.customer_id, c.month AS month,
       CASE WHEN m.month IS NULL THEN 0.0 ELSE revenue END AS revenue
FROM calendar c LEFT JOIN monthly m ON c.customer_id = m.customer_id AND c.month = m.month""",
    "kpis_cleaned": f"""WITH {CLEANED}
SELECT count(DISTINCT customer_id) AS customers, count(DISTINCT product_category) AS categories,
       CAST({EXACT} AS DOUBLE) AS revenue,
       round(coalesce(avg(returns), 0) * 100, 2) AS return_rate_pct,
       round(coalesce(avg(churn), 0) * 100, 2) AS churn_rate_pct FROM cleaned""",
    "daily_sales_cleaned": f"""WITH {CLEANED}, daily AS (
  SELECT purchase_date, {EXACT} AS revenue, count(*) AS orders
  FROM cleaned WHERE purchase_date IS NOT NULL GROUP BY purchase_date)
SELECT purchase_date, CAST(revenue AS DOUBLE) AS revenue, orders,
       CAST(sum(revenue) OVER w AS DOUBLE) / count(revenue) OVER w AS rev_ma7
FROM daily WINDOW w AS (ORDER BY purchase_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "clean_money": f"""WITH {RAW_ORDERS}
SELECT o_orderkey, {_money('total_amount_raw')} AS total_amount FROM raw_orders""",
    "clean_money_parentheses": f"""WITH {RAW_PURCHASES}
SELECT total_purchase_amount AS amount_raw, {_money('total_purchase_amount')} AS amount,
       {_signed('total_purchase_amount')} AS amount_signed FROM raw_purchases""",
    "clean_quantity": f"""WITH {RAW_PURCHASES}
SELECT quantity AS quantity_raw, {_int('quantity')} AS quantity FROM raw_purchases""",
    "clean_flags": f"""WITH {RAW_PURCHASES}
SELECT returns AS returns_raw, {_flag('returns')} AS returns, {_flag('churn')} AS churn
FROM raw_purchases""",
    "normalize_time_text": f"""WITH {RAW_ORDERS}
SELECT o_orderkey, {_ts_text('purchase_date_raw')} AS text FROM raw_orders""",
    "parse_time_prefix": _parse(_prefix("purchase_date_raw")),
    "parse_time_strict": _parse(_strict("purchase_date_raw")),
    "parse_quality": f"""WITH {RAW_PURCHASES}
SELECT count(*) AS n_rows,
       round(avg(CASE WHEN {_strict('purchase_date')} IS NULL THEN 1.0 ELSE 0.0 END), 9) AS ts_null_ratio
FROM raw_purchases""",
    "fill_unknown": f"""WITH {RAW_PURCHASES}
SELECT customer_id, coalesce(gender, 'unknown') AS gender,
       coalesce(product_category, 'unknown') AS product_category,
       coalesce(payment_method, 'unknown') AS payment_method FROM raw_purchases""",
    "etl_purchases": _etl(
        _strict("purchase_date"), _money("total_purchase_amount"), _money("product_price")
    ),
    "etl_purchases_prefix": _etl(
        _prefix("purchase_date"), _signed("total_purchase_amount"), _signed("product_price")
    ),
    "raw_csv_scan": f"""WITH {RAW_PURCHASES} SELECT * FROM raw_purchases""",
    "csv_parquet_round_trip": _etl(
        _strict("purchase_date"), _money("total_purchase_amount"), _money("product_price")
    ),
    "purchases_date_range": f"""WITH {FACTS}
SELECT purchase_date, count(*) AS orders, CAST(sum(total_amount) AS DOUBLE) AS revenue
FROM facts WHERE purchase_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
GROUP BY purchase_date""",
    "daily_figures_kept": f"""WITH {RELOADED}, daily AS (
  SELECT purchase_date, sum(total_amount) AS revenue, count(*) AS orders,
         CAST(sum(returns) AS DOUBLE) / count(returns) AS return_rate
  FROM reloaded GROUP BY purchase_date)
SELECT purchase_date, CAST(revenue AS DOUBLE) AS revenue, orders,
       CAST(sum(revenue) OVER w AS DOUBLE) / count(revenue) OVER w AS rev_ma7, return_rate
FROM daily WINDOW w AS (ORDER BY purchase_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "derive_churn": f"""WITH {FACTS}, last AS (
  SELECT customer_id, max(purchase_date) AS last_date FROM facts GROUP BY customer_id)
SELECT customer_id, purchase_date, product_category,
       CAST(coalesce(churn_sparse, CASE WHEN date_diff('day', last_date,
            (SELECT max(purchase_date) FROM facts)) > 180 THEN 1 ELSE 0 END) AS INT) AS churn
FROM facts JOIN last USING (customer_id)""",
    "rfm_all": f"""WITH {CLEANED}
SELECT customer_id,
       CAST(date_diff('day', max(purchase_date), (SELECT max(purchase_date) FROM cleaned)) AS INT) AS recency_days,
       count(*) AS frequency, CAST({EXACT} AS DOUBLE) AS monetary
FROM cleaned GROUP BY customer_id""",
    "rfm_dated": f"""WITH {CLEANED}
SELECT customer_id,
       CAST(date_diff('day', max(purchase_date), (SELECT max(purchase_date) FROM cleaned)) AS INT) AS recency_days,
       count(*) AS frequency, CAST({EXACT} AS DOUBLE) AS monetary
FROM cleaned WHERE purchase_ts IS NOT NULL GROUP BY customer_id HAVING {EXACT} IS NOT NULL""",
    "rfm_describe": f"WITH {FACTS}, {RFM}\n" + "\nUNION ALL ".join(_describe(m) for m in METRICS),
    "amount_quantiles": """SELECT round(quantile_cont(l_extendedprice, 0.01), 4) AS p1,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
       round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem""",
    "rfm_histogram_recency": _rfm_histogram("recency_days"),
    "rfm_histogram_frequency": _rfm_histogram("frequency"),
    "rfm_histogram_monetary": _rfm_histogram("monetary"),
    "rfm_scatter_sample": _hash_sample(0.5),
    "rfm_scatter_sample_small": _hash_sample(0.1),
    "rfm_training_sample": _hash_sample(0.25),
    "product_profile": f"""WITH {FACTS}, {PROFILE}
SELECT product_category, {ROUNDED_PRODUCT} FROM profile""",
    "scaled_features": f"""WITH {FACTS}, {RFM}
SELECT customer_id, {", ".join(f"round({m} / (SELECT stddev_samp({m}) FROM rfm), 6) AS {m}_scaled" for m in METRICS)}
FROM rfm""",
    "scaled_product_features": f"""WITH {FACTS}, {PROFILE}
SELECT product_category, {", ".join(
    f"round(({m} - (SELECT avg({m}) FROM profile)) / (SELECT stddev_samp({m}) FROM profile), 6) AS {m}_scaled"
    for m in ("avg_price", "avg_quantity", "total_revenue", "avg_returns_rate"))}
FROM profile""",
    "silhouette_fixed": f"""WITH {FACTS}, {RFM}, {FIXED}, scaled AS (
  SELECT customer_id, prediction,
         {", ".join(f"{m} / (SELECT stddev_samp({m}) FROM rfm) AS x{i}" for i, m in enumerate(METRICS))}
  FROM fixed),
clusters AS (
  SELECT prediction, count(*) AS n, sum(x0) AS s0, sum(x1) AS s1, sum(x2) AS s2,
         sum(x0 * x0 + x1 * x1 + x2 * x2) AS q FROM scaled GROUP BY prediction),
distances AS (
  SELECT s.customer_id, s.prediction = c.prediction AS own, c.n,
         c.n * (x0 * x0 + x1 * x1 + x2 * x2) - 2 * (x0 * s0 + x1 * s1 + x2 * s2) + q AS total
  FROM scaled s CROSS JOIN clusters c),
points AS (
  SELECT customer_id, max(CASE WHEN own AND n > 1 THEN total / (n - 1) END) AS a,
         min(CASE WHEN NOT own THEN total / n END) AS b FROM distances GROUP BY customer_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM points""",
    "global_averages": f"""WITH {FACTS}, {RFM}
SELECT {", ".join(f"round(avg({m}), 4) AS global_{m}" for m in METRICS)} FROM rfm""",
    "cluster_profile_fixed": f"""WITH {FACTS}, {RFM}, {FIXED},
overall AS (SELECT avg(recency_days) AS r, avg(frequency) AS f, avg(monetary) AS m FROM rfm)
SELECT prediction, round(avg(recency_days), 4) AS avg_recency, round(avg(frequency), 4) AS avg_freq,
       round(avg(monetary), 4) AS avg_monetary, count(*) AS n_customers,
       round(any_value(r), 4) AS global_recency, round(any_value(f), 4) AS global_freq,
       round(any_value(m), 4) AS global_monetary,
       round(avg(recency_days) - any_value(r), 4) AS delta_recency,
       round(avg(frequency) - any_value(f), 4) AS delta_freq,
       round(avg(monetary) - any_value(m), 4) AS delta_monetary
FROM fixed CROSS JOIN overall GROUP BY prediction""",
    "cluster_labels_fixed": f"""WITH {FACTS}, {RFM},
overall AS (SELECT avg(recency_days) AS gr, avg(frequency) AS gf, avg(monetary) AS gm FROM rfm),
p AS (SELECT {LABEL_GROUPS} AS prediction, avg(recency_days) AS r, avg(frequency) AS f,
             avg(monetary) AS m, count(*) AS n_customers
      FROM rfm GROUP BY 1),
scored AS (
  SELECT prediction, n_customers,
         CASE WHEN r < gr * 0.9 THEN 'low' WHEN r > gr * 1.1 THEN 'high' ELSE 'mid' END AS r,
         CASE WHEN f < gf * 0.9 THEN 'low' WHEN f > gf * 1.1 THEN 'high' ELSE 'mid' END AS f,
         CASE WHEN m < gm * 0.9 THEN 'low' WHEN m > gm * 1.1 THEN 'high' ELSE 'mid' END AS m
  FROM p CROSS JOIN overall)
SELECT prediction, n_customers,
       CASE WHEN r = 'low' AND f = 'high' AND m = 'high' THEN 'vip'
            WHEN r = 'high' AND f = 'low' THEN 'at_risk'
            WHEN r = 'low' AND f = 'low' THEN 'new'
            WHEN f = 'high' THEN 'loyal'
            WHEN m = 'high' THEN 'big_spender'
            WHEN r = 'high' THEN 'dormant' ELSE 'average' END AS label
FROM scored""",
    "segment_detail_fixed": f"""WITH {FACTS}, {RFM}, {FIXED}
SELECT customer_id, recency_days, frequency, monetary, prediction
FROM fixed ORDER BY prediction, customer_id LIMIT 200""",
    "segment_export_fixed": f"""WITH {FACTS}, {RFM}, {FIXED}
SELECT customer_id, recency_days, frequency, monetary, prediction FROM fixed""",
    "cluster_contents_fixed": f"""WITH {FACTS}, {PROFILE}, {BRANDS}
SELECT prediction, product_category, count(*) OVER (PARTITION BY prediction) AS num_products
FROM brands""",
    "cluster_examples_fixed": f"""WITH {FACTS}, {PROFILE}, {BRANDS}, ranked AS (
  SELECT prediction, product_category, row_number() OVER (PARTITION BY prediction
         ORDER BY {UNIT_HASH.format(key='product_category')}, product_category) AS place
  FROM brands)
SELECT prediction, product_category FROM ranked WHERE place <= 3""",
    "category_names_fixed": f"""WITH {FACTS} SELECT DISTINCT brand AS product_category FROM facts""",
    "cluster_ids_fixed": f"""WITH {FACTS}, {PROFILE}, {BRANDS} SELECT DISTINCT prediction FROM brands""",
    "recommend_item_fixed": f"""WITH {FACTS}, {PROFILE}, {BRANDS}
SELECT product_category, {ROUNDED_PRODUCT} FROM brands
WHERE prediction = (SELECT prediction FROM brands WHERE product_category = 'Brand#7')
  AND product_category <> 'Brand#7'
ORDER BY brands.total_revenue DESC, product_category LIMIT 10""",
    "recommend_all_fixed": f"""WITH {FACTS}, {PROFILE}, {BRANDS}, ranked AS (
  SELECT a.prediction, a.product_category AS item, b.* EXCLUDE (prediction),
         CAST(row_number() OVER (PARTITION BY a.product_category
              ORDER BY b.total_revenue DESC, b.product_category) AS INT) AS place
  FROM brands a JOIN brands b
    ON a.prediction = b.prediction AND a.product_category <> b.product_category)
SELECT prediction, item, place AS rank, product_category, {ROUNDED_PRODUCT}
FROM ranked WHERE place <= 5""",
    "browse_cluster_fixed": f"""WITH {FACTS}, {PROFILE}, {BRANDS}
SELECT product_category, {ROUNDED_PRODUCT},
       greatest((SELECT count(*) FROM brands WHERE prediction = 1) - 5, 0) AS n_more
FROM brands WHERE prediction = 1 ORDER BY brands.total_revenue DESC, product_category LIMIT 5""",
    "customer_segments_totals": f"""WITH {FACTS}, {RFM}
SELECT count(*) AS n_assigned, count(DISTINCT customer_id) AS n_customers,
       CAST(sum(frequency) AS BIGINT) AS n_purchases, round(sum(monetary), 2) AS revenue FROM rfm""",
    "customer_nearest_centre": f"""WITH {FACTS}, {RFM} SELECT customer_id, 0.0 AS gap FROM rfm""",
    "product_nearest_centre": f"""WITH {FACTS}, {PROFILE} SELECT product_category, 0.0 AS gap FROM profile""",
    "product_nearest_centre_given_k": f"""WITH {FACTS}, {PROFILE}
SELECT product_category, 0.0 AS gap FROM profile""",
    "customer_k_choice": """SELECT CAST(k AS INT) AS k, true AS chosen_is_first_best
FROM range(2, 9) r(k) WHERE (SELECT count(*) FROM customer) > 8""",
    "product_k_choice": """SELECT CAST(k AS INT) AS k, true AS chosen_is_first_best
FROM range(2, 11) r(k) WHERE (SELECT count(DISTINCT p_brand) FROM part) > 10""",
    "product_clusters_totals": f"""WITH {FACTS}, {PROFILE}
SELECT count(*) AS n_listed, count(DISTINCT product_category) AS n_categories,
       min(product_category) AS first_category, max(product_category) AS last_category
FROM profile""",
    "product_projection": f"""WITH RECURSIVE {FACTS}, {PROFILE}, {PCA}
SELECT product_category, round({" + ".join(f"x{i} * a.v{i}" for i in AXES)}, 5) AS x,
       round({" + ".join(f"x{i} * b.v{i}" for i in AXES)}, 5) AS y FROM scaled, first a, second b""",
    "product_explained_variance": f"""WITH RECURSIVE {FACTS}, {PROFILE}, {PCA}
SELECT 'x' AS axis, round(size / {len(PRODUCT)}, 6) AS share FROM first
UNION ALL SELECT 'y', round(size / {len(PRODUCT)}, 6) FROM second""",
    "customer_score_gaps": _score_gap_sql("count(*) FROM customer", 8),
    "product_score_gaps": _score_gap_sql("count(DISTINCT p_brand) FROM part", 10),
    "etl_without_dates": _etl_columns(
        f"coalesce({_flag('churn')}, 0)",
        "customer_id, product_category, total_amount, churn, true AS undated",
    ),
    "etl_churn_known": _etl_columns(
        "CASE CAST(customer_age AS INT) % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END",
        "customer_id, customer_age, product_category, churn",
    ),
    "cached_purchases": f"""WITH {FACTS}
SELECT product_category, count(*) AS orders,
       count(*) FILTER (WHERE purchase_date = (SELECT max(purchase_date) FROM facts)) AS on_last_day
FROM facts GROUP BY product_category""",
    "top_categories_resorted": f"""WITH {FACTS}, top AS (
  SELECT brand AS product_category, count(*) AS cnt, CAST(sum(total_amount) AS DOUBLE) AS revenue
  FROM facts GROUP BY brand ORDER BY cnt DESC, brand LIMIT 10)
SELECT *, CAST(row_number() OVER (ORDER BY revenue DESC, product_category) AS INT) AS place FROM top""",
}


def _long(part: str, item: str, figures: tuple[str, ...], sql: str) -> str:
    """A statement's rows as one row for each figure."""
    return " UNION ALL ".join(
        f"SELECT '{part}' AS part, CAST({item} AS VARCHAR) AS item, '{c}' AS measure, CAST({c} AS DOUBLE) AS value FROM ({sql})"
        for c in figures
    )


ORACLE["overview_one_scan"] = " UNION ALL ".join(
    (
        _long("summary", "NULL", ("row_count",), f"WITH {FACTS} SELECT count(*) AS row_count FROM facts"),
        _long(
            "kpis",
            "NULL",
            ("customers", "categories", "revenue", "return_rate_pct", "churn_rate_pct"),
            ORACLE["kpis"],
        ),
        _long("daily_sales", "purchase_date", ("revenue", "orders", "rev_ma7"), ORACLE["daily_sales_ma7"]),
        _long(
            "top_categories",
            "product_category",
            ("cnt", "revenue"),
            f"""WITH {FACTS} SELECT product_category, count(*) AS cnt, CAST(sum(total_amount) AS DOUBLE) AS revenue
FROM facts GROUP BY product_category ORDER BY cnt DESC, product_category LIMIT 10""",
        ),
        _long("payment_mix", "payment_method", ("cnt", "revenue"), ORACLE["payment_mix"]),
        _long(
            "daily_return_rate",
            "purchase_date",
            ("return_rate",),
            f"""WITH {FACTS} SELECT purchase_date, CAST(sum(returns) AS DOUBLE) / count(returns) AS return_rate
FROM facts WHERE purchase_date IS NOT NULL GROUP BY purchase_date""",
        ),
        _long("churn_by_gender", "gender", ("churn_rate",), ORACLE["churn_by_gender"]),
        _long("age_histogram", "bin", ("n",), ORACLE["age_histogram"]),
    )
)

# Amounts that no decimal holds are summed as doubles beside the others.
OUTSIZED = f"""{FACTS}, outsized AS (
  SELECT * EXCLUDE (total_amount), CASE WHEN large IS NULL THEN CAST(total_amount AS DECIMAL(28,6)) END AS small, large
  FROM (SELECT *, CASE WHEN customer_id % 50 = 7 AND day(purchase_date) = 3 THEN CAST('1.2676506002282294e30' AS DOUBLE) END AS large
        FROM facts))"""
BOTH = "coalesce(CAST(sum(small) AS DOUBLE) + sum(large), CAST(sum(small) AS DOUBLE), sum(large))"
ORACLE |= {
    "kpis_outsized": f"""WITH {OUTSIZED}
SELECT count(DISTINCT customer_id) AS customers, count(DISTINCT product_category) AS categories, {BOTH} AS revenue,
       round(coalesce(avg(returns), 0) * 100, 2) AS return_rate_pct,
       round(coalesce(avg(churn), 0) * 100, 2) AS churn_rate_pct FROM outsized""",
    "daily_sales_outsized": f"""WITH {OUTSIZED}, daily AS (
  SELECT purchase_date, sum(small) AS small, sum(large) AS large, count(*) AS orders
  FROM outsized WHERE purchase_date IS NOT NULL GROUP BY purchase_date)
SELECT purchase_date, coalesce(CAST(small AS DOUBLE) + large, CAST(small AS DOUBLE), large) AS revenue, orders,
       coalesce(CAST(sum(small) OVER w AS DOUBLE) + sum(large) OVER w, CAST(sum(small) OVER w AS DOUBLE), sum(large) OVER w)
           / count(coalesce(CAST(small AS DOUBLE), large)) OVER w AS rev_ma7
FROM daily WINDOW w AS (ORDER BY purchase_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "rfm_outsized": f"""WITH {OUTSIZED}
SELECT customer_id,
       CAST(date_diff('day', CAST(max(purchase_ts) AS DATE), (SELECT CAST(max(purchase_ts) AS DATE) FROM facts)) AS INT) AS recency_days,
       count(*) AS frequency, {BOTH} AS monetary
FROM outsized GROUP BY customer_id""",
}

ORACLE["rfm_grid"] = f"""WITH {FACTS}, {RFM}, bounds AS (
  SELECT min(CAST(recency_days AS DOUBLE)) AS x0, max(CAST(recency_days AS DOUBLE)) AS x1, min(monetary) AS y0, max(monetary) AS y1
  FROM rfm),
edges AS (
  SELECT list_transform(range(21), lambda i: CASE WHEN i = 20 THEN x1 ELSE x0 + i * ((x1 - x0) / 20) END) AS xs,
         list_transform(range(21), lambda i: CASE WHEN i = 20 THEN y1 ELSE y0 + i * ((y1 - y0) / 20) END) AS ys
  FROM bounds),
placed AS (
  SELECT CAST(least(len(list_filter(xs[2:], lambda e: e <= recency_days)), 19) AS INT) AS x_bin,
         CAST(least(len(list_filter(ys[2:], lambda e: e <= monetary)), 19) AS INT) AS y_bin, xs, ys
  FROM rfm, edges)
SELECT x_bin, y_bin, round((any_value(xs)[x_bin + 1] + any_value(xs)[x_bin + 2]) / 2, 6) AS x_center,
       round((any_value(ys)[y_bin + 1] + any_value(ys)[y_bin + 2]) / 2, 6) AS y_center, count(*) AS n
FROM placed GROUP BY x_bin, y_bin"""
