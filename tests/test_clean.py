"""Cleaning rules on literal texts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from retail_insight.functions import clean
from retail_insight.plans.etl import parse_quality


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")


def apply(spark, values, rule):
    rows = column(spark, values).select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def parse(spark, values, **options):
    text = F.trim(clean.normalize_ts_text(F.col("x"))).alias("x")
    parsed = (
        column(spark, values)
        .select("i", text)
        .select("i", clean.parse_event_time(F.col("x"), **options).cast("timestamp_ntz").alias("y"))
    )
    return [r.y for r in parsed.orderBy("i").collect()]


def test_money(spark):
    cases = {
        "$1,234.50": 1234.5,
        "(12.50)": 12.5,
        "1e5": 100000.0,
        "1.0E7": 1.0e7,
        "1.2E-3": 0.0012,
        "1.2.3": None,
        "-7": -7.0,
        "abc": None,
        "": None,
        None: None,
        "3.0": 3.0,
        "1d": 1.0,
        "NaN": None,
        "Infinity": None,
        "  42 ": 42.0,
        "+5": 5.0,
        ".5": 0.5,
        "5.": 5.0,
        "-": None,
        "0.0001": 0.0001,
    }
    assert apply(spark, list(cases), clean.clean_money) == list(cases.values())


def test_money_with_negative_parentheses(spark):
    values = ["(12.50)", " ($1,000) ", "12.50", "-3", "(abc)", None]
    found = apply(spark, values, lambda c: clean.clean_money(c, parens_negative=True))
    assert found == [-12.5, -1000.0, 12.5, -3.0, None, None]


def test_int(spark):
    values = ["3.0", "3.7", "-3.2", " 12 pcs", "1,200", "abc", "", None, "1e3", "99999999999"]
    assert apply(spark, values, clean.clean_int) == [3, 3, -4, 12, 1200, None, None, None, 1000, None]


def test_flag(spark):
    values = ["1", "0", "1.0", "2.7", "True", "false", "yes", "", None, "1e20"]
    assert apply(spark, values, clean.clean_flag) == [1, 0, 1, 2, 1, 0, None, None, None, None]


def test_normalize_ts_text(spark):
    values = ["  9/8/2020   9:38 ", "2020-09-08T14:30:00Z", "9/8/2020 9:38", "2020-09-08\t 1:00", None]
    assert apply(spark, values, clean.normalize_ts_text) == [
        "9/8/2020 9:38",
        "2020-09-08 14:30:00 ",
        "9/8/2020 9:38",
        "2020-09-08 1:00",
        None,
    ]


STAMPS = {
    # text: (whole text, its readable start)
    "9/8/2020 9:38 PM": (dt.datetime(2020, 9, 8, 21, 38), dt.datetime(2020, 9, 8, 9, 38)),
    "9/8/2020 9:38:45": (dt.datetime(2020, 9, 8, 9, 38, 45), dt.datetime(2020, 9, 8, 9, 38)),
    "9/8/2020 9:38:45 am": (dt.datetime(2020, 9, 8, 9, 38, 45), dt.datetime(2020, 9, 8, 9, 38)),
    "2020-09-08 14:30:00": (dt.datetime(2020, 9, 8, 14, 30), dt.datetime(2020, 9, 8)),
    "2020-09-08T14:30:00Z": (dt.datetime(2020, 9, 8, 14, 30), dt.datetime(2020, 9, 8)),
    "2020-09-08 14:30": (dt.datetime(2020, 9, 8, 14, 30), dt.datetime(2020, 9, 8)),
    "09/08/20 9:38": (dt.datetime(2020, 9, 8, 9, 38), None),
    "9/8/20": (dt.datetime(2020, 9, 8), None),
    "2020-09-08T14:30:00.123Z": (dt.datetime(2020, 9, 8, 14, 30, 0, 123_000), None),
    "2020-09-08T14:30:00+07:00": (dt.datetime(2020, 9, 8, 14, 30), None),
    "2020-09-08T14:30:00.5-0330": (dt.datetime(2020, 9, 8, 14, 30, 0, 500_000), None),
    "2020-9-8": (dt.datetime(2020, 9, 8), None),
    "2020-09-08 9:05": (dt.datetime(2020, 9, 8, 9, 5), None),
    "2020/09/08": (dt.datetime(2020, 9, 8), None),
    "2020/9/8 7:05:09": (dt.datetime(2020, 9, 8, 7, 5, 9), None),
    "9/8/2020 25:00": (None, dt.datetime(2020, 9, 8)),
    "5/13/2020": (dt.datetime(2020, 5, 13), dt.datetime(2020, 5, 13)),
    "13/5/2020": (dt.datetime(2020, 5, 13), dt.datetime(2020, 5, 13)),
    "13/5/2020 9:00": (dt.datetime(2020, 5, 13, 9), dt.datetime(2020, 5, 13, 9)),
    "13/5/2020 9:00:07": (dt.datetime(2020, 5, 13, 9, 0, 7), dt.datetime(2020, 5, 13, 9)),
    "9/8/2020 9:38": (dt.datetime(2020, 9, 8, 9, 38), dt.datetime(2020, 9, 8, 9, 38)),
    "12/12/2020 00:00": (dt.datetime(2020, 12, 12), dt.datetime(2020, 12, 12)),
    "2/30/2020 1:00": (None, None),
    "2020-13-45": (None, None),
    "13/13/2020": (None, None),
    "junk": (None, None),
    "": (None, None),
    None: (None, None),
}


@pytest.mark.parametrize("mode", ["strict", "prefix"])
def test_timestamps(spark, mode):
    expected = [whole or (start if mode == "prefix" else None) for whole, start in STAMPS.values()]
    assert parse(spark, list(STAMPS), mode=mode) == expected


@pytest.mark.parametrize("mode", ["strict", "prefix"])
def test_texts_that_are_no_dates_of_a_known_layout(spark, mode):
    """What a plain cast would read, and texts that only look like a layout."""
    texts = ["2020", "2020-09", "now", "epoch", "12:30", "9:38 pm", "--", "T", "13/5/20", "0/5/2020", "9/8"]
    assert parse(spark, texts, mode=mode)[:8] == [None] * 8
    assert parse(spark, texts, mode="strict") == [None] * len(texts)


def test_clock_that_the_time_zone_skips(spark):
    """A time lost to summer time moves on by an hour, in every layout alike."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = ["3/8/2020 2:30", "3/8/2020 2:30 AM", "2020-03-08T02:30:00Z", "3/8/20 2:30"]
        assert parse(spark, texts) == [dt.datetime(2020, 3, 8, 3, 30)] * 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_unknown_mode():
    with pytest.raises(ValueError, match="mode"):
        clean.parse_event_time(F.lit("x"), mode="loose")


def test_user_format_goes_first(spark):
    values = ["08.09.2020 14:05", "3/4/2020", "2020-09-08"]
    assert parse(spark, values, user_fmt="dd.MM.yyyy HH:mm") == [
        dt.datetime(2020, 9, 8, 14, 5),
        dt.datetime(2020, 3, 4),
        dt.datetime(2020, 9, 8),
    ]
    assert parse(spark, values, user_fmt="dd.MM.yyyy HH:mm", mode="prefix")[0] == dt.datetime(2020, 9, 8, 14, 5)
    assert parse(spark, ["3/4/2020"], user_fmt="d/M/yyyy") == [dt.datetime(2020, 4, 3)]
    # A format with a month name has no numeric shape and is tried as it is.
    assert parse(spark, ["8 Sep 2020", "9/8/2020"], user_fmt="d MMM yyyy") == [dt.datetime(2020, 9, 8)] * 2


# The fixed format list of the lenient parser, in its order.
LENIENT = [
    "M/d/yyyy H:mm", "M/d/yyyy h:mm a", "MM/dd/yyyy HH:mm", "dd/M/yyyy H:mm", "dd/MM/yyyy HH:mm",
    "M/d/yyyy H:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd/M/yyyy H:mm:ss", "dd/MM/yyyy HH:mm:ss",
    "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy",
]


def test_prefix_mode_equals_the_lenient_parser(spark):
    """Against Spark's own legacy date parser, on made-up texts of many shapes."""
    draw = random.Random(7)
    number = lambda hi, width: f"{draw.randint(0, hi):0{draw.choice([1, width])}d}"
    texts = list(STAMPS)
    for _ in range(1500):
        day = draw.choice([
            f"{number(14, 2)}/{number(33, 2)}/{draw.choice(['2020', '20', '1999'])}",
            f"{number(33, 2)}/{number(14, 2)}/2021",
            f"20{draw.randint(0, 40):02d}-{number(14, 2)}-{number(33, 2)}",
        ])
        time = draw.choice(["", " ", f" {number(26, 2)}:{number(62, 2)}", f" {number(26, 2)}:{number(62, 2)}:{number(62, 2)}"])
        texts.append(day + time + draw.choice(["", " AM", " pm", "Z", " +01:00", "x"]))
    legacy = spark.newSession()
    legacy.conf.set("spark.sql.legacy.timeParserPolicy", "LEGACY")
    legacy.conf.set("spark.sql.ansi.enabled", "false")
    rows = legacy.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select(
        "i", clean.normalize_ts_text(F.col("x")).alias("x")
    )
    stamps = F.coalesce(*[F.to_timestamp("x", f) for f in LENIENT])
    wanted = rows.select("i", stamps.cast("string").alias("y")).orderBy("i").collect()
    found = [None if y is None else f"{y:%Y-%m-%d %H:%M:%S}" for y in parse(spark, texts, mode="prefix")]
    # A layout that fits the whole text comes first.
    whole = [None if y is None else f"{y:%Y-%m-%d %H:%M:%S}" for y in parse(spark, texts, mode="strict")]
    wrong = [
        (t, f, w.y)
        for t, f, w, s in zip(texts, found, wanted, whole)
        # Years before the calendar reform differ between the two parsers by days.
        if f != (s or w.y) and not (w.y and w.y.startswith("00"))
    ]
    assert not wrong, wrong[:10]


def test_columns_are_renamed_once(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["Customer", "Customer ID", "Gender", "gender_x"])
    assert clean.normalize_columns(df).columns == ["Customer", "customer_id", "gender", "gender_x"]
    df = spark.createDataFrame([(1, 2)], ["Customer", "quantity"])
    assert clean.normalize_columns(df).columns == ["customer_id", "quantity"]


def test_parse_quality(spark):
    df = spark.sql("SELECT CAST(c AS TIMESTAMP) AS purchase_ts FROM VALUES ('2020-01-01'), (NULL) AS t(c)")
    assert parse_quality(df).first().asDict() == {"n_rows": 2, "ts_null_ratio": 0.5}
    assert parse_quality(df.limit(0)).first().asDict() == {"n_rows": 0, "ts_null_ratio": None}


def test_percent_rounds_half_up(spark):
    from retail_insight.functions.measures import percent

    row = spark.range(1).select(
        percent(F.lit(None).cast("double")).alias("a"), percent(F.lit(0.12345)).alias("b")
    ).first()
    assert (row.a, row.b) == (0.0, 12.35)
