"""Text-to-value cleaning, as plain Column expressions.

Everything here stays inside whole-stage code generation: no UDF, and no
``cast`` that could throw on a bad row (ANSI mode is on by default).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_insight.schema import HEADER_NAMES, UNKNOWN

# Text without a digit is kept away from casts, whose failure costs an exception.
HAS_DIGIT = r"\d"

# A text that is a number as a whole, or else each character no number has.
NUMBER_OR_NOISE = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$|[^0-9.\-]"


def normalize_columns(df: DataFrame, mapping: dict[str, str] = HEADER_NAMES) -> DataFrame:
    """Rename known headers; a target name already present is never overwritten."""
    names = list(df.columns)
    for old, new in mapping.items():
        if old in names and new not in names:
            names[names.index(old)] = new
    return df.toDF(*names)


def clean_money(value: Column, parens_negative: bool = False) -> Column:
    """Number text to double; anything unreadable becomes null.

    Text that already is a number is cast as it stands, so scientific notation
    survives. Only other text loses its currency signs and separators first.
    """
    text = value.cast("string")
    number = F.when(
        text.rlike(HAS_DIGIT), F.regexp_replace(text, NUMBER_OR_NOISE, "$1").try_cast("double")
    )
    if parens_negative:
        number = F.when(text.rlike(r"^\s*\(.*\)\s*$"), -F.abs(number)).otherwise(number)
    return number


def clean_int(value: Column) -> Column:
    """Number text to int, rounding down; out of range becomes null."""
    return F.floor(clean_money(value)).try_cast("int")


def clean_flag(value: Column) -> Column:
    """0/1 text (``1``, ``1.0``, ``true``) to int."""
    text = F.trim(value.cast("string"))
    return (
        F.when(text.rlike(HAS_DIGIT), text.try_cast("double").try_cast("int"))
        .when(F.lower(text) == "true", 1)
        .when(F.lower(text) == "false", 0)
    )


def normalize_ts_text(value: Column) -> Column:
    """Trim, then turn ISO markers and every run of blanks into one space."""
    text = F.trim(value.cast("string"))
    return F.regexp_replace(text, r"(?:T|Z$|[\s\u00A0\u2007\u202F])+", " ")


# The layouts that are read as whole texts. All those with a clock
# of 24 hours and a full year are one pattern, whose groups put in order are an
# ISO time: that is read without a formatter, and a day that does not exist costs
# no exception. Text that could be either reads month first. A distance from UTC
# after an ISO time is dropped; the time on the clock is kept.
MONTH, DAY = r"(?:0?[1-9]|1[0-2])", r"\d{1,2}"
CLOCK = r" \d{1,2}:\d\d(?::\d\d)?"
OFFSET = r" ?(?:[+-]\d\d:?\d\d|UTC|GMT)"
WHOLE_LAYOUTS = (
    rf"(?s)\A(?:(?:({MONTH})/({DAY})|({DAY})/({MONTH}))/(\d{{4}})({CLOCK})?"
    rf"|(\d{{4}})-({DAY})-({DAY})(?:( \d{{1,2}}:\d\d(?::\d\d(?:\.\d{{1,9}})?)?)(?:{OFFSET})?)?"
    rf"|(\d{{4}})/({DAY})/({DAY})({CLOCK})?"
    r"|.*)\z"
)
WHOLE_ORDER = "$5$7$11-$1$4$8$12-$2$3$9$13$6$10$14"
# Shape and format of the two layouts that need a formatter, clocks of
# 12 hours and years of two digits.
FORMATTED_LAYOUTS = (
    (rf"\A{MONTH}/{DAY}/\d{{4}}{CLOCK} [AaPp][Mm]\z", "M/d/yyyy h:mm[:ss] a"),
    (rf"\A{MONTH}/{DAY}/\d\d(?: \d{{1,2}}:\d\d)?\z", "M/d/yy[ H:mm]"),
)

# What a date at the start of a longer text looks like, its parts of
# any width with the time as far as it is one, and their format once in order.
DATE_AT_START = r"\A\d+(?:/\d+/|-\d+-)\d"
LONG_MONTH = r"0*(?:[1-9]|1[0-2])"
LEADING_LAYOUTS = (
    rf"(?s)\A(?:(?:({LONG_MONTH})/(\d+)|(\d+)/({LONG_MONTH}))/(\d+)"
    r"( 0*(?:1?\d|2[0-3]):0*[0-5]?\d(?!\d))?|(\d+)-(\d+)-(\d+)).*\z"
)
LEADING_ORDER, LEADING_FORMAT = "$5$7-$1$4$8-$2$3$9$6", "y-M-d[ H:m]"


PATTERN_PARTS = re.compile(r"'(?P<quoted>[^']*)'|(?P<run>(?P<letter>[A-Za-z])(?P=letter)*)|(?P<other>.)")


def _shape_of(fmt: str) -> str | None:
    """Regular expression for a user format; None when it is not all numbers."""
    shape = ""
    for part in PATTERN_PARTS.finditer(fmt):
        run = part["run"]
        if not run:
            shape += re.escape(part["quoted"] or part["other"] or "'")
        elif run == "a":
            shape += "[AaPp][Mm]"
        elif run[0] in "yMdHhmsS" and not run.startswith("MMM"):
            shape += r"\d+"
        else:
            return None
    return shape


def _loosened(fmt: str) -> str:
    """The format with every number read at any width (yyyy and MM become y and M)."""
    return PATTERN_PARTS.sub(lambda part: part["letter"] or part[0], fmt)


def _read_shape(text: Column, shape: str, fmt: str, group: int) -> Column:
    """Timestamp in the part of the text that has the shape, else null."""
    part = F.regexp_extract(text, shape, group) if group else text
    return F.when(text.rlike(shape), F.try_to_timestamp(part, F.lit(fmt)))


def parse_event_time(text: Column, user_fmt: str | None = None, mode: str = "strict") -> Column:
    """Timestamp text in any of the known layouts to a timestamp, else null.

    ``strict`` matches whole texts and keeps AM/PM, seconds, fractions and ISO
    times; a distance from UTC is dropped and the time on the clock kept; years
    of two digits are of this century. ``prefix`` does the same, and where no
    layout fits the whole text reads the longest known leading part, which is
    what lenient date parsers do. A user format is tried first.

    Most texts cost one pattern and one parse: the layouts are one pattern that
    puts the parts of a text in ISO order. ``text`` appears in every try, so it
    should be a column that already holds ``trim(normalize_ts_text(...))`` and not
    that expression.
    """
    if mode not in ("strict", "prefix"):
        raise ValueError(f"mode must be 'strict' or 'prefix', not {mode!r}")
    shape = _shape_of(user_fmt) if user_fmt else None
    tries = [F.try_to_timestamp(F.regexp_replace(text, WHOLE_LAYOUTS, WHOLE_ORDER))]
    tries += [_read_shape(text, s, fmt, 0) for s, fmt in FORMATTED_LAYOUTS]
    if shape:
        tries.insert(0, _read_shape(text, f"^{shape}$", user_fmt, 0))
    elif user_fmt:
        tries.insert(0, F.try_to_timestamp(text, F.lit(user_fmt)))
    if mode == "prefix":
        if shape:
            tries.append(_read_shape(text, f"^({shape})", _loosened(user_fmt), 1))
        leading = F.regexp_replace(text, LEADING_LAYOUTS, LEADING_ORDER)
        tries.append(F.when(text.rlike(DATE_AT_START), F.try_to_timestamp(leading, F.lit(LEADING_FORMAT))))
    return F.coalesce(*tries)


def event_date(ts: Column) -> Column:
    """Calendar day of a timestamp."""
    return F.to_date(ts)


def month_start(ts: Column) -> Column:
    """First day of the month of a timestamp."""
    return F.trunc(ts, "month")


def fill_unknown(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Null categories become ``unknown``; absent columns are skipped."""
    present = {c: UNKNOWN for c in columns if c in df.columns}
    return df.fillna(present) if present else df
