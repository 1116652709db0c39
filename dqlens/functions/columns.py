"""Scalar operators: parsing, shapes, labels and dates as expressions of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that read as booleans, as true and as false.
TRUE_TOKENS = ("true", "yes", "y", "t", "on", "1")
FALSE_TOKENS = ("false", "no", "n", "f", "off", "0")
# Labels that stand for a missing value.
PLACEHOLDERS = ("n/a", "na", "none", "null", "nan", "nil", "unknown", "undefined", "missing", "not available", "not applicable", "tbd", "?", "-", "--", "#n/a")
# Numbers that stand for a missing value.
SENTINELS = (-999.0, -9999.0, -99999.0, -99.0, -1.0, 999.0, 9999.0, 99999.0, 999999.0, 9999999.0, 99.0)
# Dates that systems put in for a missing one.
DEFAULT_DATES = ("1900-01-01", "1970-01-01", "1899-12-30", "1899-12-31", "1753-01-01", "0001-01-01", "2000-01-01", "9999-12-31", "2099-12-31")
# Shapes of dates, the first that fits counting (9 is a digit, A a letter).
DATE_SHAPES = (
    ("yyyy-mm-dd", r"^9999-99-99$"), ("yyyy-mm-dd time", r"^9999-99-99[ A]9{1,2}:99(:99)?([.,]9+)?(A|[+-]99:?99)?$"), ("yyyy/mm/dd", r"^9999/99?/99?$"), ("yyyy.mm.dd", r"^9999\.99\.99$"),
    ("x/x/yyyy", r"^99?/99?/9999$"), ("x/x/yyyy time", r"^99?/99?/9999 99?:99(:99)?( AA)?$"), ("x-x-yyyy", r"^99?-99?-9999$"), ("x.x.yyyy", r"^99?\.99?\.9999$"),
    ("dd mon yyyy", r"^99?[ -]AAA+[ -]9999$"), ("mon dd, yyyy", r"^AAA+ 99?, 9999$"), ("x/x/yy", r"^99?/99?/99$"), ("yyyymmdd", r"^99999999$"),
)
#: Formats that are tried in this order, so 03/04/2020 is March.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/M/d", "yyyy.MM.dd", "M/d/yyyy", "d/M/yyyy", "M/d/yyyy HH:mm", "d.M.yyyy", "d-M-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
THOUSANDS = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
CURRENCY = r"^\(?[+-]?[$€£¥₹] ?[+-]?[0-9][0-9,]*(\.[0-9]+)?\)?$|^[+-]?[0-9][0-9,]*(\.[0-9]+)? ?[$€£¥₹]$"
PERCENT = r"^[+-]?[0-9]+(\.[0-9]+)? ?%$"
UNUSUAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFD}\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00A0}]"


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, or null where it is missing."""
    return F.when(~is_missing(df, name), F.col(f"`{name}`"))


def finite(df: DataFrame, name: str) -> Column:
    """The value as a double, or null where it is missing or infinite."""
    x = present(df, name).cast("double")
    return F.when(~x.isin(float("inf"), float("-inf")), x)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def shape(c: Column, limit: int = 40) -> Column:
    """Letters as A, digits as 9, the rest kept; cut with an ellipsis."""
    out = F.regexp_replace(F.regexp_replace(F.substring(c, 1, limit), r"\p{L}", "A"), r"\p{Nd}", "9")
    return F.when(F.length(c) > limit, F.concat(out, F.lit("…"))).otherwise(out)


def compact_shape(c: Column) -> Column:
    """The shape with runs of two or more collapsed."""
    return F.regexp_replace(F.regexp_replace(shape(c), "A{2,}", "A+"), "9{2,}", "9+")


def number_kind(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(PLAIN), "plain").when(s.rlike(THOUSANDS), "thousands").when(s.rlike(CURRENCY), "currency").when(s.rlike(PERCENT), "percent")


def to_number(c: Column) -> Column:
    """A number out of text with signs of currency, thousands, percent or a negative in brackets; else null."""
    s = strip(c)
    bare = F.regexp_replace(s, r"[$€£¥₹,%()\s]", "")
    x = F.when(bare.rlike(PLAIN), bare.try_cast("double"))
    x = F.when(s.rlike(r"^\(.*\)$"), -x).otherwise(x)
    return F.when(s.rlike(r"%$"), x / 100).otherwise(x)


def date_shape(c: Column) -> Column:
    s, out = shape(strip(c)), F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in DATE_SHAPES:
        out = out.when(s.rlike(pattern), name)
    return out


def to_datetime(c: Column) -> Column:
    """The first format that reads the text, without a zone; bare numbers aren't dates."""
    s = strip(c)
    tries = [F.try_to_timestamp(F.when(~s.rlike(r"^[0-9.+-]+$") | s.rlike(r"^[0-9]{4}[-.][0-9]{2}[-.][0-9]{2}$"), s), F.lit(f)) for f in DATE_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def timezone_style(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(r"[0-9]Z$"), "Z").when(s.rlike(r":[0-9]{2}(\.[0-9]+)?\s?[+-][0-9]{2}:?[0-9]{2}$"), "offset").otherwise("none")


def boolean_token(c: Column) -> Column:
    s = F.lower(strip(c))
    return F.when(s.isin(*TRUE_TOKENS), F.lit(True)).when(s.isin(*FALSE_TOKENS), F.lit(False))


def is_uuid(c: Column) -> Column:
    return strip(c).rlike(UUID)


def normalize_label(c: Column) -> Column:
    """Lower case, separators as one space, other characters that aren't of words dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[\s_\-./]+", " "), r"(?U)[^\w ]", ""))


def is_placeholder(c: Column) -> Column:
    return F.lower(strip(c)).isin(*PLACEHOLDERS)


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def is_padded(c: Column) -> Column:
    return (strip(c) != c) & ~is_blank(c)


def has_unusual(c: Column) -> Column:
    return c.rlike(UNUSUAL)


def unusual(c: Column) -> Column:
    """The unusual characters of a text as U+XXXX, sorted."""
    return F.transform(F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({UNUSUAL})"), F.lit(1)))), lambda x: F.concat(F.lit("U+"), F.lpad(F.hex(F.expr("0L") + F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("long")), 4, "0")))


def period(c: Column, unit: str) -> Column:
    """The start of a value's hour, day, week (from Monday), month, quarter or year."""
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def redacted(c: Column) -> Column:
    return F.concat(F.lit("<label:"), F.substring(F.sha2(c, 256), 1, 8), F.lit(">"))
