"""Text to number and text to date, with null instead of an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Tokens that a CSV reader turns into null.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Columns that are read as numbers and as dates.
NUMBER_COLUMNS = ["price", "quantity", "discount", "total_price", "total"]
DATE_COLUMNS = ["date", "order_date", "shipping_date"]

DEFAULT_DATE_FORMATS = ("yyyy-MM-dd",)

# Date formats that are recognised, in order of preference, and the shape that a value must have.
DATE_FORMATS = {
    "yyyy-MM-dd": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "yyyy-MM-dd HH:mm:ss": r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$",
    "yyyy-MM-dd HH:mm": r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$",
    "yyyy/M/d": r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$",
    "M/d/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "M/d/yyyy H:mm": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$",
    "M/d/yyyy H:mm:ss": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$",
    "d/M/yyyy": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "d/M/yyyy H:mm": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}$",
    "d/M/yyyy H:mm:ss": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$",
    "M-d-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
    "d-M-yyyy": r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$",
    "d.M.yyyy": r"^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$",
    "yyyyMMdd": r"^(19|20)[0-9]{6}$",
    "d MMM yyyy": r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}$",
    "MMM d, yyyy": r"^[A-Z][a-z]{2} [0-9]{1,2}, [0-9]{4}$",
}

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def strip(c: Column) -> Column:
    """Remove outer whitespace of every kind; ``trim`` removes spaces only."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_number_type(dtype: str) -> bool:
    return dtype in _NUMERIC_TYPES or dtype.startswith("decimal")


def _checked_double(c: Column) -> Column:
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def to_number(c: Column) -> Column:
    """Number after removing ``$``, ``,`` and whitespace; null when not a number."""
    return _checked_double(F.regexp_replace(c.cast("string"), r"[$,\s]", ""))


def plain_number(c: Column, drop: str = "") -> Column:
    """Number after stripping and removing the characters in ``drop`` only."""
    text = strip(c.cast("string"))
    if drop:
        text = F.regexp_replace(text, f"[{drop}]", "")
    return _checked_double(text)


def number_view(c: Column, dtype: str, drop: str = "") -> Column:
    """``c`` as a double whatever its type; NaN counts as missing."""
    if is_number_type(dtype):
        value = c.cast("double")
        return F.when(~F.isnan(value), value) if dtype in ("float", "double") else value
    return plain_number(c, drop)


def to_time(c: Column, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """Timestamp by the first format that fits; null when none does."""
    parsed = []
    for fmt in formats:
        if fmt == "yyyy-MM-dd":
            iso = F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c.try_cast("date"))
            parsed.append(iso.cast("timestamp"))
        elif fmt in DATE_FORMATS:  # a failed parse is dear, so the shape is looked at first
            parsed.append(F.when(c.rlike(DATE_FORMATS[fmt]), F.try_to_timestamp(c, F.lit(fmt))))
        else:
            parsed.append(F.try_to_timestamp(c, F.lit(fmt)))
    return F.coalesce(*parsed)


def has_time(fmt: str) -> bool:
    return "H" in fmt or "h" in fmt


def date_view(c: Column, dtype: str, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """``c`` as a timestamp whatever its type."""
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return c.cast("timestamp")
    return to_time(c.cast("string"), formats)


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    """Replace the null tokens of a text file in every string column."""
    cols = [
        F.when(~F.col(f"`{n}`").isin(NULL_TOKENS), F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`")
        for n, t in df.dtypes
    ]
    return df.select(*cols)


def trim_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def clean_rules(df: DataFrame, date_formats: Sequence[str] | None = DEFAULT_DATE_FORMATS) -> DataFrame:
    """Coerce the number and date columns that exist; anything unreadable is null.

    Without ``date_formats`` the dates stay as they are.
    """
    df = trim_column_names(df)
    types = dict(df.dtypes)
    timed = any(has_time(f) for f in date_formats or ())
    changed = {}
    for name in NUMBER_COLUMNS:
        if name in types:
            is_number = is_number_type(types[name])
            changed[name] = number_view(F.col(name), types[name]) if is_number else to_number(F.col(name))
    for name in DATE_COLUMNS if date_formats is not None else ():
        if name in types:
            when = date_view(F.col(name), types[name], date_formats)
            changed[name] = when if timed else when.cast("date")
    return df.withColumns(changed) if changed else df
