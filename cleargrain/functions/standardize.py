"""One spelling per product, category, city, store and payment method.

``row_id`` is the zero-based position of the row in its file.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from cleargrain.functions import vocabulary as V
from cleargrain.functions.coerce import strip


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of ``key`` in a fixed vocabulary, null when absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def standard_product(product: Column) -> Column:
    return F.coalesce(F.lower(strip(product)), F.lit("unknown"))


def standard_category(
    category: Column,
    product: Column | None = None,
    by_product: Mapping[str, str] = V.REPAIR_PRODUCT_CATEGORY,
    synonyms: Mapping[str, str] = V.CATEGORY_SYNONYMS,
) -> Column:
    """Category of a known product, else the synonym's category, else ``unknown``."""
    options = [lookup(F.lower(strip(category)), synonyms), F.lit("unknown")]
    if product is not None:
        options.insert(0, lookup(F.lower(strip(product)), by_product))
    return F.coalesce(*options)


def _standard_place(value: Column, table: Mapping[str, str], missing: str) -> Column:
    key = F.lower(strip(value))
    known = F.coalesce(lookup(key, table), key)
    return F.when(key.isNull() | key.isin(*V.BLANK_WORDS, "unknown"), F.lit(missing)).otherwise(known)


def standard_city(city: Column, table: Mapping[str, str] = V.CITY_SPELLINGS) -> Column:
    return _standard_place(city, table, "unknown city")


def standard_store(store: Column, table: Mapping[str, str] = V.STORE_SPELLINGS) -> Column:
    return _standard_place(store, table, "unknown store")


def standard_payment(payment: Column) -> Column:
    key = F.lower(strip(payment))
    return (
        F.when(key.isNull() | key.isin(*V.BLANK_WORDS, "unknown"), F.lit("cash"))
        .when(key.contains("cred"), F.lit("credit_card"))
        .when(key.contains("pay"), F.lit("paypal"))
        .otherwise(payment)
    )


def email_needs_repair(email: Column) -> Column:
    """Blank, not exactly one ``@``, no dot after it, or a known dummy address."""
    text = strip(email)
    low = F.lower(text)
    at_signs = F.length(text) - F.length(F.replace(text, F.lit("@"), F.lit("")))
    domain = F.substring_index(text, "@", -1)
    return F.coalesce(
        low.isin(*V.BLANK_WORDS) | (at_signs != 1) | ~domain.contains(".") | low.contains("invalidemail"),
        F.lit(True),
    )


def repaired_email(email: Column, row_id: Column) -> Column:
    made = F.concat(F.lit("user"), (row_id + 1).cast("string"), F.lit("@example.com"))
    return F.when(email_needs_repair(email), made).otherwise(email)


def repaired_date(day: Column, as_of: Column) -> Column:
    """ISO text of a date; ``unknown_date`` when missing or after ``as_of``."""
    return F.when(day.isNull() | (day > as_of), F.lit("unknown_date")).otherwise(F.date_format(day, "yyyy-MM-dd"))


def class_name(label: Column) -> Column:
    return F.when(label == 0, F.lit("Normal")).when(label == 1, F.lit("Anomaly"))
