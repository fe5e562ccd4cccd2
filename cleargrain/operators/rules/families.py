"""The rule families in their order of execution.

Each family turns a table into the rules that apply to its columns. A null
condition counts as "not fired".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from cleargrain.functions import vocabulary as V
from cleargrain.functions.coerce import strip
from cleargrain.operators.rules.table import Hit, RuleTable

IDS = ["order_id", "product_id", "customer_id"]
METADATA_COLUMNS = 6  # columns that the rule stage itself adds before the emptiness test


def missing_cells(t: RuleTable) -> str:
    """Number of missing cells of a row, as SQL text."""
    cells = []
    for name in t.columns:
        test = f"`{name}` is null"
        if t.types[name] == "string":
            test += f" or `{name}` in ('', 'N/A')"
        cells.append(f"cast({test} as bigint)")
    return " + ".join(cells)


def _cell_rules(t: RuleTable) -> list[Hit]:
    critical = t.critical()
    hits = [Hit(f"{n}_null", t.raw(n).isNull(), 1, "critical" if n in critical else None, on_cell=True) for n in t.columns]
    hits += [Hit(f"{n}_empty", t.raw(n).isin("", "nan"), 1, on_cell=True) for n in t.text_columns()]
    hits += [Hit(f"{n}_placeholder", t.stripped(n).isin(V.PLACEHOLDERS), 1, on_cell=True) for n in t.text_columns()]
    return hits


def missing(t: RuleTable) -> list[Hit]:
    half = 0.5 * (len(t.columns) + METADATA_COLUMNS)
    return _cell_rules(t) + [Hit("row_mostly_empty", F.col("empty_count") > half, 3, late=True)]


def types(t: RuleTable) -> list[Hit]:
    return [
        Hit(f"{n}_not_numeric", t.number(n).isNull() & t.raw(n).isNotNull(), 2, "high")
        for n in ["price", "quantity", "total", "discount", "stock"]
        if t.has(n)
    ]


def numeric(t: RuleTable) -> list[Hit]:
    o, hits = t.options, []
    if name := t.first("price", "UnitPrice"):
        price = t.number(name)
        hits += [
            Hit("price_not_numeric", t.unreadable(name), 2, "high"),
            Hit("price_negative", price < 0, 2, "high"),
            Hit("price_zero", price == 0, 1),
            Hit("price_extreme_high", price > o.price_max, 2, "medium"),
            Hit("price_too_many_decimals", price != F.round(price, 2), 1),
        ]
    if name := t.first("quantity", "Quantity"):
        quantity = t.number(name, ",")
        hits.append(Hit("quantity_not_numeric", t.unreadable(name, ","), 2, "high"))
        if t.kind != "retail":
            hits.append(Hit("quantity_negative", quantity < 0, 2, "high"))
        hits += [
            Hit("quantity_zero", quantity == 0, 1),
            Hit("quantity_extreme", quantity > o.quantity_max, 2),
        ]
    if t.has("discount"):
        discount = t.number("discount", ",%")
        hits += [
            Hit("discount_over_100", discount > o.discount_max, 2, "high"),
            Hit("discount_negative", discount < o.discount_min, 2),
        ]
    return hits


def string_format(t: RuleTable) -> list[Hit]:
    hits = []
    if t.has("email"):
        hits.append(Hit("email_invalid_format", ~t.raw("email").rlike(V.EMAIL_PATTERN), 1))
    if t.has("phone"):
        hits.append(Hit("phone_invalid_format", ~t.raw("phone").cast("string").rlike(V.PHONE_PATTERN), 1))
    return hits + [Hit(f"{n}_missing", t.missing(n), 2, "high") for n in IDS if t.has(n)]


def judged_dates(columns: Sequence[str]) -> list[str]:
    """Date columns that the rules parse."""
    main = [n for n in ("date", "InvoiceDate") if n in columns][:1]
    return main + ([n for n in ("order_date", "shipping_date") if n in columns] if {"order_date", "shipping_date"} <= set(columns) else [])


def dates(t: RuleTable) -> list[Hit]:
    o, hits = t.options, []
    if name := t.first("date", "InvoiceDate"):
        day = t.time(name)
        age = F.floor((F.unix_timestamp(o.now) - F.unix_timestamp(day)) / 86400)
        hits += [
            Hit("date_invalid_format", day.isNull() & t.raw(name).isNotNull(), 2, "high"),
            Hit("date_future", day > o.now, 1),
            Hit("date_very_old", age > o.max_age_days, 1),
        ]
    if t.has("order_date", "shipping_date"):
        late = t.time("order_date") > t.time("shipping_date")
        hits.append(Hit("order_date_after_shipping", late, 2, "high"))
    return hits


def categorical(t: RuleTable) -> list[Hit]:
    hits = []
    for name, values in t.options.allowed.items():
        if t.has(name):
            hits.append(
                Hit(f"{name}_not_in_allowed_list", ~F.lower(t.stripped(name)).isin([v.lower() for v in values]), 1)
            )
            mixed = t.raw(name).cast("string").rlike("[A-Z][a-z]|[a-z][A-Z]")
            hits.append(Hit(f"{name}_case_inconsistent", mixed, 0.5, soft=True))
    return hits


def consistency(t: RuleTable) -> list[Hit]:
    return [
        Hit(f"{n}_leading_trailing_spaces", F.length(t.raw(n)) != F.length(t.stripped(n)), 0.5, soft=True)
        for n in t.text_columns()
    ]


def business(t: RuleTable) -> list[Hit]:
    hits = []
    if t.has("price", "quantity", "total"):
        gap = F.abs(t.number("total") - t.number("price") * t.number("quantity"))
        hits.append(Hit("total_price_mismatch", gap > 0.01, 3, "critical"))
    if t.has("order_date", "shipping_date"):
        early = t.time("shipping_date") < t.time("order_date")
        hits.append(Hit("shipping_date_before_order", early, 3, "critical"))
    if t.has("quantity"):
        hits.append(Hit("order_no_items", t.number("quantity") < 1, 2, "high"))
    if t.has("stock"):
        hits.append(Hit("stock_negative", t.number("stock") < 0, 3, "critical"))
    if t.has("status", "return_date"):
        returned = F.lower(t.raw("status").cast("string")) == "returned"
        hits.append(Hit("returned_no_return_date", returned & t.missing("return_date"), 2, "high"))
    return hits


def product_category(t: RuleTable) -> list[Hit]:
    if not t.has("product", "category"):
        return []
    expected = F.col("__expected_category")
    given = F.lower(t.stripped("category"))
    wrong = expected.isNotNull() & (given.isNull() | ((given != "") & (given != expected)))
    return [Hit("product_category_mismatch", wrong, 2, "high")]


def cross_column(t: RuleTable) -> list[Hit]:
    hits = []
    if t.has("order_id", "total"):
        hits.append(Hit("same_order_different_totals", F.col("__order_id_differs"), 1))
    if t.has("customer_id", "email"):
        hits.append(Hit("same_customer_different_emails", F.col("__customer_id_differs"), 1))
    return hits


def duplicates(t: RuleTable) -> list[Hit]:
    hits = [Hit("exact_duplicate_row", F.col("__same_row"), 2, "medium")]
    return hits + [Hit(f"duplicate_{n}", F.col(f"__{n}_repeats"), 2, "high") for n in IDS if t.has(n)]


def outliers(t: RuleTable) -> list[Hit]:
    hits = []
    for name in ["price", "quantity", "total"]:
        if t.has(name):
            x, q1, q3 = t.number(name), F.col(f"__stats.{name}_q1"), F.col(f"__stats.{name}_q3")
            spread = (q3 - q1) * 1.5
            hits.append(Hit(f"{name}_statistical_outlier", (x < q1 - spread) | (x > q3 + spread), 1))
    return hits


def advanced(t: RuleTable) -> list[Hit]:
    hits = []
    if t.has("quantity"):
        top = F.col("__stats.quantity_mean") + 3 * F.col("__stats.quantity_std")
        hits.append(Hit("unusual_quantity_spike", t.number("quantity") > top, 1))
    if t.has("price"):
        bottom = F.col("__stats.price_mean") - 3 * F.col("__stats.price_std")
        hits.append(Hit("suspiciously_low_price", t.number("price") < bottom, 1))
    return hits


def retail(t: RuleTable) -> list[Hit]:
    if t.kind != "retail":
        return []
    quantity, price = t.number("Quantity"), t.number("UnitPrice")
    hits = [
        Hit("invoice_no_missing", t.missing("InvoiceNo"), 2, "high"),
        Hit("invoice_cancelled", t.raw("InvoiceNo").cast("string").startswith("C"), 1, "medium"),
        Hit("quantity_not_numeric", t.unreadable("Quantity"), 2),
        Hit("quantity_negative_return", quantity < 0, 1, "medium"),
        Hit("quantity_zero", quantity == 0, 1),
        Hit("quantity_unusually_high", quantity > F.col("__stats.Quantity_p95"), 0.5, soft=True),
        Hit("unit_price_not_numeric", t.unreadable("UnitPrice"), 2),
        Hit("unit_price_negative", price < 0, 2, "high"),
        Hit("unit_price_zero", price == 0, 1),
        Hit("unit_price_unusually_low", (price < F.col("__stats.UnitPrice_p05")) & (price > 0), 0.5, soft=True),
    ]
    if t.has("InvoiceDate"):
        when = t._helper(
            "__invoice_time", F.try_to_timestamp(strip(t.raw("InvoiceDate").cast("string")), F.lit("M/d/yyyy H:mm"))
        )
        hits += [
            Hit("invoice_date_invalid", when.isNull() & t.raw("InvoiceDate").isNotNull(), 1),
            Hit("invoice_date_future", when > t.options.now, 1),
        ]
    for name, tag in [("Description", "description"), ("Country", "country"), ("StockCode", "stock_code")]:
        if t.has(name):
            hits.append(Hit(f"{tag}_missing", t.missing(name), 1))
    if name := t.first("Total", "total"):
        gap = F.abs(t.number(name) - F.abs(quantity) * price)
        hits.append(Hit("total_calculation_mismatch", gap > 0.01, 2))
    return hits


FAMILIES = {
    "missing": missing,
    "types": types,
    "numeric": numeric,
    "string_format": string_format,
    "dates": dates,
    "categorical": categorical,
    "consistency": consistency,
    "business": business,
    "product_category": product_category,
    "cross_column": cross_column,
    "duplicates": duplicates,
    "outliers": outliers,
    "advanced": advanced,
    "retail": retail,
}
