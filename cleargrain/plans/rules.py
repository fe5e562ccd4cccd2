"""Rule families and the full classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cleargrain.operators.classify import add_score, classify, flag_rows
from cleargrain.plans import fixture as X
from cleargrain.session import stage

OUTPUT = ["k", "has_anomaly", "anomaly_types", "anomaly_flags", "anomaly_severity"]


def _family(name: str, source):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir)
        return flag_rows(rows, [name], meta=["k"], options=X.OPTIONS).select(*OUTPUT)

    return run


def classify_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(X.typed_sales(spark, sf_dir), meta=["k"], options=X.OPTIONS)
    return rows.select(*OUTPUT, "anomaly_score", "severity_weight", "empty_count")


def classify_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(X.wide_sales(spark, sf_dir), meta=["k"], options=X.OPTIONS)
    return rows.select(*OUTPUT, "anomaly_score", "severity_weight", "empty_count")


def classify_retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(X.retail_sales(spark, sf_dir), meta=["k"], options=X.OPTIONS)
    return rows.select(*OUTPUT, "anomaly_score", "severity_weight", "empty_count")


def classify_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.sales(spark, sf_dir).withColumn("source_file", F.concat(F.lit("shop-"), F.coalesce("store", F.lit("none"))))
    rows = stage(X.clean_rules(X.keyed(rows)), "typed")
    out = classify(rows, scope=["source_file"], meta=["k"], options=X.OPTIONS)
    return out.select("source_file", *OUTPUT, "anomaly_score", "severity_weight", "empty_count")


def anomaly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = stage(flag_rows(X.typed_sales(spark, sf_dir), meta=["k"], options=X.OPTIONS))
    return add_score(flagged).select("k", "anomaly_flags", "anomaly_severity", "severity_weight", "anomaly_score")


QUERIES = {
    "classify_anomalies": classify_anomalies,
    "classify_raw": classify_raw,
    "classify_retail": classify_retail,
    "classify_per_file": classify_per_file,
    "anomaly_score": anomaly_score,
    "check_missing": _family("missing", X.holed_sales),
    "check_types": _family("types", X.wide_sales),
    "check_numeric": _family("numeric", X.wide_sales),
    "check_string_format": _family("string_format", X.wide_sales),
    "check_dates": _family("dates", X.wide_sales),
    "check_categorical": _family("categorical", X.wide_sales),
    "check_consistency": _family("consistency", X.wide_sales),
    "check_business": _family("business", X.wide_sales),
    "check_product_category": _family("product_category", X.typed_sales),
    "check_cross_column": _family("cross_column", X.typed_sales),
    "check_duplicates": _family("duplicates", X.copied_sales),
    "check_outliers": _family("outliers", X.typed_sales),
    "check_advanced": _family("advanced", X.typed_sales),
    "check_retail": _family("retail", X.retail_sales),
}

# ---- SQL counterparts -------------------------------------------------------------------------
# A rule is (tag, condition, weight, severity or None, soft).


class Source:
    """A table of the SQL side and how its columns read."""

    def __init__(self, cte: str, name: str, columns: list[str], typed: bool, scope: str = ""):
        self.cte, self.name, self.columns, self.typed, self.scope = cte, name, columns, typed, scope
        self.numbers = {"price", "quantity", "discount", "total"} if typed else set()
        self.days = {"date", "order_date", "shipping_date"} if typed else set()
        self.text = [c for c in columns if c not in self.numbers | self.days]

    def num(self, c, drop=""):
        return c if c in self.numbers else f"({X.sql_plain(c, drop)})"

    def day(self, c):
        if c == "InvoiceDate":
            return "try_strptime(InvoiceDate, '%m/%d/%Y %H:%M')"
        return f"cast({c} as timestamp)" if c in self.days else f"cast(({X.sql_date(c)}) as timestamp)"

    def part(self, *keys):
        return "partition by " + ", ".join([*([self.scope] if self.scope else []), *keys])

    def over(self):
        return f"partition by {self.scope}" if self.scope else ""


TYPED = Source(X.SQL_TYPED, "typed", X.SALES_COLUMNS, True)
WIDE = Source(X.SQL_WIDE, "wide", X.SALES_COLUMNS + X.EXTRA_COLUMNS, False)
RETAIL = Source(
    X.SQL_RETAIL, "retail",
    ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country", "Total"],
    False,
)
HOLED = Source(X.SQL_HOLED, "holed", ["order_id", "product_id", *[c for c in X.SALES_COLUMNS + X.EXTRA_COLUMNS if c not in ("order_id", "product_id")]], False)
COPIED = Source(X.SQL_COPIED, "copied", X.SALES_COLUMNS + X.EXTRA_COLUMNS, False)
PER_FILE = Source(
    X.SQL_TYPED + ", filed as (select *, 'shop-' || coalesce(store, 'none') as source_file from typed)",
    "filed", X.SALES_COLUMNS, True, "source_file",
)

PLACEHOLDER_LIST = "('N/A','N/a','na','unknown','Unknown','-','--','null','NULL')"


def _blank(c):
    return f"({c} is null or {X.sql_strip(c)} = '')"


def sql_missing(s: Source):
    critical = [next((c for c in pair if c in s.columns), None) for pair in (("price", "UnitPrice"), ("quantity", "Quantity"), ("order_id", "InvoiceNo"))]
    rules = [(f"{c}_null", f"{c} is null", 1, "critical" if c in critical else None, False) for c in s.columns]
    rules += [(f"{c}_empty", f"{c} in ('', 'nan')", 1, None, False) for c in s.text]
    rules += [(f"{c}_placeholder", f"{X.sql_strip(c)} in {PLACEHOLDER_LIST}", 1, None, False) for c in s.text]
    return rules + [("row_mostly_empty", f"empty_count > {0.5 * (len(s.columns) + 6)}", 3, None, False)]


def sql_empty_count(s: Source) -> str:
    cells = [f"({c} is null)::int" for c in s.columns] + [f"coalesce({c} in ('', 'N/A'), false)::int" for c in s.text]
    fired = " or ".join(f"coalesce({r[1]}, false)" for r in sql_missing(s)[:-1])
    return f"{' + '.join(cells)} + (not ({fired}))::int"


def sql_types(s):
    return [
        (f"{c}_not_numeric", f"{s.num(c)} is null and {c} is not null", 2, "high", False)
        for c in ("price", "quantity", "total", "discount", "stock") if c in s.columns
    ]


def sql_numeric(s):
    p = "price" if "price" in s.columns else "UnitPrice"
    q = "quantity" if "quantity" in s.columns else "Quantity"
    pn, qn = s.num(p), s.num(q, ",")
    rules = [
        ("price_not_numeric", f"{pn} is null and {p} is not null", 2, "high", False),
        ("price_negative", f"{pn} < 0", 2, "high", False),
        ("price_zero", f"{pn} = 0", 1, None, False),
        ("price_extreme_high", f"{pn} > 100000", 2, "medium", False),
        ("price_too_many_decimals", f"{pn} <> round({pn}, 2)", 1, None, False),
        ("quantity_not_numeric", f"{qn} is null and {q} is not null", 2, "high", False),
    ]
    if s.name != "retail":
        rules.append(("quantity_negative", f"{qn} < 0", 2, "high", False))
    rules += [("quantity_zero", f"{qn} = 0", 1, None, False), ("quantity_extreme", f"{qn} > 1000000", 2, None, False)]
    if "discount" in s.columns:
        d = s.num("discount", ",%")
        rules += [("discount_over_100", f"{d} > 100", 2, "high", False), ("discount_negative", f"{d} < 0", 2, None, False)]
    return rules


def sql_string_format(s):
    rules = []
    if "email" in s.columns:
        rules.append(("email_invalid_format", r"not regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')", 1, None, False))
    if "phone" in s.columns:
        rules.append(("phone_invalid_format", r"not regexp_matches(phone, '^\+?1?\d{9,15}$')", 1, None, False))
    return rules + [(f"{c}_missing", _blank(c), 2, "high", False) for c in ("order_id", "product_id", "customer_id") if c in s.columns]


def sql_dates(s):
    d = "date" if "date" in s.columns else "InvoiceDate"
    rules = [
        ("date_invalid_format", f"{s.day(d)} is null and {d} is not null", 2, "high", False),
        ("date_future", f"{s.day(d)} > {X.SQL_AS_OF}", 1, None, False),
        ("date_very_old", f"floor((epoch({X.SQL_AS_OF}) - epoch({s.day(d)})) / 86400) > 3650", 1, None, False),
    ]
    if "order_date" in s.columns:
        rules.append(("order_date_after_shipping", f"{s.day('order_date')} > {s.day('shipping_date')}", 2, "high", False))
    return rules


def sql_categorical(s):
    allowed = {
        "payment": "('cash','credit_card','debit_card','check','other')",
        "status": "('pending','completed','cancelled','returned')",
        "country": "('us','ca','uk','fr','de','other')",
    }
    rules = []
    for c, values in allowed.items():
        if c in s.columns:
            rules.append((f"{c}_not_in_allowed_list", f"lower({X.sql_strip(c)}) not in {values}", 1, None, False))
            rules.append((f"{c}_case_inconsistent", f"regexp_matches({c}, '[A-Z][a-z]|[a-z][A-Z]')", 0.5, None, True))
    return rules


def sql_consistency(s):
    return [(f"{c}_leading_trailing_spaces", f"length({c}) <> length({X.sql_strip(c)})", 0.5, None, True) for c in s.text]


def sql_business(s):
    rules = []
    if "price" in s.columns:
        p, q, t = s.num("price"), s.num("quantity"), s.num("total")
        rules.append(("total_price_mismatch", f"abs({t} - {p} * {q}) > 0.01", 3, "critical", False))
        rules.append(("shipping_date_before_order", f"{s.day('shipping_date')} < {s.day('order_date')}", 3, "critical", False))
        rules.append(("order_no_items", f"{q} < 1", 2, "high", False))
    if "stock" in s.columns:
        rules.append(("stock_negative", f"{s.num('stock')} < 0", 3, "critical", False))
        rules.append(("returned_no_return_date", f"lower(status) = 'returned' and {_blank('return_date')}", 2, "high", False))
    return rules


def sql_product_category(s):
    if "product" not in s.columns:
        return []
    pairs = "('apple','produce'),('milk','beverages'),('chicken','meat'),('bread','grains'),('rice','grains'),('juice','beverages'),('laptop','electronics'),('shirt','fashion'),('ice cream','frozen'),('eggs','dairy'),('chair','home')"
    p, c = f"lower({X.sql_strip('product')})", f"lower({X.sql_strip('category')})"
    expected = f"(select e from (values {pairs}) v(n, e) where n = {p})"
    return [("product_category_mismatch", f"{expected} is not null and coalesce({c}, 'nan') <> '' and coalesce({c}, 'nan') <> {expected}", 2, "high", False)]


def sql_cross_column(s):
    if "order_id" not in s.columns:
        return []
    t = s.num("total")
    a, b = s.part("order_id"), s.part("customer_id")
    return [
        ("same_order_different_totals", f"order_id is not null and (min({t}) over ({a}) < max({t}) over ({a}) or (count({t}) over ({a}) between 1 and count(*) over ({a}) - 1))", 1, None, False),
        ("same_customer_different_emails", f"customer_id is not null and (min(email) over ({b}) < max(email) over ({b}) or (count(email) over ({b}) between 1 and count(*) over ({b}) - 1))", 1, None, False),
    ]


def sql_duplicates(s):
    rules = [("exact_duplicate_row", f"count(*) over ({s.part(*s.columns)}) > 1", 2, "medium", False)]
    return rules + [
        (f"duplicate_{c}", f"{c} is not null and count(*) over ({s.part(c)}) > 1", 2, "high", False)
        for c in ("order_id", "product_id", "customer_id") if c in s.columns
    ]


def sql_outliers(s):
    rules = []
    for c in ("price", "quantity", "total"):
        if c in s.columns:
            x = s.num(c)
            q1, q3 = (f"quantile_cont({x}, {p}) over ({s.over()})" for p in (0.25, 0.75))
            rules.append((f"{c}_statistical_outlier", f"{x} < {q1} - 1.5 * ({q3} - {q1}) or {x} > {q3} + 1.5 * ({q3} - {q1})", 1, None, False))
    return rules


def sql_advanced(s):
    if "price" not in s.columns:
        return []
    p, q, w = s.num("price"), s.num("quantity"), s.over()
    return [
        ("unusual_quantity_spike", f"{q} > avg({q}) over ({w}) + 3 * stddev_samp({q}) over ({w})", 1, None, False),
        ("suspiciously_low_price", f"{p} < avg({p}) over ({w}) - 3 * stddev_samp({p}) over ({w})", 1, None, False),
    ]


def sql_retail(s):
    if s.name != "retail":
        return []
    q, p, t = s.num("Quantity"), s.num("UnitPrice"), s.num("Total")
    when = "try_strptime(InvoiceDate, '%m/%d/%Y %H:%M')"
    return [
        ("invoice_no_missing", _blank("InvoiceNo"), 2, "high", False),
        ("invoice_cancelled", "starts_with(InvoiceNo, 'C')", 1, "medium", False),
        ("quantity_not_numeric", f"{q} is null and Quantity is not null", 2, None, False),
        ("quantity_negative_return", f"{q} < 0", 1, "medium", False),
        ("quantity_zero", f"{q} = 0", 1, None, False),
        ("quantity_unusually_high", f"{q} > quantile_cont({q}, 0.95) over ()", 0.5, None, True),
        ("unit_price_not_numeric", f"{p} is null and UnitPrice is not null", 2, None, False),
        ("unit_price_negative", f"{p} < 0", 2, "high", False),
        ("unit_price_zero", f"{p} = 0", 1, None, False),
        ("unit_price_unusually_low", f"{p} < quantile_cont({p}, 0.05) over () and {p} > 0", 0.5, None, True),
        ("invoice_date_invalid", f"{when} is null and InvoiceDate is not null", 1, None, False),
        ("invoice_date_future", f"{when} > {X.SQL_AS_OF}", 1, None, False),
        ("description_missing", _blank("Description"), 1, None, False),
        ("country_missing", _blank("Country"), 1, None, False),
        ("stock_code_missing", _blank("StockCode"), 1, None, False),
        ("total_calculation_mismatch", f"abs({t} - abs({q}) * {p}) > 0.01", 2, None, False),
    ]


SQL_FAMILIES = {
    "missing": sql_missing, "types": sql_types, "numeric": sql_numeric, "string_format": sql_string_format,
    "dates": sql_dates, "categorical": sql_categorical, "consistency": sql_consistency, "business": sql_business,
    "product_category": sql_product_category, "cross_column": sql_cross_column, "duplicates": sql_duplicates,
    "outliers": sql_outliers, "advanced": sql_advanced, "retail": sql_retail,
}


def flagged_ctes(s: Source, families) -> str:
    """CTE text that ends in ``flagged``, the rows with the four rule columns."""
    rules = [r for f in families for r in SQL_FAMILIES[f](s)]
    scope = f"{s.scope}, " if s.scope else ""
    bools = ", ".join(f"coalesce({cond}, false) as r{i}" for i, (_, cond, *_rest) in enumerate(rules))
    tags = " || ".join(f"case when r{i} then '{r[0]}|' else '' end" for i, r in enumerate(rules))
    flags = " + ".join(f"case when r{i} then {float(r[2])}::double else 0::double end" for i, r in enumerate(rules))
    last = [f"when r{i} then '{r[3]}'" for i, r in enumerate(rules) if r[3]][::-1]
    severity = f"case {' '.join(last)} else 'low' end" if last else "'low'"
    marked = " or ".join(f"r{i}" for i, r in enumerate(rules) if not r[4]) or "false"
    return f"""{s.cte}, counted as (select *, cast({sql_empty_count(s)} as bigint) as empty_count from {s.name}),
fired as (select {scope}k, empty_count, {bools} from counted),
flagged as (select {scope}k, empty_count, {marked} as has_anomaly, {tags} as anomaly_types, {flags} as anomaly_flags,
 {severity} as anomaly_severity from fired)"""


def scored_ctes(s: Source, families=tuple(SQL_FAMILIES)) -> str:
    """``flagged_ctes`` followed by ``scored``."""
    return flagged_ctes(s, families) + f""", weighted as (select *, cast(case anomaly_severity when 'low' then 10 when 'medium' then 25
 when 'high' then 50 when 'critical' then 100 else 0 end as bigint) as severity_weight, max(anomaly_flags) over ({s.over()}) as top from flagged),
scored as (select * exclude (top), ((case when top > 0 then anomaly_flags / top * 50 else 0 end) + severity_weight) / 2 as anomaly_score from weighted)"""


def _family_sql(family: str, s: Source) -> str:
    return f"with {flagged_ctes(s, [family])} select {', '.join(OUTPUT)} from flagged"


_FULL = ", ".join([*OUTPUT, "anomaly_score", "severity_weight", "empty_count"])
ORACLES = {
    "classify_anomalies": f"with {scored_ctes(TYPED)} select {_FULL} from scored",
    "classify_raw": f"with {scored_ctes(WIDE)} select {_FULL} from scored",
    "classify_retail": f"with {scored_ctes(RETAIL)} select {_FULL} from scored",
    "classify_per_file": f"with {scored_ctes(PER_FILE)} select source_file, {_FULL} from scored",
    "anomaly_score": f"with {scored_ctes(TYPED)} select k, anomaly_flags, anomaly_severity, severity_weight, anomaly_score from scored",
    "check_missing": _family_sql("missing", HOLED),
    "check_types": _family_sql("types", WIDE),
    "check_numeric": _family_sql("numeric", WIDE),
    "check_string_format": _family_sql("string_format", WIDE),
    "check_dates": _family_sql("dates", WIDE),
    "check_categorical": _family_sql("categorical", WIDE),
    "check_consistency": _family_sql("consistency", WIDE),
    "check_business": _family_sql("business", WIDE),
    "check_product_category": _family_sql("product_category", TYPED),
    "check_cross_column": _family_sql("cross_column", TYPED),
    "check_duplicates": _family_sql("duplicates", COPIED),
    "check_outliers": _family_sql("outliers", TYPED),
    "check_advanced": _family_sql("advanced", TYPED),
    "check_retail": _family_sql("retail", RETAIL),
}
