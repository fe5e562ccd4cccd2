"""Standardisers, imputation, id allocation and the repair stage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from cleargrain.functions import standardize as S, vocabulary as V
from cleargrain.functions.coerce import clean_rules, date_view, to_number
from cleargrain.operators import corrections as C, ids, repair as R
from cleargrain.operators.date_formats import clean_inferred, infer_formats, parse_dates
from cleargrain.operators.rules.table import retail_as_sales
from cleargrain.plans import fixture as X
from cleargrain.session import stage



def as_of():
    return F.lit(X.AS_OF)


def _one(name, build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.sales(spark, sf_dir).select("k", build().alias(name))

    return run


def clean_numeric(spark, sf_dir):
    return X.sales(spark, sf_dir).select("k", *[to_number(F.col(c)).alias(c) for c in ("price", "quantity", "discount", "total")])


def clean(spark, sf_dir):
    return clean_rules(X.sales(spark, sf_dir))


def repair_email(spark, sf_dir):
    rows = X.numbered_sales(spark, sf_dir)
    return rows.select("k", "row_id", S.repaired_email(F.col("email"), F.col("row_id")).alias("email"))


def repair_date(spark, sf_dir):
    return X.sales(spark, sf_dir).select("k", S.repaired_date(date_view(F.col("date"), "string"), as_of()).alias("date"))


def repair_retail(spark, sf_dir):
    rows = R.repair_values(retail_as_sales(X.retail_sales(spark, sf_dir)), as_of=as_of())
    return rows.select("k", "price", "quantity", "date", "fix_date_missing_replaced", "fix_date_future_replaced")


def infer_date_formats(spark, sf_dir):
    return infer_formats(X.dated(spark, sf_dir), ["date"], ["shop"])


def parse_dates_per_shop(spark, sf_dir):
    rows, times, _ = parse_dates(X.dated(spark, sf_dir), ["date"], ["shop"])
    return rows.select("k", "shop", times["date"].cast("date").alias("day"))


def clean_dates_per_shop(spark, sf_dir):
    return clean_inferred(X.dated(spark, sf_dir).drop("day"), ["shop"]).select("k", "shop", F.col("date").cast("timestamp").alias("date"))


def with_row_id(spark, sf_dir):
    return X.numbered_sales(spark, sf_dir).select("k", "row_id")


def _typed_numbered(spark, sf_dir):
    return stage(clean_rules(X.numbered_sales(spark, sf_dir)), "typed")


def _labelled(spark, sf_dir):
    rows = clean_rules(X.keyed(X.sales(spark, sf_dir)))
    return stage(R.repair_labels(rows), "labels")


def _impute(column):
    def run(spark, sf_dir):
        rows = _labelled(spark, sf_dir).select("k", "row_id", "product", "category", column)
        return R.attach_medians(rows, [column], []).select("k", column, F.col(f"__fill_{column}").alias("fill_value"))

    return run


def positive_median(spark, sf_dir):
    return R.positive_median(X.typed_sales(spark, sf_dir), "price").select("median")


def _repaired_number(column):
    def run(spark, sf_dir):
        return R.repair_numbers(_labelled(spark, sf_dir)).select("k", column)

    return run


def duplicate_rank(spark, sf_dir):
    return ids.repeated_ids(stage(X.numbered_sales(spark, sf_dir)), "order_id").select("row_id", "order_id", "rank")


def allocate_ids(spark, sf_dir):
    rows = stage(X.numbered_sales(spark, sf_dir).select("row_id", "sale_id"))
    used = rows.filter("sale_id is not null").select(ids.sale_number(F.col("sale_id")).alias("number"))
    asks = rows.filter("sale_id is null").select("row_id", F.floor(F.col("row_id") / 10 + 1).alias("start"))
    return ids.allocate_numbers(used, asks)


def _fill(column):
    def run(spark, sf_dir):
        rows = stage(X.numbered_sales(spark, sf_dir).select("row_id", column))
        return ids.fill_ids(rows, [column])

    return run


def _dedupe(column):
    def run(spark, sf_dir):
        rows = stage(X.numbered_sales(spark, sf_dir).select("row_id", column))
        rows = rows.filter(F.col(column).isNotNull())
        return ids.dedupe_ids(rows, [column])

    return run


def drop_exact_duplicates(spark, sf_dir):
    rows = X.keyed(X.sales(spark, sf_dir)).select("row_id", "customer_id", "product", "category", "store", "city")
    return R.drop_exact_duplicates(rows)


def repair_values(spark, sf_dir):
    rows = R.repair_values(_typed_numbered(spark, sf_dir), as_of=as_of())
    return rows.drop("__payment_changed")


def repair_pipeline(spark, sf_dir):
    return R.repair(_typed_numbered(spark, sf_dir), as_of=as_of()).select("row_id", *X.SALES_COLUMNS, "row_changed")


def fix_counts(spark, sf_dir):
    return R.fix_counts(R.repair(_typed_numbered(spark, sf_dir), as_of=as_of()))


CORRECTIONS = """select k, case when k % 3 = 0 then '{"price": "9.5", "city": "sousse", "extra": "x"}'
 when k % 3 = 1 then '{"product": "tea"}' else 'no json here' end as response from sales where price is null or price = 'abc'"""


def _corrections(rows):
    third = F.pmod("k", F.lit(3))
    text = F.when(third == 0, F.lit('{"price": "9.5", "city": "sousse", "extra": "x"}')).when(
        third == 1, F.lit('{"product": "tea"}')
    ).otherwise(F.lit("no json here"))
    return rows.filter("price is null or price = 'abc'").select("k", text.alias("response"))


def apply_corrections(spark, sf_dir):
    rows = stage(X.sales(spark, sf_dir))
    out = C.apply_corrections(rows, _corrections(rows), key="k")
    return out.select("k", "product", "price", "city", "quantity", "llm_correction_applied", "llm_raw_response")


def correction_counts(spark, sf_dir):
    rows = stage(X.sales(spark, sf_dir))
    return C.correction_counts(C.apply_corrections(rows, _corrections(rows), key="k"))


def apply_json_patch(spark, sf_dir):
    events = X.table(spark, sf_dir, "events").withColumn("k", F.lit(None).cast("bigint"))
    return C.apply_json_patch(events, "props").select("event_id", "k")


QUERIES = {
    "clean_numeric": clean_numeric,
    "clean_rules": clean,
    "std_product": _one("product", lambda: S.standard_product(F.col("product"))),
    "std_category": _one("category", lambda: S.standard_category(F.col("category"), F.col("product"))),
    "std_city": _one("city", lambda: S.standard_city(F.col("city"))),
    "std_store": _one("store", lambda: S.standard_store(F.col("store"))),
    "std_payment": _one("payment_method", lambda: S.standard_payment(F.col("payment_method"))),
    "repair_email": repair_email,
    "repair_date": repair_date,
    "repair_retail": repair_retail,
    "infer_date_formats": infer_date_formats,
    "parse_dates_per_shop": parse_dates_per_shop,
    "clean_dates_per_shop": clean_dates_per_shop,
    "with_row_id": with_row_id,
    "impute_price_hierarchical": _impute("price"),
    "impute_quantity_hierarchical": _impute("quantity"),
    "positive_median": positive_median,
    "repair_price": _repaired_number("price"),
    "repair_quantity": _repaired_number("quantity"),
    "repair_total": _repaired_number("total"),
    "duplicate_rank": duplicate_rank,
    "allocate_ids": allocate_ids,
    "fill_sale_id": _fill("sale_id"),
    "fill_order_id": _fill("order_id"),
    "dedupe_sale_id": _dedupe("sale_id"),
    "dedupe_order_id": _dedupe("order_id"),
    "drop_exact_duplicates": drop_exact_duplicates,
    "repair_values": repair_values,
    "repair_pipeline": repair_pipeline,
    "fix_counts": fix_counts,
    "apply_corrections": apply_corrections,
    "correction_counts": correction_counts,
    "apply_json_patch": apply_json_patch,
}

# ---- SQL counterparts -------------------------------------------------------------------------


def _case(table: dict[str, str], key: str) -> str:
    return f"case {key} " + " ".join("when '{}' then '{}'".format(a, b) for a, b in table.items()) + " end"


_P, _C = f"lower({X.sql_strip('product')})", f"lower({X.sql_strip('category')})"
PRODUCT = f"coalesce({_P}, 'unknown')"
FILLED_PRODUCT = f"case when {_P} is null or {_P} in ('', 'none', 'nan') then 'unknown' else {_P} end"
CATEGORY = f"coalesce({_case(V.REPAIR_PRODUCT_CATEGORY, _P)}, {_case(V.CATEGORY_SYNONYMS, _C)}, 'unknown')"


def _place(name: str, table) -> str:
    key = f"lower({X.sql_strip(name)})"
    return f"case when {key} is null or {key} in ('', 'none', 'nan', 'unknown') then 'unknown {name}' else coalesce({_case(table, key)}, {key}) end"


CITY, STORE = _place("city", V.CITY_SPELLINGS), _place("store", V.STORE_SPELLINGS)
_PAY = f"lower({X.sql_strip('payment_method')})"
PAYMENT = f"case when {_PAY} is null or {_PAY} in ('', 'none', 'nan', 'unknown') then 'cash' when contains({_PAY}, 'cred') then 'credit_card' when contains({_PAY}, 'pay') then 'paypal' else payment_method end"
_EM = X.sql_strip("email")
BAD_EMAIL = f"(email is null or lower({_EM}) in ('', 'none', 'nan') or length({_EM}) - length(replace({_EM}, '@', '')) <> 1 or not contains(split_part({_EM}, '@', 2), '.') or contains(lower({_EM}), 'invalidemail'))"
EMAIL = f"case when {BAD_EMAIL} then 'user' || cast(row_id + 1 as varchar) || '@example.com' else email end"


def _date(day: str) -> str:
    return f"case when {day} is null or {day} > {X.SQL_AS_OF} then 'unknown_date' else strftime({day}, '%Y-%m-%d') end"


# labels, medians and numbers of the repair stage on top of a CTE named ``src``
LABELLED = f"""labelled as (select * replace ({FILLED_PRODUCT} as product, {CATEGORY} as category, {STORE} as store, {CITY} as city, {PAYMENT} as payment_method),
 product as raw_product, category as raw_category, store as raw_store, city as raw_city, payment_method as raw_payment from src),
by_product as (select product, median(price) filter (price > 0) as pm, median(quantity) filter (quantity > 0) as qm from labelled group by 1),
by_category as (select category, median(price) filter (price > 0) as pc, median(quantity) filter (quantity > 0) as qc from labelled group by 1),
overall as (select median(price) filter (price > 0) as pa, median(quantity) filter (quantity > 0) as qa from labelled),
filled as (select *, coalesce(pm, pc, pa, 1.0) as price_fill, coalesce(qm, qc, qa, 1.0) as quantity_fill
 from labelled left join by_product using (product) left join by_category using (category), overall),
numbers as (select *, case when price is null or price = 0 then price_fill else abs(price) end as new_price,
 case when quantity is null or quantity = 0 then quantity_fill else abs(quantity) end as new_quantity from filled),
totals as (select *, floor(new_price * new_quantity * 100 + 0.5) / 100 as fresh from numbers),
judged as (select *, (total is null or total <= 0 or abs(total - fresh) > 0.01) as total_wrong from totals)"""
_SRC_K = f"with {X.SQL_TYPED}, src as (select * from typed), {LABELLED}"
_SRC_ROW = f"with {X.SQL_TYPED}, src as (select *, row_number() over (order by k) - 1 as row_id from typed), {LABELLED}"


def _b(raw: str) -> str:
    return f"({raw} is null or lower({X.sql_strip(raw)}) in ('', 'none', 'nan'))"


FLAGS = {
    "product_filled": _b("raw_product"),
    "product_standardized": f"not {_b('raw_product')} and {X.sql_strip('raw_product')} <> product",
    "category_filled": _b("raw_category"),
    "category_standardized": f"not {_b('raw_category')} and {X.sql_strip('raw_category')} <> category",
    "store_filled": "store = 'unknown store'",
    "store_standardized": f"store <> 'unknown store' and lower({X.sql_strip('raw_store')}) <> store",
    "city_filled": "city = 'unknown city'",
    "city_standardized": f"city <> 'unknown city' and lower({X.sql_strip('raw_city')}) <> city",
    "payment_method_filled": f"({_b('raw_payment')} or lower({X.sql_strip('raw_payment')}) = 'unknown')",
    "price_made_positive": "coalesce(price < 0, false)",
    "price_filled_hierarchical": "price is null",
    "price_zero_replaced": "coalesce(price = 0, false)",
    "quantity_made_positive": "coalesce(quantity < 0, false)",
    "quantity_filled_hierarchical": "(quantity is null or quantity = 0)",
    "total_recalculated": "total_wrong",
    "email_fixed": BAD_EMAIL,
    "date_missing_replaced": "date is null",
    "date_future_replaced": f"coalesce(date > {X.SQL_AS_OF}, false)",
}
_FLAG_COLUMNS = ", ".join(f"{sql} as fix_{name}" for name, sql in FLAGS.items())
_VALUES = f"""product, category, new_price as price, new_quantity as quantity, discount,
 case when total_wrong then fresh else total end as total, {_date('date')} as date, order_date, shipping_date, {EMAIL} as email, payment_method, store, city"""


def _allocate(existing: str, requests: str) -> str:
    """CTEs ending in ``given(row_id, number)``; the direct form over all free numbers."""
    return f"""used as (select distinct number from ({existing}) where number > 0),
asked as (select *, row_number() over (order by start, row_id) as n from ({requests})),
points as (select start as p, 0 as kind, n, row_id from asked union all select number, 1, null, null from used),
counted as (select *, sum(kind) over (order by p, kind, n rows unbounded preceding) as below from points),
lead_of as (select row_id, n, n + max(p - below - n) over (order by n rows unbounded preceding) as want from counted where kind = 0),
free as (select x, row_number() over (order by x) as want from range(1, (select coalesce(max(number), 0) + (select count(*) + coalesce(max(start), 0) from asked) + 2 from used)) t(x)
 where x not in (select number from used)),
given as (select row_id, x as number from lead_of join free using (want))"""


_SALE = f"cast({X.sql_plain('sale_id')} as bigint)"
_ORDER = "case when regexp_matches(order_id, '^ORD[0-9]{4,18}$') and (length(order_id) = 7 or order_id[4] <> '0') then cast(substr(order_id, 4) as bigint) end"
_ORD_TEXT = "'ORD' || case when number < 10000 then lpad(cast(number as varchar), 4, '0') else cast(number as varchar) end"


def _fill_sql(column: str) -> str:
    number, text = (_SALE, "cast(number as varchar)") if column == "sale_id" else (_ORDER, _ORD_TEXT)
    return f"""with {X.SQL_NUMBERED}, {_allocate(f'select {number} as number from numbered where {column} is not null',
 f'select row_id, row_id + 1 as start from numbered where {column} is null')}
select row_id, coalesce({column}, {text}) as {column}, {column} is null as {column}_generated from numbered left join given using (row_id)"""


def _dedupe_ctes(column: str, source: str) -> str:
    number, text = (_SALE, "cast(number as varchar)") if column == "sale_id" else (_ORDER, _ORD_TEXT)
    start = f"coalesce({_SALE}, rank)" if column == "sale_id" else (
        "rank + coalesce(case when regexp_matches(tail, '^[0-9]{1,18}$') then cast(tail as bigint) end, rank)"
    )
    return f"""ranked as (select row_id, {column}, case when upper(substr({column}, 1, 3)) = 'ORD' then substr({column}, 4) else {column} end as tail,
 row_number() over (partition by {column} order by row_id) - 1 as rank from {source} where {column} is not null),
{_allocate(f'select {number} as number from {source}', f'select row_id, greatest({start}, 1) as start from ranked where rank > 0')},
fixed as (select s.* replace (coalesce({text}, {column}) as {column}), number is not null as {column}_changed from {source} s left join given using (row_id))"""


def _dedupe_sql(column: str) -> str:
    return f"""with {X.SQL_NUMBERED}, kept as (select row_id, {column} from numbered where {column} is not null),
{_dedupe_ctes(column, 'kept')} select * from fixed"""


def _rename(ctes: str, mark: str) -> str:
    for name in ("used", "asked", "points", "counted", "lead_of", "free", "given", "ranked", "fixed"):
        ctes = re.sub(rf"\b{name}\b", f"{name}_{mark}", ctes)
    return ctes


_ANY = " or ".join(f"fix_{n}" for n in FLAGS)
_PIPELINE = f"""{_SRC_ROW},
{_rename(_allocate(f'select {_SALE} as number from judged where sale_id is not null', 'select row_id, row_id + 1 as start from judged where sale_id is null'), 'a')},
{_rename(_allocate(f'select {_ORDER} as number from judged where order_id is not null', 'select row_id, row_id + 1 as start from judged where order_id is null'), 'b')},
with_ids as (select judged.* replace (coalesce(sale_id, cast(a.number as varchar)) as sale_id, coalesce(order_id, {_ORD_TEXT.replace('number', 'b.number')}) as order_id),
 sale_id is null as fix_sale_id_generated, order_id is null as fix_order_id_generated, {_FLAG_COLUMNS}
 from judged left join given_a a using (row_id) left join given_b b using (row_id)),
valued as (select row_id, k, sale_id, order_id, customer_id, {_VALUES},
 (fix_sale_id_generated or fix_order_id_generated or {_ANY} or payment_method is distinct from raw_payment) as row_changed,
 fix_sale_id_generated, fix_order_id_generated, {', '.join(f'fix_{n}' for n in FLAGS)} from with_ids),
{_rename(_dedupe_ctes('sale_id', 'valued'), 'c')},
{_rename(_dedupe_ctes('order_id', 'fixed_c'), 'd')},
repaired as (select * exclude (sale_id_changed, order_id_changed) replace (row_changed or sale_id_changed or order_id_changed as row_changed),
 sale_id_changed as fix_duplicate_sale_ids_corrected, order_id_changed as fix_duplicate_order_ids_corrected from fixed_d)"""
_ALL_FLAGS = ["sale_id_generated", "order_id_generated", *FLAGS, "duplicate_sale_ids_corrected", "duplicate_order_ids_corrected"]
_COUNTS = " union all ".join(
    [f"select '{n}' as fix, cast(sum(cast(fix_{n} as bigint)) as bigint) as n_rows from repaired" for n in _ALL_FLAGS]
    + ["select 'rows_updated', cast(sum(cast(row_changed as bigint)) as bigint) from repaired"]
)
_PATCHED = f"with {X.SQL_SALES}, answers as ({CORRECTIONS}), joined as (select sales.*, response, json_valid(response) as readable from sales left join answers using (k))"

_RETAIL_DAY = "try_strptime(InvoiceDate, '%m/%d/%Y %H:%M')"
_FORMAT_OF_SHOP = "case right(shop, 1) " + " ".join(f"when '{i}' then '{f}'" for i, f in enumerate(X.SHOP_FORMATS)) + " end"
_SHOP_DAY = "case when k % 97 = 0 or k % 89 = 0 or k % 83 = 0 then null else day end"

ORACLES = {
    "clean_numeric": f"with {X.SQL_TYPED} select k, price, quantity, discount, total from typed",
    "clean_rules": f"with {X.SQL_TYPED} select * from typed",
    "std_product": f"with {X.SQL_SALES} select k, {PRODUCT} as product from sales",
    "std_category": f"with {X.SQL_SALES} select k, {CATEGORY} as category from sales",
    "std_city": f"with {X.SQL_SALES} select k, {CITY} as city from sales",
    "std_store": f"with {X.SQL_SALES} select k, {STORE} as store from sales",
    "std_payment": f"with {X.SQL_SALES} select k, {PAYMENT} as payment_method from sales",
    "repair_email": f"with {X.SQL_NUMBERED} select k, row_id, {EMAIL} as email from numbered",
    "repair_retail": f"""with {X.SQL_RETAIL},
n as (select k, {X.sql_plain('UnitPrice')} as p, {X.sql_plain('Quantity')} as q, {_RETAIL_DAY} as day from retail),
m as (select median(p) filter (p > 0) as mp, median(q) filter (q > 0) as mq from n)
select k, case when p is null or p = 0 then coalesce(mp, 1.0) else abs(p) end as price, case when q is null or q = 0 then coalesce(mq, 1.0) else abs(q) end as quantity,
 {_date('day')} as date, day is null as fix_date_missing_replaced, coalesce(day > {X.SQL_AS_OF}, false) as fix_date_future_replaced from n, m""",
    "infer_date_formats": f"with {X.SQL_DATED} select shop, 'date' as \"column\", {_FORMAT_OF_SHOP} as format, count(date) as n_values from dated group by shop",
    "parse_dates_per_shop": f"with {X.SQL_DATED} select k, shop, {_SHOP_DAY} as day from dated",
    "clean_dates_per_shop": f"with {X.SQL_DATED} select k, shop, cast({_SHOP_DAY} as timestamp) as date from dated",
    "repair_date": f"with {X.SQL_TYPED} select k, {_date('date')} as date from typed",
    "with_row_id": f"with {X.SQL_NUMBERED} select k, row_id from numbered",
    "impute_price_hierarchical": f"{_SRC_K} select k, price, price_fill as fill_value from filled",
    "impute_quantity_hierarchical": f"{_SRC_K} select k, quantity, quantity_fill as fill_value from filled",
    "positive_median": f"with {X.SQL_TYPED} select coalesce(median(price) filter (price > 0), 1.0) as median from typed",
    "repair_price": f"{_SRC_K} select k, new_price as price from judged",
    "repair_quantity": f"{_SRC_K} select k, new_quantity as quantity from judged",
    "repair_total": f"{_SRC_K} select k, case when total_wrong then fresh else total end as total from judged",
    "duplicate_rank": f"""with {X.SQL_NUMBERED} select row_id, order_id, row_number() over (partition by order_id order by row_id) - 1 as rank
 from numbered where order_id is not null qualify count(*) over (partition by order_id) > 1""",
    "allocate_ids": f"""with {X.SQL_NUMBERED}, {_allocate(f'select {_SALE} as number from numbered where sale_id is not null',
 'select row_id, cast(floor(row_id / 10 + 1) as bigint) as start from numbered where sale_id is null')} select row_id, number from given""",
    "fill_sale_id": _fill_sql("sale_id"),
    "fill_order_id": _fill_sql("order_id"),
    "dedupe_sale_id": _dedupe_sql("sale_id"),
    "dedupe_order_id": _dedupe_sql("order_id"),
    "drop_exact_duplicates": f"with {X.SQL_SALES} select min(k) as row_id, customer_id, product, category, store, city from sales group by all",
    "repair_values": f"{_SRC_ROW} select row_id, k, sale_id, order_id, customer_id, {_VALUES}, {_FLAG_COLUMNS} from judged",
    "repair_pipeline": f"{_PIPELINE} select row_id, {', '.join(X.SALES_COLUMNS)}, row_changed from repaired",
    "fix_counts": f"{_PIPELINE} {_COUNTS}",
    "apply_corrections": f"""{_PATCHED} select k, coalesce(case when readable then response->>'product' end, product) as product,
 coalesce(case when readable then response->>'price' end, price) as price, coalesce(case when readable then response->>'city' end, city) as city,
 quantity, case when readable then true end as llm_correction_applied, case when not readable then response end as llm_raw_response from joined""",
    "correction_counts": f"""{_PATCHED} select count(response) as rows_sent, count(*) filter (readable) as rows_updated,
 count(*) filter (not readable) as unreadable from joined""",
    "apply_json_patch": "select event_id, cast(props->>'k' as bigint) as k from events",
}
