"""Dirty sales tables derived from the test tables, in Spark and as SQL text.

``SALES`` parses unchanged in both engines. ``k`` is the row key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from cleargrain.functions.coerce import clean_rules
from cleargrain.operators.rules.table import RuleOptions
from cleargrain.operators.scan import with_row_id
from cleargrain.session import stage, widen

AS_OF = dt.datetime(2008, 6, 30)
OPTIONS = RuleOptions(as_of=AS_OF)

# The derived dirty table of the test description.
SALES_BODY = """
with b as (
 select ((cast(l_orderkey as bigint)*8+l_linenumber)*20000+l_partkey)*1000+l_suppkey as k,
  (l_orderkey*31+l_linenumber*17+l_partkey*7+l_suppkey) % 1000 as h,
  l_partkey % 12 as pi, l_suppkey % 6 as ci, l_orderkey, l_linenumber,
  l_extendedprice as px, l_quantity as q, l_discount, cast(cast(l_shipdate as date) as string) as ship, cast(cast(o_orderdate as date) as string) as ord, o_custkey
 from {lineitem} join {orders} on l_orderkey=o_orderkey)
select k,
 case when h < 25 then null else cast(l_orderkey*8+l_linenumber as string) end as sale_id,
 case
      when h between 25 and 44 then null
      when h between 45 and 54 then 'ORD_DUP' else 'ORD'||cast(l_orderkey as string) end as order_id,
 cast(o_custkey as string) as customer_id,
 case
      when h between 60 and 69 then null
      when pi=0 then 'Apple'
      when pi=1 then ' milk '
      when pi=2 then 'CHICKEN'
      when pi=3 then 'bread'
      when pi=4 then 'Rice'
      when pi=5 then 'juice'
      when pi=6 then 'Laptop'
      when pi=7 then 'shirt'
      when pi=8 then 'ice cream'
      when pi=9 then 'Eggs'
      when pi=10 then 'TV' else 'Chair' end as product,
 case
      when h between 70 and 84 then null
      when ci=0 then 'produce'
      when ci=1 then 'Dairy'
      when ci=2 then 'meat'
      when ci=3 then 'Fruit'
      when ci=4 then 'furnitur' else 'clothing' end as category,
 case
      when h between 100 and 119 then null
      when h between 120 and 139 then 'abc'
      when h between 140 and 149 then '-'||cast(px as string)
      when h between 150 and 159 then '0'
      when h between 160 and 163 then '250000.5'
      when h between 164 and 169 then '12.3456'
      when h between 170 and 179 then '$'||cast(px as string) else cast(px as string) end as price,
 case
      when h between 180 and 199 then null
      when h between 200 and 219 then 'ten'
      when h between 220 and 229 then '-3'
      when h between 230 and 239 then '0'
      when h between 240 and 242 then '2,000,000' else cast(cast(q as int) as string) end as quantity,
 case
      when h between 250 and 259 then '150'
      when h between 260 and 269 then '-5' else cast(l_discount*100 as string) end as discount,
 case
      when h between 280 and 299 then null
      when h between 300 and 319 then 'error'
      when h between 320 and 339 then '-100' else cast(px*q as string) end as total,
 case
      when h between 340 and 359 then null
      when h between 360 and 379 then '2023-13-01'
      when h between 380 and 389 then '19/08/2023'
      when h between 390 and 394 then '2999-01-01' else ship end as date,
 ord as order_date, ship as shipping_date,
 case
      when h between 400 and 419 then null
      when h between 420 and 429 then 'invalidemail'
      when h between 430 and 439 then 'user@.com'
      when h between 440 and 449 then ' padded@example.com ' else 'user'||cast(o_custkey as string)||'@example.com' end as email,
 case
      when h between 450 and 469 then null
      when h between 470 and 499 then 'credt_card'
      when h between 500 and 549 then 'PayPal'
      when h between 550 and 599 then 'unknown' else 'cash' end as payment_method,
 case
      when h between 600 and 619 then null
      when h%5=0 then 'Carrefour Market'
      when h%5=1 then 'MG'
      when h%5=2 then 'Monoprix' else 'corner shop' end as store,
 case
      when h between 640 and 659 then null
      when h%4=0 then 'Tunis City'
      when h%4=1 then 'Aryana'
      when h%4=2 then 'Sfax' else 'Paris' end as city
from b
"""

# Columns that only some inputs have, derived from the key.
EXTRA_BODY = """
select *,
 case when k % 41 = 0 then null when k % 43 = 0 then '  ' else 'P' || cast(k % 5003 as string) end as product_id,
 case when k % 31 = 0 then '-4' when k % 37 = 0 then 'many' else cast(k % 90 as string) end as stock,
 case when k % 11 = 0 then 'Returned' when k % 13 = 0 then 'returned' when k % 17 = 0 then 'lost' when k % 19 = 0 then null else 'completed' end as status,
 case when k % 22 = 0 then null when k % 26 = 0 then ' ' else order_date end as return_date,
 case when k % 7 = 0 then 'Credit_Card' when k % 29 = 0 then 'barter' else 'cash' end as payment,
 case when k % 9 = 0 then 'us' when k % 23 = 0 then 'Tunisia' else 'FR' end as country,
 case when k % 15 = 0 then '+21612345678' when k % 16 = 0 then '123' when k % 53 = 0 then null else '0021655512345' end as phone
from {sales}
"""

# The wide table with empty cells and rows that are mostly empty.
_HELD = ["k", "order_id", "product_id"]


def holed_body() -> str:
    cells = [f"case when k % 61 = 7 then null when k % 67 = {i + 3} then '' when k % 71 = {i + 2} then 'nan' else {c} end as {c}"
             for i, c in enumerate([*SALES_COLUMNS, *EXTRA_COLUMNS]) if c not in _HELD]
    return f"select {', '.join(_HELD)}, {', '.join(cells)} from {{wide}}"


# The wide table with copies of some rows, which keep their key.
COPIED_BODY = "select *, 0 as copy from {wide} union all select *, 1 as copy from {wide} where k % 47 = 5 union all select *, 2 as copy from {wide} where k % 94 = 5"

RETAIL_BODY = """
select k,
 case when k % 50 = 0 then 'C' || order_id else order_id end as InvoiceNo,
 sale_id as StockCode, product as Description, quantity as Quantity,
 case when k % 3 = 0 then date else strftime_mdy end as InvoiceDate,
 price as UnitPrice, customer_id as CustomerID, city as Country, total as Total
from {sales}
"""

# Dates as five shops write them, with some that nobody can read.
DATED_BODY = """
select o_orderkey as k, 'shop' || cast(o_orderkey % 5 as string) as shop, cast(o_orderdate as date) as day,
 case when o_orderkey % 97 = 0 then 'soon' when o_orderkey % 89 = 0 then null when o_orderkey % 83 = 0 then '99/99/2001'
      else {text} end as date
from {orders}
"""
SHOP_FORMATS = ["yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy H:mm", "d.M.yyyy", "MMM d, yyyy"]
SQL_SHOP_FORMATS = ["%Y-%m-%d", "%-m/%-d/%Y", "%-d/%-m/%Y %-H:%M", "%-d.%-m.%Y", "%b %-d, %Y"]

SALES_COLUMNS = [
    "sale_id", "order_id", "customer_id", "product", "category", "price", "quantity", "discount", "total", "date",
    "order_date", "shipping_date", "email", "payment_method", "store", "city",
]
EXTRA_COLUMNS = ["product_id", "stock", "status", "return_date", "payment", "country", "phone"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty table, all data columns as text."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_shipdate"]
    lineitem = widen(table(spark, sf_dir, "lineitem").select(*columns), "l_orderkey", "l_linenumber")
    return spark.sql(SALES_BODY, lineitem=lineitem, orders=table(spark, sf_dir, "orders"))


def numbered_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty table with a dense ``row_id`` in the order of ``k``."""
    return with_row_id(sales(spark, sf_dir), ["k"])


def keyed(df: DataFrame) -> DataFrame:
    """Use ``k`` as the row id where only uniqueness matters."""
    return df.withColumn("row_id", F.col("k"))


def typed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coerced table, stored once, with ``k`` as row id."""
    return stage(clean_rules(keyed(sales(spark, sf_dir))), "typed")


def wide_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty table with the extra columns, stored once."""
    return stage(keyed(spark.sql(EXTRA_BODY, sales=sales(spark, sf_dir))), "wide")


def holed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table with empty cells, stored once."""
    return stage(keyed(spark.sql(holed_body(), wide=spark.sql(EXTRA_BODY, sales=sales(spark, sf_dir)))), "holed")


def copied_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table with copies of rows, stored once."""
    rows = spark.sql(COPIED_BODY, wide=spark.sql(EXTRA_BODY, sales=sales(spark, sf_dir)))
    return stage(rows.withColumn("row_id", F.col("k") * 4 + F.col("copy")).drop("copy"), "copied")


def retail_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty table under retail column names, stored once."""
    body = RETAIL_BODY.replace("strftime_mdy", "date_format(try_cast(date as date), 'MM/dd/yyyy HH:mm')")
    return stage(keyed(spark.sql(body, sales=sales(spark, sf_dir))), "retail")


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the text date of their shop, stored once."""
    text = "case o_orderkey % 5 " + " ".join(f"when {i} then date_format(o_orderdate, '{f}')" for i, f in enumerate(SHOP_FORMATS)) + " end"
    return stage(keyed(spark.sql(DATED_BODY.replace("{text}", text), orders=table(spark, sf_dir, "orders"))), "dated")


# ---- the same tables for the SQL counterparts -------------------------------------------------

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
SQL_AS_OF = "timestamp '2008-06-30 00:00:00'"


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sql_double(c: str) -> str:
    return f"case when regexp_matches({c}, '{NUMBER}') then try_cast({c} as double) end"


def sql_number(c: str) -> str:
    return sql_double(rf"regexp_replace({c}, '[$,\s]', '', 'g')")


def sql_plain(c: str, drop: str = "") -> str:
    text = sql_strip(c)
    return sql_double(f"regexp_replace({text}, '[{drop}]', '', 'g')" if drop else text)


def sql_date(c: str) -> str:
    return f"case when regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then try_cast({c} as date) end"


SQL_SALES = f"sales as ({SALES_BODY.format(lineitem='lineitem', orders='orders')})"
SQL_NUMBERED = SQL_SALES + ", numbered as (select *, row_number() over (order by k) - 1 as row_id from sales)"
SQL_TYPED = (
    SQL_SALES
    + f""", typed as (select k, sale_id, order_id, customer_id, product, category,
 {sql_number('price')} as price, {sql_number('quantity')} as quantity, {sql_number('discount')} as discount,
 {sql_number('total')} as total, {sql_date('date')} as date, {sql_date('order_date')} as order_date,
 {sql_date('shipping_date')} as shipping_date, email, payment_method, store, city from sales)"""
)
SQL_WIDE = SQL_SALES + f", wide as ({EXTRA_BODY.format(sales='sales')})"
SQL_RETAIL = SQL_SALES + ", retail as (" + RETAIL_BODY.format(sales="sales").replace(
    "strftime_mdy", "strftime(try_cast(date as date), '%m/%d/%Y %H:%M')"
) + ")"
SQL_DATED = "dated as (" + DATED_BODY.replace("{orders}", "orders").replace("{text}", "case o_orderkey % 5 " + " ".join(
    f"when {i} then strftime(o_orderdate, '{f}')" for i, f in enumerate(SQL_SHOP_FORMATS)
) + " end") + ")"
SQL_HOLED = SQL_WIDE + f", holed as ({holed_body().format(wide='wide')})"
SQL_COPIED = SQL_WIDE + f", copied as (select * exclude (copy) from ({COPIED_BODY.format(wide='wide')}))"
