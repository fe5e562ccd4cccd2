"""Truth tables of the rules on literal rows."""

import datetime as dt

import pytest

from cleargrain.functions.vocabulary import DEFAULT_CATALOGUE
from cleargrain.operators.classify import classify, flag_rows
from cleargrain.operators.rules.table import RuleOptions, dataset_kind

OPTIONS = RuleOptions(as_of=dt.datetime(2024, 6, 1))


def tags(df, families, **kw):
    rows = flag_rows(df, families, options=OPTIONS, **kw).orderBy("row_id").collect()
    return [r.anomaly_types for r in rows], rows


@pytest.mark.parametrize(
    "price, expected",
    [
        ("12.50", ""), (" 7 ", ""), ("abc", "price_not_numeric|"), ("1d", "price_not_numeric|"), ("-3", "price_negative|"),
        ("0", "price_zero|"), ("250000.5", "price_extreme_high|"), ("12.3456", "price_too_many_decimals|"),
        ("12345678.9", "price_extreme_high|"), (None, ""), ("nan", "price_not_numeric|"), ("-0.123", "price_negative|price_too_many_decimals|"),
    ],
)
def test_price(frame, price, expected):
    assert tags(frame("price string", [(price,)]), ["numeric"])[0] == [expected]


def test_quantity_discount_stock(frame):
    df = frame("quantity string, discount string, stock string", [
        ("ten", "150", "-1"), ("-2", "-5", "3"), ("0", "10%", "many"), ("2,000,000", "1,0", None), (None, None, "0"),
    ])
    assert tags(df, ["numeric"])[0] == [
        "quantity_not_numeric|discount_over_100|", "quantity_negative|discount_negative|", "quantity_zero|", "quantity_extreme|", "",
    ]
    assert tags(df, ["types"])[0] == [
        "quantity_not_numeric|", "", "discount_not_numeric|stock_not_numeric|", "quantity_not_numeric|discount_not_numeric|", "",
    ]
    assert tags(df, ["business"])[0] == ["stock_negative|", "order_no_items|", "order_no_items|", "", ""]


def test_missing_and_mostly_empty(frame):
    df = frame("order_id string, price double, note string", [("A", 1.0, "x"), (None, None, "unknown"), ("", 2.0, "nan"), ("B", 1.0, " -- ")])
    got, rows = tags(df, ["missing"])
    assert got == ["", "order_id_null|price_null|note_placeholder|", "order_id_empty|note_empty|", "note_placeholder|"]
    assert [r.anomaly_severity for r in rows] == ["low", "critical", "low", "low"]
    assert [r.empty_count for r in rows] == [1, 2, 1, 0]
    wide = frame(", ".join(f"c{i} string" for i in range(8)), [(None,) * 8, (None,) * 7 + ("x",)])
    assert [g.endswith("row_mostly_empty|") for g in tags(wide, ["missing"])[0]] == [True, False]


def test_formats_and_ids(frame):
    df = frame("email string, phone string, product_id string", [
        ("a@b.com", "+21612345678", "P1"), ("user@.com", "12", " "), (None, None, None), ("padded@x.org ", "123456789", "P2"),
    ])
    got, rows = tags(df, ["string_format"])
    assert got == ["", "email_invalid_format|phone_invalid_format|product_id_missing|", "product_id_missing|", "email_invalid_format|"]
    assert [r.anomaly_severity for r in rows] == ["low", "high", "high", "low"]
    soft = tags(df, ["consistency"])[1][3]
    assert (soft.anomaly_types, soft.anomaly_flags, soft.has_anomaly) == ("email_leading_trailing_spaces|", 0.5, False)


def test_dates(frame):
    df = frame("date string, order_date string, shipping_date string", [
        ("2024-05-01", "2024-01-02", "2024-01-01"), ("2023-13-01", None, "2024-01-01"), ("2999-01-01", "2024-01-01", "2024-01-01"),
        ("2001-01-01", "2024-01-01", "2024-01-09"), (None, None, None),
    ])
    assert tags(df, ["dates"])[0] == ["order_date_after_shipping|", "date_invalid_format|", "date_future|", "date_very_old|", ""]
    assert tags(df, ["business"])[0] == ["shipping_date_before_order|", "", "", "", ""]


def test_categorical_and_returns(frame):
    df = frame("payment string, status string, return_date string, country string", [
        ("Credit_Card", "Returned", None, "fr"), ("barter", "lost", " ", "Tunisia"), (None, "returned", "2024-01-01", None),
    ])
    assert tags(df, ["categorical"])[0] == [
        "payment_case_inconsistent|status_case_inconsistent|",
        "payment_not_in_allowed_list|status_not_in_allowed_list|country_not_in_allowed_list|country_case_inconsistent|", "",
    ]
    assert tags(df, ["business"])[0] == ["returned_no_return_date|", "", ""]


def test_product_category(frame, spark):
    df = frame("product string, category string", [("Apple", "produce"), (" apple ", "Fruits"), ("apple", None), ("apple", " "), ("gadget", "x"), (None, "x")])
    wrong = "product_category_mismatch|"
    assert tags(df, ["product_category"])[0] == ["", wrong, wrong, "", "", ""]
    own = spark.createDataFrame([("gadget", "y")], "product string, category string")
    rows = flag_rows(df, ["product_category"], options=RuleOptions(catalogue=own)).orderBy("row_id").collect()
    assert [r.anomaly_types for r in rows] == ["", "", "", "", wrong, ""]


def test_product_of_every_category(frame):
    pairs = {
        "plum": "produce", "ham": "meat", "cod": "seafood", "feta": "dairy", "oats": "grains", "vodka": "beverages", "ketchup": "condiments",
        "chips": "snacks", "frozen pizza": "frozen", "canned soup": "canned", "shampoo": "health_beauty", "mop": "household",
        "cat litter": "pets", "mouse": "electronics", "belt": "fashion", "garden hose": "home",
    }
    assert len(DEFAULT_CATALOGUE) == 384 and set(DEFAULT_CATALOGUE.values()) == set(pairs.values())
    df = frame("product string, category string", [*pairs.items(), *((p, "elsewhere") for p in pairs)])
    assert tags(df, ["product_category"])[0] == [""] * 16 + ["product_category_mismatch|"] * 16


def test_groups_and_copies(frame):
    df = frame("order_id string, total double, customer_id string, email string", [
        ("A", 1.0, "c1", "x"), ("A", None, "c1", "x"), ("B", 5.0, "c2", None), ("B", 5.0, "c2", None),
        (None, 1.0, "c3", "y"), (None, 2.0, "c3", None), ("C", 1.0, None, "z"),
    ])
    order, customer = "same_order_different_totals|", "same_customer_different_emails|"
    assert tags(df, ["cross_column"])[0] == [order, order, "", "", customer, customer, ""]
    copies = tags(df, ["duplicates"])[0]
    both = "duplicate_order_id|duplicate_customer_id|"
    assert copies == [both, both, "exact_duplicate_row|" + both, "exact_duplicate_row|" + both, "duplicate_customer_id|", "duplicate_customer_id|", ""]


def test_missing_cells_do_not_shift_in_the_copy_test(frame):
    df = frame("a string, b string", [("x", None), (None, "x"), (None, None), (None, None)])
    assert tags(df, ["duplicates"])[0] == ["", "", "exact_duplicate_row|", "exact_duplicate_row|"]


def test_severity_is_the_last_writer(frame):
    df = frame("order_id string, price double, quantity double, total double", [("A", 2.0, 0.0, 9.0), (None, None, 1.0, 9.0)])
    rows = flag_rows(df, ["missing", "numeric", "string_format", "business"], options=OPTIONS).orderBy("row_id").collect()
    assert [r.anomaly_severity for r in rows] == ["high", "high"]
    assert rows[0].anomaly_types == "quantity_zero|total_price_mismatch|order_no_items|"


def test_retail(frame):
    df = frame("InvoiceNo string, StockCode string, Description string, Quantity string, InvoiceDate string, UnitPrice string, CustomerID string, Country string", [
        ("536365", "S1", "lamp", "6", "12/1/2010 8:26", "2.55", "1", "UK"),
        ("C536366", None, " ", "-1", "2010-12-01", "-3", "1", None),
        (None, "S2", "x", "1,0", "12/1/2999 8:26", "0", "1", "UK"),
    ])
    assert dataset_kind(df.columns) == "retail"
    got = tags(df, ["retail"])[0]
    assert got[0] == "quantity_unusually_high|"
    assert got[1] == "invoice_cancelled|quantity_negative_return|unit_price_negative|invoice_date_invalid|description_missing|country_missing|stock_code_missing|"
    assert got[2] == "invoice_no_missing|quantity_not_numeric|unit_price_zero|invoice_date_future|"


def test_scope_keeps_files_apart_and_score(frame):
    df = frame("source_file string, order_id string, price double", [("f", "A", 0.0), ("g", "A", 1.0), ("g", "A", 2.0)])
    rows = classify(df, scope=["source_file"], options=OPTIONS, families=["numeric", "duplicates"]).orderBy("row_id").collect()
    assert [r.anomaly_types for r in rows] == ["price_zero|", "duplicate_order_id|", "duplicate_order_id|"]
    assert [r.anomaly_score for r in rows] == [30.0, 50.0, 50.0]


@pytest.mark.parametrize("partitions", [1, 40])
def test_result_does_not_depend_on_partitioning(spark, frame, partitions):
    df = frame("order_id string, price double, total double", [(f"O{i % 7}", float(i % 5), float(i % 3)) for i in range(60)])
    expected = sorted(map(tuple, classify(df, options=OPTIONS).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        assert sorted(map(tuple, classify(df.repartition(partitions), options=OPTIONS).collect())) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
