"""Queries against their SQL counterparts in DuckDB.

A representative set by default; all of them with CLEARGRAIN_ALL=1.
"""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import connect, difference

SF_DIR = os.environ.get("CLEARGRAIN_SF_DIR", "/root/testdata/sf0.001")
SOME = [
    "classify_anomalies", "check_duplicates", "check_retail", "std_category", "std_city", "repair_total", "dedupe_order_id",
    "describe_numeric", "tag_frequency", "features_train", "roc_auc", "classification_report", "scan_csv", "last_event",
    "repair_retail", "infer_date_formats", "parse_dates_per_shop", "training_file_stats", "check_missing", "anti_split",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CLEARGRAIN_ALL") else SOME


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert difference(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name]) is None


def test_every_counterpart_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 6000
