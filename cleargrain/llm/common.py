"""Helpers that several operators of this package share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Groups above 1 / HEAVY_SHARE of all rows are answered from a broadcast; at most HEAVY_SHARE groups can be that large.
HEAVY_SHARE = 1000


_kept: dict = {}


def keep_one(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from one task to the next: ``make()``, until another operator of the worker asks."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Number of partitions of a shuffle, as the session sets it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty text.

    ``lower`` agrees with that on texts of single-byte characters and is much cheaper than ``translate``.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores appended until no column has that name (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def join_groups(rows: DataFrame, facts: DataFrame, key: str, size: str) -> DataFrame:
    """Give every row the facts of its group, whatever share of the rows one group holds.

    ``facts`` has one row per key, and its column ``size`` says how many rows have that key. Groups above
    1 / HEAVY_SHARE of all rows, of which there are HEAVY_SHARE at most, are broadcast; the rest is joined by a shuffle.
    Both inputs are read twice and should be stored tables.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * HEAVY_SHARE > F.lit(total)
    heavy = F.broadcast(facts.filter(large))
    few = rows.join(F.broadcast(facts.filter(large).select(key)), key, "left_anti")
    return rows.join(heavy, key).unionByName(few.join(facts.filter(~large), key))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores."""
    raised = F.transform(scores, lambda v: F.exp(v - F.array_max(scores)))
    return F.transform(F.array(raised), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)))[0]
