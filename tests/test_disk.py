"""What a run leaves on disk, and which rows it moves."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from cleargrain import session
from cleargrain.operators import features, keyed
from cleargrain.operators.classify import classify
from cleargrain.operators.rules.table import RuleOptions
from cleargrain.plans import files
from cleargrain.session import keep, scratch, settled, stage

OPTIONS = RuleOptions(as_of=dt.datetime(2024, 6, 1))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return disk.getAllFiles().mkString("\n").count("shuffle_")


def local(path):
    return path.removeprefix("file://")


def test_shuffle_files_go_when_a_table_is_stored(spark):
    before = shuffle_files(spark)
    rows = spark.range(0, 10000, 1, 4).repartition(16, "id").groupBy((F.col("id") % 7).alias("k")).count()
    stored = stage(rows)
    until = time.time() + 10
    while shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and stored.count() == 7


def test_a_shuffled_join_is_stored(spark):
    rows = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 9).alias("k"))
    facts = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"), F.lit(11).cast("bigint").alias("n"))
    for weight in ("n", None):
        facts = facts if weight else facts.drop("n")
        joined = keyed.attach(rows, facts, ["k"], weight=weight, limit=0)
        assert "Join" not in plan(joined)
        assert sorted(map(tuple, joined.collect())) == [(i, i % 9, 2 * (i % 9) if i % 9 < 5 else None) for i in range(100)]
        assert "BroadcastHashJoin" in plan(keyed.attach(rows, facts, ["k"], weight=weight))


def test_scratch_deletes_what_is_not_kept(spark):
    with scratch(spark):
        with scratch(spark):
            one, two = stage(spark.range(3)), stage(spark.range(4))
            keep(two)
            three = settled(spark, lambda: stage(spark.range(5)).filter("id > 0"))
        assert not os.path.exists(local(one.staged_at)) and not os.path.exists(local(three.staged_at))
        assert two.count() == 4
        four = settled(spark, lambda: stage(two, "inner").filter("id > 1"))
        assert four.count() == 2 and not [x for x in os.listdir(os.path.dirname(local(four.staged_at))) if x.startswith("inner-")]
    assert not os.path.exists(local(two.staged_at)) and not os.path.exists(local(four.staged_at))
    five = settled(spark, lambda: stage(spark.range(5)).filter("id > 0"))
    assert five.count() == 4


def test_scratch_deletes_after_an_error(spark):
    with pytest.raises(ValueError), scratch(spark):
        one = stage(spark.range(3))
        raise ValueError
    assert not os.path.exists(local(one.staged_at))


def test_rules_agree_when_all_facts_are_shuffled(frame, monkeypatch):
    rows = [(f"O{i % 7}", f"C{i % 5}", float(i % 4), i % 3, float(i), f"u{i % 2}@x.com", f"2024-01-{1 + i % 9:02}") for i in range(40)]
    df = frame("order_id string, customer_id string, price double, quantity int, total double, email string, date string", rows + rows[:3])
    small = sorted(map(tuple, classify(df, options=OPTIONS).collect()))
    monkeypatch.setattr(session, "BROADCAST_LIMIT_BYTES", 0)
    assert sorted(map(tuple, classify(df, options=OPTIONS).collect())) == small


def test_labels_travel_with_their_rows(frame, spark):
    df = frame("price double, quantity double, category string, label string", [(1.0, 2.0, "a", None), (3.0, 1.0, None, "x"), (2.0, 5.0, "b", "y")])
    label = (F.col("price") > 1).cast("int")
    table, names, _ = features.labelled_features(df, label)
    plain, expected, _ = features.training_features(df)
    assert names == expected and "label_is_missing" in names and "__label" not in names
    assert "Join" not in plan(stage(table.select("row_id", "label", "price_value")))
    assert {r.row_id: r.label for r in table.collect()} == {0: 0, 1: 1, 2: 1}
    # as the join of both tables on row_id where ids repeat or are missing
    odd = df.withColumn("row_id", F.when(F.col("row_id") < 2, 7).cast("bigint")).unionByName(df)
    table, names, _ = features.labelled_features(odd, label)
    joined = features.training_features(odd)[0].join(odd.select("row_id", label.alias("label")), "row_id")
    assert sorted(map(tuple, table.select("row_id", "label", *names).collect())) == sorted(map(tuple, joined.select("row_id", "label", *names).collect()))
    assert table.count() == 7


def test_single_files_are_written_from_stored_rows(spark, tmp_path, monkeypatch):
    spark.range(40).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") * 3).alias("l_partkey"), (F.col("id") % 6).alias("l_suppkey"),
        F.lit(9.5).alias("l_extendedprice"), F.lit(2.0).alias("l_quantity"), F.lit(0.05).alias("l_discount"), F.lit(dt.datetime(1995, 1, 2)).alias("l_shipdate"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).select(F.col("id").alias("o_orderkey"), F.lit(dt.datetime(1995, 1, 1)).alias("o_orderdate"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    seen, write = [], files._write

    def watched(rows, *args):
        seen.append(plan(rows))
        write(rows, *args)

    monkeypatch.setattr(files, "_write", watched)
    stats = files.training_file_stats(spark, str(tmp_path)).collect()
    assert len(seen) == 3 and not [p for p in seen if "Join" in p]
    assert sum(r.rows for r in stats) == 40 and {r.columns for r in stats} == {3}
