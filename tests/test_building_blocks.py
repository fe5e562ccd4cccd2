"""Keyed joins, running totals, quantiles and ids against direct computation."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cleargrain.operators import ids, keyed, labels, quantiles, scan


def test_attach_is_the_same_for_small_large_and_hot(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 97).alias("k"))
    facts = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.sum("row_id").alias("s"))
    small = keyed.attach(rows, facts, ["k"], weight="n").collect()
    monkeypatch.setattr(keyed, "HEAVY_KEYS", 3)
    large = keyed.attach(rows, facts, ["k"], weight="n", limit=0)
    assert sorted(small, key=str) == sorted(large.collect(), key=str)
    assert large.columns == ["row_id", "k", "s"]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 4001])
def test_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"row_id": range(n), "g": rng.integers(0, 3, n), "x": np.round(rng.lognormal(3, 2, n), 2)})
    wanted = {"a": ("x", 0.0), "b": ("x", 0.25), "c": ("x", 0.5), "d": ("x", 0.95), "e": ("x", 1.0)}
    df = spark.createDataFrame(pdf)
    whole = quantiles.exact_quantiles(df, [], wanted).first()
    for name, (_, p) in wanted.items():
        assert whole[name] == pytest.approx(np.quantile(pdf.x, p), rel=1e-12)
    for row in quantiles.exact_quantiles(df, ["g"], wanted).collect():
        for name, (_, p) in wanted.items():
            assert row[name] == pytest.approx(np.quantile(pdf.x[pdf.g == row.g], p), rel=1e-12)


def test_quantiles_of_missing_values(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "b", 2.0)], "row_id bigint, g string, x double")
    got = {r.g: r.m for r in quantiles.exact_quantiles(df, ["g"], {"m": ("x", 0.5)}).collect()}
    assert got == {"a": None, "b": 2.0}


def test_running_and_rank(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("g"))
    rows = scan.rank_in_group(df, ["g"], width=16).collect()
    assert all(r["rank"] == r.row_id // 3 for r in rows)


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000 * 1_000_003).alias("v"))
    assert scan.with_row_id(df, ["v"]).filter("v <> row_id * 1000003").isEmpty()


def greedy(used, requests):
    used, out = set(used), {}
    for start, row in sorted(requests):
        number = start
        while number in used:
            number += 1
        used.add(number)
        out[row] = number
    return out


@pytest.mark.parametrize("seed", range(3))
def test_allocation_equals_the_greedy_loop(spark, seed):
    rnd = random.Random(seed)
    used = [rnd.randint(1, 60) for _ in range(40)]
    asks = [(rnd.choice([5, 5, 5, rnd.randint(1, 80)]), i) for i in range(30)]
    existing = spark.createDataFrame([(u,) for u in used], "number bigint")
    requests = spark.createDataFrame([(i, s) for s, i in asks], "row_id bigint, start bigint")
    got = {r.row_id: r.number for r in ids.allocate_numbers(existing, requests, width=8).collect()}
    assert got == greedy(used, asks)


def test_fill_and_dedupe_ids(frame):
    df = frame("sale_id string, order_id string", [("1", "ORD_DUP"), (None, None), ("3", "ORD_DUP"), ("3.0", "ORD0002"), (" ", "ORD0002"), ("x", "nan")])
    filled = ids.fill_ids(df, ["sale_id", "order_id"]).orderBy("row_id").collect()
    assert [r.sale_id for r in filled] == ["1", "2", "3", "3.0", "5", "x"]
    assert [r.order_id for r in filled] == ["ORD_DUP", "ORD0003", "ORD_DUP", "ORD0002", "ORD0002", "ORD0006"]
    assert [r.order_id_generated for r in filled] == [False, True, False, False, False, True]
    fixed = ids.dedupe_ids(ids.fill_ids(df, ["order_id"]), ["order_id"]).orderBy("row_id").collect()
    # starts: ORD_DUP 1+1, ORD0002 2+1; numbers 2, 3 and 6 are in use
    assert [r.order_id for r in fixed] == ["ORD_DUP", "ORD0003", "ORD0004", "ORD0002", "ORD0005", "ORD0006"]


def test_ids_stay_within_the_file(frame):
    df = frame("row_id bigint, source_file string, sale_id string", [(0, "f", None), (1, "f", "1"), (0, "g", None)])
    rows = ids.fill_ids(df, ["sale_id"], ["source_file"]).collect()
    assert {(r.source_file, r.row_id): r.sale_id for r in rows} == {("f", 0): "2", ("f", 1): "1", ("g", 0): "1"}


def test_draws_are_exact_and_repeatable(spark):
    df = spark.range(1001).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    split = labels.stratified_split(df, "label", ["id"])
    counts = {(r.label, r.is_test): r["count"] for r in split.groupBy("label", "is_test").count().collect()}
    assert counts == {(1, True): 21, (1, False): 80, (0, True): 180, (0, False): 720}
    again = labels.stratified_split(df.repartition(13), "label", ["id"])
    assert split.exceptAll(again).isEmpty()
    assert labels.flip_labels(df, "label", ["id"]).agg(F.sum("label")).first()[0] == 51


def test_draws_keep_rows_without_a_label(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(100)], "row_id bigint, label int")
    split = labels.stratified_split(rows, "label", ["row_id"]).collect()
    assert len(split) == 100 and not any(r.is_test for r in split if r.label is None)
    assert sum(r.is_test for r in split) == 15
    flipped = labels.flip_labels(rows, "label", ["row_id"]).collect()
    assert len(flipped) == 100 and sum(r.label is None for r in flipped) == 25
    assert sum(r.label == 1 for r in flipped) == 25


def test_narrowed_quantiles(spark, monkeypatch):
    """Brackets that are cut again and again give the same quantiles, on continuous values and on ties."""
    from cleargrain.operators import quantiles as Q

    monkeypatch.setattr(Q, "INSIDE", 5)
    monkeypatch.setattr(Q, "CELLS", 8)
    rows = spark.range(30000).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).alias("g"), F.exp(F.randn(1) * 40).alias("x"), F.when(F.col("id") % 10 < 7, F.lit(5.0)).otherwise(F.randn(2)).alias("y")
    )
    rows = rows.cache()
    plain = rows.toPandas()
    wanted = {"a": ("x", 0.25), "b": ("x", 0.95), "c": ("y", 0.5), "d": ("y", 0.05)}
    for by, groups in (([], [(None, plain)]), (["g"], list(plain.groupby("g")))):
        got = {r["g"] if by else None: r for r in Q.exact_quantiles(rows, by, wanted, [F.count(F.lit(1)).alias("n")]).collect()}
        for key, own in groups:
            assert got[key].n == len(own)
            for name, (column, p) in wanted.items():
                assert got[key][name] == pytest.approx(own[column].quantile(p), rel=1e-12)


def test_broadcast_goes_by_measured_bytes(spark):
    from cleargrain.session import fits_broadcast

    few = spark.range(1000).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))
    assert not fits_broadcast(few) and fits_broadcast(few.select("id")) and not fits_broadcast(few.select(F.array("text").alias("list")))
    assert fits_broadcast(few.limit(10))


def test_allocation_among_far_apart_ids(spark, monkeypatch):
    """Ids of eighteen digits, each in a bucket of its own, are cut into ranges of equal numbers of rows."""
    monkeypatch.setattr(scan, "MANY_BUCKETS", 3)
    rnd = random.Random(9)
    used = [rnd.randrange(10**17, 10**18) for _ in range(200)]
    used += [u + k for u in used[:20] for k in (1, 2, 4)]
    asks = [(rnd.choice([*used[:40], 1, rnd.randrange(1, 10**18)]), i) for i in range(60)]
    existing = spark.createDataFrame([(u,) for u in used], "number bigint")
    requests = spark.createDataFrame([(i, s) for s, i in asks], "row_id bigint, start bigint")
    got = {r.row_id: r.number for r in ids.allocate_numbers(existing, requests, width=8).collect()}
    assert got == greedy(used, asks)
