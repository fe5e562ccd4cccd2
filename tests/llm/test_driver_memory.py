"""Joins that must not be broadcast on an estimate."""

from pyspark.sql import functions as F

from cleargrain.llm import simhash
from cleargrain.session import stage


def test_probes_are_not_broadcast(spark, monkeypatch):
    prints = stage(spark.range(0, 5000, 1, 4).select(F.xxhash64("id").alias("print")), "prints")
    assert "BroadcastHashJoin" not in simhash.links(prints, 3)._jdf.queryExecution().executedPlan().toString()
    plans = []

    def stored(df, label="stage"):
        plans.append(df._jdf.queryExecution().executedPlan().toString()) if label == "print-drawn" else None
        return stage(df, label)

    monkeypatch.setattr(simhash, "stage", stored)
    rooted = simhash.rooted_prints(prints, 3)
    assert rooted.count() == 5000
    assert plans and not [p for p in plans if "BroadcastHashJoin" in p]
