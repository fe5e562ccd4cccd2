"""Joins of one facts row per key that stay whole under hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cleargrain.session import fits_broadcast, stage

HEAVY_KEYS = 1024  # the heaviest keys; every key above 1/1024 of the rows is among them
SPREAD = 4096


def attach(
    df: DataFrame,
    facts: DataFrame,
    on: Sequence[str],
    row_key: Sequence[str] = ("row_id",),
    weight: str | None = None,
    limit: int | None = None,
    staged: bool = False,
) -> DataFrame:
    """Left join ``facts`` (one row per key) to the rows of ``df``.

    The facts are staged and counted. A small table is broadcast. A larger one
    is joined by shuffle, after the heaviest ``HEAVY_KEYS`` keys (by ``weight``,
    the number of rows of a key) have been answered from a broadcast of that
    many rows; their rows and rows without a key are spread by ``row_key`` so
    that no task receives a whole hot key. What a shuffle joins is stored at
    once, so that several such joins in a row never hold the shuffled rows of
    more than one on disk.
    """
    on = list(on)
    if not staged:
        facts = stage(facts, "facts")
    payload = [c for c in facts.columns if c not in on and c != weight]
    rows = [F.col(f"`{c}`") for c in df.columns]
    small = fits_broadcast(facts, limit)
    if small or weight is None:
        side = facts.select(*on, *payload)
        if small:
            return df.join(F.broadcast(side), on, "left").select(*rows, *payload)
        return stage(df.join(side, on, "left").select(*rows, *payload), "attached")

    heavy = facts.orderBy(F.desc(weight), *on).limit(HEAVY_KEYS)
    heavy = heavy.select(*on, F.struct(*payload).alias("__heavy"))
    known = df.join(F.broadcast(heavy), on, "left")
    no_key = F.lit(False)
    for name in on:
        no_key = no_key | F.col(name).isNull()
    spread = F.pmod(F.xxhash64(*row_key), F.lit(SPREAD)) + 1
    salted = known.withColumn("__salt", F.when(F.col("__heavy").isNotNull() | no_key, spread).otherwise(F.lit(0)))
    light = facts.select(*on, F.lit(0).cast("bigint").alias("__salt"), F.struct(*payload).alias("__light"))
    joined = salted.join(light, on + ["__salt"], "left")
    found = F.coalesce("__heavy", "__light")
    return stage(joined.select(*rows, *[found[c].alias(c) for c in payload]), "attached")
