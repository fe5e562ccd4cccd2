"""Facts that a rule needs from other rows: key groups, copies, statistics.

Each fact is one aggregate with map-side combine. Only offending keys are kept
and attached, so the attached side is small on clean data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cleargrain.functions.coerce import strip
from cleargrain.operators.keyed import attach
from cleargrain.operators.quantiles import exact_quantiles, one_row
from cleargrain.operators.rules.families import IDS
from cleargrain.operators.rules.table import RuleTable
from cleargrain.session import BROADCAST_LIMIT_BYTES, stage

DETAIL = {"order_id": "total", "customer_id": "email"}


def numeric_inputs(t: RuleTable) -> list[str]:
    names = ["price", "quantity", "total"] + (["Quantity", "UnitPrice"] if t.kind == "retail" else [])
    return [n for n in names if t.has(n)]


def _detail(t: RuleTable, key: str) -> Column | None:
    name = DETAIL.get(key)
    if name is None or not t.has(name):
        return None
    return t.number(name) if name == "total" else t.raw(name)


def attach_key_facts(
    df: DataFrame, base: DataFrame, t: RuleTable, scope: Sequence[str], differs: bool, repeats: bool
) -> DataFrame:
    """Per id: does it repeat, and do its rows disagree on the detail column.

    Facts come from ``base``, the rows before any join; they are attached to ``df``.
    """
    for key in IDS:
        if not t.has(key):
            continue
        detail = _detail(t, key) if differs else None
        if detail is None and not repeats:
            continue
        narrow = base.filter(t.raw(key).isNotNull())
        aggs = [F.count(F.lit(1)).alias("__copies")]
        if detail is not None:
            aggs += [F.min(detail).alias("__low"), F.max(detail).alias("__high"), F.count(detail).alias("__filled")]
        groups = narrow.groupBy(*scope, key).agg(*aggs).filter("__copies > 1")
        payload = [F.lit(True).alias(f"__{key}_repeats")]
        if detail is not None:
            some_missing = (F.col("__filled") > 0) & (F.col("__filled") < F.col("__copies"))
            payload.append(F.coalesce((F.col("__low") < F.col("__high")) | some_missing, F.lit(False)).alias(f"__{key}_differs"))
        facts = groups.select(*scope, key, "__copies", *payload)
        if not repeats:
            facts = facts.filter(f"__{key}_differs")
        df = attach(df, facts, [*scope, key], weight="__copies")
    return df


def row_hash(names: Sequence[str]) -> Column:
    """Hash of a row in which a missing cell is a value of its own."""
    cells = [F.col(f"`{n}`") for n in names]
    return F.xxhash64(F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cells]), *cells)


def attach_row_copies(df: DataFrame, base: DataFrame, t: RuleTable, scope: Sequence[str]) -> DataFrame:
    """``__same_row``: the same input cells occur in another row of the scope.

    Rows are grouped by a hash first; rows that share a hash are then compared
    in full, and a row that is alone with its cells is taken out again.
    """
    hashed = base.withColumn("__hash", row_hash(t.columns))
    shared = hashed.groupBy(*scope, "__hash").agg(F.count(F.lit(1)).alias("__copies")).filter("__copies > 1")
    shared = stage(shared.withColumn("__same_hash", F.lit(True)), "shared")
    if shared.isEmpty():
        return df.withColumn("__same_row", F.lit(False))
    on = [*scope, "__hash"]
    df = attach(df.withColumn("__hash", row_hash(t.columns)), shared, on, weight="__copies", staged=True)
    cells = [F.col(f"`{n}`") for n in t.columns]
    alone = (
        attach(hashed, shared, on, weight="__copies", staged=True).filter("__same_hash").groupBy(*scope, "__hash", *cells)
        .agg(F.count(F.lit(1)).alias("__n"), F.min("row_id").alias("row_id")).filter("__n = 1")
    )
    alone = stage(alone.select(*scope, "row_id", F.lit(True).alias("__alone")), "alone")
    if alone.isEmpty():
        return df.withColumn("__same_row", F.coalesce("__same_hash", F.lit(False)))
    df = attach(df, alone, [*scope, "row_id"], staged=True)
    return df.withColumn("__same_row", F.coalesce("__same_hash", F.lit(False)) & F.col("__alone").isNull())


def attach_stats(df: DataFrame, base: DataFrame, t: RuleTable, scope: Sequence[str]) -> DataFrame:
    """``__stats``: quartiles, means and deviations of the scope."""
    wanted, extra, columns = {}, [], {}
    for name in ["price", "quantity", "total"]:
        if t.has(name):
            columns[f"__x_{name}"] = t.number(name)
            wanted[f"{name}_q1"] = (f"__x_{name}", 0.25)
            wanted[f"{name}_q3"] = (f"__x_{name}", 0.75)
            if name != "total":
                extra.append(F.avg(f"__x_{name}").alias(f"{name}_mean"))
                extra.append(F.stddev_samp(f"__x_{name}").alias(f"{name}_std"))
    if t.kind == "retail":
        for name, tail, p in [("Quantity", "p95", 0.95), ("UnitPrice", "p05", 0.05)]:
            columns[f"__x_{name}"] = t.number(name)
            wanted[f"{name}_{tail}"] = (f"__x_{name}", p)
    if not wanted:
        return df
    stats = exact_quantiles(base.withColumns(columns), scope, wanted, extra)
    if scope:
        facts = stats.select(*scope, F.struct(*[c for c in stats.columns if c not in scope]).alias("__stats"))
        sizes = base.groupBy(*scope).agg(F.count(F.lit(1)).alias("__rows"))
        return attach(df, facts.join(sizes, list(scope)), list(scope), weight="__rows")
    return df.withColumn("__stats", one_row(stage(stats, "stats")))


def attach_expected_category(df: DataFrame, t: RuleTable) -> DataFrame:
    """``__expected_category`` of a product by the catalogue."""
    catalogue = t.options.catalogue
    keyed = df.withColumn("__product", F.lower(strip(t.raw("product"))))
    if isinstance(catalogue, Mapping):
        # a mapping lives on the driver, so its size is known
        size = sum(len(p.encode()) + len(c.encode()) + 48 for p, c in catalogue.items())
        rows = df.sparkSession.createDataFrame(list(catalogue.items()), "product string, category string")
        if size <= BROADCAST_LIMIT_BYTES:
            return keyed.join(F.broadcast(rows.toDF("__product", "__expected_category")), "__product", "left")
        catalogue = rows
    names = catalogue.select(F.col("product").alias("__product"), F.col("category").alias("__expected_category"))
    sizes = keyed.filter("__product is not null").groupBy("__product").agg(F.count(F.lit(1)).alias("__rows"))
    return attach(keyed, names.join(sizes, "__product"), ["__product"], weight="__rows")
