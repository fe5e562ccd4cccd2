"""Exact quantiles without holding a group in one task.

Pass one is a bounded sketch per group that brackets each wanted quantile. The
last pass counts the values below the bracket and tabulates those inside it;
the order statistics are then read off the running counts of that table. Where
a group is so large that too many values would be inside, passes in between cut
its bracket into CELLS cells, count them, and keep the cell with the wanted
rank, so the table of a quantile stays below a fixed size on any data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cleargrain.operators.keyed import attach
from cleargrain.session import stage

ACCURACY = 10000
MARGIN = 4 / ACCURACY
INSIDE = 1 << 18  # values inside a bracket that one task may rank
CELLS = 4096
ROUNDS = 40  # a bracket shrinks CELLS times a round, unless equal values fill it


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct-valued scalar subquery."""
    return df.select(F.struct(*df.columns)).scalar()


def _entries(wanted: Mapping[str, tuple[str, float]], values: Sequence[str], places: Mapping[str, list[str]], bounds: Sequence[Column]) -> list[Column]:
    """One struct (spec, x, lo, hi) for each wanted quantile."""
    out = []
    for spec, (name, (col, _)) in enumerate(wanted.items()):
        at, pair = 2 * places[col].index(name), bounds[values.index(col)]
        out.append(F.struct(F.lit(spec).alias("spec"), F.col(col).alias("x"), pair[at].alias("lo"), pair[at + 1].alias("hi")))
    return out


def _narrowed(
    rows: DataFrame, sketch: DataFrame, by: list[str], wanted: Mapping[str, tuple[str, float]], values: list[str],
    places: Mapping[str, list[str]], row_key: Sequence[str],
) -> DataFrame:
    """The sketch with brackets that hold INSIDE values at most, or values that are all equal.

    Only groups whose bracket may hold more are read again; there are few of them, as each has many rows.
    """
    arrays = [f"__sk{i}" for i in range(len(values))]
    keys = by or ["__all"]
    left = sketch.select(*by, *([] if by else [F.lit(0).alias("__all")]), "__n", *arrays, (F.col("__n") * 2 * (MARGIN + 1 / ACCURACY)).alias("__inside"))
    done = left.filter(F.col("__inside") <= INSIDE).drop("__inside")
    left = stage(left.filter(F.col("__inside") > INSIDE), "brackets")
    if left.isEmpty():
        return sketch
    if not by:
        rows = rows.withColumn("__all", F.lit(0))
    probs = F.element_at(F.array(*[F.lit(float(p)) for _, p in wanted.values()]), F.col("spec") + 1)
    for _ in range(ROUNDS):
        marked = attach(rows, left.drop("__inside"), keys, row_key=row_key if by else values, weight="__n", staged=True).filter(f"{arrays[0]} is not null")
        long = marked.select(*keys, F.inline(F.array(*_entries(wanted, values, places, [F.col(a) for a in arrays])))).filter("x is not null")
        # halves first, so that no difference overflows
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        cell = F.when(F.col("x") < F.col("lo"), -1).when(F.col("x") > F.col("hi"), CELLS + 1).when(F.col("hi") > F.col("lo"), F.floor(share * CELLS)).otherwise(0)
        cells = long.groupBy(*keys, "spec", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        group = Window.partitionBy(*keys, "spec")
        upto = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        ranked = cells.withColumns({"end": F.sum("n").over(upto), "pos": (F.sum("n").over(group) - 1) * probs}).withColumn("start", F.col("end") - F.col("n"))
        low, high = ((F.col("start") <= r) & (r < F.col("end")) for r in (F.floor("pos"), F.ceil("pos")))
        inside = ranked.filter(low | high).groupBy(*keys, "spec").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), F.sum(F.when(F.col("least") < F.col("most"), F.col("n")).otherwise(0)).alias("n"))
        table = inside.groupBy(*keys).agg(
            F.max("n").alias("__inside"),
            *[F.max(F.when(F.col("spec") == s, F.col(v))).alias(f"__{v}{s}") for s in range(len(wanted)) for v in ("lo", "hi")],
        )
        order = list(wanted)
        fresh = [F.array(*[F.col(f"__{v}{order.index(name)}") for name in places[col] for v in ("lo", "hi")]).alias(a) for col, a in zip(values, arrays)]
        found = stage(left.select(*keys, "__n").join(table, keys).select(*keys, "__n", *fresh, "__inside"), "brackets")
        done = done.unionByName(found.filter(F.col("__inside") <= INSIDE).drop("__inside"))
        left = stage(found.filter(F.col("__inside") > INSIDE), "brackets")
        if left.isEmpty():
            break
    done = done.unionByName(left.drop("__inside"))
    if by:
        return stage(sketch.drop("__n", *arrays).join(done, by), "sketch")
    one = sketch.drop("__n", *arrays).withColumn("__d", one_row(stage(done.drop("__all"), "brackets")))
    return stage(one.select("*", *[F.col(f"__d.{c}").alias(c) for c in ("__n", *arrays)]).drop("__d"), "sketch")


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    extra: Sequence[Column] = (),
    row_key: Sequence[str] = ("row_id",),
) -> DataFrame:
    """One row per group of ``by`` with the linearly interpolated quantiles.

    ``wanted`` maps an output name to (value column, probability). Value columns
    are doubles with null for missing. ``extra`` holds further aggregates to
    compute in the first pass. ``df`` is read twice: stage it when it is costly.
    """
    by = list(by)
    names = list(wanted)
    values = list(dict.fromkeys(col for col, _ in wanted.values()))
    places = {col: [n for n in names if wanted[n][0] == col] for col in values}
    sketches = []
    for i, col in enumerate(values):
        probs = []
        for name in places[col]:
            p = wanted[name][1]
            probs += [max(p - MARGIN, 0.0), min(p + MARGIN, 1.0)]
        grid = F.array(*[F.lit(p) for p in probs])
        sketches.append(F.percentile_approx(col, grid, ACCURACY).alias(f"__sk{i}"))
    count_rows = F.count(F.lit(1)).alias("__n")
    sketch = stage(df.groupBy(*by).agg(count_rows, *sketches, *extra), "sketch")

    narrow = df.select(*dict.fromkeys([*by, *values, *(row_key if by else [])]))
    sketch = _narrowed(narrow, sketch, by, wanted, values, places, row_key)
    if by:
        marked = attach(narrow, sketch.select(*by, "__n", *[f"__sk{i}" for i in range(len(values))]), by,
                        row_key=row_key, weight="__n", staged=True)
        bounds = [F.col(f"__sk{i}") for i in range(len(values))]
    else:
        marked = narrow.withColumn("__s", one_row(sketch.select(*[f"__sk{i}" for i in range(len(values))])))
        bounds = [F.col(f"__s.__sk{i}") for i in range(len(values))]

    long = marked.select(*by, F.inline(F.array(*_entries(wanted, values, places, bounds)))).filter("x is not null")
    zone = F.when(F.col("x") < F.col("lo"), -1).when(F.col("x") > F.col("hi"), 1).otherwise(0)
    table = (
        long.withColumn("zone", zone)
        .withColumn("inside", F.when(F.col("zone") == 0, F.col("x")))
        .groupBy(*by, "spec", "zone", "inside")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        .withColumn("value", F.when(F.col("zone") == -1, F.col("most")).otherwise(F.col("least")))
    )
    group = Window.partitionBy(*by, "spec")
    upto = group.orderBy("zone", "value").rowsBetween(Window.unboundedPreceding, 0)
    prob = F.element_at(F.array(*[F.lit(float(wanted[n][1])) for n in names]), F.col("spec") + 1)
    ranked = table.select(
        *by, "spec", "value",
        F.sum("n").over(upto).alias("end"), (F.sum("n").over(upto) - F.col("n")).alias("start"),
        ((F.sum("n").over(group) - 1) * prob).alias("pos"),
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("start") <= rank) & (rank < F.col("end")), F.col("value")))

    picked = ranked.groupBy(*by, "spec").agg(
        at(F.floor("pos")).alias("below"), at(F.ceil("pos")).alias("above"),
        F.max(F.col("pos") - F.floor("pos")).alias("part"),
    )
    quantile = F.col("below") + (F.col("above") - F.col("below")) * F.col("part")
    wide = picked.withColumn("q", quantile).groupBy(*by).agg(
        *[F.max(F.when(F.col("spec") == i, F.col("q"))).alias(n) for i, n in enumerate(names)]
    )
    rest = sketch.drop(*[f"__sk{i}" for i in range(len(values))])
    if by:
        return rest.join(wide, by, "left").drop("__n")
    return rest.withColumn("__q", one_row(wide)).select(
        *[c for c in rest.columns if c != "__n"], *[F.col(f"__q.{n}").alias(n) for n in names]
    )

