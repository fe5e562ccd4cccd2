"""Formats of text dates, inferred from the data of each scope.

One aggregate counts, for every scope and date column, how many values each known format reads; the format with the most
wins, the earlier one of equals. The aggregate combines in each task, so a large file is no hot group. The rows are then
parsed once, by the format of their scope: where all scopes agree, by that format alone, else by a small table of
scopes. Only the list of formats in use reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cleargrain.functions.coerce import DATE_COLUMNS, DATE_FORMATS, clean_rules, has_time, to_time
from cleargrain.operators.keyed import attach
from cleargrain.session import stage

PATTERNS = list(DATE_FORMATS)


def text_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that ``df`` has as text."""
    types = dict(df.dtypes)
    return [n for n in names if types.get(n) == "string"]


def count_formats(df: DataFrame, columns: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """One row per scope, column and format: ``column``, ``format``, ``n_read`` of ``n_values``."""
    scope = list(scope)
    sums = {c: [F.count(to_time(F.col(f"`{c}`"), [p])).alias(f"n{i}_{j}") for j, p in enumerate(PATTERNS)] for i, c in enumerate(columns)}
    wide = df.groupBy(*scope).agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)], *[s for own in sums.values() for s in own])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(p).alias("format"), F.lit(j).alias("place"), F.col(f"n{i}_{j}").alias("n_read"), F.col(f"n{i}").alias("n_values"))
        for i, c in enumerate(columns) for j, p in enumerate(PATTERNS)
    ]
    return wide.select(*scope, F.inline(F.array(*cells)))


def infer_formats(df: DataFrame, columns: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """One row per scope and column: the ``format`` that reads most values, null when none reads any."""
    best = F.max(F.when(F.col("n_read") > 0, F.struct("n_read", (-F.col("place")).alias("first"), "format")))
    return count_formats(df, columns, scope).groupBy(*scope, "column").agg(best["format"].alias("format"), F.max("n_values").alias("n_values"))


def parse_dates(
    df: DataFrame, columns: Sequence[str], scope: Sequence[str] = (), source: DataFrame | None = None
) -> tuple[DataFrame, dict[str, Column], bool]:
    """``df`` with what parsing needs, a timestamp per text date column, and whether a format in use has a time of day.

    Formats are inferred from ``source``, a stored table with the same scopes, or from ``df``.
    """
    scope, columns = list(scope), text_columns(df, columns)
    if not columns:
        return df, {}, False
    found = stage(infer_formats(df if source is None else source, columns, scope), "date-formats")
    # at most one row per column and known format
    used: dict[str, list[str]] = {c: [] for c in columns}
    for r in found.filter("format is not null").select("column", "format").distinct().collect():
        used[r.column].append(r.format)
    several = [c for c in columns if len(used[c]) > 1]
    if several:
        facts = found.groupBy(*scope).agg(
            *[F.max(F.when(F.col("column") == c, F.col("format"))).alias(f"__format_{c}") for c in several], F.max("n_values").alias("__rows")
        )
        df = attach(df, facts, scope, weight="__rows")
    times = {}
    for c in columns:
        if c in several:
            cases = [F.when(F.col(f"`__format_{c}`") == p, to_time(F.col(f"`{c}`"), [p])) for p in sorted(used[c], key=PATTERNS.index)]
            times[c] = F.coalesce(*cases)
        else:
            times[c] = to_time(F.col(f"`{c}`"), used[c]) if used[c] else F.lit(None).cast("timestamp")
    return df, times, any(has_time(p) for own in used.values() for p in own)


def clean_inferred(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """``clean_rules`` with the date formats inferred for each scope.

    Dates are timestamps when a format in use has a time of day. ``df`` is read twice and should be a stored table.
    """
    columns = [c.strip() for c in df.columns]
    trimmed = df.toDF(*columns)
    rows, times, timed = parse_dates(trimmed, DATE_COLUMNS, scope)
    typed = rows.withColumns({c: t if timed else t.cast("date") for c, t in times.items()})
    return clean_rules(typed.select(*columns), None)
