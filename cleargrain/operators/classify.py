"""Rule stage: tags, weighted flags, severity and score of every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cleargrain.functions import vocabulary as V
from cleargrain.operators.date_formats import parse_dates
from cleargrain.operators.keyed import attach
from cleargrain.operators.quantiles import one_row
from cleargrain.operators.rules import facts
from cleargrain.operators.rules.families import FAMILIES, judged_dates, missing_cells
from cleargrain.operators.rules.table import Hit, RuleOptions, RuleTable
from cleargrain.session import settled

TAG_END = "|"


def flag_rows(
    df: DataFrame,
    families: Sequence[str] = tuple(FAMILIES),
    scope: Sequence[str] = (),
    meta: Sequence[str] = (),
    options: RuleOptions = RuleOptions(),
) -> DataFrame:
    """Evaluate rule families; adds has_anomaly, anomaly_types, anomaly_flags,
    anomaly_severity and empty_count.

    ``df`` needs ``row_id``. ``scope`` columns delimit one file: every group,
    copy and statistic stays within it. ``meta`` columns are carried but not
    judged. The table is read once per fact, so pass a stored one.
    """
    scope, rows, times = list(scope), df, {}
    families = [f for f in FAMILIES if f in families]
    if options.date_formats is None and {"dates", "business"} & set(families):
        rows, times, _ = parse_dates(df, judged_dates(df.columns), scope)
    table = RuleTable(df, {"row_id", *scope, *meta}, options, times)
    hits = [hit for f in families for hit in FAMILIES[f](table)]
    for name in facts.numeric_inputs(table):
        table.number(name)  # read by the facts, so it must be among the helpers

    # the helpers are computed after the joins, so a join that is shuffled moves the cells alone
    base, work = rows.withColumns(table.helpers) if table.helpers else rows, rows
    if "cross_column" in families or "duplicates" in families:
        work = facts.attach_key_facts(work, base, table, scope, "cross_column" in families, "duplicates" in families)
    if "duplicates" in families:
        work = facts.attach_row_copies(work, base, table, scope)
    if {"outliers", "advanced", "retail"} & set(families):
        work = facts.attach_stats(work, base, table, scope)
    if "product_category" in families and table.has("product", "category"):
        work = facts.attach_expected_category(work, table)
    return _fold(work.withColumns(table.helpers) if table.helpers else work, table, df.columns, hits)


def _fold(work: DataFrame, table: RuleTable, keep: Sequence[str], hits: Sequence[Hit]) -> DataFrame:
    """One boolean per rule, then the columns that sum the rules up.

    The sums are written as SQL text: they only name the booleans, and one
    parsed expression is much cheaper to build than hundreds of columns.
    """
    kept = [F.col(f"`{c}`") for c in keep]
    named = [(f"__r{i}", h) for i, h in enumerate(hits)]
    fired = work.select(
        *kept, F.expr(missing_cells(table)).alias("empty_count"),
        *[F.coalesce(h.cond, F.lit(False)).alias(r) for r, h in named if not h.late],
    )
    cell_rules = [r for r, h in named if h.on_cell]
    if cell_rules:
        # an untouched tag list is one more empty cell of the row
        count = f"empty_count + cast(not ({' or '.join(cell_rules)}) as bigint)"
        fired = fired.withColumn("empty_count", F.expr(count))
        fired = fired.withColumns({r: h.cond for r, h in named if h.late})

    tags = ", ".join(f"case when {r} then '{h.tag}{TAG_END}' end" for r, h in named) or "''"
    flags = " + ".join(f"case when {r} then {float(h.weight)}D else 0D end" for r, h in named) or "0D"
    grades = " ".join(f"when {r} then '{h.severity}'" for r, h in reversed(named) if h.severity)
    marks = " or ".join(r for r, h in named if not h.soft) or "false"
    return fired.select(
        *kept,
        F.expr(marks).alias("has_anomaly"),
        F.expr(f"concat_ws('', {tags})").alias("anomaly_types"),
        F.expr(flags).alias("anomaly_flags"),
        F.expr(f"case {grades} else 'low' end" if grades else "'low'").alias("anomaly_severity"),
        "empty_count",
    )


def severity_weight(severity: Column) -> Column:
    weight = F.lit(0)
    for name, points in V.SEVERITY_WEIGHTS.items():
        weight = F.when(severity == name, F.lit(points)).otherwise(weight)
    return weight.cast("bigint")


def add_score(df: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Score from the flags relative to the scope's maximum, and the severity."""
    scope = list(scope)
    top = df.groupBy(*scope).agg(F.max("anomaly_flags").alias("__top"), F.count(F.lit(1)).alias("__rows"))
    if scope:
        rated = attach(df, top, scope, weight="__rows")
    else:
        rated = df.withColumn("__top", one_row(top.select("__top"))["__top"])
    base = F.when(F.col("__top") > 0, F.col("anomaly_flags") / F.col("__top") * 50).otherwise(F.lit(0.0))
    weight = severity_weight(F.col("anomaly_severity"))
    return rated.withColumns({"severity_weight": weight, "anomaly_score": (base + weight) / 2}).drop("__top")


def classify(
    df: DataFrame,
    scope: Sequence[str] = (),
    meta: Sequence[str] = (),
    options: RuleOptions = RuleOptions(),
    families: Sequence[str] = tuple(FAMILIES),
) -> DataFrame:
    """All rules and the score. The flagged rows are staged for the maximum."""
    flagged = settled(df.sparkSession, lambda: flag_rows(df, families, scope, meta, options), "flagged")
    return add_score(flagged, scope)


def tag_array(types: Column) -> Column:
    """Rendered tag list as an array without blanks."""
    return F.filter(F.split(types, r"\|"), lambda tag: tag != "")
