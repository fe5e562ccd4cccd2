"""Patch rows with corrections that arrive as a table of JSON texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cleargrain.operators.keyed import attach


def apply_json_patch(df: DataFrame, response: str) -> DataFrame:
    """Overwrite columns by the keys of a JSON object; unreadable text changes nothing."""
    patch = F.from_json(F.col(response), "map<string,string>")
    parsed = df.withColumn("__patch", patch)
    new = {}
    for name, dtype in df.dtypes:
        if name == response or "<" in dtype:
            continue
        value = F.try_element_at("__patch", F.lit(name))
        new[name] = F.coalesce(value.try_cast(dtype) if dtype != "string" else value, F.col(f"`{name}`"))
    return parsed.withColumns(new).drop("__patch")


def apply_corrections(df: DataFrame, corrections: DataFrame, key: str = "row_id", order: str | None = None) -> DataFrame:
    """Patch the rows that have a correction (columns ``key`` and ``response``).

    Of several answers for one key the last by ``order`` counts, by the text itself where that is equal or not given.

    Adds ``llm_correction_applied`` and keeps unreadable text in ``llm_raw_response``.
    """
    place = F.struct(*([order] if order else []), "response")
    answers = corrections.filter("response is not null").groupBy(key).agg(F.max_by("response", place).alias("__response"))
    joined = attach(df, answers, [key], row_key=(key,))
    answered = F.col("__response").isNotNull()
    readable = F.from_json("__response", "map<string,string>").isNotNull()
    marked = joined.withColumns(
        {
            "llm_correction_applied": F.when(answered & readable, F.lit(True)),
            "llm_raw_response": F.when(answered & ~readable, F.col("__response")),
        }
    )
    return apply_json_patch(marked, "__response").drop("__response")


def correction_counts(patched: DataFrame) -> DataFrame:
    """How many rows were sent, updated and unreadable."""
    updated = F.count_if(F.col("llm_correction_applied"))
    unreadable = F.count_if(F.col("llm_raw_response").isNotNull())
    return patched.agg(
        (updated + unreadable).alias("rows_sent"), updated.alias("rows_updated"), unreadable.alias("unreadable")
    )
