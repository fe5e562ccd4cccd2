"""One label per row from the votes of the rules, the forest and the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def ensemble_vote(
    df: DataFrame, isolation: str = "isolation_vote", model: str | None = None, model_score: str | None = None
) -> DataFrame:
    """A row is anomalous (-1) when any detector says so and a rule has fired.

    Votes are -1 or 1. Confidence is the number of -1 votes, 0 without tags.
    """
    votes = [F.when(F.col("has_anomaly"), -1).otherwise(1), F.col(isolation)]
    if model is not None:
        votes.append(F.col(model))
    untagged = F.col("anomaly_types") == ""
    against = sum((F.when(v == -1, 1).otherwise(0) for v in votes), F.lit(0))
    label = F.when(untagged | (against == 0), 1).otherwise(-1)
    return df.withColumns(
        {
            "anomaly": label,
            "anomaly_method": F.lit("ensemble"),
            "anomaly_confidence": F.when(untagged, 0).otherwise(against),
            "ml_anomaly_score": F.col(model_score) if model_score else F.lit(0.0),
            "has_anomaly": label == -1,
        }
    )
