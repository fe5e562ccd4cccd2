"""Evaluation of predictions and scores against 0/1 labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cleargrain.operators.scan import running

SCORE_BUCKETS = 1 << 16


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n_rows"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, their weighted means, and accuracy."""
    cells = confusion_matrix(df, label, prediction)
    y, p, n = F.col(label), F.col(prediction), F.col("n_rows")

    def total(cond):
        return F.sum(F.when(cond, n).otherwise(0))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    sums = cells.agg(
        F.sum(n).alias("n"),
        *[total((y == c) & (p == c)).alias(f"hit{c}") for c in (0, 1)],
        *[total(p == c).alias(f"said{c}") for c in (0, 1)],
        *[total(y == c).alias(f"real{c}") for c in (0, 1)],
    )
    for c in (0, 1):
        sums = sums.withColumns(
            {f"prec{c}": ratio(F.col(f"hit{c}"), F.col(f"said{c}")), f"rec{c}": ratio(F.col(f"hit{c}"), F.col(f"real{c}"))}
        )
        sums = sums.withColumn(f"f{c}", ratio(2 * F.col(f"prec{c}") * F.col(f"rec{c}"), F.col(f"prec{c}") + F.col(f"rec{c}")))

    def line(name, precision, recall, f1, support):
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.cast("bigint").alias("support"))

    def mean(stem):
        return (F.col(f"{stem}0") * F.col("real0") + F.col(f"{stem}1") * F.col("real1")) / F.col("n")

    lines = [line(str(c), F.col(f"prec{c}"), F.col(f"rec{c}"), F.col(f"f{c}"), F.col(f"real{c}")) for c in (0, 1)]
    lines.append(line("weighted", mean("prec"), mean("rec"), mean("f"), F.col("n")))
    accuracy = (F.col("hit0") + F.col("hit1")) / F.col("n")
    lines.append(line("accuracy", accuracy, accuracy, accuracy, F.col("n")))
    return sums.select(F.inline(F.array(*lines)))


def _upto(df: DataFrame, label: str, score: str) -> DataFrame:
    """Rows of both classes at or above each distinct score in [0, 1]."""
    by_score = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    falling = by_score.withColumn("__down", -F.col("threshold"))
    bucket = F.floor((1 - F.col("threshold")) * SCORE_BUCKETS)
    return running(falling, [], bucket, ["__down"], sums={"tp": F.col("pos"), "fp": F.col("neg")})


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """True and false positive rate at every distinct score."""
    sizes = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    sized = _upto(df, label, score).withColumn("__s", sizes.select(F.struct("p", "n")).scalar())
    return sized.select("threshold", (F.col("tp") / F.col("__s.p")).alias("tpr"), (F.col("fp") / F.col("__s.n")).alias("fpr"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the curve by trapezoids, from the counts per distinct score."""
    steps = _upto(df, label, score)
    # doubled area in whole numbers: width neg, heights tp before and after the step
    area = F.sum((F.col("neg") * (2 * F.col("tp") - F.col("pos"))).cast("decimal(38,0)"))
    return steps.agg(
        (area.cast("double") / (2 * F.sum("pos").cast("double") * F.sum("neg").cast("double"))).alias("auc")
    )
