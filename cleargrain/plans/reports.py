"""Profiles, summaries, labels, features and evaluation."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from cleargrain.functions import standardize as S
from cleargrain.functions.coerce import clean_rules
from cleargrain.functions.features import abs_zscore, date_trio, text_trio
from cleargrain.operators import evaluate as E, features as FE, labels as L, profile as P, reports as R
from cleargrain.operators.classify import add_score, flag_rows
from cleargrain.operators.ensemble import ensemble_vote
from cleargrain.operators.quantiles import one_row
from cleargrain.plans import fixture as X
from cleargrain.plans.rules import PER_FILE, TYPED, scored_ctes
from cleargrain.session import stage


def flagged(spark, sf_dir):
    return stage(flag_rows(X.typed_sales(spark, sf_dir), meta=["k"], options=X.OPTIONS), "flagged")


def voted(spark, sf_dir):
    """Rules with two stand-in votes that SQL can state as well."""
    rows = add_score(flagged(spark, sf_dir))
    rows = rows.withColumns(
        {
            "isolation_vote": F.expr("case when price > 90000 or quantity > 45 then -1 else 1 end"),
            "model_vote": F.expr("case when discount >= 9 then -1 else 1 end"),
            "model_score": F.expr("coalesce(1 - discount / 200, 0)"),
        }
    )
    return ensemble_vote(rows, "isolation_vote", "model_vote", "model_score")


def _rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


def profile_missing(spark, sf_dir):
    return P.profile(clean_rules(X.sales(spark, sf_dir)))


def column_details(spark, sf_dir):
    return _rounded(P.column_details(X.typed_sales(spark, sf_dir).drop("row_id")), "mean")


def describe_numeric(spark, sf_dir):
    rows = X.typed_sales(spark, sf_dir).select("price", "quantity", "discount", "total")
    return _rounded(P.describe_numeric(rows), "mean", "std", "q25", "q50", "q75")


def preview_top20(spark, sf_dir):
    return P.preview(voted(spark, sf_dir), order_by="k").select("k", "product", "price", "has_anomaly")


def class_labelled(spark, sf_dir):
    return voted(spark, sf_dir).withColumn("is_anomaly", F.when(F.col("anomaly_confidence") >= 2, 1).otherwise(0))


def class_stats(spark, sf_dir):
    rows = class_labelled(spark, sf_dir)
    names = [f"{c}_{s}" for c in ("price", "quantity", "total", "discount") for s in ("mean", "std")]
    return _rounded(R.class_stats(rows, "is_anomaly"), *names)


def class_missing_pct(spark, sf_dir):
    rows = class_labelled(spark, sf_dir).select("is_anomaly", *X.SALES_COLUMNS)
    return _rounded(R.class_missing_pct(rows, "is_anomaly"), "anomaly_missing_pct", "normal_missing_pct")


def run_summary(spark, sf_dir):
    rows = X.sales(spark, sf_dir).withColumn("source_file", F.concat(F.lit("shop-"), F.coalesce("store", F.lit("none"))))
    rows = stage(clean_rules(X.keyed(rows)), "typed")
    rows = flag_rows(rows, scope=["source_file"], meta=["k"], options=X.OPTIONS)
    return _rounded(R.run_summary(rows, 8.0, ["source_file"]), "anomaly_percentage")


def _agg(function, *rounded, source=voted):
    def run(spark: SparkSession, sf_dir: str):
        return _rounded(function(source(spark, sf_dir)), *rounded)

    return run


def text_features(spark, sf_dir):
    rows = X.sales(spark, sf_dir)
    return rows.select("k", *text_trio(F.col("product"), "product"), *text_trio(F.col("email"), "email"))


def date_features(spark, sf_dir):
    return clean_rules(X.sales(spark, sf_dir)).select("k", *date_trio(F.col("date"), "date"))


def zscore(spark, sf_dir):
    rows = X.typed_sales(spark, sf_dir)
    stats = one_row(rows.agg(F.avg("price").alias("m"), F.stddev_samp("price").alias("s")))
    rows = rows.withColumn("__s", stats)
    return rows.select("k", F.round(abs_zscore(F.col("price"), F.col("__s.m"), F.col("__s.s")), 6).alias("price_zscore"))


def class_name(spark, sf_dir):
    return X.table(spark, sf_dir, "labels").select("doc_id", S.class_name(F.col("quality")).alias("class_name"))


def features_train(spark, sf_dir):
    return _rounded(FE.training_features(X.typed_sales(spark, sf_dir).drop("k"))[0], "price_per_unit_variance", digits=6)


def features_score(spark, sf_dir):
    rows = X.typed_sales(spark, sf_dir)
    codes = stage(FE.label_codes(rows, "category"), "codes")
    names = ["price_value", "quantity_is_zero", "discount_is_negative", "category_encoded", "order_date_day_of_week",
             "order_date_month", "order_date_is_valid", "profit_value", "price_qty_interaction"]
    return FE.scoring_features(rows, names, {"category": codes})


def features_enhanced(spark, sf_dir):
    rows = X.typed_sales(spark, sf_dir).drop("k")
    out = FE.enhanced_features(FE.training_features(rows)[0], rows.columns)
    return out.select(
        "row_id", "sale_id_is_missing", "product_is_missing", "date_is_missing", "store_is_missing", "city_is_missing",
        "suspicious_price", "suspicious_quantity", F.round("price_value_zscore", 6).alias("price_value_zscore"),
        "price_value_is_outlier", F.round("quantity_value_zscore", 6).alias("quantity_value_zscore"),
        "quantity_value_is_outlier", "price_qty_ratio_extreme", "low_variance_pattern",
    )


def label_encode(spark, sf_dir):
    return FE.label_codes(X.sales(spark, sf_dir), "category").select("value", "code", "n_rows")


def target_label(spark, sf_dir):
    rows = flagged(spark, sf_dir)
    return rows.select("k", L.target_label(rows).alias("label"))


def _people(spark, sf_dir):
    customers = X.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") < 0, -1).otherwise(1).alias("anomaly"))
    suppliers = X.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("in_credit"))
    return customers, suppliers


def combine_training(spark, sf_dir):
    return L.combine_training(_people(spark, sf_dir))


def anti_split(spark, sf_dir):
    orders = X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return L.rest_of(X.table(spark, sf_dir, "customer"), orders, ["c_custkey"]).select("c_custkey", "c_name")


def _items(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem")
    return rows.select(
        *["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        (F.col("l_extendedprice") / 105000).alias("score"), F.when(F.col("l_extendedprice") >= 52500, 1).otherwise(0).alias("prediction"))


ITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def stratified_split(spark, sf_dir):
    rows = L.stratified_split(_items(spark, sf_dir), "label", ITEM_KEY)
    return rows.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n_rows"))


def flip_labels(spark, sf_dir):
    rows = L.flip_labels(_items(spark, sf_dir), "label", ITEM_KEY)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


def mixed_dataset(spark, sf_dir):
    rows = flagged(spark, sf_dir)
    mixed = L.mixed_dataset(rows.filter("not has_anomaly"), rows.filter("has_anomaly"), ["k"])
    return mixed.groupBy("target_class", "class_name").agg(F.count(F.lit(1)).alias("n_rows"))


QUERIES = {
    "profile_missing": profile_missing,
    "column_details": column_details,
    "describe_numeric": describe_numeric,
    "missing_report": lambda s, d: P.missing_report(clean_rules(X.sales(s, d))),
    "drop_technical": lambda s, d: P.drop_technical(voted(s, d)).drop("row_id", "isolation_vote", "model_vote", "model_score"),
    "clean_rate": _agg(R.clean_rate, "clean_percentage", "mean_clean_price"),
    "preview_top20": preview_top20,
    "anomalies_capped": lambda s, d: R.anomalies_capped(voted(s, d), 1000, "k").select("k", "anomaly", "anomaly_types"),
    "validate": lambda s, d: P.validate(clean_rules(X.sales(s, d))),
    "ensemble_vote": lambda s, d: voted(s, d).select("k", "anomaly", "anomaly_method", "anomaly_confidence", "ml_anomaly_score", "has_anomaly"),
    "anomaly_summary": _agg(R.anomaly_summary, "anomaly_percentage", "avg_flags_per_anomaly", "avg_anomaly_score"),
    "severity_counts": _agg(R.severity_counts),
    "anomaly_insights": _agg(R.anomaly_insights),
    "confidence_distribution": _agg(R.confidence_distribution),
    "tag_frequency": _agg(R.tag_frequency, source=flagged),
    "top_anomaly_types": _agg(R.top_anomaly_types, source=flagged),
    "class_stats": class_stats,
    "class_missing_pct": class_missing_pct,
    "class_distribution": _agg(lambda df: R.class_distribution(df, "is_anomaly"), "percentage", source=class_labelled),
    "run_summary": run_summary,
    "text_features": text_features,
    "date_features": date_features,
    "zscore": zscore,
    "class_name": class_name,
    "features_train": features_train,
    "features_score": features_score,
    "features_enhanced": features_enhanced,
    "label_encode": label_encode,
    "target_label": target_label,
    "combine_training": combine_training,
    "anti_split": anti_split,
    "stratified_split": stratified_split,
    "flip_labels": flip_labels,
    "mixed_dataset": mixed_dataset,
    "confusion_matrix": lambda s, d: E.confusion_matrix(_items(s, d), "label", "prediction"),
    "classification_report": lambda s, d: _rounded(E.classification_report(_items(s, d), "label", "prediction"), "precision", "recall", "f1", digits=9),
    "roc_curve": lambda s, d: E.roc_curve(_items(s, d), "label", "score"),
    "roc_auc": lambda s, d: _rounded(E.roc_auc(_items(s, d), "label", "score"), "auc", digits=9),
}

# ---- SQL counterparts -------------------------------------------------------------------------

TYPES = {c: "double" if c in ("price", "quantity", "discount", "total") else "date" if c in ("date", "order_date", "shipping_date") else "string" for c in X.SALES_COLUMNS}
NUMBERS = [c for c, t in TYPES.items() if t == "double"]
ALL = {"k": "bigint"} | TYPES
_T = f"with {X.SQL_TYPED}"
_VOTED = f"""with {scored_ctes(TYPED)}, votes as (select scored.*, typed.* exclude (k),
 case when price > 90000 or quantity > 45 then -1 else 1 end as iv, case when discount >= 9 then -1 else 1 end as mv,
 coalesce(1 - discount / 200, 0) as ml_anomaly_score, (case when scored.has_anomaly then 1 else 0 end) as rv
 from scored join typed using (k)),
tally as (select *, (iv = -1)::int + (mv = -1)::int + rv as against from votes),
voted as (select * replace ((anomaly_types <> '' and against > 0) as has_anomaly),
 case when anomaly_types <> '' and against > 0 then -1 else 1 end as anomaly, 'ensemble' as anomaly_method,
 case when anomaly_types = '' then 0 else against end as anomaly_confidence from tally),
classed as (select *, case when anomaly_confidence >= 2 then 1 else 0 end as is_anomaly from voted)"""
_FLAGGED = f"with {scored_ctes(TYPED)}"
_TAGS = "select unnest(string_split(anomaly_types, '|')) as tag from scored"
_ITEMS = "with items as (select case when l_returnflag = 'R' then 1 else 0 end as label, l_extendedprice / 105000 as score, case when l_extendedprice >= 52500 then 1 else 0 end as prediction from lineitem)"
_CELLS = f"""{_ITEMS}, c as (select count(*) as n, {', '.join(f"sum((label = {c} and prediction = {c})::int)::double as h{c}, sum((prediction = {c})::int)::double as s{c}, sum((label = {c})::int)::double as r{c}" for c in (0, 1))} from items),
m as (select *, h0/s0 as p0, h1/s1 as p1, h0/r0 as q0, h1/r1 as q1, 2*(h0/s0)*(h0/r0)/(h0/s0+h0/r0) as f0, 2*(h1/s1)*(h1/r1)/(h1/s1+h1/r1) as f1 from c)"""
_HOLES = [c for c in X.SALES_COLUMNS if c not in ("customer_id", "discount", "order_date", "shipping_date")]


def _trio(c: str, name: str) -> str:
    return f"length(coalesce({c}, '')) as {name}_length, (coalesce({c}, '') = '')::int as {name}_is_empty, regexp_matches(coalesce({c}, ''), '[0-9]')::int as {name}_has_numbers"


def _dtrio(c: str, name: str) -> str:
    return f"({c} is not null)::int as {name}_is_valid, coalesce(isodow({c}) - 1, 0) as {name}_day_of_week, coalesce(month({c}), 0) as {name}_month"


def _code(c: str) -> str:
    return f"(dense_rank() over (order by coalesce({c}, 'unknown')) - 1)::double as {c}_encoded"


_NUM3 = ", ".join(f"coalesce({c}, 0) as {f}_value, (coalesce({c}, 0) = 0)::int as {f}_is_zero, (coalesce({c}, 0) < 0)::int as {f}_is_negative" for f, c in (("price", "price"), ("quantity", "quantity"), ("discount", "discount"), ("total_spent", "total")))
_FEATURES = f"""{_T}, base as (select k as row_id, {_NUM3}, {_trio('category', 'category')}, {_code('category')}, {_code('payment_method')},
 {', '.join(f'({c} is null)::int as {c}_is_missing' for c in _HOLES)} from typed),
features as (select *, price_value * quantity_value as price_qty_interaction,
 abs((price_value - avg(price_value) over ()) / (stddev_samp(price_value) over () + 1e-8)) as price_per_unit_variance from base)"""
_DESCRIBE = " union all ".join(f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c}) as least, round(quantile_cont({c}, 0.25), 4) as q25, round(quantile_cont({c}, 0.5), 4) as q50, round(quantile_cont({c}, 0.75), 4) as q75, max({c}) as greatest from typed" for c in ("price", "quantity", "discount", "total"))

ORACLES = {
    "profile_missing": f"{_T} " + " union all ".join(f"select '{c}' as \"column\", count(*) as n_rows, count(*) filter ({c} is null) as n_missing, '{t}' as type from typed" for c, t in ALL.items()),
    "column_details": f"{_T} " + " union all ".join(
        f"select '{c}' as \"column\", count({c}) as n_filled, count(distinct {c}) as n_distinct, "
        + (f"cast(min({c}) as double) as least, cast(max({c}) as double) as greatest, round(avg({c}), 4) as mean" if t in ("double", "bigint") else "null::double as least, null::double as greatest, null::double as mean")
        + f", '{t}' as type from typed" for c, t in ALL.items()),
    "describe_numeric": f"{_T} {_DESCRIBE}",
    "missing_report": f"{_T} select * from (" + " union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} is null) as n_missing from typed" for c in ALL) + ") where n_missing > 0",
    "drop_technical": f"{_T} select * from typed",
    "clean_rate": f"{_VOTED} select count(*) filter (anomaly = 1) as clean_rows, round(count(*) filter (anomaly = 1) / count(*) * 100, 4) as clean_percentage, round(avg(price) filter (anomaly = 1), 4) as mean_clean_price from voted",
    "preview_top20": f"{_VOTED} select k, product, price, has_anomaly from voted order by k limit 20",
    "anomalies_capped": f"{_VOTED} select k, anomaly, anomaly_types from voted where anomaly = -1 order by k limit 1000",
    "validate": f"{_T} select 'price has nulls' as \"check\", count(*) filter (price is null) as violations, count(*) filter (price is null) = 0 as passed from typed union all select 'negative price exists', count(*) filter (price < 0), count(*) filter (price < 0) = 0 from typed",
    "ensemble_vote": f"{_VOTED} select k, anomaly, anomaly_method, anomaly_confidence, ml_anomaly_score, has_anomaly from voted",
    "anomaly_summary": f"""{_VOTED} select count(*) as total_rows, count(*) filter (has_anomaly) as anomalous_rows, round(count(*) filter (has_anomaly) / count(*) * 100, 4) as anomaly_percentage,
 {', '.join(f"count(*) filter (anomaly_severity = '{s}') as n_{s}" for s in ('critical', 'high', 'medium', 'low'))},
 round(avg(anomaly_flags) filter (has_anomaly), 4) as avg_flags_per_anomaly, round(avg(anomaly_score) filter (has_anomaly), 4) as avg_anomaly_score from voted""",
    "severity_counts": f"{_VOTED} select anomaly_severity, count(*) as n_rows from voted group by 1",
    "anomaly_insights": f"{_VOTED} select count(*) filter (anomaly = -1) as total_anomalies, " + ", ".join(f"count(*) filter (anomaly = -1 and anomaly_confidence = {n}) as confidence_{n}" for n in (3, 2, 1)) + " from voted",
    "confidence_distribution": f"{_VOTED} select anomaly_confidence, count(*) as n_rows from voted where anomaly = -1 group by 1",
    "tag_frequency": f"{_FLAGGED} select tag, count(*) as n_rows from ({_TAGS}) where tag <> '' group by 1",
    "top_anomaly_types": f"{_FLAGGED} select anomaly_types, count(*) as n_rows from scored where has_anomaly group by 1 order by n_rows desc, anomaly_types limit 5",
    "class_stats": f"{_VOTED} select is_anomaly, " + ", ".join(f"round(avg({c}), 4) as {c}_mean, round(stddev_samp({c}), 4) as {c}_std" for c in ("price", "quantity", "total", "discount")) + " from classed group by 1",
    "class_missing_pct": f"{_VOTED}, pct as (" + " union all ".join(f"select '{c}' as \"column\", count(*) filter (is_anomaly = 1 and {c} is null) / count(*) filter (is_anomaly = 1) * 100 as a, count(*) filter (is_anomaly = 0 and {c} is null) / count(*) filter (is_anomaly = 0) * 100 as b from classed" for c in X.SALES_COLUMNS) + ") select \"column\", round(a, 4) as anomaly_missing_pct, round(b, 4) as normal_missing_pct from pct order by a desc, \"column\" limit 10",
    "class_distribution": f"{_VOTED} select is_anomaly, count(*) as n_rows, round(count(*) / sum(count(*)) over () * 100, 4) as percentage from classed group by 1",
    "run_summary": f"with {scored_ctes(PER_FILE)} select source_file, count(*) as total_rows, 8.0::double as total_time, cast(floor(count(*) / 8.0) as bigint) as rows_per_second, count(*) filter (has_anomaly) as anomalies_found, round(count(*) filter (has_anomaly) / count(*) * 100, 4) as anomaly_percentage from scored group by 1",
    "text_features": f"with {X.SQL_SALES} select k, {_trio('product', 'product')}, {_trio('email', 'email')} from sales",
    "date_features": f"{_T} select k, {_dtrio('date', 'date')} from typed",
    "zscore": f"{_T} select k, round(abs((price - avg(price) over ()) / (stddev_samp(price) over () + 1e-8)), 6) as price_zscore from typed",
    "class_name": "select doc_id, case quality when 0 then 'Normal' when 1 then 'Anomaly' end as class_name from labels",
    "features_train": f"{_FEATURES} select * replace (round(price_per_unit_variance, 6) as price_per_unit_variance) from features",
    "features_score": f"{_T} select k as row_id, coalesce(price, 0) as price_value, (coalesce(quantity, 0) = 0)::double as quantity_is_zero, (coalesce(discount, 0) < 0)::double as discount_is_negative, {_code('category')}, coalesce(isodow(order_date) - 1, 0)::double as order_date_day_of_week, coalesce(month(order_date), 0)::double as order_date_month, (order_date is not null)::double as order_date_is_valid, 0::double as profit_value, coalesce(price, 0) * coalesce(quantity, 0) as price_qty_interaction from typed",
    "features_enhanced": f"""{_FEATURES}, e as (select *, abs((quantity_value - avg(quantity_value) over ()) / (stddev_samp(quantity_value) over () + 1e-8)) as qz,
 quantile_cont(price_qty_interaction, 0.95) over () as high, quantile_cont(price_per_unit_variance, 0.05) over () as low from features)
select row_id, sale_id_is_missing, product_is_missing, date_is_missing, store_is_missing, city_is_missing,
 ((price_is_zero = 1 or price_is_negative = 1) and quantity_value > 0)::int as suspicious_price, ((quantity_is_zero = 1 or quantity_is_negative = 1) and price_value > 0)::int as suspicious_quantity,
 round(price_per_unit_variance, 6) as price_value_zscore, (price_per_unit_variance > 3)::int as price_value_is_outlier, round(qz, 6) as quantity_value_zscore, (qz > 3)::int as quantity_value_is_outlier,
 (abs(price_qty_interaction) > high)::int as price_qty_ratio_extreme, (price_per_unit_variance < low)::int as low_variance_pattern from e""",
    "label_encode": f"with {X.SQL_SALES} select value, row_number() over (order by value) - 1 as code, n_rows from (select coalesce(category, 'unknown') as value, count(*) as n_rows from sales group by 1)",
    "target_label": f"{_FLAGGED} select k, has_anomaly::int as label from scored",
    "combine_training": "select distinct * from (select c_nationkey as nation, c_mktsegment as segment, case when c_acctbal < 0 then -1 else 1 end as anomaly, c_acctbal < 0 as has_anomaly, null::boolean as in_credit from customer union all select s_nationkey, null, null, false, s_acctbal > 0 from supplier)",
    "anti_split": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)",
    "stratified_split": f"{_ITEMS}, n as (select label, count(*) as n from items group by 1) select label, true as is_test, cast(ceil(n * 0.2::double) as bigint) as n_rows from n union all select label, false, n - cast(ceil(n * 0.2::double) as bigint) from n",
    "flip_labels": f"{_ITEMS}, n as (select count(*) as n, sum(label) as ones from items) select 1 as label, cast(ones - floor(ones * 0.5) as bigint) as n_rows from n union all select 0, cast(n - ones + floor(ones * 0.5) as bigint) from n",
    "mixed_dataset": f"{_FLAGGED}, n as (select count(*) as n, count(*) filter (has_anomaly) as bad from scored) select 0 as target_class, 'Normal' as class_name, cast(n - bad + ceil(bad * 0.5) as bigint) as n_rows from n union all select 1, 'Anomaly', cast(bad - ceil(bad * 0.5) as bigint) from n",
    "confusion_matrix": f"{_ITEMS} select label, prediction, count(*) as n_rows from items group by all",
    "classification_report": f"""{_CELLS} select * replace (round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1) from (
 select '0' as class, p0 as precision, q0 as recall, f0 as f1, cast(r0 as bigint) as support from m union all select '1', p1, q1, f1, cast(r1 as bigint) from m
 union all select 'weighted', (p0*r0+p1*r1)/n, (q0*r0+q1*r1)/n, (f0*r0+f1*r1)/n, n from m union all select 'accuracy', (h0+h1)/n, (h0+h1)/n, (h0+h1)/n, n from m)""",
    "roc_curve": f"{_ITEMS}, g as (select score as threshold, sum(label) as pos, sum(1 - label) as neg from items group by 1) select threshold, sum(pos) over (order by threshold desc) / (select sum(label)::double from items) as tpr, sum(neg) over (order by threshold desc) / (select sum(1 - label)::double from items) as fpr from g",
    "roc_auc": f"{_ITEMS}, r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as rk from items), s as (select sum(rk) filter (label = 1) as rs, sum(label)::double as p, sum(1 - label)::double as n from r) select round((rs - p * (p + 1) / 2) / (p * n), 9) as auc from s",
}
