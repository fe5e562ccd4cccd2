"""Repair, detectors, sources, stream and the whole run."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cleargrain.functions import standardize as S
from cleargrain.functions.coerce import clean_rules
from cleargrain.operators import corrections, evaluate, forest, repair
from cleargrain.operators.ensemble import ensemble_vote
from cleargrain.operators.rules.table import RuleOptions
from cleargrain.pipeline import load_trained, run_pipeline, train_on_files
from cleargrain.plans import reports
from cleargrain.sources import csv_files, sinks
from cleargrain.streaming.watch import results, stream_events, watch

OPTIONS = RuleOptions(as_of=dt.datetime(2024, 6, 1))
DIRTY = "sale_id string, order_id string, product string, category string, price string, quantity string, total string, date string, store string, city string, email string, payment_method string"
ROWS = [
    ("1", "ORD1", " Apple ", "x", "$10", "2", "20", "2024-01-01", "MG Market", "Aryana", "a@b.com", "credt"),
    ("1", "ORD1", "apple", None, "20", None, "error", "2024-13-01", None, None, "user@.com", None),
    (None, None, "apple", "fruit", "-30", "0", "-100", "2999-01-01", "corner", "Paris", "invalidemail", "PayPal"),
    ("9", "ORD_DUP", None, "Clothes", None, "4", None, None, "nan", "unknown", None, "cash"),
    ("9", "ORD_DUP", "lamp", "Clothes", "0", "4", None, None, "nan", "unknown", "x@y@z.com", "Cash"),
]


def test_repair_values_and_ids(frame):
    rows = repair.repair(clean_rules(frame(DIRTY, ROWS)), as_of=F.lit(OPTIONS.as_of)).orderBy("row_id").collect()
    assert [r["product"] for r in rows] == ["apple", "apple", "apple", "unknown", "lamp"]
    assert [r.category for r in rows] == ["fruits", "fruits", "fruits", "fashion", "fashion"]
    # apple medians: price 15, quantity 2; no positive price of unknown, lamp or fashion: global 15
    assert [r.price for r in rows] == [10.0, 20.0, 30.0, 15.0, 15.0]
    assert [r.quantity for r in rows] == [2.0, 2.0, 2.0, 4.0, 4.0]
    assert [r.total for r in rows] == [20.0, 40.0, 60.0, 60.0, 60.0]
    assert [r.date for r in rows] == ["2024-01-01"] + ["unknown_date"] * 4
    assert [r.store for r in rows] == ["mg", "unknown store", "corner", "unknown store", "unknown store"]
    assert [r.city for r in rows] == ["ariana", "unknown city", "paris", "unknown city", "unknown city"]
    # user@.com has a dot in its domain and stays
    assert [r.email for r in rows] == ["a@b.com", "user@.com", "user3@example.com", "user4@example.com", "user5@example.com"]
    assert [r.payment_method for r in rows] == ["credit_card", "cash", "paypal", "cash", "Cash"]
    assert len({r.sale_id for r in rows}) == len({r.order_id for r in rows}) == 5
    assert [r.sale_id for r in rows][:1] == ["1"] and rows[3].sale_id == "9" and rows[3].order_id == "ORD_DUP"
    assert all(r.row_changed for r in rows)


def test_repair_is_idempotent(frame):
    once = repair.repair(clean_rules(frame(DIRTY, ROWS)), as_of=F.lit(OPTIONS.as_of))
    plain = [c for c in once.columns if not c.startswith(repair.PREFIX) and c != "row_changed"]
    twice = repair.repair(once.select(*plain), as_of=F.lit(OPTIONS.as_of))
    assert sorted(once.select(*plain).collect()) == sorted(twice.select(*plain).collect())


def test_copies_are_removed_and_counted(frame):
    df = frame("product string, price double", [("tea", 1.0), ("tea", 1.0), ("tea", 2.0), (None, None), (None, None)])
    assert [r.row_id for r in repair.drop_exact_duplicates(df).orderBy("row_id").collect()] == [0, 2, 3]


def test_standardisers(spark):
    df = spark.createDataFrame([("Béja", "Magasin Général")], "city string, store string")
    row = df.select(S.standard_city(F.col("city")), S.standard_store(F.col("store"))).first()
    assert tuple(row) == ("beja", "magasin general")


def test_corrections(frame, spark):
    df = frame("price double, city string", [(1.0, "a"), (2.0, "b"), (3.0, "c")])
    answers = spark.createDataFrame([(0, '{"price": "7", "other": 1}'), (1, "sorry")], "row_id bigint, response string")
    out = corrections.apply_corrections(df, answers)
    rows = out.orderBy("row_id").collect()
    assert [r.price for r in rows] == [7.0, 2.0, 3.0]
    assert [r.llm_correction_applied for r in rows] == [True, None, None]
    assert rows[1].llm_raw_response == "sorry"
    assert tuple(corrections.correction_counts(out).first()) == (2, 1, 1)


def test_last_correction_of_a_key_wins(frame, spark):
    df = frame("price double", [(1.0,), (2.0,)])
    answers = spark.createDataFrame([(0, '{"price": "9"}', 1), (0, '{"price": "3"}', 2), (1, None, 1)], "row_id bigint, response string, at int")
    assert [r.price for r in corrections.apply_corrections(df, answers, order="at").orderBy("row_id").collect()] == [3.0, 2.0]
    assert [r.price for r in corrections.apply_corrections(df, answers).orderBy("row_id").collect()] == [9.0, 2.0]


DATES = [("a", "1/13/2011 8:26"), ("a", "2/1/2011 10:00"), ("a", "soon"), ("b", "13.1.2011"), ("b", None), ("b", "1.2.2011"), ("c", "later"), ("d", "2011-01-13"), ("e", "13/1/2011"), ("e", "1/2/2011")]


def test_formats_are_inferred_for_each_scope(frame):
    from cleargrain.operators.date_formats import infer_formats, parse_dates

    df = frame("shop string, date string", DATES)
    found = {r.shop: r.format for r in infer_formats(df, ["date"], ["shop"]).collect()}
    assert found == {"a": "M/d/yyyy H:mm", "b": "d.M.yyyy", "c": None, "d": "yyyy-MM-dd", "e": "d/M/yyyy"}
    rows, times, timed = parse_dates(df, ["date"], ["shop"])
    got = [str(r.day) for r in rows.select("row_id", times["date"].cast("date").alias("day")).orderBy("row_id").collect()]
    assert timed and got == ["2011-01-13", "2011-02-01", "None", "2011-01-13", "None", "2011-02-01", "None", "2011-01-13", "2011-01-13", "2011-02-01"]
    # without scopes the majority decides for all, and an empty table has no format
    assert infer_formats(df, ["date"]).first().format in ("M/d/yyyy H:mm", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy")
    rows, times, _ = parse_dates(df.limit(0), ["date"], ["shop"])
    assert rows.select(times["date"]).count() == 0


def test_vote_needs_a_tag(spark):
    schema = "has_anomaly boolean, anomaly_types string, isolation_vote int, m int, s double"
    df = spark.createDataFrame([(True, "a|", 1, -1, 0.3), (False, "", -1, -1, 0.1), (False, "b|", 1, 1, 0.9), (False, "b|", -1, 1, 0.9)], schema)
    rows = ensemble_vote(df, model="m", model_score="s").collect()
    assert [(r.anomaly, r.anomaly_confidence, r.has_anomaly) for r in rows] == [(-1, 2, True), (1, 0, False), (1, 0, False), (-1, 1, True)]


def test_forest_finds_planted_rows_whatever_the_partitioning(spark):
    df = spark.range(2000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") < 20, 90000.0 + F.col("id") * 500).otherwise(F.col("id") % 100).alias("price"),
        F.when(F.col("id") < 20, 900.0).otherwise(F.col("id") % 7).alias("quantity"), F.lit(0.0).alias("anomaly_flags"))
    first = forest.isolation_votes(df, trees=25).orderBy("row_id").collect()
    assert all(r.isolation_vote == -1 for r in first[:20])
    assert sum(r.isolation_vote == -1 for r in first) <= 300
    second = forest.isolation_votes(df.repartition(11), trees=25).orderBy("row_id").collect()
    assert first == second
    scoped = forest.isolation_votes(df.withColumn("source_file", (F.col("row_id") % 2).cast("string")), scope=["source_file"], trees=25)
    assert scoped.count() == 2000 and scoped.filter("row_id < 20 and isolation_vote = 1").isEmpty()


def test_auc_and_curve(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (0, 0.1)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first().auc == pytest.approx(4.5 / 6)
    curve = evaluate.roc_curve(df, "y", "s").orderBy(F.desc("threshold")).collect()
    assert [(r.tpr, round(r.fpr, 4)) for r in curve] == [(0.5, 0.0), (0.5, 0.3333), (1.0, 0.6667), (1.0, 1.0)]


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)


def test_files_of_mixed_dialects(spark, tmp_path):
    write(f"{tmp_path}/a.csv", "product, price \nthé,1\nN/A,2\n\"x,y\",3\n")
    write(f"{tmp_path}/b.csv", "product;city\ncafé;Béja\n", "iso-8859-1")
    write(f"{tmp_path}/c.csv", "product\tcity\n milk \tTunis\n")
    files = {os.path.basename(r.source_file): (r.encoding, r.delimiter) for r in csv_files.inspect_files(spark, str(tmp_path)).collect()}
    assert files == {"a.csv": ("UTF-8", ","), "b.csv": ("ISO-8859-1", ";"), "c.csv": ("UTF-8", "\t")}
    rows = csv_files.scan_csv(spark, str(tmp_path)).collect()
    got = sorted((os.path.basename(r.source_file), r.row_id, r["product"], r.price, r.city) for r in rows)
    assert got == [("a.csv", 0, "thé", "1", None), ("a.csv", 1, None, "2", None), ("a.csv", 2, "x,y", "3", None),
                   ("b.csv", 0, "café", None, "Béja"), ("c.csv", 0, " milk ", None, "Tunis")]
    totals = csv_files.training_totals(csv_files.training_file_stats(spark, str(tmp_path))).first()
    assert (totals.total_files, totals.total_rows, os.path.basename(totals.largest_file)) == (3, 5, "a.csv")


def test_row_ids_follow_the_lines_across_splits(spark, tmp_path):
    write(f"{tmp_path}/big.csv", "n\n" + "".join(f"{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        rows = csv_files.scan_csv(spark, str(tmp_path))
        assert rows.count() == 5000 and rows.filter("cast(n as bigint) <> row_id").isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_records_with_line_breaks(spark, tmp_path, split):
    write(f"{tmp_path}/a.csv", 'id,text,n\n1,"one\ntwo, ""q""\n\nend",3\n\n2,5" pipe,4\n3,"x",5\n4,"open\n",6\n5,"a""b",7\n')
    write(f"{tmp_path}/b.csv", "id|text|id\r\n1|\"é\r\n|\"|7\r\n2||8\r\n", "iso-8859-1")
    write(f"{tmp_path}/c.csv", "id;text\n\n1;\"a;b\"\n   \n2;c\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = csv_files.scan_csv(spark, str(tmp_path)).collect()
        stats = {os.path.basename(r.source_file): r.rows for r in csv_files.training_file_stats(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    got = sorted((os.path.basename(r.source_file), r.row_id, r.id, r.text, r["n"] or r["id.1"]) for r in rows)
    assert got == [
        ("a.csv", 0, "1", 'one\ntwo, "q"\n\nend', "3"), ("a.csv", 1, "2", '5" pipe', "4"), ("a.csv", 2, "3", "x", "5"), ("a.csv", 3, "4", "open\n", "6"),
        ("a.csv", 4, "5", 'a"b', "7"), ("b.csv", 0, "1", "é\n|", "7"), ("b.csv", 1, "2", None, "8"), ("c.csv", 0, "1", "a;b", None), ("c.csv", 1, "2", "c", None),
    ]
    assert stats == {"a.csv": 5, "b.csv": 2, "c.csv": 2}


def test_overlong_lines_are_skipped(spark, tmp_path):
    write(f"{tmp_path}/t.csv", "a,b\n1,2\n1,2,3\n4\n")
    rows = csv_files.scan_training_files(spark, str(tmp_path)).collect()
    assert [(r.a, r.b) for r in rows] == [("1", "2"), ("4", None)]


def test_event_log(spark, tmp_path):
    for i, kind in enumerate(["start", "processing_completed", "end"]):
        sinks.log_event(spark, f"{tmp_path}/log", kind, {"n": i}, dt.datetime(2024, 1, 1 + i))
    events = sinks.read_events(spark, f"{tmp_path}/log")
    assert sinks.last_event(events).first().event == "end"
    assert sinks.last_event_of(events, "processing_completed").first().details == {"n": "1"}
    assert sinks.last_event_of(events, "processing_completed", window=1).isEmpty()


LINES = "order_id,product,price,quantity,total\n" + "".join(f"O{i % 9},tea,{i % 5},{i % 3},{i}\n" for i in range(40))


def test_whole_run(spark, tmp_path):
    write(f"{tmp_path}/in/a.csv", LINES)
    write(f"{tmp_path}/in/b.csv", LINES.replace("tea", "rice"))
    summary, checks = run_pipeline(spark, f"{tmp_path}/in", f"{tmp_path}/out", OPTIONS, trees=10)
    assert sorted(r.total_rows for r in summary.collect()) == [40, 40]
    assert all(r.passed for r in checks.collect())
    found, clean = (spark.read.parquet(f"{tmp_path}/out/{n}") for n in ("anomaly_detection", "clean_data"))
    assert found.count() == 80 and {"anomaly", "anomaly_confidence", "anomaly_score"} <= set(found.columns)
    assert set(clean.columns) == {"order_id", "product", "price", "quantity", "total", "source_file", "row_id"}
    assert clean.groupBy("source_file", "order_id").count().filter("count > 1").isEmpty()
    events = {r.event for r in sinks.read_events(spark, f"{tmp_path}/out/log").collect()}
    assert {"pipeline_start", "profiling", "cleaning", "validation", "processing_completed"} <= events


def test_training_is_stored_and_used(spark, tmp_path):
    head = "price,quantity,category,has_anomaly\n"
    write(f"{tmp_path}/in/a.csv", head + "".join(f"{i},{i % 4},{'ab'[i % 2]},{i % 2 == 1}\n" for i in range(60)))
    write(f"{tmp_path}/in/b.csv", "price,quantity,category,anomaly\n" + "".join(f"{i}.5,1,{'ba'[i % 2]},{(-1, 1)[i % 2]}\n" for i in range(60)))
    assert load_trained(spark, f"{tmp_path}/model") is None
    model, metadata = train_on_files(spark, f"{tmp_path}/in", f"{tmp_path}/model", numTrees=10, maxDepth=4)
    row = metadata.first()
    assert (row.training_rows, row.anomaly, row.normal) == (120, 60, 60) and row.training_accuracy > 0.9
    again = load_trained(spark, f"{tmp_path}/model")
    assert list(again.feature_names) == model.feature_names and set(again.codes) == {"category"}
    write(f"{tmp_path}/new/c.csv", "order_id,price,quantity,category\n" + "".join(f"O{i},{i},0,{'ab'[i % 2]}\n" for i in range(20)))
    run_pipeline(spark, f"{tmp_path}/new", f"{tmp_path}/out", OPTIONS, model=again, trees=5)
    found = spark.read.parquet(f"{tmp_path}/out/anomaly_detection")
    assert found.filter("ml_anomaly_score between 0 and 1").count() == 20
    assert found.filter("anomaly_confidence >= 1").count() == 20


def events_of(spark, path, wanted, seconds=20):
    """Events of a log, once the listener has written those that are wanted."""
    import time

    for _ in range(seconds * 2):
        found = [r.event for r in stream_events(spark, path).collect()]
        if wanted <= set(found):
            return found
        time.sleep(0.5)
    return found


def test_stream_takes_each_file_once_and_survives_a_bad_file(spark, tmp_path):
    seen = []

    def handle(rows, path):
        files = {os.path.basename(r.source_file) for r in rows.select("source_file").distinct().collect()}
        if "bad.csv" in files:
            raise ValueError("cannot read")
        seen.append(files)
        assert rows.agg(F.max("row_id")).first()[0] == 39
        rows.write.parquet(path + "/rows")

    def run(archive=None):
        watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", OPTIONS, handle=handle, archive_dir=archive).awaitTermination()

    write(f"{tmp_path}/in/a.csv", LINES)
    write(f"{tmp_path}/in/notes.txt", "no")
    run()
    write(f"{tmp_path}/in/bad.csv", LINES)
    write(f"{tmp_path}/in/empty.csv", "\n")
    write(f"{tmp_path}/in/c.csv", LINES)
    write(f"{tmp_path}/in/d.csv", LINES.replace(",", ";"))
    run()
    run()
    assert seen == [{"a.csv"}, {"c.csv"}, {"d.csv"}]
    events = events_of(spark, f"{tmp_path}/out", {"stream_started", "stream_progress", "stream_terminated"})
    assert events.count("processing_completed") == 3 and events.count("processing_failed") == 2
    assert {"stream_started", "stream_progress", "stream_terminated"} <= set(events)
    bad = {os.path.basename(r.source_file): r.error for r in spark.read.json(f"{tmp_path}/out/quarantine").collect()}
    assert bad["bad.csv"] == "cannot read" and "no records" in bad["empty.csv"]
    assert results(spark, f"{tmp_path}/out", "rows").count() == 120


def test_stream_reads_any_dialect_and_archives(spark, tmp_path):
    turned = "quantity;price;note\n" + "".join(f'{i % 3};{i % 5};"é\n;{i}"\n' for i in range(20))
    write(f"{tmp_path}/in/a.csv", LINES)
    write(f"{tmp_path}/in/b.csv", turned, "iso-8859-1")
    write(f"{tmp_path}/in/c.csv", "InvoiceNo\tStockCode\tUnitPrice\tQuantity\tInvoiceDate\n" + "".join(f"I{i}\tS\t{i + 1}\t2\t{i + 1}/1/2011 8:26\n" for i in range(12)))
    write(f"{tmp_path}/old.csv", "price,quantity,has_anomaly\n" + "".join(f"{i},{i % 4},{i % 2 == 1}\n" for i in range(40)))
    model, _ = train_on_files(spark, f"{tmp_path}/old.csv", f"{tmp_path}/model", numTrees=3, maxDepth=3)
    for _ in range(2):  # files are moved when a later batch is planned
        query = watch(spark, f"{tmp_path}/in", f"{tmp_path}/out", OPTIONS, model=model, archive_dir=f"{tmp_path}/archive")
        query.awaitTermination()
        if not os.path.exists(f"{tmp_path}/in/d.csv"):
            write(f"{tmp_path}/in/d.csv", LINES)
    found = results(spark, f"{tmp_path}/out")
    sizes = {os.path.basename(r.source_file): r["count"] for r in found.groupBy("source_file").count().collect()}
    assert sizes == {"a.csv": 40, "b.csv": 20, "c.csv": 12, "d.csv": 40}
    assert found.filter("note is not null").select("note").first().note.startswith("é\n;")
    assert found.filter("ml_anomaly_score between 0 and 1").count() == 112
    clean = results(spark, f"{tmp_path}/out", "clean_data")
    assert {r.date for r in clean.filter("date is not null").select("date").collect()} == {f"2011-{i + 1:02d}-01" for i in range(12)}
    assert any(name.endswith("a.csv") for _, _, files in os.walk(f"{tmp_path}/archive") for name in files)


def test_anti_split_reads_all_orders(spark, tmp_path):
    """A customer with a cheap order is no remainder; one without any order is."""
    customers = [(1, "cheap"), (2, "none"), (3, "dear")]
    spark.createDataFrame(customers, "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(1, 10.0), (3, 400000.0), (3, 20.0)]
    spark.createDataFrame(orders, "o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in reports.anti_split(spark, str(tmp_path)).collect()] == [(2, "none")]
