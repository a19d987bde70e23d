import pytest
from pyspark.sql import functions as F

from voucherflow.config import Rules, load_rules
from voucherflow.operators import audit as Q
from voucherflow.operators import certificates as CE
from voucherflow.operators import features, normalize, rules
from voucherflow.operators import metrics as M
from voucherflow.operators.ranking import overall_rank
from voucherflow.sources import readers, sinks
from voucherflow.sources import tables as T


def test_metrics_by_hand(spark):
    rows = [("m", a, p) for a, p in zip("AABC", "ABBC")] + [("n", a, p) for a, p in zip("AB", "AX")]
    got = {r["model"]: r for r in M.overall(M.pair_counts(spark.createDataFrame(rows, "model string, actual string, predicted string"))).collect()}
    assert got["m"]["accuracy"] == 0.75 and got["m"]["macro_f1_union"] == pytest.approx((2 / 3 + 2 / 3 + 1) / 3)
    assert got["m"]["weighted_f1"] == pytest.approx((2 * 2 / 3 + 2 / 3 + 1) / 4)
    assert got["n"]["macro_f1_union"] == pytest.approx(1 / 3) and got["n"]["weighted_f1"] == pytest.approx(0.5)


def test_components_match_a_plain_search(spark):
    import random
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(120)}", f"n{rnd.randrange(120)}") for _ in range(90)] + [("hub", f"x{i}") for i in range(60)]
    got = {r["node"]: r["component"] for r in Q.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    for node in links:
        seen, todo = {node}, [node]
        while todo:
            for other in links[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        assert got[node] == min(seen)


def test_overall_rank_is_a_full_order(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("h"))
    got = [tuple(r) for r in overall_rank(df, [("g", True), ("h", False)], "id", "place").select("place", "g", "h", "id").orderBy("place").collect()]
    want = sorted(((i % 3, i % 7, i) for i in range(1000)), key=lambda t: (t[0], -t[1], t[2]))
    assert got == [(n + 1, *t) for n, t in enumerate(want)]


def test_csv_rows_keep_their_numbers(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 17)):
        (tmp_path / f"{name}.csv").write_text("Invoice No,Amount\n" + "".join(f"{name}{i},{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for multiline in (True, False):
            rows = readers.read_sheet(spark, str(tmp_path), "csv", multiline).collect()
            assert len(rows) == 5017 and all(r["source_row"] == int(r["Amount"]) + 2 for r in rows)
            assert len({r["source_ref"] for r in rows}) == len({r["ord"] for r in rows}) == 5017
            assert {r["source_ref"] for r in rows if r["Amount"] == "0"} == {"a!R2", "b!R2"}
            assert [r["Invoice No"] for r in sorted(rows, key=lambda r: r["ord"])] == [f"a{i}" for i in range(5000)] + [f"b{i}" for i in range(17)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["source_ref"] for r in readers.read_sheet(spark, str(tmp_path / "b.csv")).collect()} == {f"csv!R{i}" for i in range(2, 19)}


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "my q.csv").write_text('Invoice No,Narration\n1,"two\nlines and a ""quote"""\n2,one\n')
    got = readers.read_sheet(spark, str(tmp_path / "my q.csv")).orderBy("ord").collect()
    assert [(r["Invoice No"], r["Narration"], r["source_ref"]) for r in got] == [("1", 'two\nlines and a "quote"', "csv!R2"), ("2", "one", "csv!R3")]


def write_csv(path, seed, rows):
    import csv
    import random
    r = random.Random(seed)
    values = ["plain", "", "two\nlines", 'a ""quote""'.replace('""', '"'), "a, comma", '"', '\n"\n', "x" * 300, "three\n\nlines", 'end"', "é 😀", "5 in pipe"]
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=r.choice(["\n", "\r\n"]))
        w.writerow(["Invoice No", "Narration", "Party"])
        for n in range(rows):
            w.writerow([n, r.choice(values), r.choice(values)])
            if r.random() < 0.05:
                f.write("\n")      # a blank line is no record


def test_csv_with_line_breaks_inside_quotes_is_read_in_splits(spark, tmp_path):
    """Splits that start anywhere, also inside a quoted value, give the rows that the single-task reader gives."""
    for k in range(4):
        write_csv(tmp_path / f"f{k}.csv", k, 400)
    (tmp_path / "g.csv").write_text('Invoice No,Narration,Party\n0,a 5" pipe and 6",ok\n1,"open\n' + "long line\n" * 700 + 'end",z\n2,x,y')
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    want = sorted((str(r["Invoice No"]), str(r["Narration"]), str(r["Party"])) for r in whole.select("Invoice No", F.replace("Narration", F.lit("\r\n"), F.lit("\n")).alias("Narration"), "Party").collect())
    for size in ("700", "5000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = readers.read_sheet(spark, str(tmp_path)).collect()
            splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert splits > 5 or size == "134217728"
        assert sorted((str(r["Invoice No"]), str(r["Narration"]), str(r["Party"])) for r in rows) == want
        assert all(r["source_row"] == int(r["Invoice No"]) + 2 for r in rows) and len({r["source_ref"] for r in rows}) == 1603


@pytest.mark.parametrize(("line", "before", "after"), [("a,b", False, False), ('"a', False, True), ('"a"', False, False), ('a,"b', False, True), ('5" pipe,"x', False, True), ('5" pipe,x"y', False, False),
                                                       ('"a""', False, True), ('"a"",', False, True), ("x", True, True), ('x"', True, False), ('x","y', True, True), ('x""', True, True), ('",,"', True, True), (',"",', False, False)])
def test_what_a_line_leaves_open(line, before, after):
    assert readers.ends_open(line, before) == after


def test_empty_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("Amount\n")
    assert readers.read_sheet(spark, str(tmp_path / "a.csv")).count() == 0 and readers.read_sheet(spark, str(tmp_path / "b.csv")).columns[0] == "Amount"
    assert readers.read_sheet(spark, str(tmp_path / "b.csv")).count() == 0


def test_two_files_of_one_name_and_two_formats_keep_apart(spark, tmp_path):
    for folder in ("x", "y"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.csv").write_text("Amount\n1\n2\n")
    (tmp_path / "x" / "s.json").write_text('{"Amount": "3"}\n')
    got = readers.read_sheets(spark, [(str(tmp_path / "x" / "s.csv"), "csv"), (str(tmp_path / "y"), "csv"), (str(tmp_path / "x" / "s.json"), "json")]).collect()
    assert sorted(r["source_ref"] for r in got) == ["x/s.csv!R2", "x/s.csv!R3", "x/s.json!R2", "y/s!R2", "y/s!R3"]


def test_readme_pipeline_gives_one_feature_row_for_each_input_row(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("Invoice Number,Invoice Date,Taxable Value,GST Rate\n" + "".join(f"{name}{i},2024-01-0{i + 1},100,18\n" for i in range(2)))
    raw = readers.read_sheets(spark, [(str(tmp_path / f"{n}.csv"), "csv") for n in ("a", "b")])
    decided = rules.decide(raw)
    cls = decided.selectExpr("source_ref", "rule_category AS category", "CAST(NULL AS double) AS score", "rule_status <> 'RULE_MATCH' AS ambiguous")
    got = features.features(normalize.normalize(raw), Rules(), "27AAACB1234C1ZF", cls).select("source_ref", "invoice_number").collect()
    assert sorted(map(tuple, got)) == [("a!R2", "a0"), ("a!R3", "a1"), ("b!R2", "b0"), ("b!R3", "b1")]


def test_json_records(spark):
    df = spark.createDataFrame([(1, '[{"a": "x"}, {"a": "y"}]'), (2, '{"records": [{"a": "z"}]}'), (3, "oops"), (4, '{"other": 1}')], "k int, t string")
    rows = readers.json_records(df, "t", "k").orderBy("k", "pos").collect()
    assert [(r["k"], r["error"], r["record"]["a"] if r["record"] else None) for r in rows] == [
        (1, False, "x"), (1, False, "y"), (2, False, "z"), (3, True, None), (4, True, None)]


def test_results_are_never_overwritten(spark, tmp_path):
    target = str(tmp_path / "out")
    sinks.write_once(spark.range(3).toDF("a"), target)
    with pytest.raises(FileExistsError):
        sinks.write_report({"fresh": spark.range(1), "out": spark.range(1)}, str(tmp_path))
    assert not (tmp_path / "fresh").exists()
    assert sinks.run_folder("/x", "predictions") != sinks.run_folder("/x", "predictions")


def test_certificates(spark):
    new = spark.createDataFrame([("A", 1, "h1", "2024-01-02"), ("A", 2, "h2", "2024-01-01"), ("B", 3, "h3", "2024-01-01")],
                                "certificate_number string, ord int, voucher_hash string, issued_at string")
    first = CE.certify(new)
    assert {(r["certificate_number"], r["voucher_hash"]) for r in first.collect()} == {("A", "h2"), ("B", "h3")}
    assert CE.certify(new, first).count() == 0
    assert CE.rejected(new, first).first()["rejected"] == 1


def test_rule_overrides(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"base_currency": "usd", "valid_rates": ["9"], "outward": ["Sales"], "unknown": 1}')
    rules = load_rules(str(path))
    assert rules.base_currency == "USD" and [str(r) for r in rules.valid_rates] == ["9"] and rules.outward == ("Sales",)
    assert load_rules() == Rules()


def test_stream_equals_batch_over_several_files(spark, folder, tmp_path):
    from voucherflow.operators import features as FE
    from voucherflow.operators import validation as V
    from voucherflow.streaming import jobs
    orders = T.table(spark, folder, "orders")
    source = str(tmp_path / "in")
    orders.repartition(3).write.parquet(source)
    stream = jobs.file_stream(spark, source, orders)
    jobs.run_checks(T.books_from(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("source_ref", "finding_id").collect())
    want = sorted(tuple(r) for r in V.row_checks(FE.features(T.books(spark, folder))).select("source_ref", "finding_id").collect())
    assert got == want


def test_late_rows_close_days(spark, tmp_path):
    from voucherflow.streaming import jobs
    rows = [("2024-01-01 10:00:00", "a"), ("2024-01-02 10:00:00", "a"), ("2024-01-09 10:00:00", "b")]
    df = spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    for i, r in enumerate((df.limit(1), df.filter("event_type = 'a'").exceptAll(df.limit(1)), df.filter("event_type = 'b'"))):
        r.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), df)
    jobs.run_daily_counts(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(str(r["day"]), r["n_rows"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01", 1), ("2024-01-02", 1)}


def test_closed_days_and_late_rows(spark, tmp_path):
    """Every row is in a closed day, in a day still open, or among the late ones."""
    from voucherflow.streaming import jobs
    batches = [[("2024-01-01 10:00:00", "a"), ("2024-01-02 10:00:00", "a")], [("2024-01-09 10:00:00", "b"), (None, "a")], [("2024-01-01 23:00:00", "a"), ("2024-01-09 11:00:00", "b"), ("2024-01-08 12:00:00", "a")]]
    for rows in batches:
        df = spark.createDataFrame(rows, "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.run_closed_days(jobs.file_stream(spark, str(tmp_path / "in"), df), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(str(r["day"]), r["event_type"], r["n_rows"], r["late"]) for r in jobs.closed_days(spark, str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01", "a", 1, False), ("2024-01-02", "a", 1, False), ("2024-01-01", "a", 1, True)}
    ended = jobs.closed_days(spark, str(tmp_path / "out"), ended=True)
    assert ended.agg(F.sum("n_rows")).first()[0] == 6 and ended.filter("late").count() == 1


def test_numbers_expire_after_their_lifetime(spark, tmp_path):
    """Repeats within the lifetime are found over batches; a key whose time is over leaves the history and starts anew."""
    from voucherflow.streaming import jobs
    batches = [[("p", "1", "2024-01-01"), ("p", "2", "2024-01-01")], [("p", "1", "2024-01-20"), ("q", "1", "2024-01-21")], [("p", "1", "2024-02-15"), ("r", "9", "2024-02-15")], [("p", "2", "2024-02-16"), ("q", "1", "2024-03-30")]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([("outward", p, k, n * 10 + i, at) for i, (p, k, at) in enumerate(rows)], "`group` string, party string, number string, ord long, at string").withColumn("at", F.to_timestamp("at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.run_recent_duplicates(jobs.file_stream(spark, str(tmp_path / "in"), df), str(tmp_path / "h"), str(tmp_path / "ck"), "30 days").awaitTermination()
        alive = {(r["party"], r["number"], r["n"]) for r in jobs._Batches(spark, str(tmp_path / "h" / "alive"), jobs.RECENT).at(n).collect()}
        assert alive == [{("p", "1", 1), ("p", "2", 1)}, {("p", "1", 2), ("p", "2", 1), ("q", "1", 1)}, {("p", "1", 3), ("q", "1", 1), ("r", "9", 1)}, {("q", "1", 1)}][n]
    assert {(r["party"], r["number"], r["n"]) for r in jobs.recent_duplicates(spark, str(tmp_path / "h")).collect()} == {("p", "1", 3)}


def test_pages_by_key_read_only_their_range(spark, tmp_path):
    """Every page equals the one by offset, also with equal times over a page's end; a deep page's filter reaches the files."""
    from voucherflow.operators import console as K
    rows = spark.range(1000).select("id", F.timestamp_seconds(F.col("id") / 7 * 0 + F.floor(F.col("id") / 7)).alias("created_at"))
    store, last = K.sorted_store(rows, str(tmp_path / "s")), None
    for n in range(11):
        page = K.page_after(store, 100, last)
        got = [r["id"] for r in page.collect()]
        assert got == [r["id"] for r in K.newest(rows, 100, n * 100).collect()]
        last = K.last_key(page) or last
    plan = K.page_after(store, 100, last)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(created_at" in plan and K.last_key(store.limit(0)) is None
    assert K.retained(rows, 10).count() == 10


def test_a_batch_of_duplicate_numbers_is_dealt_to_all_cores(spark, folder, monkeypatch):
    """A batch is one file, so one task would make all of its keys."""
    from voucherflow.plans import streams
    seen, real = [], streams.jobs.numbered_stream
    monkeypatch.setattr(streams.jobs, "numbered_stream", lambda rows, *a: seen.append(rows) or real(rows, *a))
    streams.str_03(spark, folder)
    assert "Repartition" in seen[0]._jdf.queryExecution().logical().toString()
