import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import fuzzy, graph, upsert
from sparrowmill.sources import formats

NODES = [(1, 40.0, 5), (2, None, 0), (3, None, 0), (4, None, 0), (5, None, 0)]
EDGES = [(1, 2, 0.9, 0.8), (1, 3, 0.7, 0.5), (2, 3, 0.5, 0.9), (3, 4, None, None), (3, 99, 1.0, 1.0)]


def chain(spark, more=()):
    nodes = spark.createDataFrame(NODES, "node long, measured double, n_tests long")
    edges = spark.createDataFrame(EDGES + list(more), "source long, target long, retention double, link double")
    return nodes, graph.clean_edges(edges, nodes)


def test_propagation(spark):
    got = {r["node"]: (r["estimate"], r["confidence"], r["source"]) for r in graph.propagate(*chain(spark)).collect()}
    assert got[1] == (40.0, pytest.approx(0.75), "measured") and got[2] == (36.0, pytest.approx(0.6), "propagated")
    assert got[3] == (pytest.approx(22.0983606557), pytest.approx(0.4575), "propagated")
    assert got[4] == (pytest.approx(22.0983606557), pytest.approx(0.22875), "propagated") and got[5] == (None, 0.0, "none")


def test_a_cycle_leaves_no_estimates(spark):
    nodes, edges = chain(spark, [(4, 1, 1.0, 1.0)])
    assert all(r["estimate"] is None for r in graph.propagate(nodes, edges).collect())


def test_ancestors(spark):
    _, edges = chain(spark, [(4, 1, 1.0, 1.0)])
    assert {r["node"] for r in graph.ancestors(edges, 4).collect()} == {1, 2, 3}
    assert {r["node"] for r in graph.ancestors(edges, 4, 1).collect()} == {3}


def test_upsert_is_idempotent_and_keeps_other_columns(spark):
    old = spark.createDataFrame([("a", 1, 9.0), (None, 2, 8.0)], "k string, n int, ci double")
    new = spark.createDataFrame([(None, 5), ("b", 6)], "k string, n int")
    once = upsert.upsert(old, new, ["k"], ["n"], {"ci": 0.0})
    want = {("a", 1, 9.0), (None, 5, 8.0), ("b", 6, 0.0)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in upsert.upsert(once, new, ["k"], ["n"], {"ci": 0.0}).collect()}


def test_insert_absent(spark):
    old = spark.createDataFrame([(3, "x")], "id int, name string")
    got = upsert.insert_absent(old, spark.createDataFrame([("y",), ("x",), (None,), ("w",), ("y",)], "name string"), "name", "id")
    assert {tuple(r) for r in got.collect()} == {(3, "x"), (4, "w"), (5, "y")}


def test_numbers_in_order_over_many_ranges(spark):
    import random

    names = [f"{n:06x}" for n in random.Random(5).sample(range(1 << 20), 5000)] + [None, "", "same", "same"]
    rows = spark.createDataFrame([(n, "clash") for n in names], "name string, _n string").repartition(7)
    got = sorted((r["id"], r["name"], r["_n"]) for r in upsert.in_order(rows, "name", "id").collect())
    assert [g[0] for g in got] == list(range(1, len(names) + 1))
    assert [g[1] for g in got] == [None, *sorted(names[:5000] + names[5001:])] and {g[2] for g in got} == {"clash"}
    assert upsert.in_order(spark.createDataFrame([], "name string"), "name", "id").count() == 0


def test_a_district_is_sought_at_the_customers(spark, small):
    from sparrowmill.plans import views

    own = views.facts(spark, small).where((F.col("district_id") == 1) & ~F.col("is_duplicate"))
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window") :]
    assert "c_nationkey" in window and "(c_nationkey" in window[window.index("Filter") :]
    shuffled = views.facts(spark, small).where(~F.col("is_duplicate")).select("order_id", "is_duplicate", "amount")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("hashpartitioning(l_orderkey") == 1


def test_gaps_in_features_are_filled(spark):
    from sparrowmill.operators import features

    aggregates = [(1, "a", "2024-Q1", 5, 0.2), (1, "a", "2024-Q2", 4, 0.5), (2, "a", "2024-Q2", 3, 0.1), (2, "a", "2024-Q3", 3, None), (1, "b", "2024-Q1", 2, 1.0), (3, "a", "2024-Q4", 9, 0.0), (9, "a", "2024-Q1", 9, 0.3)]
    rows = spark.createDataFrame(aggregates, "district_id int, commodity string, quarter string, n_tests int, fail_rate double")
    districts = spark.createDataFrame([(1, "n", 61.5, None), (2, "n", None, 12.0), (3, None, float("nan"), 0.0)], "district_id int, state string, wqi double, industry double")
    got = {(r["district_id"], r["quarter"]): r for r in features.training_features(rows, districts).collect()}
    assert set(got) == {(1, "2024-Q1"), (1, "2024-Q2"), (2, "2024-Q2"), (2, "2024-Q3"), (3, "2024-Q4")}
    assert [got[1, q]["slope"] for q in ("2024-Q1", "2024-Q2")] == [0.0, pytest.approx(0.3)] and got[2, "2024-Q3"]["slope"] == 0.0
    assert got[1, "2024-Q2"]["state_rate"] == pytest.approx(0.3) == got[2, "2024-Q2"]["state_rate"] and got[2, "2024-Q3"]["state_rate"] is None
    assert [(r["wqi"], r["industry"], r["density"]) for r in (got[1, "2024-Q1"], got[2, "2024-Q2"], got[3, "2024-Q4"])] == [(61.5, 50.0, 500.0), (50.0, 12.0, 500.0), (50.0, 0.0, 500.0)]
    assert [got[k]["label"] for k in ((1, "2024-Q1"), (2, "2024-Q3"), (3, "2024-Q4"))] == [1, 0, 0]
    assert features.training_features(rows.limit(0), districts).count() == 0


def test_fuzzy_names(spark):
    aliases = spark.createDataFrame([(0, "aflatoxin b1", "af"), (1, "lead", "pb"), (2, "cadmium", "cd")], "rank int, alias string, canonical string")
    rows = spark.createDataFrame([(" Lead ",), ("b1 aflatoxn",), ("leed",), ("",), (None,), ("cadmum",)], "name string")
    got = {r["name"]: r["canonical"] for r in fuzzy.canonicalise(rows, "name", aliases, 80.0).collect()}
    assert got == {" Lead ": "pb", "b1 aflatoxn": "af", "leed": None, "": None, None: None, "cadmum": "cd"}


def test_links_are_resolved(spark):
    html = '<a class="x" href="/files/Delhi%20report.PDF"> Report <b>Delhi</b> </a><a href="b.pdf"></a><A HREF="http://other/c.pdf">C</A><a href="d.html">no</a><a href="b.pdf">again</a>'
    pages = spark.createDataFrame([(1, "http://host/dir/page?x=1", html), (2, "http://host", None)], "page_id int, url string, html string")
    got = {r["url"]: (r["title"], r["state"]) for r in formats.html_links(pages).collect()}
    assert set(got) == {"http://host/files/Delhi%20report.PDF", "http://host/dir/b.pdf", "http://other/c.pdf"}
    assert got["http://host/files/Delhi%20report.PDF"] == ("Report Delhi", "Delhi")


def test_tables_of_documents(spark):
    rows = [["Commodity", "Analyte", "Result", None], ["Rice", "Lead", " 5 ", "x"], [None, " ", "", ""], ["Milk"]]
    df = spark.createDataFrame([("u", rows), ("v", [["only header"]])], "source_url string, rows array<array<string>>")
    got = [(r["product_name"], r["contaminant"], r["value"], r["pass_fail"], r["unit"]) for r in formats.table_records(df).orderBy("row_no").collect()]
    assert got == [("Rice", "Lead", "5", "5", None), ("Milk", None, None, None, None)]


def test_feeds_and_markets(spark):
    feeds = spark.createDataFrame([("f", "<rss><channel><item><title>Import Alert - Groundnut - Aflatoxin - India</title><link> http://l </link></item></channel></rss>"), ("g", "<rss><broken"), ("h", None)], "feed_url string, xml string")
    assert [tuple(r) for r in formats.feed_items(feeds).collect()] == [("http://l", "Groundnut", "Aflatoxin", None, "fail")]
    markets = spark.createDataFrame([("a", '[{"Commodity": " Rice ", "min_price": 0, "modal_price": 7}]'), ("b", '{"records": [{"commodity": "Dal", "state": ""}]}'), ("c", "nonsense")], "source_url string, json string")
    got = {tuple(r) for r in formats.market_records(markets).select("source_url", "product", "state", "value").collect()}
    assert got == {("a", "Rice", None, "7"), ("b", "Dal", None, None)}


def test_fields_of_text_and_pages(spark):
    text = "Lab report LAB/AB1234: Aflatoxin B1 found 12.5 µg/kg on 03/04/2024 in Kerala, not safe"
    row = formats.text_fields(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert (row["contaminant"], row["value"], row["unit"], row["verdict"], row["date"], row["state"], row["lab_id"]) == ("Aflatoxin B1", "12.5", "µg/kg", "not safe", "03/04/2024", "Kerala", "LAB/AB1234")
    pages = spark.createDataFrame([("u", 1, b"low"), ("v", 1, b"high"), ("w", 1, b"")], "source_url string, page int, image binary")
    read = formats.recognised(pages, lambda x: (x.decode() + " lead", 0.5 if x == b"low" else 0.9) if x else ("", 1.0), lambda x: ("cadmium 5 ppb", 0.7))
    got = {r["source_url"]: (r["text"], r["conf"]) for r in read.collect()}
    assert got == {"u": ("cadmium 5 ppb", 0.7), "v": ("high lead", 0.9)}
    records = spark.createDataFrame([("v", "lead", "1", "ppb", None, None, None)], "source_url string, contaminant string, value string, unit string, date string, state string, lab_id string")
    both = formats.documents_or_pages(records, read)
    assert {(r["source_url"], r["contaminant"]) for r in both.collect()} == {("v", "lead"), ("u", "cadmium")}


def test_stream_runs_to_its_end(spark, small):
    from sparrowmill.streaming.ingest import event_windows

    assert event_windows(spark, small).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()


def test_facts_are_appended_by_year_and_pruned(spark, tmp_path):
    import datetime

    from sparrowmill.operators import ingest

    day = datetime.date
    rows = [("rice", "lead", 1.0, day(2024, 5, 1)), ("rice", "lead", 2.0, None), (None, "lead", 3.0, day(2023, 1, 1)), ("rice", "lead", None, day(2023, 1, 1)), ("dal", "lead", 4.0, day(2025, 2, 1))]
    df = spark.createDataFrame(rows, "commodity string, contaminant string, ppb double, test_date date")
    assert ingest.append_facts(df, str(tmp_path / "facts"), "2026-06-30") == (3, 2)
    assert ingest.append_facts(df.limit(0), str(tmp_path / "facts"), "2026-06-30") == (0, 0)
    stored = spark.read.parquet(str(tmp_path / "facts"))
    assert sorted(r["ppb"] for r in ingest.facts_since(stored, "2025-02-01").collect()) == [2.0, 4.0]
    assert "test_year" in ingest.facts_since(stored, "2025-02-01")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]


def test_a_batch_run_twice_is_all_duplicates(spark):
    import datetime

    from sparrowmill.operators import ingest

    a, b, c = ((n, datetime.date(2024, 1, n), "lab", "rice", "lead", float(n), "") for n in (1, 2, 3))
    schema = "n int, test_date date, lab string, commodity string, contaminant string, ppb double, district string"
    batch = spark.createDataFrame([a, b, (4, *a[1:]), c], schema)
    none = spark.createDataFrame([], "hash string")
    history = ingest.flag_duplicates(spark.createDataFrame([c], schema), none, ["n"])
    once = ingest.flag_duplicates(batch, history, ["n"])
    assert [r["is_duplicate"] for r in once.orderBy("n").collect()] == [False, False, True, True]
    assert all(r["is_duplicate"] for r in ingest.flag_duplicates(batch, once, ["n"]).collect())


def test_fetching_waits_and_gives_up():
    from sparrowmill.sources.listing import Listing, fetched

    waits = []
    answers = iter([(429, ""), (503, ""), (200, "page")])
    assert fetched("u", lambda _: next(answers), waits.append) == "page" and waits == [2.0, 60.0, 2.0, 10.0, 2.0]
    assert fetched("u", lambda _: (0, ""), waits.append) is None
    with pytest.raises(ValueError):
        fetched("u", lambda _: (404, ""), waits.append)
    reader = Listing({"url": "http://host/list", "pages": "3"}).reader(None)
    assert [p.value for p in reader.partitions()] == [1, 2, 3]


def test_a_listing_ends_at_a_page_without_new_links(spark):
    page = lambda *names: "".join(f"<a href='{n}.pdf' title='T {n}'></a>" for n in names)
    rows = [(1, "http://h/l", page("a", "b")), (2, "http://h/l", page("b", "c")), (3, "http://h/l", page("a", "c")), (4, "http://h/l", page("d"))]
    got = formats.listed_links(spark.createDataFrame(rows, "page_no int, url string, html string")).collect()
    assert sorted((r["page_no"], r["url"], r["title"]) for r in got) == [(1, "http://h/a.pdf", "T a"), (1, "http://h/b.pdf", "T b"), (2, "http://h/c.pdf", "T c")]


def test_landed_files_are_read_with_their_place(spark, tmp_path):
    place = spark.range(1).select(formats.landed_path(F.lit("fssai"), F.lit("list"), F.lit("http://h/a/b.pdf?x=1")).alias("p"), formats.landed_path(F.lit("s"), F.lit("t"), F.lit("http://h")).alias("q")).first()
    assert tuple(place) == ("raw/fssai/list/b.pdf", "raw/s/t/report.pdf")
    (tmp_path / place["p"]).parent.mkdir(parents=True)
    (tmp_path / place["p"]).write_bytes(b"12345")
    assert [tuple(r) for r in formats.landed_files(spark, str(tmp_path)).select("source", "page_type", "size", "content").collect()] == [("fssai", "list", 5, b"12345")]


def test_districts_by_name(spark):
    from sparrowmill.operators import places

    dims = spark.createDataFrame([(1, "Ahmedabad", "Gujarat", None), (2, "Coimbatore", "Tamil Nadu", None), (3, "Bengaluru", "Karnataka", ["Blr"]), (4, "Blr", "Goa", None)], "id int, name string, state string, alternate_names array<string>")
    rows = spark.createDataFrame([("ahmadabad", None), ("coimbatur", "Tamil Nadu"), ("coimbatur", "Goa"), ("bangalore", None), ("blr", "Karnataka"), (" BLR ", None), (None, "Goa"), ("", None)], "district string, state string")
    got = [(r["district"], r["state"], r["district_id"], r["district_name"]) for r in places.resolve_districts(rows, dims).collect()]
    want = [("ahmadabad", None, 1, "Ahmedabad"), ("coimbatur", "Tamil Nadu", 2, "Coimbatore"), ("coimbatur", "Goa", None, "coimbatur"), ("bangalore", None, None, "bangalore"), ("blr", "Karnataka", 3, "Bengaluru"), (" BLR ", None, 4, "Blr"), (None, "Goa", None, None), ("", None, None, "")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_write_back_and_audit_are_idempotent(spark):
    from sparrowmill.operators import fraud_pass

    flag = "array<struct<type:string,score:double>>"
    schema = f"k int, fraud_flags {flag}, fraud_score double, geo_plausibility_ok boolean, value_is_round boolean, lab_flagged boolean"
    facts = spark.createDataFrame([(1, None, 0.1, None, None, None), (2, None, 0.7, None, None, None)], schema)
    scored = spark.createDataFrame([(1, [("lab", 0.25), ("cluster", 0.2)], 0.45, True, False, True)], schema)
    once = fraud_pass.write_back(facts, scored, ["k"])
    assert {(r["k"], r["fraud_score"], r["lab_flagged"]) for r in once.collect()} == {(1, 0.45, True), (2, 0.7, None)}
    audit = fraud_pass.append_audit(spark.createDataFrame([], "k int, flag_type string, score double"), scored, ["k"])
    assert fraud_pass.append_audit(audit, scored, ["k"]).count() == audit.count() == 2
    none = spark.createDataFrame([], "k int")
    assert fraud_pass.selected(facts, "k", none, "2024-01-01").count() == 0


def test_trees_as_arrays_score_as_spark_does(spark, tmp_path):
    import random

    from pyspark.ml.functions import vector_to_array

    from sparrowmill.operators import forest

    rng = random.Random(1)
    rows = []
    for k in range(400):
        x = [rng.random() for _ in range(7)]
        rows.append((k, f"2020-Q{k % 4 + 1}" if k < 200 else f"2021-Q{k % 4 + 1}", "a" if k % 5 else "b", *x, int(x[0] + x[3] + rng.random() > 1.5)))
    df = spark.createDataFrame(rows, "id int, quarter string, state string, " + ", ".join(f"{c} double" for c in forest.FEATURES) + ", label int")
    model, held = forest.fit(df, ("b",), trees=15)
    want = {r["id"]: r["p"] for r in model.transform(df).select("id", (100 * vector_to_array("probability")[1]).alias("p")).collect()}
    got = {r["id"]: (r["lower"], r["risk"], r["upper"]) for r in forest.scores(model, df).collect()}
    assert all(got[k][1] == pytest.approx(p) and got[k][0] <= got[k][1] + 1e-9 and got[k][1] <= got[k][2] + 1e-9 for k, p in want.items())
    cv = forest.cross_validated(df, folds=3, trees=5)
    assert len(cv["aucs"]) == 3 and 0.5 < cv["auc_mean"] <= 1 and held["auc"] > 0.6
    forest.save(model, str(tmp_path / "m"))
    assert forest.top_importances(forest.load(str(tmp_path / "m"))) == forest.top_importances(model)
