import datetime
import hashlib
import http.server
import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.operators import access, constraints, graph
from sparrowmill.operators.history import Bloom, HashHistory
from sparrowmill.sources import grid, listing
from sparrowmill.streaming.aggregates import QuarterlyAggregates
from sparrowmill.versioned import Conflict, VersionedTable

# -- versions -------------------------------------------------------------------


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "part string, v int")


def held(table, *args, **kw):
    return sorted((r["part"], r["v"]) for r in table.read(*args, **kw).collect())


def test_versions_replace_and_append(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "part")
    with pytest.raises(ValueError):
        t.read()
    one = t.append(rows(spark, [("a", 1), ("b/=%", 2)]), t.snapshot())
    two = t.replace(rows(spark, [("a", 5), ("c", 7)]), one, {"batch": 3})
    three = t.append(rows(spark, [("c", 8)]), two)
    assert held(t, one) == [("a", 1), ("b/=%", 2)] and held(t, two) == [("a", 5), ("b/=%", 2), ("c", 7)]
    assert held(t) == [("a", 5), ("b/=%", 2), ("c", 7), ("c", 8)] and held(t, three, parts=["c"]) == [("c", 7), ("c", 8)]
    assert t.snapshot() == three and t.snapshot(2).notes == {"batch": 3} and held(t, parts=[]) == []
    assert {f.split("/_part=")[1].split("/")[0] for f in t.read(parts=["c"]).inputFiles()} == {"c"}
    assert t.vacuum() == 1 and held(t) == [("a", 5), ("b/=%", 2), ("c", 7), ("c", 8)]


def test_a_second_writer_fails_and_leaves_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "part")
    base = t.append(rows(spark, [("a", 1)]), t.snapshot())
    t.append(rows(spark, [("a", 2)]), base)
    before = t._names("data")
    with pytest.raises(Conflict):
        t.append(rows(spark, [("a", 3)]), base)
    assert held(t) == [("a", 1), ("a", 2)] and t._names("data") == before and not [n for n in t._names("manifests") if "draft" in n]


def test_a_writer_that_dies_half_way_changes_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "part")
    base = t.append(rows(spark, [("a", 1)]), t.snapshot())
    bad = rows(spark, [("a", 2), ("b", 3)]).withColumn("v", F.when(F.col("part") == "b", F.raise_error(F.lit("died"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="died"):
        t.replace(bad, base)
    t._stored(rows(spark, [("z", 9)]))  # data without a manifest
    assert held(t) == [("a", 1)]
    assert t.vacuum() >= 1 and held(t) == [("a", 1)]


# -- history ----------------------------------------------------------------------


def test_filters_hold_what_they_were_given():
    rng = np.random.default_rng(1)
    known, other = rng.integers(0, 1 << 63, (2, 5000, 2)).astype(np.uint64)
    bloom = Bloom.sized(5000)
    bloom.add(known)
    assert bloom.may_hold(known).all() and bloom.may_hold(other).mean() < 0.03


def test_batches_are_flagged_as_if_all_were_one(spark, tmp_path):
    rng = random.Random(3)
    digest = lambda k: hashlib.sha256(str(k).encode()).hexdigest()
    batches = [[(n * 1000 + k, None if rng.random() < 0.05 else digest(rng.randrange(150 * (n + 1)))) for k in range(300)] for n in range(4)]
    history, seen = HashHistory(spark, str(tmp_path / "h")), set()
    for batch in batches:
        frame = spark.createDataFrame(batch, "n int, hash string")
        got = {r["n"]: r["is_duplicate"] for r in history.flag(frame, ["n"]).collect()}
        for n, h in batch:
            assert got[n] == (h is not None and h in seen)
            seen.add(h)
        history.add(frame)
        history.add(frame)  # once more changes nothing
    assert history.hashes.read().count() == len(seen - {None})
    assert sum(r["n"] for r in history.filters.read().collect()) == len(seen - {None})


def test_only_touched_buckets_are_opened(spark, tmp_path):
    history = HashHistory(spark, str(tmp_path / "h"), 2)
    history.add(spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash")))
    one = spark.range(1).select(F.sha2(F.lit("7"), 256).alias("hash"))
    known = history.known(one)
    assert known.count() == 1
    files = [f for f in known.inputFiles() if "/hashes/" in f]
    assert {f.split("/_part=")[1].split("/")[0] for f in files} == {hashlib.sha256(b"7").hexdigest()[:2]}


# -- aggregates -------------------------------------------------------------------


def test_a_batch_counts_once_and_touches_its_quarters_only(spark, tmp_path):
    kept = QuarterlyAggregates(spark, str(tmp_path / "a"))
    day = datetime.date
    batch = lambda *items: spark.createDataFrame([(1, "rice", d, p) for d, p in items], "district_id int, commodity string, test_date date, pass_fail boolean")
    kept.merge(batch((day(2024, 1, 5), True), (day(2024, 5, 1), False)), 0, F.lit(True))
    before = kept.table.snapshot().parts["2024-Q2"]
    kept.merge(batch((day(2024, 2, 5), False), (day(2024, 2, 6), None), (None, False)), 1, F.lit(True))
    kept.merge(batch((day(2024, 2, 5), False)), 1, F.lit(True))  # handed over again
    kept.merge(batch(), 2, F.lit(True))
    got = {r["quarter"]: (r["n_tests"], r["fail_rate"], r["risk_score"]) for r in kept.current().collect()}
    assert got == {"2024-Q1": (3, 0.3333, 33.33), "2024-Q2": (1, 1.0, 100.0)}
    assert kept.table.snapshot().parts["2024-Q2"] == before and kept.table.snapshot().version == 2


# -- a listing, page by page --------------------------------------------------------


def site(n):
    links = {1: ["a.pdf", "b.PDF", "x.html"], 2: ["b.PDF", "c.pdf"], 3: ["c.pdf"], 4: ["never.pdf"]}
    return "".join(f'<a class="k" href="/f/{x}">t</a>' for x in links.get(n, []))


def test_pages_keep_their_distance_and_end_at_the_first_without_news():
    asked, waited = [], []

    def get(url):
        asked.append(url)
        return 200, site(int(url.partition("?page=")[2] or 1))

    reader = listing.PacedListing("http://host/list", 50, get=get, sleep=waited.append)
    at, got = reader.initialOffset(), []
    for _ in range(6):
        found, at = reader.read(at)
        got += [n for n, _, _ in found]
    assert got == [1, 2] and asked == ["http://host/list", "http://host/list?page=2", "http://host/list?page=3"] and waited == [listing.SPACING] * 3
    again = listing.PacedListing("http://host/list", 50, get=get, sleep=waited.append)
    assert again.read(at)[1] == at and len(asked) == 3
    assert [n for n, _, _ in again.readBetweenOffsets(reader.initialOffset(), at)] == [1, 2]
    assert listing.PacedListing("http://host/list", 0, get=get).read(reader.initialOffset())[1]["page"] == 0


def test_a_listing_is_followed_as_a_stream(spark, tmp_path):
    times = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            times.append((self.path, time.time()))
            body = site(int(self.path.partition("?page=")[2] or 1)).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/list"
        for _ in range(2):  # the second call has nothing left to ask for
            pages = listing.followed(spark, url, str(tmp_path), spacing=0.3)
            assert sorted(r["page_no"] for r in pages.collect()) == [1, 2]
        assert [p for p, _ in times] == ["/list", "/list?page=2", "/list?page=3"]
        assert all(b - a >= 0.29 for (_, a), (_, b) in zip(times, times[1:]))
    finally:
        server.shutdown()


# -- tables from words ------------------------------------------------------------


def test_tables_are_rebuilt_from_words(spark):
    place = lambda x, y, text, page=1: [("u", page, x + 6.0 * text.index(w), x + 6.0 * text.index(w) + 6.0 * len(w), float(y), y + 10.0, w) for w in text.split()]
    words = [*place(0, 0, "A long title that spans every column of the page"), *place(0, 15, "Product"), *place(100, 16, "Value"), *place(200, 15, "Unit")]
    words += [*place(0, 30, "Basmati rice"), *place(104, 29, "12"), *place(200, 31, "ppb"), *place(2, 45, "Milk"), *place(200, 45, "ppm"), *place(0, 60, "Remarks follow here"), *place(0, 75, "x"), *place(50, 76, "y")]
    words += [*place(0, 0, "p", 2), *place(90, 1, "q", 2), ("u", 2, None, 1.0, 1.0, 1.0, "lost"), ("u", 2, 1.0, 2.0, 1.0, 1.0, " ")]
    random.Random(2).shuffle(words)
    frame = spark.createDataFrame(words, "source_url string, page int, x0 double, x1 double, y0 double, y1 double, word string")
    got = {(r["page"], r["table_no"]): r["rows"] for r in grid.tables_of_words(frame, 8.0).collect()}
    assert got == {(1, 1): [["Product", "Value", "Unit"], ["Basmati rice", "12", "ppb"], ["Milk", "", "ppm"]], (1, 2): [["x", "y"]], (2, 1): [["p", "q"]]}
    assert grid.tables_of_words(frame.limit(0), 8.0).count() == 0


# -- constraints, access, blended estimates ---------------------------------------------


def test_every_kind_of_constraint(spark):
    rows_ = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", None, "y"), (3, None, 6, "x"), (4, "b", 7, None), (None, "c", 5, None)], "id int, name string, parent int, kind string")
    parents = spark.createDataFrame([(5,), (5,), (7,), (None,)], "id int")
    rules = [constraints.Required("id"), constraints.Unique("name_once", ("name",)), constraints.Unique("pair_once", ("name", "kind")), constraints.Reference("parent_known", "parent", parents, "id"), constraints.one_of("kind", ("x",))]
    got = {(r["id"], r["name"]): r["broken"] for r in constraints.broken(rows_, rules).collect()}
    assert got == {(1, "a"): ["name_once"], (2, "a"): ["name_once", "kind_value"], (3, None): ["parent_known"], (4, "b"): [], (None, "c"): ["id_required"]}
    good, bad = constraints.quarantine(rows_, rules)
    assert good.count() == 1 and bad.count() == 4 and good.columns == rows_.columns
    assert constraints.broken(rows_, []).where("size(broken) > 0").count() == 0


def test_rows_of_a_user_and_rows_that_must_exist(spark):
    table = spark.createDataFrame([(1, 42, False), (2, 7, True), (3, None, False)], "id int, owner int, open boolean")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(access.visible(table, "owner", 42)) == [1] and ids(access.visible(table, "owner", None)) == []
    assert ids(access.visible(table, "owner", 42, F.col("open"))) == [1, 2] and ids(access.visible(table, "owner", None, F.col("open"))) == [2]
    assert access.by_key(table, "id", 2).first()["owner"] == 7
    with pytest.raises(access.NotFound):
        access.by_key(table, "id", 9, "district")


def test_blended_estimates(spark):
    nodes = spark.createDataFrame([(1, 10.0, 10), (2, 20.0, 4), (3, None, 0), (4, 8.0, 20)], "node long, measured double, n_tests int")
    edges = spark.createDataFrame([(1, 2, 0.5, 0.5), (2, 3, 1.0, 1.0), (3, 4, 1.0, 0.5)], "source long, target long, retention double, link double")
    got = {r["node"]: (round(r["estimate"], 9), round(r["confidence"], 9), r["source"]) for r in graph.propagate(nodes, edges, blend=True).collect()}
    two = 0.88 * 5 + 0.12 * 20
    assert got == {1: (10.0, 0.9, "measured"), 2: (round(two, 9), 0.65, "mixed"), 3: (round(two, 9), 0.6, "propagated"), 4: (round(0.7 * two + 0.3 * 8, 9), 0.9, "mixed")}
    assert {r["source"] for r in graph.propagate(nodes, edges).collect()} == {"measured", "propagated"}
