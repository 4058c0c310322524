"""Each stage of the pipeline on its own input, against a plain version of it."""

import random

import pytest

import corpus_pipeline
from sparrowmill.llm import decontamination, packing, toxicity
from sparrowmill.storage import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, small), name)
        out.append((name, docs, result))
        docs = result
    return {name: (a, b) for name, a, b in out}


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scan", "packing"]
    assert all(stages[name][1].columns == COLUMNS for name in list(stages)[:-1])


def test_toxic_documents_are_out(stages, spark, small):
    before, after = stages["toxicity"]
    scores = toxicity.toxicity_scores(before, spark.read.parquet(f"{small}/labels.parquet")).collect()
    assert ids(after) == {r["doc_id"] for r in scores if not r["predicted"]}


def test_one_of_each_group_stays(stages):
    from test_text_operators import prints_by_hand

    before, after = stages["near_dedup"]
    fp = {r["doc_id"]: prints_by_hand(r["text"]) for r in before.collect()}
    label, changed = {d: d for d in fp}, True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if label[b] < label[a] and bin(fp[a] ^ fp[b]).count("1") <= 3:
                    label[a], changed = label[b], True
    assert ids(after) == set(label.values())


def test_documents_with_items_are_out(stages, spark, small):
    before, after = stages["decontamination"]
    plain = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    holds = {r["doc_id"] for r in before.collect() if any(i in plain(r["text"]) for i in items)}
    assert not holds & ids(after)
    gone = ids(before) - ids(after)
    index = decontamination.SeedIndex([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    assert gone == {r["doc_id"] for r in before.collect() if index.search([r["text"]])} >= holds


def test_secrets_are_masked(stages):
    from test_text_operators import base_by_hand

    before, after = stages["secret_scan"]
    old, new = {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r for r in after.collect()}
    assert set(old) == set(new)
    for doc, text in old.items():
        assert not base_by_hand(new[doc]["text"])
        assert (new[doc]["text"] != text) >= bool(base_by_hand(text)) and new[doc]["n_chars"] == len(new[doc]["text"])


def test_everything_is_packed(stages):
    before, after = stages["packing"]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == ids(before)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * total / packing.CAPACITY + 2


def test_run_and_empty_tables(spark, small, tmp_path, stages):
    assert corpus_pipeline.run(spark, small).count() == stages["packing"][1].count()
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_rows(spark, small):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["ba", "do", "ki", "lu", "me"]) * rng.randint(1, 3) for _ in range(60))
    rows = [(k, text(), "en", "s", 1, "more") for k in range(20)] + [(None, text(), None, None, None, None), (21, None, None, None, None, None), (22, "", None, None, None, None)]
    rows += rows[3:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, small), name)
        assert docs.columns[-1] == "row"
    assert docs.count() == 22
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 22
