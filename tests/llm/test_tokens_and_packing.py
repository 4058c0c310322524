import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowmill.llm import packing, token_counts
from sparrowmill.llm.bpe_fst import BpeTransducer

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def fst():
    return BpeTransducer(PATH)


def library(fst, text):
    return fst.library.encode(text or "", add_special_tokens=False).ids


ODD = ["it's 'sabc ''s !'s we'll've x'RE", "Ünïcode İstanbul ß ſ Σας", "日本語 text <|endoftext|>abc a<|startoftext|>", "a\x1cb\x85c\xa0d e", "", " ", "12³ 4½5", "é Éx", "a" * 3000, "\x00\x01 a\x7fb", "'", "'s", "x'll", "🙂🙂 ok"]


def test_ids_and_counts_are_the_library_s(fst, spark, small):
    texts = ODD + [None] + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    want = [library(fst, t) for t in texts]
    assert [x.tolist() for x in fst.ids(texts)] == want
    assert fst.counts(texts).tolist() == [len(w) for w in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcehilnorstuABSTéÉß '.,!?-0129\n\tΣ🙂<|>"), max_size=700), max_size=4))
def test_any_text(texts):
    global _one
    fst = _one = globals().get("_one") or BpeTransducer(PATH)
    assert [x.tolist() for x in fst.ids(texts)] == [library(fst, t) for t in texts]
    assert fst.counts(texts).tolist() == [len(library(fst, t)) for t in texts]


def test_a_full_table_is_cleared(monkeypatch):
    import sparrowmill.llm.bpe_fst as module

    monkeypatch.setattr(module, "MAX_STATES", 50)
    fst = BpeTransducer(PATH)
    texts = ["some words here", "and other ones there", "quite different spellings"]
    assert [fst.counts([t])[0] for t in texts * 2] == [len(library(fst, t)) for t in texts * 2]


def letters(n, seed):
    return "".join(np.random.default_rng(seed).choice(list("abcdefghijklmnopqrstuvwxyzé"), n))


def test_long_words_and_random_letters_are_bounded(fst):
    import time

    import sparrowmill.llm.bpe_fst as module

    before, began = len(fst.states), time.time()
    word = letters(1_000_000, 1)
    assert fst.counts([word, "x" + word[:100_000]]).tolist() == [len(library(fst, word)), len(library(fst, "x" + word[:100_000]))]
    assert len(fst.states) == before and time.time() - began < 12
    text = " ".join(letters(9, k) for k in range(40_000))
    assert [x.tolist() for x in fst.ids([text, "some words"])] == [library(fst, text), library(fst, "some words")]
    assert len(fst.states) <= module.MAX_STATES + module.NEW_STATES == len(fst.table)


SCRIPTS = [
    "Все люди рождаются свободными и равными в своём достоинстве и правах. ",
    "Όλοι οι άνθρωποι γεννιούνται ΕΛΕΎΘΕΡΟΙ ΚΑΙ ΊΣΟΙΣ στην αξιοπρέπεια ",
    "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता प्राप्त है। ",
    "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心\u3000并应以兄弟关系的精神相对待",
    "すべての人間は、生まれながらにして自由であり",
    "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق ",
    "모든 인간은 태어날 때부터 자유로우며 🙂 ",
]


def long_runs():
    rng = np.random.default_rng(7)
    mixed = "".join(rng.choice(list(SCRIPTS[3].replace("\u3000", "")), 30_000))
    return [mixed, "的" * 20_000, "a" * 50_000, "ab" * 9_999 + "c", "-" * 7001 + "=-" * 4000, "х" * 3001 + " да", "1" * 3000, "".join(rng.choice(list("abc"), 5000))]


def test_scripts_and_long_runs_stay_in_the_transducer(fst, monkeypatch):
    texts = [t * 30 for t in SCRIPTS] + long_runs()
    want = [library(fst, t) for t in texts]
    monkeypatch.setattr(fst, "_library_ids", lambda text: pytest.fail(f"{len(text)} characters for the library"))
    assert [x.tolist() for x in fst.ids(texts)] == want
    assert fst.counts(texts).tolist() == [len(w) for w in want]


def test_the_scan_of_maps_gives_what_one_chunk_gives(fst, monkeypatch):
    import sparrowmill.llm.bpe_fst as module

    texts = [t[:2000] for t in long_runs()] + SCRIPTS
    for chunk in (3, 8, 4096):
        monkeypatch.setattr(module, "CHUNK", chunk)
        assert [x.tolist() for x in fst.ids(texts)] == [library(fst, t) for t in texts]


def test_every_character_of_the_alphabet(fst):
    import re

    import sparrowmill.llm.bpe_fst as module

    inside = re.compile(f"[{module.alphabet()}]")
    chars = [c for c in map(chr, range(0x30000)) if inside.match(c)]
    assert len(chars) > 100_000
    own = BpeTransducer(PATH)
    texts = [" ".join(f"a{c}1{c}{c}.{c}'s x{c}" for c in chars[k : k + 200]) for k in range(0, len(chars), 200)]
    want = [library(fst, t) for t in texts]
    assert [x.tolist() for x in own.ids(texts)] == want


def test_controls_and_new_letters_go_to_the_library(fst):
    texts = ["ab\x1ccd " * 3, "ok \u1c90\u1c91" + "z" * 90 + " end", "\U000f0000 x", "\u180e1 a" * 5]
    assert [x.tolist() for x in fst.ids(texts)] == [library(fst, t) for t in texts]


def test_texts_longer_than_a_piece_are_cut_at_white_space(fst, monkeypatch):
    import sparrowmill.llm.bpe_fst as module

    monkeypatch.setattr(module, "PIECE_BYTES", 300)
    texts = ["\xa0".join(letters(k % 60 + 1, k) for k in range(90)), " ".join(["it's", "Ünïcode"] * 200) + " 日本 end " + "ab\n" * 500, "z" * 63 + " " + "y" * 64]
    assert [x.tolist() for x in fst.ids(texts)] == [library(fst, t) for t in texts]
    assert fst.counts(texts).tolist() == [len(library(fst, t)) for t in texts]


DOCS = "doc_id long, text string, n_tokens string, lang string"


def test_counts_of_odd_rows(spark, fst):
    rows = [(1, "some words", "x", None), (None, None, None, None), (2, "", "y", "en"), (3, "word " * 3000, None, None), (1, "some words", "x", None)]
    got = sorted(tuple(r) for r in token_counts.token_counts(spark.createDataFrame(rows, DOCS), PATH).where("doc_id is not null").collect())
    assert got == [(1, 10, 2, False), (1, 10, 2, False), (2, 0, 0, False), (3, 15000, 3000, True)]
    assert token_counts.token_counts(spark.createDataFrame([], DOCS), PATH).count() == 0


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_whole_and_tight(spark, fst):
    rng = np.random.default_rng(3)
    rows = [(int(k), "word " * int(n), "clash", None) for k, n in enumerate(rng.integers(0, 300, 120))] + [(500, None, None, None), (None, "a b", None, None), (7, "word", "x", "y"), (7, "word", "x", "y"), (900, "word " * 1000, None, None)]
    got = packing.best_fit_packing(spark.createDataFrame(rows, DOCS), PATH, capacity=128).collect()
    n = check_places(got, 128)
    assert n <= 1.03 * sum(r["length"] for r in got) / 128 + 2
    want = []
    for doc, text, *_ in rows:
        ids = np.asarray([*library(fst, text), 0], "<u4")
        want += [(doc, k // 128, k, len(ids[k : k + 128]), zlib.crc32(ids[k : k + 128].tobytes())) for k in range(0, len(ids), 128)]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    assert packing.best_fit_packing(spark.createDataFrame([], DOCS), PATH).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 400), max_size=25))
def test_plan_places_every_piece_once(histogram):
    plan = packing.packing_plan(histogram, 60, rounds=8)
    length = np.repeat(list(histogram), list(histogram.values())).astype(np.int64) if histogram else np.zeros(0, np.int64)
    rank = np.concatenate([np.arange(n) for n in histogram.values()]) if histogram else np.zeros(0, np.int64)
    if not len(length):
        assert plan.sequences == 0
        return
    sequence, offset = plan.place(length, rank)
    used = np.zeros((plan.sequences, 60), int)
    for s, o, n in zip(sequence, offset, length):
        used[s, o : o + n] += 1
    assert used.max() == 1 and (np.diff(used, axis=1) <= 0).all() and plan.sequences >= plan.bound - 1e-6


def like_documents(pieces, capacity, seed):
    rng = np.random.default_rng(seed)
    return np.unique(np.minimum(rng.lognormal(np.log(capacity) - 1.5, 0.9, pieces).astype(int) + 1, capacity), return_counts=True)


def test_weights_make_amounts_cover_every_length():
    lengths, counts = like_documents(5000, 256, 5)
    bound = packing.lower_bound(lengths, counts, 256)
    program = packing.Program(lengths, counts, 256, np.ceil(bound))
    assert program.solve(200) <= packing.GAP
    found = np.bincount(program.item, program.power * program.ways[256 - program.size]) / program.ways[256]
    assert abs(found @ program.lengths - 256) < 1e-6
    drawn = program.draw(2000, np.random.default_rng(1))
    assert sum(drawn.values()) == 2000 and all(sum(k * lengths[j] for j, k in parts) <= 256 for parts in drawn)
    mean = np.zeros(len(lengths))
    for parts, n in drawn.items():
        for j, k in parts:
            mean[j] += n * k / 2000
    assert np.abs((mean - found[:-1])[:50]).max() < 0.1


def ways_by_hand(lengths, weight, room):
    if not lengths:
        return float(room == 0)
    return sum(weight[0] ** k * ways_by_hand(lengths[1:], weight[1:], room - k * lengths[0]) for k in range(room // lengths[0] + 1))


def test_the_soft_knapsack_prices_every_configuration():
    lengths, weight = np.asarray([2, 3, 7]), np.asarray([0.5, 1.5, 0.25])
    item, times = packing._multiples(lengths, 12)
    sigma = np.bincount(lengths[item] * times, lengths[item] * weight[item] ** times, 13)
    want = [ways_by_hand(lengths.tolist(), weight.tolist(), r) for r in range(13)]
    assert np.allclose(packing._soft_knapsack(sigma), want)


@pytest.mark.parametrize("pieces, capacity", [(1500, 256), (12000, 2048), (12000, 500)])
@pytest.mark.parametrize("times", [1, 1000])
def test_the_sequences_come_from_the_configuration_program(pieces, capacity, times):
    lengths, counts = like_documents(pieces, capacity, 5)
    plan = packing.packing_plan(dict(zip(lengths.tolist(), (counts * times).tolist())), capacity)
    assert plan.from_lp >= 0.5 * plan.sequences
    fewest = sum(n for _, n in packing.best_fit_runs(lengths, counts * times, capacity))
    assert plan.bound - 1e-6 <= plan.sequences <= min(fewest, 1.005 * plan.bound + 1)


@pytest.mark.parametrize("copies", [3, 5000])
def test_equal_pieces_get_places_of_their_own(spark, copies):
    rows = [(None, "a b c", "x", None)] * copies + [(1, None, "x", None)] * copies
    got = packing.best_fit_packing(spark.createDataFrame(rows, DOCS), PATH, capacity=16).collect()
    assert len(got) == 2 * copies and check_places(got, 16) <= -(-5 * copies // 16) + 1
