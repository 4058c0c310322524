import hashlib
import random

import numpy as np
import pytest

from sparrowmill.llm import alignment, clustering, jaccard

DOCS = "doc_id long, text string, lang string, source string, n_chars long, gram string, set_id string, label int, batch string, n long"


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", None, 0, "x", "x", 1, "x", 7) for d, t in rows], DOCS)


# -- tokenizer alignment -------------------------------------------------------


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_by_hand(rows):
    """Each whole text through both libraries, and two pointers over its tokens."""
    import base64

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    ranks = {int(k): base64.b64decode(w) for w, k in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    a, b = Tokenizer.from_file(paths()[0]), sentencepiece.SentencePieceProcessor(model_file=paths()[1])
    a.encode_special_tokens = True
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    parsed = []
    for _, text in rows:
        said = (" " + (text or "")).encode()
        ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        wa, wb = [ranks[i] for i in ia], [b_bytes(i) for i in ib]
        if not text or b"".join(wa) != said or b"".join(wb) != said:
            parsed.append(([], [], [], []))
            continue
        i = j = ea = eb = 0
        links, groups, ga, gb = [], [], [], []
        while i < len(ia):
            links.append((ia[i], ib[j]))
            ha, hb = ea + len(wa[i]), eb + len(wb[j])
            if ha <= hb:
                ga.append(ia[i])
            if hb <= ha:
                gb.append(ib[j])
            if ha == hb:
                groups.append((ga, gb))
                ga, gb = [], []
            if ha <= hb:
                i, ea = i + 1, ha
            if hb <= ha:
                j, eb = j + 1, hb
        parsed.append((ia, ib, groups, links))
    count = {}
    for *_, links in parsed:
        for x in links:
            count[x] = count.get(x, 0) + 1
    most = {}
    for (x, y), n in count.items():
        most["a", x], most["b", y] = max(n, most.get(("a", x), 0)), max(n, most.get(("b", y), 0))
    out = []
    for (d, _), (ia, ib, groups, links) in zip(rows, parsed):
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best_a, best_b = (sum(count[x] == most[side, x[k]] for x in links) for k, side in enumerate("ab"))
        out.append((d, len(ia), len(ib), len(groups), len(links), best_b, best_a, sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def test_alignment_is_as_by_hand(spark, small, monkeypatch):
    rng = random.Random(4)
    letters = ["a", "Z", " ", " ", "  ", "\n", "\t", "é", "日本", "<0x0A>", "<|endoftext|>", "<s>", "'s", "12", "-", "ﬁ", "́", " ", "\x00", "🙂", "_"]
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.choice([1, 3, 30, 200])))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "with ▁ inside"), (None, "no id here"), (203, "twice"), (203, "twice"), (204, "x" * 3000), (205, "many words " * 5000), (206, " "), (207, "a  b")]
    rows += [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    monkeypatch.setattr(alignment, "BATCH_CHARS", 20000)
    got = alignment.align_tokenizers(documents(spark, rows), *paths()).collect()
    assert sorted(map(tuple, got), key=repr) == aligned_by_hand(rows)


def test_nothing_to_align(spark):
    assert alignment.align_tokenizers(documents(spark, []), *paths()).count() == 0
    got = alignment.align_tokenizers(documents(spark, [(1, None), (2, "▁")]), *paths()).collect()
    assert sorted(map(tuple, got)) == [(1, *[0] * 7, ""), (2, *[0] * 7, "")]


# -- n-gram jaccard join -------------------------------------------------------


def joined_by_hand(rows, percent=90):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * 100 >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(seed, size=220):
    """Texts with chains of edits, near copies without their original, common passages and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    common = [word() for _ in range(40)]
    texts = []
    while len(texts) < size:
        base = [word() for _ in range(rng.choice([1, 2, 3, 8, 11, 25, 60, 150]))]
        if rng.random() < 0.5:
            base += common
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    return texts


@pytest.mark.parametrize("seed,centres,block,frequent", [(1, 2, 1024, 1 << 20), (2, 0, 8, 1 << 20), (3, 1, 3, 3)])
def test_jaccard_components(spark, monkeypatch, seed, centres, block, frequent):
    if frequent == 3:  # any order of columns will do
        monkeypatch.setattr(jaccard, "SLOTS", 64)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "CENTRES", centres)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rows = list(enumerate(near_copies(seed)))
    rng = random.Random(seed)
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n"), (None, "one two"), (None, "only here, twice or"), (None, "only here, twice or"), (903, "ONE\ttwo"), (904, "one"), (905, "one"), (905, "one")]
    rows += [(906, "É é a"), (907, "é é a"), (908, "long " * 30000), (909, "LONG " * 40000)]
    got = jaccard.jaccard_components(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == joined_by_hand(rows)


def test_other_thresholds_and_nothing(spark):
    rows = list(enumerate(near_copies(9, 80)))
    assert sorted(map(tuple, jaccard.jaccard_components(documents(spark, rows), percent=50).collect()), key=repr) == joined_by_hand(rows, 50)
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_components(documents(spark, [(4, None)])).collect()] == [(4, 0, 4)]


def test_a_group_of_near_copies_makes_no_pairs_of_all(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"v{k}" for k in range(300)]
    texts = [" ".join(base)]
    for k in range(400):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(300)] = f"new{k}"
        texts.append(" ".join(copy))
    seen = []
    counted = jaccard._counted
    monkeypatch.setattr(jaccard, "_counted", lambda pairs, *rest: seen.append(pairs.count()) or counted(pairs, *rest))
    got = jaccard.jaccard_components(documents(spark, list(enumerate(texts)))).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(seen) < 6 * len(texts)


def test_a_dense_block_is_multiplied_out(spark, monkeypatch):
    """Near copies of a text that isn't there itself, most of them not similar enough to each other, but to some."""
    rng = random.Random(8)
    base = [f"v{k}" for k in range(200)]
    texts = []
    for k in range(60):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(0, 200, 9)] = f"new{k}"
        texts.append(" ".join(copy))
    calls = []
    product = jaccard._block_product
    monkeypatch.setattr(jaccard, "_block_product", lambda *a: product(*a))
    fetched = jaccard._fetched
    monkeypatch.setattr(jaccard, "_fetched", lambda *a: calls.append(1) or fetched(*a))
    monkeypatch.setattr(jaccard, "CENTRES", 0)
    monkeypatch.setattr(jaccard, "FEW", 2)
    rows = list(enumerate(texts))
    assert sorted(map(tuple, jaccard.jaccard_components(documents(spark, rows)).collect()), key=repr) == joined_by_hand(rows)
    assert len(calls) == 3  # pairs of few, pairs of blocks, and sets for the dense ones


def test_marks_never_exclude_a_similar_pair():
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.choice([1, 5, 40, 127, 128, 129, 300, 1500]))
        base = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        sets = [base]
        for _ in range(6):
            gone = rng.random(len(base)) < rng.choice([0, 0.02, 0.05, 0.3])
            sets.append(np.unique(np.concatenate([base[~gone], rng.integers(-(1 << 62), 1 << 62, int(rng.choice([0, 1, n // 20, n // 3])))])))
        may = jaccard.possible(np.array([len(s) for s in sets]), [jaccard._marks(s) for s in sets], 90)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                assert may[i, j] or not len(a) or 100 * both < 90 * (len(a) + len(b) - both)


def test_batches_of_sets_are_small(spark, monkeypatch):
    """What a worker holds of 2 MB of text, and what it passes on at once, follows SIGN_CHARS and CHOOSE_ROWS."""
    import pyarrow as pa

    passed = []
    monkeypatch.setattr(jaccard, "map_texts", lambda rows, function, schema: passed.append(function) or spark.createDataFrame([], schema))
    signed = jaccard.signed_documents(documents(spark, [(0, "a")]))
    jaccard.columns(signed, np.zeros(64, np.uint8), 90)
    sign, choose = passed
    texts = [" ".join(f"w{k}x{i}" for i in range(300)) for k in range(1000)]
    out = list(sign(iter([pa.record_batch({"doc_id": pa.array(range(1000)), "text": pa.array(texts)})])))
    assert sum(b.num_rows for b in out) == 1000 and max(b.nbytes for b in out) < 1 << 20
    whole = pa.Table.from_batches(out).select(["set_id", "n", "grams"]).combine_chunks().to_batches()
    chosen = list(choose(iter(whole)))
    assert sum(b.num_rows for b in chosen) == 1000 and max(b.num_rows for b in chosen) <= 250
    assert [v for b in chosen for v in b.column("grams").to_pylist()] == [g[:jaccard.prefix(len(g), 90)] for g in whole[0].column("grams").to_pylist()]


def test_sets_are_fetched_without_a_way_through_python(spark, monkeypatch):
    texts = [" ".join(f"w{k}x{i}" for i in range(k + 1)) for k in range(40)]
    signed = jaccard.written(jaccard.signed_documents(documents(spark, list(enumerate([*texts, *texts, None])))), "sets")
    ids = signed.where("doc_id % 3 = 1").select("set_id")
    monkeypatch.setattr(jaccard, "map_texts", None)
    got = jaccard._fetched(signed, ids)
    asked = {r["set_id"] for r in ids.collect()}
    assert sorted((r["set_id"], r["n"], tuple(r["grams"])) for r in got.collect()) == sorted({(r["set_id"], r["n"], tuple(r["grams"])) for r in signed.where("n > 0").collect() if r["set_id"] in asked})


def test_products_of_blocks():
    rng = np.random.default_rng(0)
    grams = [np.unique(rng.integers(0, m, k)) for m, k in [(30, 20), (50, 10), (1000, 200), (40, 25), (3, 3)] * 30]
    hand = [[len(np.intersect1d(a, b)) for b in grams] for a in grams]
    got = jaccard.product(grams)
    np.fill_diagonal(got, 0)
    hand = np.array(hand)
    np.fill_diagonal(hand, 0)
    assert (got == hand).all()


# -- centroid clustering -------------------------------------------------------


def clustered_by_hand(rows, k=8, rounds=10):
    import math

    kept = [(v, [math.floor(1024 * float(x)) for x in e]) for v, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [e for _, e in start[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda e: min(range(len(centroids)), key=lambda c: (square(e, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(e) for _, e in kept]
        for c in range(len(centroids)):
            held = [e for (_, e), o in zip(kept, own) if o == c]
            if held:
                centroids[c] = [sum(x) // len(held) for x in zip(*held)]
    own = [nearest(e) for _, e in kept]
    d = [square(e, centroids[o]) for (_, e), o in zip(kept, own)]
    inertia = [sum(x for x, o in zip(d, own) if o == c) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((v, o, x, inertia[o], sum(d), sha[o]) for (v, _), o, x in zip(kept, own, d)), key=repr)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, cluster string, x string, sums int"


def embeddings(spark, rows):
    return spark.createDataFrame([(v, e, 1, "clash", "clash", 1) for v, e in rows], EMBEDDINGS)


@pytest.mark.parametrize("seed,n,scale", [(1, 300, 1.0), (2, 200, 0.002), (3, 150, 3000.0), (4, 5, 1.0)])
def test_clusters(spark, seed, n, scale):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, 64))
    rows = [(k, [float(np.float32(x)) for x in (middle[k % 5] + rng.normal(size=64) * 0.3) * scale]) for k in range(n)]
    rows += [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [None] + [1.0] * 63), (904, [float("nan")] + [1.0] * 63), (905, [float("inf")] + [0.0] * 63), (906, [3e8] + [0.0] * 63)]
    if n > 10:
        rows += [(None, rows[0][1]), rows[1], rows[1]]
    got = clustering.clusters(embeddings(spark, rows)).drop("n_scanned").collect()
    rows = [r for r in rows if r[0] != 906]  # its squares wouldn't fit
    assert sorted(map(tuple, got), key=repr) == clustered_by_hand(rows)


def test_bounds_spare_scans(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    got = clustering.clusters(table).collect()
    assert 0 < got[0]["n_scanned"] < 0.9 * 11 * len(got)
    assert clustering.clusters(embeddings(spark, [(1, [0.5])])).count() == 0


def test_bounds_hold_and_ties_go_to_the_smaller():
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (400, 64)) * 8
    before = x[:8].copy()
    before[5] = before[2]
    cluster, upper, lower = clustering.scan(x, before)
    for _ in range(6):
        after = before + rng.integers(-4, 5, before.shape)
        after[5] = after[2]
        cluster, upper, lower, _ = clustering.reassign(x, cluster, upper, lower, before, after)
        d = clustering.squares(x, after)
        assert (cluster == d.argmin(1)).all() and not (cluster == 5).any()
        assert (np.sqrt(d.min(1)) <= upper * (1 + 1e-9) + 1e-9).all() and (lower <= np.sqrt(np.partition(d, 1, 1)[:, 1]) + 1e-6).all()
        before = after


@pytest.mark.parametrize("module", [jaccard, clustering])
def test_joins_and_clusters_against_sql(module, same_as_sql):
    same_as_sql(module.query, module.ORACLE)
