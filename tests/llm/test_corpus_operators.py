"""Near duplicates, search, toxicity and the pipeline: edge cases and brute-force twins."""

import itertools
import random
import re

import math

import numpy as np
import pytest

import corpus_pipeline
from tesserae.llm import near_dedup, packing, quality, topk_search, toxicity
from tesserae.llm import queries as llm_queries
from tesserae.llm.common import map_batches


def shingle_set(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute_components(rows, percent=75):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        both = len(a & b)
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def edited(rng, words, share):
    return [rng.choice("pqrstuv") + str(rng.randint(0, 999)) if rng.random() < share else w for w in words]


def corpus(seed=0):
    """Texts with chains of ever more edited copies, large groups around the threshold, short texts and copies."""
    rng = random.Random(seed)
    texts = [None, "", "  \n", "one two", "ONE two", "one two three", "É a b c d e", "é a b c d e", "x " * 50, "x " * 60]
    for _ in range(12):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 8)):
            texts.append(" ".join(base))
            base = edited(rng, base, 0.02)
    hub = [f"h{i}" for i in range(120)]
    texts += [" ".join(edited(rng, hub, rng.choice([0.01, 0.03, 0.05]))) for _ in range(90)]
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join([*passage, *(f"u{rng.randint(0, 10**6)}" for _ in range(30))]) for _ in range(40)]
    texts += [texts[12]] * 30
    order = list(enumerate(texts))
    rng.shuffle(order)
    return [(n * 3 + 1, t) for n, (_, t) in enumerate(order)]


@pytest.mark.parametrize("seed", [0, 1])
def test_components_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # blocks of large buckets meet too
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, component_id int, digest string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    want = {i: (n, c, i == c) for i, (n, c) in brute_components(rows).items()}
    assert got == want


def test_bridges_between_components(spark):
    """Two close pairs joined by one link at 0.758 (100 of 132 shingles), which only the step across components finds."""
    rows = []
    for q in range(3000):
        left = [f"q{q}w{i}" for i in range(120)]
        right = [f"{w}x" if i >= 104 else w for i, w in enumerate(left)]
        texts = [[f"{w}y" for w in left[:4]] + left[4:], [f"{w}z" for w in right[:4]] + right[4:], left, right]
        rows += [(4 * q + k, " ".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) and [i for i in sorted(got) if got[i] != i // 4 * 4] == []


def test_near_duplicates_edges(spark):
    kinds = "doc_id long, text string"
    empty = spark.createDataFrame([], kinds)
    assert near_dedup.near_duplicates(empty).collect() == [] and near_dedup.keep_one(empty).collect() == []
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "A B C D E F"), (7, None), (8, None)]
    got = sorted(map(tuple, near_dedup.near_duplicates(spark.createDataFrame(rows, kinds)).where("doc_id is not null").collect()))
    assert got == [(2, 2, 2, True), (2, 2, 2, True), (5, 2, 2, False), (7, 0, 7, True), (8, 0, 8, True)]
    kept = near_dedup.keep_one(spark.createDataFrame([(*r, "x") for r in rows], kinds + ", component_id string"))
    assert kept.columns == ["doc_id", "text", "component_id"] and sorted(r.doc_id for r in kept.collect()) == [2, 7, 8]


def test_keep_one_judges_rows(spark):
    new = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(None, new("a")), (None, new("a")), (None, new("b") + " end"), (4, new("b")), (3, new("c")), (3, new("d")), (3, new("d")),
            (5, new("d")), (1, new("d") + " end"), (6, new("e")), (None, None), (None, ""), (7, None), (7, ""), (7, new("e")), (9, " ")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_shingles string")
    kept = near_dedup.keep_one(docs)
    want = [(1, new("d") + " end"), (3, new("c")), (4, new("b")), (6, new("e")), (7, ""), (9, " "), (None, None), (None, ""), (None, new("a"))]
    shown = lambda found: sorted((repr(k), t or "") for k, t, *_ in found)
    assert kept.columns == docs.columns and shown(kept.collect()) == shown(want)


def test_posterior_bounds_keep_what_is_similar():
    least = near_dedup.least_matches(0.75, 1e-5)
    assert list(least) == sorted(least)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (4000, 128), dtype=np.uint8)
    for s, stays in ((0.8, 0.999), (0.3, 0.0)):
        b = np.where(rng.random(a.shape) < s, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
        alive, matches = near_dedup.surviving(a, b, 0.75, 1e-5)
        assert len(alive) / 4000 >= stays if stays else len(alive) / 4000 < 0.01
        assert (matches == (a[alive] == b[alive]).sum(axis=1)).all()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in near_dedup.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("alone", [0.0, 0.25, 1.0])
def test_top_k_against_all_products(spark, monkeypatch, alone):
    monkeypatch.setattr(topk_search, "BLOCK_VALUES", 64 * 6)
    monkeypatch.setattr(topk_search, "QUERY_VALUES", 5 * 6)
    monkeypatch.setattr(topk_search, "ALONE", alone)
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.1, (300, 6)).round(2)
    vectors[7] = vectors[3]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(400, None, "x"), (401, [0.1, None, 0.0, 0.0, 0.0, 0.0], "x"), (420, [float("nan")] + [0.0] * 5, "x"), (3, vectors[3].tolist(), "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    from pyspark.sql import functions as F

    got = sorted(map(tuple, topk_search.top_k(df, F.col("id") % 20 == 0, k=5).collect()))
    q = np.floor(64 * np.concatenate([vectors, vectors[3:4]])).astype(int)
    ids = [*range(300), 3]
    want = []
    for i in range(0, 300, 20):
        best = sorted((-int(q[i] @ q[j]), ids[j]) for j in range(301) if ids[j] != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk_search.top_k(df.where("false"), F.col("id") % 20 == 0).collect() == []
    few = topk_search.top_k(df.where("vec_id < 2 or vec_id = 20"), F.col("id") % 20 == 0).collect()
    assert len(few) == 4 and {r.rank for r in few} == {1, 2}


def test_top_k_reads_in_steps_and_stops():
    """Queries stop by themselves before the lists end where the values allow it, and get the exact answer."""
    rng = np.random.default_rng(3)
    x = rng.integers(-5, 6, (4000, 4))
    x[:40] = rng.integers(200, 400, (40, 4))  # few rows far ahead
    lists = topk_search.SortedLists(np.arange(4000), x)
    assert list(lists.depths())[0] == 2000 and list(lists.depths())[-1] == 4000
    q = np.abs(rng.integers(1, 9, (30, 4)))
    found = lists.search(np.full(30, -1), q, 5)
    for i, (rows, score) in enumerate(found):
        want = sorted((-int(q[i] @ v), j) for j, v in enumerate(x))[:5]
        assert [(-s, int(j)) for s, j in zip(score, rows, strict=True)] == want
    assert min(lists.read) < 1 and len(lists.read) == 30
    floors = np.asarray([float(s[-1]) for _, s in found])
    again = lists.search(np.full(30, -1), q, 5, floors)
    assert all((a[0] == b[0]).all() and a[1] == b[1] for a, b in zip(found, again, strict=True))
    none = lists.search(np.full(30, -1), q, 5, floors + 1e6)
    assert all(len(rows) == 0 for rows, _ in none)


def test_top_k_of_large_components(spark):
    """Scores beyond what doubles and longs hold: exact order, and the nearest long as the score."""
    rng = np.random.default_rng(4)
    big = rng.normal(0, 1e9, (40, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(big)] + [(40, [1e300, -1e300, 0.0]), (41, [0.5, 0.25, -1.0]), (60, [-1e300, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    got = sorted(map(tuple, topk_search.top_k(df, F.col("id") % 20 == 0, k=6).collect()))
    held = lambda x: math.floor(min(max(64 * x, -(2.0**63)), float(2**63 - 1024)))
    v = {i: [held(x) for x in e] for i, e in rows}
    want = []
    for i in (0, 20, 40, 60):
        best = sorted((-sum(a * b for a, b in zip(v[i], v[j], strict=True)), j) for j in v if j != i)[:6]
        want += [(i, k + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)



BAD, FINE = ["vile", "rotten", "nasty"], [f"word{i}" for i in range(300)]


def toxic_docs(spark, n=600, seed=0):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        words = [rng.choice(FINE) for _ in range(rng.randint(10, 60))]
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD).upper() + "!"
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), int(bad), "z"))
        marks.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, kept string")
    return docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {r[0]: bool(r[3]) for r in rows}


def test_chain_on_unlabelled_documents(spark):
    docs, labels, truth = toxic_docs(spark)
    found = toxicity.judge_toxicity(docs, labels.where("doc_id < 300"))
    rows = {r.doc_id: r for r in found.collect()}
    later = [i for i in truth if i >= 300]
    right = [rows[i].toxic == truth[i] for i in later]
    assert sum(right) / len(right) > 0.95
    assert any(rows[i].toxic for i in later)  # verdicts are real
    assert set(rows[0].categories) == {"toxic_en", "toxic_de", "toxic"} and all(r.kept != r.toxic for r in rows.values())
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} <= {i for i in truth}
    assert clean.count() < docs.count()


def test_toxicity_edges(spark):
    docs, labels, _ = toxic_docs(spark, 80)
    odd = docs.union(spark.createDataFrame([(900, None, None, None, None), (901, "", "en", 1, ""), (900, None, None, None, None)], docs.schema))
    rows = toxicity.judge_toxicity(odd, labels.union(labels.limit(5))).where("doc_id >= 900").collect()
    assert len(rows) == 3 and not any(r.toxic for r in rows)
    for none in (labels.where("false"), labels.where("toxic = 0")):
        assert not any(r.toxic for r in toxicity.judge_toxicity(docs, none).collect())
    assert toxicity.judge_toxicity(docs.where("false"), labels).collect() == []


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(0)
    n = 400
    first = rng.random(n) < 0.3
    x = toxicity.Sparse(np.arange(n + 1), np.where(first, 0, 1), np.ones(n))
    y = np.stack([first, first], axis=1).astype(float)
    chain = toxicity.fit_chain(x, y, ("a", "b"), np.arange(2))
    assert chain.models[1].extra[0] > 0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "truth")
    found = toxicity.judge_toxicity(docs, fit).join(rest, "doc_id")
    n = {(r.truth, r.toxic): r["count"] for r in found.groupBy("truth", "toxic").count().collect()}
    assert n.get((0, True), 0) <= 0.03 * (n.get((0, True), 0) + n[0, False])
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.5


def test_batches_are_cut_small(spark):
    sizes = map_batches(spark.range(1200).coalesce(1), lambda bs: ({"n": [len(b["id"])]} for b in bs), "n long")
    assert max(r.n for r in sizes.collect()) <= 500


def test_pipeline_stages(spark, tmp_path):
    """Each stage's decisions against the operators on the same rows; the last against the ids of the texts that are left."""
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {"quality": lambda d: quality.judge_quality(d), "near_dedup": lambda d: near_dedup.near_duplicates(d),
            "toxicity": lambda d: toxicity.judge_toxicity(d, spark.read.parquet(f"{sf}/labels.parquet"))}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name in kept:
            want = {r.doc_id for r in kept[name](docs).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == want and 0 < len(want) < docs.count()
        else:
            assert out.count() == docs.count()
            assert not out.where("text rlike '[A-Za-z0-9]@mail'").count() and out.where("text like '%[EMAIL]%'").count()
            assert out.where("n_chars != length(text)").isEmpty()
        docs = out
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = stage(spark, docs, sf).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got: dict = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want
    run = corpus_pipeline.run(spark, sf).collect()
    assert {(p.doc_id, p.start, p.ids_crc32) for p in run} == {(p.doc_id, p.start, p.ids_crc32) for p in pieces}


def test_stages_stand_odd_rows(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    good = "Some words of a plain text, and more of them. " * 12
    rows = [(1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)), (None, None, None, None, None), (3, "", "", "", 0), (4, good + "end of it. " * 3, None, None, None)]
    for table in (spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs.collect()


def test_pieces_are_numbered_in_their_partition(spark):
    """Within a class and a partition the numbers are 0, 1, ...; whole sequences are a class of their own."""
    import public_tokenizers

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2, 256, 8, "doc_id", "text").collect()
    held: dict = {}
    for r in rows:
        assert r["class"] == (0 if r.length == 256 else -(-r.length // 8))
        held.setdefault((r["class"], r.part), []).append(r["at"])
    assert len({part for _, part in held}) == 3 and all(sorted(v) == list(range(len(v))) for v in held.values())


def test_every_operator_is_registered():
    names = sorted(llm_queries.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "pii", "packing"]
