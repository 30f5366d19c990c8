import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import columns, quality, queries


def texts(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    good = [" ".join(rng.choice(vocabulary, rng.integers(20, 200))).capitalize() + "." for _ in range(n)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(vocabulary, rng.integers(20, 200))) for _ in range(n)]
    return good, bad


@pytest.fixture(scope="module")
def model():
    good, bad = texts(150, 1)
    return quality.BradleyTerry.fit(good + bad, np.array([2] * 150 + [0] * 150), pairs=5000, steps=100)


def test_held_out_pairs(model):
    good, bad = texts(200, 2)
    g, b = model.score(pa.array(good)), model.score(pa.array(bad))
    assert (g[:, None] > b[None]).mean() > 0.99


def test_gradient_is_of_the_logistic_loss():
    good, bad = texts(20, 3)
    rank = np.array([2] * 20 + [0] * 20)
    loss = lambda m: np.log1p(np.exp(m.score(pa.array(bad))[None] - m.score(pa.array(good))[:, None])).mean()
    early, late = (quality.BradleyTerry.fit(good + bad, rank, pairs=2000, steps=s) for s in (2, 50))
    assert loss(late) < loss(early) < np.log(2)


def test_no_preference_means_ties():
    m = quality.BradleyTerry.fit(["a", "b"], np.array([1, 1]))
    assert m.score(pa.array(["x y", None, ""])).tolist() == [0, 0, 0]
    assert quality.BradleyTerry.fit([], np.zeros(0, int)).score(pa.array(["x"])).tolist() == [0]


def test_score_cases(spark, make, model):
    model.threshold = 0.0
    rows = [(1, None), (2, ""), (3, "long " * 30000), (4, "fine words here."), (4, "fine words here."), (None, "BAD!! BAD!!")]
    out = quality.score(make(rows, extra=True), model)
    got = sorted(((r.doc_id, r.text, r.quality_score, r.quality_keep) for r in out.collect()), key=repr)
    whole = model.score(pa.array([t for _, t in rows], pa.string()))
    assert got == sorted(((i, t, None if t is None else s, t is not None and bool(s >= 0)) for (i, t), s in zip(rows, whole)), key=repr)
    assert out.columns.count("quality_score") == 1
    assert quality.score(make([]), model).count() == 0
    kept = quality.accept(make(rows), model)
    assert kept.columns == make(rows).columns and {r.doc_id for r in kept.collect()} <= {2, 3, 4, None}


def test_train_without_labels_keeps_all(spark, make):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.train(make([(1, "a b c"), (2, None)]), labels)
    assert model.threshold == -np.inf
    assert quality.accept(make([(1, "a b c"), (2, None)]), model).count() == 1


def test_train_separates(spark, make):
    good, bad = texts(60, 5)
    docs = make([(k, t) for k, t in enumerate(good + bad)])
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)] + [(None, 1, 0), (3, None, 0), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    kept = {r.doc_id for r in quality.accept(docs, model).collect()}
    assert kept == set(range(60))


def test_toxic_documents_go_whatever_their_length(spark, make):
    good, junk = texts(240, 6)
    toxic = [" ".join([*t.split()[: k % 100], "vile", *t.split()[k % 100 :]]) for k, t in enumerate(texts(80, 7)[0])]
    rows = [(t, 1, 0) for t in good] + [(t, 0, 0) for t in junk[:80]] + [(t, 1, 1) for t in toxic]
    docs = make([(k, t) for k, (t, _, _) in enumerate(rows)])
    # A quarter of each kind is not labelled.
    labels = spark.createDataFrame([(k, q, x) for k, (_, q, x) in enumerate(rows) if k % 4], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in quality.accept(docs, quality.train(docs, labels)).collect()}
    assert kept <= set(range(240)) and len(kept) >= 235


def slow_score(m, text):
    """The score of one text, letter by letter and word by word."""
    text = text or ""
    data = text.encode()
    words = [w.encode() for w in re.split("[ \\t\\n\\r\\f\\v]+", text) if w]
    signs = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^_|~<>=+\\/", b"!?", b".,;:", b"\t\n\r ")
    dense = [sum(c in s for c in data) / len(data) if data else 0.0 for s in signs]
    n = max(len(words), 1)
    dense += [sum(map(len, words)) / n / 10, sum(len(w) > 20 for w in words) / n, len(set(words)) / n, np.log1p(len(words)) / 10, float(len(words) < 3), 1.0, sum(a == b for a, b in zip(words, words[1:])) / n]
    hashes = {int(columns.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) & 0xFFFFFFFF for w in words}
    buckets = [h & (quality.HASHED - 1) for h in hashes]
    return float(np.dot(dense, m.dense)) + sum(m.hashed[b] for b in buckets) / max(len(hashes), 1) ** 0.5 + m.strong * max((m.odds[b] for b in buckets), default=0.0)


def test_scores_against_brute_force(spark, make):
    good, junk = texts(60, 8)
    rank = np.array([2] * 60 + [0] * 40 + [1] * 20)
    m = quality.BradleyTerry.fit(good + junk, rank, pairs=4000, steps=40, min_texts=2)
    m.threshold = 0.1
    rows = [(k, t) for k, t in enumerate([*texts(25, 9)[0], *texts(25, 9)[1], None, "", " \n ", "ein Wört, über ÄÖ\u00a0x", "a a b", "long " * 5000, "x" * 3000])]
    got = {r.doc_id: (r.quality_score, r.quality_keep) for r in quality.score(make(rows), m).collect()}
    for i, t in rows:
        s = slow_score(m, t)
        assert got[i] == ((None, False) if t is None else (pytest.approx(s, abs=1e-9), s >= 0.1))
    assert {r.doc_id for r in quality.accept(make(rows), m).collect()} == {i for i, t in rows if t is not None and slow_score(m, t) >= 0.1}


def test_query_against_brute_force(spark, make, tmp_path):
    good, junk = texts(90, 12)
    rows = list(enumerate(good + junk)) + [(500, None), (501, "")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 90), 0) for k in range(0, 180, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: (r.quality_score, r.quality_keep) for r in queries.op4_quality(spark, str(tmp_path)).collect()}
    m = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    for i, t in rows:
        s = slow_score(m, t)
        assert got[i] == ((None, False) if t is None else (pytest.approx(s, abs=1e-9), s >= m.threshold))


def test_the_sample_is_bounded_by_bytes(spark, make):
    docs = make([(k, "word " * 100) for k in range(20)] + [(3, "another text")])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id bigint, quality int, toxic int")
    assert len(quality.labelled_sample(docs, labels)[0]) == 20
    found = quality.labelled_sample(docs, labels, most_bytes=2600)[0]
    assert 5 <= len(found) <= 6 and set(found) <= {"word " * 100, "another text"}


def test_odd_column_names(make, model):
    df = make([(1, "fine words here."), (2, None)]).selectExpr("*", "1 as `a.b`", "2 as `c``d`", "'x' as `Quality_Score`")
    out = quality.score(df, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "c`d", "quality_score", "quality_keep"] and out.count() == 2
    model.threshold = -np.inf
    assert [tuple(r) for r in quality.accept(df, model).collect()] == [(1, "fine words here.", "en", "s", 16, 1, 2, "x")]


def test_every_labelled_row_teaches(spark, make):
    good, junk = texts(150, 14)
    # Words that stand only in documents of few blocks are learned, too, and the held-out quantiles are those of all blocks.
    docs = make([(k, t) for k, t in enumerate(good + junk)])
    labels = spark.createDataFrame([(k, int(k < 150), 0) for k in range(300)], "doc_id bigint, quality int, toxic int")
    own = quality.labelled(docs, labels, 60).collect()
    assert sorted(r.text for r in own) == sorted(good + junk) and len({r.block for r in own}) == 5
    have, count = quality.bucket_counts(spark.createDataFrame(own))
    buckets = [set(quality.features(pa.array([t]))[1].tolist()) for t in good]
    assert count.tolist() == [150, 0, 150] and have[2].tolist() == np.bincount([b for s in buckets for b in s], minlength=quality.HASHED).tolist()
    model = quality.train(docs, labels, rows=60)
    held = [r for r in own if r.held]
    low, high = (np.quantile(model.score(pa.array([r.text for r in held if (r.rank == 2) == kind])), q) for kind, q in ((True, 0.002), (False, 0.98)))
    assert model.threshold == pytest.approx(min(low, high + 0.25 * (low - high)), abs=1e-9)
    assert {r.doc_id for r in quality.accept(docs, model).collect()} == set(range(150))


def test_packed_features():
    good, junk = texts(30, 15)
    column = pa.array([*good, None, "", " ", "a a b", *junk, "x" * 3000, " ".join(map(str, range(70000)))])
    for part in (column, column.slice(5, 31), column.slice(0, 0)):
        dense, buckets, first = quality.features(part)
        got = quality.unpacked(quality.packed(part))
        assert got[0].tolist() == dense.tolist() and got[2].tolist() == first.tolist()
        assert [sorted(x.tolist()) for x in np.split(buckets, first[1:-1])] == [x.tolist() for x in np.split(got[1], got[2][1:-1])]
    assert quality.unpacked(quality.packed(column).slice(3, 9))[0].tolist() == quality.features(column.slice(3, 9))[0].tolist()


def test_training_keeps_no_texts_on_disk(spark, make):
    # Few words, but long ones: what is learned from is small, whatever the texts' length.
    rng = np.random.default_rng(16)
    docs = make([(k, " ".join(bytes(rng.integers(97, 123, 5000).astype(np.uint8)).decode() for _ in range(20))) for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    stored = lambda: sum(p.stat().st_size for p in folder.rglob("part-*"))
    before = stored()
    quality.train(docs, labels)
    assert stored() - before < 60 * 100_000 / 10


def test_one_of_several_texts_teaches(spark, make):
    good, junk = texts(8, 17)
    rows = [(k, t) for k, t in enumerate(good)] * 2 + [(k, t) for k, t in enumerate(junk[:6])] + [(k, None) for k in range(3)] + [(20, None), (20, None), (None, "x"), (21, "y")]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(8)] + [(20, 1, 1), (20, 0, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = quality.labelled(make(rows), labels).collect()
    assert len(found) == 9 and len({r.text for r in found}) == 9 and {r.text for r in found} <= {*good, *junk, None}
    assert [r["rank"] for r in found if r.text is None] == [0] and sum(r.held for r in found) == 3
    features = quality.labelled(make(rows), labels, content="features").collect()
    assert [(r.block, r.held, r["rank"], r.features) for r in features] == [(r.block, r.held, r["rank"], quality.packed(pa.array([r.text], pa.string()))[0].as_py()) for r in found]
    empty = quality.labelled(make([]), labels, content="features")
    assert empty.count() == 0 and quality.fit_blocks(empty).strong == 0
