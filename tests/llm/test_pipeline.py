import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import jaccard, packing, pii, quality, queries
from pathlib import Path

from test_jaccard import groups
from test_mixing import brute as mixed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, make, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for k in range(260):
        w = [word() for _ in range(rng.randint(20, 90))]
        good = k % 6 > 0
        text = " ".join(w).capitalize() + "." if good else " ".join(x.upper() + "!!" for x in w)
        if good and k % 9 == 0:
            text += f" Write to {word()}.{k}@mail{k % 7}.example.com soon."
        rows.append((k, text, f"s{k % 3 if k % 4 else 0}"))
        if k % 2:
            labels.append((k, int(good), 0))
    for k in range(30):
        base = rows[1 + 6 * k][1].split(" ")
        base[rng.randrange(len(base))] = word()
        rows.append((1000 + k, " ".join(base), "s1"))
    rows += [(2000, rows[1][1], "s2"), (2001, None, "s0"), (2002, "", None), (None, "A row without an id. It stays.", "s1"), (7, rows[7][1], rows[7][2]), (2003, "Long text here. " * 4000, "s2")]
    folder = str(tmp_path_factory.mktemp("tables"))
    make(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, folder


def null_shard(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(-1 - F.pmod(F.xxhash64("text"), F.lit(packing.NULL_SHARDS))).first()[0]


def brute(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.score(pa.array([t for _, t, _ in rows], pa.string()))
    rows = [r for r, s in zip(rows, scores) if r[1] is not None and s >= model.threshold]
    root = groups([(i, t) for i, t, _ in rows], 3, jaccard.THRESHOLD)
    rows = sorted({r for r in rows if r[0] is None or root[r[0]] == r[0]}, key=repr)
    tagger = pii.default_model()
    rows = [(i, pii.redacted(t, pii.spans(tagger, [t])[0]), s) for i, t, s in rows]
    rows = [r[:3] for r in mixed(rows, {}, 1.0, 1.0, (0.25, 0.5, 1.0))]
    out = []
    shards = {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        shards.setdefault(null_shard(spark, t) if i is None else i // packing.SHARD_DOCS, []).append((i, t))
    for s, own in shards.items():
        found = packing.windows([i for i, _ in own], [t for _, t in own], packing.LENGTH, packing.SENTENCE_CUT, packing.HARD_CUT)
        out += [(s, k, tuple(seg), body, n) for k, (seg, body, n) in enumerate(found)]
    return out


def test_run_against_brute_force(spark, tables):
    rows, folder = tables
    result = corpus_pipeline.run(spark, folder)
    got = [(r.shard, r.window, tuple((s.doc_id, s.start, s.end) for s in r.segments), r.text, r.n_tokens) for r in result.collect()]
    expected = brute(spark, rows, folder)
    assert sorted(got, key=repr) == sorted(expected, key=repr) and expected


def test_stages_keep_the_columns_of_documents(spark, tables):
    _, folder = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_stages_on_empty_documents(spark, tables):
    _, folder = tables
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    if not Path(SF).exists():
        pytest.skip("no test tables")
    frame = queries.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    order = [[d[0] for d in found.description].index(c) for c in names]
    assert sorted(repr([plain(r[c]) for c in names]) for r in frame.collect()) == sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())


def test_queries_cover_whole_tables(spark):
    if not Path(SF).exists():
        pytest.skip("no test tables")
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.op4_quality(spark, SF).count() == n
    assert queries.op10_lm_scoring(spark, SF).count() == n
    assert queries.op1_pii(spark, SF).count() == n
    ids = queries.op8_packing(spark, SF).select(F.explode("doc_ids").alias("doc_id")).distinct().count()
    assert ids == spark.read.parquet(f"{SF}/documents.parquet").where("trim(text) <> ''").count()


def test_stages_take_any_column_names(spark, tables):
    _, folder = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 as `a.b`", "2 as `c``d`", "3 as `MIX_Tier`", "4 as `Quality_Keep`", "5 as class_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns[:7] == docs.columns[:7] and set(out.columns) <= set(docs.columns) and out.count() > 0
