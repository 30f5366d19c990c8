"""Each registered query of the engine against its SQL, on the smallest tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from pagewright import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, duck, name):
    frame = plans.QUERIES[name](spark, SF)
    names = sorted(frame.columns)
    mine = sorted(repr([plain(r[c]) for c in names]) for r in frame.collect())
    found = duck.execute(plans.ORACLES[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == names
    order = [theirs.index(c) for c in names]
    assert mine == sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    if not Path(SF).exists():
        pytest.skip("no test tables")
    plans.QUERIES[name](spark, SF).count()


def test_yaml_pipeline_takes_long_texts(spark, tmp_path):
    listed = "1. first thing\n2. second thing\n3. third thing\n"
    rows = [(1, listed), (2, listed + "some more words here\n" * 600), (3, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in plans.QUERIES["pipeline_yaml_smoke"](spark, str(tmp_path)).collect()} == {1, 2}
