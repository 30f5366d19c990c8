import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source); with an extra column whose name clashes with ones that operators use."""

    def build(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("node", "hub", "key", "shard", "_source", "_hash", "slot", "quality_score", "mix_tier", "pii_spans", "rank", "ids"):
                df = df.selectExpr("*", f"'clash' as `{name}`")
        return df

    return build
