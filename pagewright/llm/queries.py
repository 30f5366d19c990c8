"""The queries of the ten operators, with their production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import jaccard, licenses, lm, media, mixing, packing, pii, quality, suffixes, vectors
from pagewright.session import scratch, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, redacted, with the spans found."""
    return pii.redact(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding that has a cosine of 0.97 or more to another: its class, and how many others."""
    return vectors.join(table(spark, sf_dir, "embeddings"))


def embedding_links_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op2_embedding_dedup at a cosine of 0.45, at which the smaller given tables have links, too."""
    return vectors.join(table(spark, sf_dir, "embeddings"), 0.45)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mixture keeps, with the first tier of each."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_tokens", "mix_tier")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that has a Jaccard similarity of at least 0.6, of word trigrams, to another: its class, and how many others."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stretches covered by passages of 50 words or more that stand in several documents."""
    return suffixes.passages(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as members of archives in the shared folder and read again by the archive source."""
    folder = scratch(spark, "archives")
    pages = table(spark, sf_dir, "pages")
    media.write(pages.select(F.concat("page_id", F.lit(".html")).alias("member"), F.col("html").alias("payload")), folder)
    found = media.columns(media.scan(spark, folder))
    return found.select(F.regexp_extract("member", "^(.*)[.]html$", 1).cast("bigint").alias("page_id"), "media_type", "n_bytes", "md5", "width", "height", "error")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All licence notices in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score under the trigram model of all documents."""
    return lm.scored(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_embedding_dedup, op3_mixing, op4_quality, op5_ngram_jaccard, op6_suffix_dedup, op7_media_columns, op8_packing, op9_license_scan, op10_lm_scoring, embedding_links_loose)}

_BLANK = r"' \t\n\r\f\v'".replace("'", "")


def _links(cosine: float) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
n AS (SELECT list_sort(list(DISTINCT vec_id)) AS ids, e, sqrt(list_dot_product(e, e)) AS r FROM v GROUP BY e),
p AS (SELECT a.ids AS ids_a, b.ids AS ids_b FROM n a JOIN n b ON a.ids < b.ids WHERE list_dot_product(a.e, b.e) / (a.r * b.r) >= {cosine} - 1e-9),
f AS (SELECT ids_a AS x, ids_b AS y FROM p UNION ALL SELECT ids_b, ids_a FROM p),
r(x, root) AS (SELECT ids, ids[1] FROM n UNION SELECT f.y, r.root FROM r JOIN f ON f.x = r.x),
k AS (SELECT x, min(root) AS class_id FROM r GROUP BY x),
l AS (SELECT n.ids, len(n.ids) - 1 + coalesce(sum(len(f.y)), 0) AS links FROM n LEFT JOIN f ON f.x = n.ids GROUP BY n.ids)
SELECT unnest(l.ids) AS vec_id, k.class_id, CAST(l.links AS BIGINT) AS n_links FROM l JOIN k ON k.x = l.ids WHERE l.links > 0"""


ORACLES: dict[str, str] = {
    "op2_embedding_dedup": _links(0.97),
    "embedding_links_loose": _links(0.45),
    "op6_suffix_dedup": r"""
WITH p AS (SELECT doc_id, regexp_split_to_array(text, '[ \t\n\r\f\v]') AS p FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
q AS (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS k FROM p),
r AS (SELECT doc_id, w, k, CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(w) - 1 AS INTEGER) AS a FROM q),
t AS (SELECT doc_id, w, a, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM r WHERE w <> ''),
d AS (SELECT doc_id, list(w ORDER BY i) AS w, list(a ORDER BY i) AS a FROM t GROUP BY doc_id),
e AS (SELECT doc_id, w, a, unnest(generate_series(0, len(w) - 50)) AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 50], ' ') AS g, a[i + 1] AS s, CAST(a[i + 50] + length(w[i + 50]) AS INTEGER) AS z FROM e),
h AS (SELECT g, min(doc_id) AS f FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, i, s, z, f, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM g JOIN h USING (g)),
n AS (SELECT *, count_if(new) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM m)
SELECT doc_id, CAST(min(i) AS INTEGER) AS first_word, CAST(max(i) + 50 - min(i) AS INTEGER) AS n_words, min(s) AS start, max(z) AS "end", arg_min(f, i) AS first_doc
FROM n GROUP BY doc_id, part""",
    "op7_media_columns": """
SELECT page_id, 'text/html' AS media_type, CAST(strlen(html) AS BIGINT) AS n_bytes, md5(html) AS md5, CAST(NULL AS INTEGER) AS width, CAST(NULL AS INTEGER) AS height, CAST(NULL AS VARCHAR) AS error FROM pages
WHERE page_id IS NOT NULL AND html IS NOT NULL""",
    "op3_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+')) AS BIGINT) AS mix_tokens,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'), 1, 15) AS BIGINT) AS h
  FROM documents),
c AS (SELECT *, sum(mix_tokens) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) AS run FROM d),
n AS (SELECT source, sum(mix_tokens) AS n FROM d GROUP BY source),
g AS (SELECT coalesce(floor(min(n) + 1e-6), 0) AS target FROM n WHERE NOT n < CAST(0.5 AS DOUBLE) * (SELECT sum(n) FROM n) / (SELECT count(*) FROM n)),
t AS (SELECT * FROM (VALUES (0, CAST(0.25 AS DOUBLE)), (1, CAST(0.5 AS DOUBLE)), (2, CAST(1 AS DOUBLE))) v(tier, part))
SELECT doc_id, source, mix_tokens, CAST(min(tier) AS INTEGER) AS mix_tier
FROM c JOIN t ON run <= floor(part * (SELECT target FROM g))
GROUP BY doc_id, source, mix_tokens, h""",
    "op5_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^{_BLANK}]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(generate_series(1, greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i:i + 2], ' ')))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT list_sort(list(DISTINCT doc_id)) AS ids, s, len(s) AS n FROM s GROUP BY s),
p AS (SELECT ids, n, unnest(s) AS g FROM n),
o AS (SELECT a.ids AS ids_a, b.ids AS ids_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM p a JOIN p b ON a.g = b.g AND a.ids < b.ids GROUP BY a.ids, b.ids),
e AS (SELECT ids_a, ids_b FROM o WHERE c / (na + nb - c) >= 0.6 - 1e-9),
f AS (SELECT ids_a AS x, ids_b AS y FROM e UNION ALL SELECT ids_b, ids_a FROM e),
r(x, root) AS (SELECT ids, ids[1] FROM n UNION SELECT f.y, r.root FROM r JOIN f ON f.x = r.x),
k AS (SELECT x, min(root) AS class_id FROM r GROUP BY x),
l AS (SELECT n.ids, len(n.ids) - 1 + coalesce(sum(len(f.y)), 0) AS links FROM n LEFT JOIN f ON f.x = n.ids GROUP BY n.ids)
SELECT unnest(l.ids) AS doc_id, k.class_id, CAST(l.links AS BIGINT) AS n_links FROM l JOIN k ON k.x = l.ids WHERE l.links > 0""",
}
