"""Queries over texts, vocabularies, spans and time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import glyphs
from pagewright.functions import spans as S
from pagewright.functions import text as X
from pagewright.operators import layout, records, tables, timeline, vocabulary
from pagewright.plans import stages  # noqa: F401 - registers the stages
from pagewright.plans.layout_queries import WORDS, words_of
from pagewright.plans.registry import Pipeline, distinct_first
from pagewright.session import table
from pagewright.sources import documents, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def sql(text: str) -> str:
    return text.replace("'", "''")


PUNCT = sql(X.PUNCTUATION)
BLANKS = " " * len(X.PUNCTUATION)


@query(f"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(translate(text, '{PUNCT}' || chr(10), '{BLANKS} ')), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word HAVING count(*) >= 2""")
def word_frequency(spark, sf_dir):
    return sinks.word_frequencies(table(spark, sf_dir, "documents"), 2)


BLOCK_SQL = "CASE " + " ".join(f"WHEN unicode(ch) BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in X.BLOCKS) + " ELSE 'Other' END"


@query(f"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), b AS (SELECT doc_id, {BLOCK_SQL} AS script, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, script) AS rn, count(*) OVER (PARTITION BY doc_id) AS n_scripts FROM b)
SELECT doc_id, script, CAST(n AS BIGINT) AS n_chars, n_scripts FROM r WHERE rn = 1""")
def script_by_document(spark, sf_dir):
    return records.dominant_script(table(spark, sf_dir, "documents"), X.block)


@query(f"""WITH {WORDS}, u AS MATERIALIZED (SELECT DISTINCT text FROM words), c AS MATERIALIZED (SELECT text, unnest(string_split(translate(text, '{PUNCT} ', ''), '')) AS ch FROM u),
n AS (SELECT text, count(DISTINCT {BLOCK_SQL}) AS k FROM c WHERE ch <> '' GROUP BY text)
SELECT u.text, coalesce(k, 0) <= 1 AS single, regexp_full_match(u.text, '[\\x00-\\x7F]*') AS ascii, trim(translate(u.text, '{PUNCT}', '{BLANKS}'), ' ') AS bare FROM u LEFT JOIN n USING (text)""")
def word_forms(spark, sf_dir):
    t = F.col("text")
    return words_of(spark, sf_dir).select("text").distinct().select("text", X.single_script(t).alias("single"), X.is_ascii(t).alias("ascii"), X.without_punctuation(t).alias("bare"))


@query(f"""SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(translate(text, '{X.ACCENTS[0]}', '{X.ACCENTS[1]}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'Æ', 'AE'), 'Œ', 'OE'), '''', ''), '[^\\x00-\\x7F]', '', 'g')) AS ascii_md5 FROM documents""")
def ascii_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.to_ascii(F.col("text"))).alias("ascii_md5"))


@query(f"""SELECT page_id, md5(translate(html, '{X.INDIC}', '{"0123456789" * len(X.INDIC_ZEROS)}')) AS digits, md5(translate(html, '0123456789', '{"".join(chr(0x966 + k) for k in range(10))}')) AS nagari,
 md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages""")
def numerals_and_escapes(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.indic_to_ascii(h)).alias("digits"), F.md5(X.ascii_to_devanagari(h)).alias("nagari"), F.md5(X.html_escaped(h)).alias("escaped"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '({X.DNT})', '<dnt> \\1 </dnt>', 'g')) AS wrapped FROM documents")
def dnt_wrap(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.protected(F.col("text"))).alias("wrapped"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(translate(text, '“”„«»‘’‚´`–—‐ ', '\"\"\"\"\"''''''''''--- '), '…', '...'), ' +([.,;:!?%])', '\\1', 'g'), '\\( +', '(', 'g'), ' {2,}', ' ', 'g')) AS plain FROM documents""")
def punct_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.normal_punctuation(F.col("text"))).alias("plain"))


@query("""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?।])[ \\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ') <> '') AS s FROM documents),
p AS (SELECT doc_id, len(s) AS n_sentences, flatten(list_transform(s, lambda x: list_transform(generate_series(0, (len(string_split(x, ' ')) - 1) // 256), lambda i: 'src tgt ' || array_to_string((string_split(x, ' '))[i * 256 + 1:i * 256 + 256], ' ')))) AS p FROM s)
SELECT doc_id, n_sentences, CAST(len(p) AS INTEGER) AS n_parts, md5(array_to_string(p, chr(10))) AS tagged FROM p""")
def sentence_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    parts = d.withColumn("p", F.flatten(F.transform("s", lambda x: X.tagged_for_translation(x, "src", "tgt"))))
    return parts.select("doc_id", F.size("s").alias("n_sentences"), F.size("p").alias("n_parts"), F.md5(F.array_join("p", "\n")).alias("tagged"))


@query("""SELECT doc_id, CAST(unnest(generate_series(doc_id % 5, doc_id % 5 + 3)) AS INTEGER) AS number FROM documents UNION ALL SELECT doc_id, 77 FROM documents""")
def number_ranges(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("r", F.concat(F.lit("77,"), (F.col("doc_id") % 5).cast("string"), F.lit("-"), (F.col("doc_id") % 5 + 3).cast("string")))
    return d.select("doc_id", F.explode(X.number_ranges(F.col("r"))).alias("number"))


@query("""WITH p AS (SELECT page_id, url, 'in/' || page_id || '/a' || page_id || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.pdf.doc.json' WHEN 2 THEN '.mp4' ELSE '.json.gz' END AS path FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 2 THEN 'video' ELSE 'document' END AS kind, CASE WHEN page_id % 4 < 2 THEN 'a' || page_id || '.pdf' ELSE string_split(path, '/')[-1] END AS name, CAST(page_id AS VARCHAR) AS folder FROM p""")
def file_paths(spark, sf_dir):
    i = F.col("page_id")
    end = F.when(i % 4 == 0, ".pdf").when(i % 4 == 1, ".pdf.doc.json").when(i % 4 == 2, ".mp4").otherwise(".json.gz")
    p = table(spark, sf_dir, "pages").withColumn("path", F.concat(F.lit("in/"), i, F.lit("/a"), i, end))
    return p.select("page_id", X.file_kind(F.col("path")).alias("kind"), X.document_name(F.col("path")).alias("name"), X.path_part(F.col("path"), -2).alias("folder"))


@query("""SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock, CAST(s AS INTEGER) AS secs, CAST(round_even(CAST(value AS DECIMAL(18, 6)) * 1000, 0) AS INTEGER) AS ms, CAST(ts AS DATE) AS day
FROM (SELECT *, CAST(event_id % 90000 AS BIGINT) AS s FROM events)""")
def time_strings(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("clock", X.time_string(F.col("event_id") % 90000))
    return e.select("event_id", "clock", X.seconds(F.col("clock")).alias("secs"), X.milliseconds(F.concat(F.col("value").cast("string"), F.lit("s"))).alias("ms"), X.find_date(F.concat(F.lit("on "), F.date_format("ts", "d/M/yyyy"), F.lit(" it was"))).alias("day"))


@query(f"""WITH {WORDS} SELECT doc_id, page_idx, word_idx, 'pa' || page_idx || '.wo' || word_idx AS path, page_idx AS p, word_idx AS w FROM words""")
def word_paths(spark, sf_dir):
    w = words_of(spark, sf_dir).withColumn("path", X.word_path(F.col("page_idx"), F.col("word_idx"))).withColumn("x", X.parsed_path(F.col("path")))
    return w.select("doc_id", "page_idx", "word_idx", "path", F.col("x.page_idx").alias("p"), F.col("x.idx_to").alias("w"))


# ---- spans: of the e-mail-like and bracketed parts, and of line items as intervals


_SPANS = """s AS (SELECT l_orderkey AS k, CAST((l_partkey % 60) AS INTEGER) AS a, CAST((l_partkey % 60 + 1 + l_suppkey % 9) AS INTEGER) AS b FROM lineitem),
_r AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)"""


def _spans(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    span = S.span(F.col("l_partkey") % 60, F.col("l_partkey") % 60 + 1 + F.col("l_suppkey") % 9)
    return li.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(span).alias("spans"))


@query(f"""WITH {_SPANS}, i AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM _r) SELECT k, min(a) AS start, max(b) AS "end" FROM i GROUP BY k, g""")
def span_accumulate(spark, sf_dir):
    return _spans(spark, sf_dir).select("k", F.explode(S.accumulated(F.col("spans"), F.repeat(F.lit("x"), F.lit(100)))).alias("s")).select("k", "s.start", "s.end")


@query(f"""WITH {_SPANS}, o AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s) SELECT k, a AS start, b AS "end" FROM o WHERE m IS NULL OR b > m""")
def span_remove_subsumed(spark, sf_dir):
    return _spans(spark, sf_dir).select("k", F.explode(S.without_subsumed(F.col("spans"))).alias("s")).select("k", "s.start", "s.end")


@query(f"""WITH {_SPANS}, l AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a, b), 0) AS before FROM s) SELECT k, bool_and(before <= a) AS apart FROM l GROUP BY k""")
def span_non_overlapping(spark, sf_dir):
    return _spans(spark, sf_dir).select("k", S.non_overlapping(F.col("spans")).alias("apart"))


@query(f"""WITH {_SPANS} SELECT k, coalesce(reach, 0) AS start, a AS "end" FROM _r WHERE a > coalesce(reach, 0) UNION ALL SELECT k, max(b), 100 FROM s GROUP BY k HAVING max(b) < 100""")
def span_complement(spark, sf_dir):
    return _spans(spark, sf_dir).select("k", F.explode(S.complement(F.col("spans"), F.lit(100))).alias("s")).select("k", "s.start", "s.end")


@query(f"""WITH {_SPANS}, i AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM _r), c AS (SELECT k, sum(e - st) AS covered FROM (SELECT k, g, min(a) AS st, max(b) AS e FROM i GROUP BY k, g) GROUP BY k)
SELECT s.k, min(a) AS min_start, max(b) AS max_end, max(b) - min(a) AS span_len, CAST(sum(b - a) AS INTEGER) AS sum_span_len, CAST(any_value(covered) AS INTEGER) AS sum_match_len, CAST(max(b) - min(a) - any_value(covered) AS INTEGER) AS sum_gap FROM s JOIN c ON s.k = c.k GROUP BY s.k""")
def span_measures(spark, sf_dir):
    return _spans(spark, sf_dir).select("k", S.measures(F.col("spans")).alias("m")).select("k", "m.*")


@query("""SELECT l_orderkey AS k, l_linenumber AS n, greatest(0, least(a + 10, c + 8) - greatest(a, c)) AS shared, a <= c AND a + 10 >= c + 8 AS holds FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 30 AS INTEGER) AS a, CAST(l_suppkey % 30 AS INTEGER) AS c FROM lineitem)""")
def span_predicates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = S.span(F.col("l_partkey") % 30, F.col("l_partkey") % 30 + 10), S.span(F.col("l_suppkey") % 30, F.col("l_suppkey") % 30 + 8)
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), S.overlap_length(a, b).alias("shared"), S.subsumes(a, b).alias("holds"))


@query("""SELECT item_id, string_split(t, ' ')[1] || substr(t, length(string_split(t, ' ')[1]) + 2 + length(string_split(t, ' ')[2])) AS without_second, 1 + length(string_split(t, ' ')[1]) AS at FROM (SELECT item_id, replace(text, chr(10), ' ') AS t FROM benchmark)""")
def text_without_labels(spark, sf_dir):
    """Each text without its second word, which is labelled."""
    b = table(spark, sf_dir, "benchmark").withColumn("t", F.replace("text", F.lit("\n"), F.lit(" "))).withColumn("ws", S.word_spans(F.col("t")))
    second = F.element_at("ws", 2)
    return b.select("item_id", S.view_text(F.col("t"), F.array(second)).alias("without_second"), second["start"].alias("at"))


@query("""SELECT doc_id, (length(text) - length(replace(text, 'th', ''))) // 2 AS n, CASE WHEN strpos(text, 'th') > 0 THEN strpos(text, 'th') - 1 END AS first FROM documents""")
def pattern_occurrences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = F.col("text").try_cast("string")
    n = F.regexp_count(at, F.lit("th"))
    return d.select("doc_id", n.cast("bigint").alias("n"), F.when(F.instr("text", "th") > 0, F.instr("text", "th") - 1).alias("first"))


@query("""WITH b AS (SELECT item_id, replace(text, chr(10), ' ') AS t FROM benchmark) SELECT item_id, CAST(i - 1 AS INTEGER) AS at FROM b, LATERAL (SELECT unnest(generate_series(1, length(t) - 1)) AS i) WHERE substr(t, i, 2) = 'an'""")
def overlapping_occurrences(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("t", F.replace("text", F.lit("\n"), F.lit(" ")))
    return b.select("item_id", F.explode(X.occurrences(F.col("t"), F.lit("an"))).alias("at"))


# ---- vocabulary


_VOCAB = """vocab AS (SELECT row_number() OVER (ORDER BY w) AS pos, w AS text FROM (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS w FROM part UNION SELECT DISTINCT lower(p_type) FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer UNION SELECT DISTINCT lower(n_name) FROM nation)),
typo AS (SELECT DISTINCT substr(text, 1, 2) || substr(text, 4) AS text FROM vocab WHERE length(text) > 3 UNION SELECT text FROM vocab)"""


def _vocab(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("w")).union(part.select("p_type")).union(table(spark, sf_dir, "customer").select("c_mktsegment")).union(table(spark, sf_dir, "nation").select("n_name"))
    vocab = words.select(F.lower("w").alias("text")).distinct().withColumn("pos", F.row_number().over(Window.orderBy("text")))  # a vocabulary: a few hundred words
    typos = vocab.where(F.length("text") > 3).select(F.concat(F.substring("text", 1, 2), F.substring("text", 4, 99)).alias("text")).union(vocab.select("text")).distinct()
    return vocab, typos


@query(f"WITH {_VOCAB} SELECT t.text, v.text AS entry, CAST(v.pos AS INTEGER) AS pos, CAST(levenshtein(t.text, v.text) AS INTEGER) AS dist FROM typo t JOIN vocab v ON levenshtein(t.text, v.text) <= 2")
def fuzzy_vocab(spark, sf_dir):
    vocab, typos = _vocab(spark, sf_dir)
    return vocabulary.fuzzy(typos, vocab, 2)


@query(f"""WITH {_VOCAB}, b AS (SELECT text, trim(translate(text, '{PUNCT}', '{BLANKS}'), ' ') AS bare FROM typo), n AS (SELECT b.bare, arg_min(v.text, levenshtein(b.bare, v.text) * 100000 + v.pos) AS entry FROM (SELECT DISTINCT bare FROM b) b JOIN vocab v ON levenshtein(b.bare, v.text) <= 1 GROUP BY b.bare)
SELECT b.text, CASE WHEN length(b.bare) <= 2 THEN CASE WHEN b.bare IN ('uf', 'cf', 'qf', 'nf', 'af', 'bf') THEN replace(b.text, b.bare, 'of') ELSE b.text END WHEN n.entry IS NOT NULL THEN replace(b.text, b.bare, n.entry) ELSE b.text END AS corrected FROM b LEFT JOIN n ON b.bare = n.bare""")
def spelling_correction(spark, sf_dir):
    vocab, typos = _vocab(spark, sf_dir)
    return vocabulary.corrected(typos, vocab, 1)


@query()
def merge_split_words(spark, sf_dir):
    """Part names whose first word is split after two letters, put together again."""
    vocab, _ = _vocab(spark, sf_dir)
    pieces = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.flatten(F.transform(F.split("p_name", " "), lambda w, i: F.when(i == 0, F.array(F.substring(w, 1, 2), F.substring(w, 3, 99))).otherwise(F.array(w))))).alias("pos", "text"))
    return vocabulary.merged(pieces, vocab, ("p_partkey",), "pos")


@query(f"WITH {_VOCAB} SELECT p_partkey FROM part WHERE lower(p_type) IN (SELECT text FROM vocab)")
def exact_vocab(spark, sf_dir):
    vocab, _ = _vocab(spark, sf_dir)
    return vocabulary.exact(table(spark, sf_dir, "part"), vocab, "p_type", fold=True).select("p_partkey")


@query("""WITH k AS (SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM lineitem), d AS (SELECT 'A' AS l_returnflag, 'accepted' AS value UNION ALL SELECT 'N', 'none')
SELECT l_returnflag, coalesce(value, 'missing') AS value, count(*) AS n FROM k LEFT JOIN d USING (l_returnflag) GROUP BY ALL""")
def dictionary_fix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    dictionary = spark.createDataFrame([("A", "accepted"), ("N", "none")], "l_returnflag string, value string")
    hits, misses = vocabulary.looked_up(li.select("l_returnflag"), dictionary, "l_returnflag")
    return hits.unionByName(misses.withColumn("value", F.lit("missing"))).groupBy("l_returnflag", "value").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT text FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def translation_todo(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return vocabulary.todo(d, d.where("doc_id % 3 = 0").select("text").distinct())


@query("""SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, a.v AS left, b.v AS right FROM (SELECT p_partkey, p_size AS v FROM part WHERE p_partkey % 5 <> 0) a FULL JOIN (SELECT p_partkey, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM part WHERE p_partkey % 4 <> 0) b USING (p_partkey)
WHERE a.v IS DISTINCT FROM b.v""")
def reference_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return vocabulary.differences(p.where("p_partkey % 5 <> 0"), p.where("p_partkey % 4 <> 0").withColumn("p_size", F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)), "p_partkey", "p_size")


@query("SELECT 'd' || p_partkey AS pdf_name FROM part WHERE p_partkey % 3 <> 0 AND 'd' || p_partkey NOT IN ('d1', 'd2') AND NOT contains('d' || p_partkey, '77')")
def skip_existing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("d"), "p_partkey").alias("pdf_name"))
    return records.to_do(p.select("pdf_name"), p.where("p_partkey % 3 = 0"), ["d1", "d2"], ["77"])


_ERRORS = "e AS (SELECT CASE l_returnflag WHEN 'A' THEN 'EmptyCell' WHEN 'N' THEN 'ColumnCount' ELSE 'IncorrectValue' END AS error_name, 'pa' || l_linenumber || '.wo' || l_orderkey AS path, l_linestatus AS pipe FROM lineitem)"


def _errors(spark, sf_dir) -> DataFrame:
    f = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(F.when(f == "A", "EmptyCell").when(f == "N", "ColumnCount").otherwise("IncorrectValue").alias("error_name"), F.format_string("pa%d.wo%d", "l_linenumber", "l_orderkey").alias("path"), F.col("l_linestatus").alias("pipe"))


@query(f"WITH {_ERRORS} SELECT pipe, error_name, count(*) AS n FROM e GROUP BY ALL")
def error_counts(spark, sf_dir):
    return records.error_counts(_errors(spark, sf_dir), "pipe")


@query(f"WITH {_ERRORS} SELECT error_name, path, pipe FROM e WHERE NOT (error_name = 'EmptyCell' AND path IN (SELECT path FROM e WHERE error_name = 'EmptyCell' AND path LIKE '%7'))")
def ignore_errors(spark, sf_dir):
    e = _errors(spark, sf_dir)
    return records.without_ignored(e, e.where("error_name = 'EmptyCell' and path like '%7'").select("error_name", "path").distinct()).select("error_name", "path", "pipe")


# ---- sequences, tables


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS num_val FROM lineitem), e AS (SELECT *, coalesce(lag(num_val) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, num_val) + 1, 1) AS expected FROM v)
SELECT l_orderkey, l_linenumber, num_val, expected FROM e WHERE num_val <> 1 AND num_val <> expected""")
def marker_sequence_errors(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") + F.when(F.col("l_partkey") % 11 == 0, 1).otherwise(0)).alias("num_val"))
    return layout.sequence_errors(v, ("l_orderkey",), ("l_linenumber", "num_val"), "num_val")


@query("""WITH v AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS o, CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN 0 ELSE l_linenumber END AS num FROM lineitem),
a AS (SELECT *, CASE WHEN num <> 0 THEN num END AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY o) AS nth FROM v),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS last, last_value(CASE WHEN v IS NOT NULL THEN nth END IGNORE NULLS) OVER w AS last_nth FROM a WINDOW w AS (PARTITION BY l_orderkey ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, last + 1 + 2 * (nth - last_nth - 1) AS expected FROM b) SELECT l_orderkey, o, num, CAST(expected AS INTEGER) AS expected FROM c WHERE expected IS NOT NULL AND (v IS NULL OR v <> expected)""")
def table_serial_errors(spark, sf_dir):
    p = F.col("l_partkey")
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("bigint") * 1000000000000 + p * 1000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")).alias("o"), F.when(p % 13 == 0, None).when(p % 11 == 0, 0).otherwise(F.col("l_linenumber")).alias("num"))
    return tables.serial_errors(v, "l_orderkey", "o", "num")


@query("""WITH v AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS o, CAST(l_linenumber % 3 AS INTEGER) AS num FROM lineitem)
SELECT l_orderkey, o, num, CAST(count_if(num = 1 AND rn > 1) OVER (PARTITION BY l_orderkey ORDER BY o) AS INTEGER) AS table_idx FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY o) AS rn FROM v)""")
def split_tables(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("bigint") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")).alias("o"), (F.col("l_linenumber") % 3).alias("num"))
    return tables.split_tables(v, ("l_orderkey",), "o", "num")


@query("""WITH c AS (SELECT l_orderkey AS "table", l_linenumber AS row_idx, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) - 1 AS INTEGER) AS col_idx, CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE 'x' END AS text FROM lineitem),
s AS (SELECT "table", row_idx, count(*) AS n FROM c GROUP BY ALL), u AS (SELECT "table", n, count(*) AS times FROM s GROUP BY ALL), m AS (SELECT "table", arg_max(n, times * 1000 - n) AS usual FROM u GROUP BY ALL)
SELECT "table", 'EmptyCell' AS error_name, row_idx, col_idx FROM c WHERE trim(text) = '' UNION ALL SELECT s."table", 'ColumnCount', row_idx, NULL FROM s JOIN m ON s."table" = m."table" WHERE n <> usual""")
def table_validation(spark, sf_dir):
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("row_idx"), (F.row_number().over(order) - 1).alias("col_idx"), F.when(F.col("l_partkey") % 17 == 0, " ").otherwise("x").alias("text"))
    return tables.table_errors(cells)


@query("""SELECT l_orderkey, l_linenumber, '|' || string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_partkey) || '|' AS markdown FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def markdown_rows(spark, sf_dir):
    return sinks.markdown_rows(table(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"), "l_partkey", F.col("l_partkey").cast("string"))


@query()
def leader_clusters(spark, sf_dir):
    return tables.leader_clusters(table(spark, sf_dir, "events").withColumn("v", F.round("value", 2)), "user_id", "v", 5.0)


@query()
def merge_close_lines(spark, sf_dir):
    return tables.merged_lines(table(spark, sf_dir, "events"), "user_id", "value", 2.0)


@query("""WITH r AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + event_id % 4000 AS b FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN a - reach <= 600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(a) AS start, max(b) AS "end" FROM i GROUP BY user_id, g""")
def merge_ranges(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("a", F.unix_timestamp(F.col("ts").cast("timestamp"))).withColumn("b", F.col("a") + F.col("event_id") % 4000)
    return tables.merged_ranges(e, ("user_id",), "a", "b", 600)


@query("""WITH v AS (SELECT user_id, event_id, value FROM events), s AS (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY value) - value AS step FROM v), c AS (SELECT user_id, arg_max(value, step) AS low, max(step) AS widest, max(value) AS longest FROM s GROUP BY user_id)
SELECT v.user_id, event_id, value FROM v JOIN c ON v.user_id = c.user_id WHERE widest > longest * 0.05 AND value > low OR coalesce(widest, 0) <= longest * 0.05""")
def longest_cut(spark, sf_dir):
    return tables.longest_cut(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "value")


# ---- hierarchy


_TREE = "nodes AS (SELECT CAST(r_regionkey AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation)"


def _tree(spark, sf_dir) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("bigint"), F.col("n_regionkey").cast("bigint"), "n_name")
    return r.union(n)


@query(f"WITH {_TREE} SELECT node_id, node_id AS ancestor_id, 0 AS distance FROM nodes UNION ALL SELECT node_id, parent_id, 1 FROM nodes WHERE parent_id IS NOT NULL")
def hierarchy_closure(spark, sf_dir):
    return vocabulary.closure(_tree(spark, sf_dir))


def _places(spark, sf_dir) -> DataFrame:
    """A text for each customer that names a nation, sometimes its region too."""
    tree = _tree(spark, sf_dir)
    n, r = tree.where("parent_id is not null"), tree.where("parent_id is null").select(F.col("node_id").alias("parent_id"), F.col("name").alias("region"))
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 100).cast("bigint").alias("node_id"))
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("from "), "name", F.lit(", "), "region", F.lit("."))).otherwise(F.concat(F.lit("from "), "name"))
    return c.join(n, "node_id").join(r, "parent_id").select("c_custkey", text.alias("text"))


_PLACES = f"""{_TREE}, places AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'from ' || n.name || ', ' || r.name || '.' ELSE 'from ' || n.name END AS text FROM customer c JOIN nodes n ON n.node_id = c.c_nationkey + 100 JOIN nodes r ON r.node_id = n.parent_id),
spans AS (SELECT c_custkey, node_id, lower(name) AS name, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + length(name) AS INTEGER) AS "end" FROM places p, nodes n, LATERAL (SELECT unnest(generate_series(1, length(text) - length(name) + 1)) AS i)
 WHERE lower(substr(text, i, length(name))) = lower(name) AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_matches(substr(text, i + length(name), 1), '[\\p{{L}}\\p{{N}}]'))"""


@query(f"WITH {_PLACES} SELECT * FROM spans")
def hierarchy_match(spark, sf_dir):
    return vocabulary.named_spans(_places(spark, sf_dir), _tree(spark, sf_dir), "c_custkey")


#: A text of these has one name, or a nation and, behind a comma, its region: so it has one group.
_GROUPS = f"{_PLACES}, _deep AS (SELECT c_custkey, node_id, start, \"end\", parent_id IS NULL AS up FROM spans JOIN nodes USING (node_id)), groups AS (SELECT c_custkey, 0 AS group_id, list(node_id ORDER BY up) AS node_ids, list(start ORDER BY up) AS starts, list(\"end\" ORDER BY up) AS ends FROM _deep GROUP BY c_custkey)"


@query(f"WITH {_GROUPS} SELECT * FROM groups")
def hierarchy_groups(spark, sf_dir):
    p, t = _places(spark, sf_dir), _tree(spark, sf_dir)
    return vocabulary.grouped_spans(vocabulary.named_spans(p, t, "c_custkey"), p, t, "c_custkey")


@query(f"""WITH {_GROUPS} SELECT c_custkey, group_id, node_ids[1] AS leaf_id, node_ids[-1] AS root_id, CAST(len(node_ids) AS INTEGER) AS depth, CASE WHEN n.parent_id IS NULL THEN 0 ELSE 1 END AS level, list_min(starts) AS span_start, list_max(ends) AS span_end, true AS is_contiguous FROM groups g JOIN nodes n ON n.node_id = g.node_ids[1]""")
def hierarchy_accessors(spark, sf_dir):
    return vocabulary.group_accessors(hierarchy_groups(spark, sf_dir), _tree(spark, sf_dir), "c_custkey")


@query(f"WITH {_GROUPS} SELECT g.* FROM groups g JOIN nodes n ON n.node_id = g.node_ids[1] JOIN nodes p ON p.node_id = n.parent_id WHERE contains(lower(p.name), 'asia')")
def hierarchy_path_match(spark, sf_dir):
    return vocabulary.path_match(hierarchy_groups(spark, sf_dir), _tree(spark, sf_dir), ["ASIA"])


@query("""WITH t AS (SELECT 'World' AS name, [] AS aliases, NULL AS level, '' AS path UNION ALL SELECT r_name, list_filter([replace(r_name, 'A', 'AA')], lambda x: contains(r_name, 'A')), 'regions', 'World' FROM region
 UNION ALL SELECT n_name, list_filter([replace(n_name, 'A', 'AA')], lambda x: contains(n_name, 'A')), 'nations', 'World.' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT name, array_to_string(aliases, ',') AS aliases, level, path FROM t""")
def hierarchy_yaml(spark, sf_dir):
    """A tree read from YAML, with names in which a text is replaced as aliases."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").orderBy("r_name", "n_name").collect()  # a tree of names, small by its kind
    lines = ["name: World", "regions:"]
    for region in sorted({r["r_name"] for r in rows}):
        lines += [f"  - name: '{region}'", "    nations:", *(f"      - name: '{r['n_name']}'" for r in rows if r["r_name"] == region)]
    tree = vocabulary.read_tree(spark, "\n".join(lines), expand=(("A", "AA"),))
    return tree.select("name", F.array_join("aliases", ",").alias("aliases"), "level", F.array_join("path", ".").alias("path"))


def _selection(name: str):
    def run(spark, sf_dir):
        return vocabulary.selected(hierarchy_groups(spark, sf_dir), "c_custkey", name)

    run.__name__ = f"select_{name}"
    return run


#: As each text has one group, a strategy keeps it, or not: by where it starts, or how many names it has.
_KEPT = {"at_start": " WHERE list_min(starts) = 0", "connected_sum_span_len": " WHERE len(node_ids) >= 2"}
for _name in (*vocabulary.SELECTIONS, "at_start", "non_overlapping", "unique", "none"):
    query(f"WITH {_GROUPS} SELECT * FROM groups{_KEPT.get(_name, '')}")(_selection(_name))


@query(f"WITH {_PLACES} SELECT n.node_id, CASE WHEN count(s.name) = 0 THEN [] ELSE list_sort(list(DISTINCT s.name)) END AS aliases FROM nodes n LEFT JOIN spans s ON s.node_id = n.node_id GROUP BY n.node_id")
def alias_record(spark, sf_dir):
    return vocabulary.alias_record(vocabulary.named_spans(_places(spark, sf_dir), _tree(spark, sf_dir), "c_custkey"), _tree(spark, sf_dir))


# ---- geometry of edges


@query("""WITH e AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS x1, l_discount * 100 AS y1, l_tax * 100 AS x2, l_quantity + 3 AS y2, CAST(l_linenumber AS DOUBLE) AS u1, 1.0::DOUBLE AS v1, 40.0::DOUBLE AS u2, 30.0::DOUBLE AS v2 FROM lineitem),
d AS (SELECT *, (x1 - x2) * (v1 - v2) - (y1 - y2) * (u1 - u2) AS det FROM e)
SELECT k, n, round(((x1 * y2 - y1 * x2) * (u1 - u2) - (u1 * v2 - v1 * u2) * (x1 - x2)) / nullif(det, 0), 7) AS x, round(((x1 * y2 - y1 * x2) * (v1 - v2) - (u1 * v2 - v1 * u2) * (y1 - y2)) / nullif(det, 0), 7) AS y, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) AS length, round(x1 + (x2 - x1) * 0.25, 6) AS qx FROM d""")
def edge_intersection(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem")
    a = (F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.col("l_quantity") + 3)
    b = (F.col("l_linenumber").cast("double"), F.lit(1.0), F.lit(40.0), F.lit(30.0))
    x, y = G.intersection(a, b)
    return e.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(x, 7).alias("x"), F.round(y, 7).alias("y"), F.round(G.edge_length(*a), 6).alias("length"), F.round(G.point_along(*a, 0.25)[0], 6).alias("qx"))


@query("""SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity - 0.005 ELSE l_quantity END AS x1, CASE WHEN l_linenumber % 2 = 1 THEN l_tax + 0.007 ELSE l_tax END AS y2 FROM lineitem""")
def move_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("edge_idx", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").cast("string"))
    edges = li.select("edge_idx", F.col("l_quantity").alias("x1"), F.col("l_discount").alias("y1"), F.col("l_quantity").alias("x2"), F.col("l_tax").alias("y2"))
    even = F.col("l_linenumber") % 2 == 0
    moves = li.select("edge_idx", F.when(even, "coord1").otherwise("coord2").alias("which"), F.when(even, "left").otherwise("down").alias("direction"), F.when(even, 5).otherwise(7).alias("thou")).dropDuplicates(["edge_idx"])
    keys = li.select("edge_idx", F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).dropDuplicates(["edge_idx"])
    return records.move_edges(edges, moves).join(keys, "edge_idx").select("k", "n", "x1", "y2")


# ---- time


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER w - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), s AS (SELECT conv_id, role, min(turn) AS start, max(turn) AS "end", count(*) AS n FROM r GROUP BY conv_id, role, g)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start) - 1 AS scene_idx, role, start, "end", n FROM s""")
def run_length_roles(spark, sf_dir):
    return timeline.scenes(table(spark, sf_dir, "conversations"), ("conv_id",), "turn", "role")


@query("""WITH s AS (SELECT user_id, CAST(min(floor(epoch(ts))) AS BIGINT) AS a, CAST(max(floor(epoch(ts))) AS BIGINT) AS b FROM events GROUP BY user_id) SELECT user_id, unnest(generate_series(a, b, 86400)) AS t FROM s""")
def scene_grid(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("b"))
    return timeline.grid(e, "a", "b", 86400).select("user_id", "t")


@query("""WITH h AS (SELECT user_id, CAST(event_id AS BIGINT) AS t FROM events) SELECT DISTINCT user_id, unnest(generate_series(greatest(0, t - 10), t + 10 - 1, 1)) AS t FROM h""")
def scene_fine_grid(spark, sf_dir):
    return timeline.fine_grid(table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("t")), "user_id", 10, 1)


@query("""WITH c AS (SELECT conv_id, trim(text, ' ') AS t, count(*) AS n FROM conversations WHERE length(trim(text, ' ')) > 10 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, length(t) DESC, t COLLATE "C" DESC) AS rn FROM c) SELECT conv_id, t AS text FROM r WHERE rn = 1""".replace(' COLLATE "C"', ""))
def scene_text(spark, sf_dir):
    return timeline.scene_text(table(spark, sf_dir, "conversations"), "conv_id")


@query("""SELECT user_id, CAST(sum(event_id % 100) AS BIGINT) AS duration FROM events GROUP BY user_id""")
def trimmed_duration(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("a", F.col("event_id")).withColumn("b", F.col("event_id") + F.col("event_id") % 100)
    return timeline.trimmed_duration(e, "user_id", "a", "b")


@query("""SELECT event_id, CAST(floor(29.97 * value) AS INTEGER) AS frame, CAST(floor(0.1 * 1920) AS INTEGER) AS x, CAST(floor(0.6 * 1920) AS INTEGER) - CAST(floor(0.1 * 1920) AS INTEGER) AS w FROM (SELECT event_id, CAST(value AS DOUBLE) AS value FROM events)""".replace("29.97", "29.97::DOUBLE"))
def frames_and_crops(spark, sf_dir):
    box = {"xmin": F.lit(0.1), "ymin": F.lit(0.2), "xmax": F.lit(0.6), "ymax": F.lit(0.9)}
    x, _, w, _ = timeline.crop_pixels(box, F.lit(1920), F.lit(1080))
    return table(spark, sf_dir, "events").select("event_id", timeline.frame_index(F.lit(29.97), F.col("value")).alias("frame"), x, w)


@query("""WITH w AS (SELECT conv_id AS file, turn AS chunk_idx, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM conversations)
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY chunk_idx, pos) - 1 AS INTEGER) AS word_idx, text, CAST(pos * 500 + chunk_idx * 60000 AS INTEGER) AS start_ms, CAST(pos * 500 + 400 + chunk_idx * 60000 AS INTEGER) AS end_ms, chunk_idx FROM w""")
def transcript_words(spark, sf_dir):
    at = lambda i, d: F.concat((i * 0.5 + d).cast("decimal(12,3)").cast("string"), F.lit("s"))
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), at(i, 0.0).alias("start"), at(i, 0.4).alias("end")))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("chunk_idx"), (F.col("turn") * 60000).cast("int").alias("chunk_start_ms"), words.alias("words"))
    return timeline.transcript_words(c)


# ---- learning data


@query("""WITH l AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'good' WHEN toxic = 1 THEN 'toxic' END AS label FROM labels), b AS (SELECT *, lag(label) OVER (ORDER BY doc_id) AS before FROM l)
SELECT doc_id, CASE WHEN label IS NULL THEN 'O' WHEN label IS DISTINCT FROM before THEN 'B-' || label ELSE 'I-' || label END AS tag FROM (SELECT *, lag(label) OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS before FROM l)""")
def iob_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("label", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "good").when(F.col("toxic") == 1, "toxic")).withColumn("part", F.expr("doc_id div 100"))
    return records.iob(rows, ("part",), "doc_id", "label").select("doc_id", "tag")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels), c AS (SELECT k, CAST(floor(k * n / 3) AS BIGINT) AS a, CAST(floor((k + 1) * n / 3) AS BIGINT) AS b FROM range(3) t(k), (SELECT count(*) AS n FROM labels))
SELECT doc_id, CAST(k AS INTEGER) AS fold FROM r JOIN c ON i >= a AND i < b""")
def kfold_split(spark, sf_dir):
    return records.folds(table(spark, sf_dir, "labels").select("doc_id"), F.col("doc_id"), 3)


@query("""WITH g AS (SELECT doc_id, quality AS label FROM labels), f AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS label FROM labels WHERE doc_id % 7 <> 0), n AS (SELECT label, count(g.doc_id) AS n_gold, count(f.doc_id) AS n_found, CAST(count_if(g.doc_id IS NOT NULL AND f.doc_id IS NOT NULL) AS BIGINT) AS n_right
 FROM g FULL JOIN f USING (doc_id, label) GROUP BY label), p AS (SELECT *, CASE WHEN n_found = 0 THEN 0 ELSE n_right / n_found END AS precision, CASE WHEN n_gold = 0 THEN 0 ELSE n_right / n_gold END AS recall FROM n)
SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p""")
def prf_metrics(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    found = lab.where("doc_id % 7 <> 0").withColumn("label", F.when(F.col("doc_id") % 10 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    return records.entity_scores(lab, found, ["doc_id"], "label")


# ---- fonts, recognition, pipelines, models


@query("""SELECT p_partkey, lower(replace(replace(replace(p_brand, ' ', ''), ',', ''), '-', '')) AS font, p_size >= 25 AS bold FROM part""")
def font_names(spark, sf_dir):
    name = F.concat(F.lit("ABCDEF+"), "p_brand", F.when(F.col("p_size") >= 25, F.lit("")).otherwise(F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", glyphs.clean_font(name).alias("font"), glyphs.is_bold(F.when(F.col("p_size") >= 25, F.lit("X-Bold")).otherwise(F.lit("X"))).alias("bold"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 26 THEN chr(CAST(64 + p_size AS INTEGER)) ELSE '(' || p_brand || '-cid:' || p_size || ')' END AS ch FROM part""")
def glyph_characters(spark, sf_dir):
    g = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("font"), F.col("p_size").alias("cid"))
    cmap = g.select("font", "cid").distinct().where("cid <= 26").withColumn("ch", F.char(F.col("cid") + 64))
    return glyphs.characters(g, cmap).select("p_partkey", "ch")


@query(f"""WITH {WORDS}, f AS (SELECT DISTINCT doc_id, page_idx, word_idx, CASE WHEN unicode(ch) < 97 THEN 'caps' WHEN unicode(ch) <= 122 THEN 'small' ELSE 'other' END AS font FROM (SELECT doc_id, page_idx, word_idx, unnest(string_split(text, '')) AS ch FROM words)),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_idx, word_idx) AS k FROM f) SELECT doc_id, page_idx, font, count(*) AS n_words, count_if(k > 1)::BIGINT AS n_mixed FROM n GROUP BY ALL""")
def font_statistics(spark, sf_dir):
    """Words with a font for each of their letters, by its kind."""
    letters = words_of(spark, sf_dir).select("doc_id", "page_idx", "word_idx", F.explode(X.characters(F.col("text"))).alias("ch"))
    point = F.ascii("ch")
    return glyphs.font_statistics(letters.withColumn("font", F.when(point < 97, "caps").when(point <= 122, "small").otherwise("other")))


@query("""SELECT doc_id, 0 AS page_idx, CAST(0 AS INTEGER) AS word_idx, 'ab' AS text, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 1 END AS break_type, 0.0::DOUBLE AS xmin, 0.1::DOUBLE AS ymin, 0.4::DOUBLE AS xmax, 0.2::DOUBLE AS ymax FROM documents""")
def recognition_words(spark, sf_dir):
    """A recogniser's response for each document, flattened; the vertex without x is at 0."""
    head = '{"responses":[{"fullTextAnnotation":{"pages":[{"width":10,"height":10,"blocks":[{"paragraphs":[{"words":[{"boundingBox":{"normalizedVertices":[{"y":0.1},{"x":0.4,"y":0.1},{"x":0.4,"y":0.2},{"y":0.2}]},"symbols":[{"text":"a"},{"text":"b","property":{"detectedBreak":{"type":"'
    tail = '"}}}]}]}]}]}]}}]}'
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(head), F.when(F.col("doc_id") % 2 == 0, "LINE_BREAK").otherwise("SPACE"), F.lit(tail)).alias("json"))
    return documents.recognised_words(d)


@query("""SELECT doc_id, CAST(doc_id % 2100 AS BIGINT) AS num_pages, CASE WHEN doc_id % 2100 > 2000 THEN 'error' WHEN doc_id % 2100 <= 5 THEN 'sync' ELSE 'async' END AS route FROM documents""")
def recognition_route(spark, sf_dir):
    return documents.recognition_route(table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2100).alias("num_pages"))).drop("parts")


@query("""SELECT doc_id, 'line' AS stub, 'cutoff' AS key, CASE WHEN doc_id % 3 = 0 THEN '9' WHEN doc_id % 2 = 0 THEN '7' ELSE '5' END AS value FROM documents""")
def config_layers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("line").alias("stub"), F.lit("cutoff").alias("key"))
    layers = d.withColumn("levels", F.array(F.struct(F.lit(0).alias("priority"), F.lit("5").alias("value"), F.lit(True).alias("on")), F.struct(F.lit(1).alias("priority"), F.lit("7").alias("value"), (F.col("doc_id") % 2 == 0).alias("on")), F.struct(F.lit(2).alias("priority"), F.lit("9").alias("value"), (F.col("doc_id") % 3 == 0).alias("on"))))
    each = layers.select("doc_id", "stub", "key", F.explode("levels").alias("l")).where("l.on").select("doc_id", "stub", "key", "l.value", "l.priority")
    return records.layered_config({"cutoff": "5"}, each)


PIPELINE = """
pipeline:
  - name: quarantine
    most_chars: 10000
  - component: words
  - name: line_finder
    cutoff: 5
  - name: num_marker
  - name: list_finder
"""
#: The same without the limit on length.
WHOLE_PIPELINE = PIPELINE.replace("  - name: quarantine\n    most_chars: 10000\n", "")


@query("SELECT doc_id, 'quarantine' AS pipe, 'TextTooLong' AS error FROM documents WHERE length(text) > 10000")
def quarantine_smoke(spark, sf_dir):
    return Pipeline.load(PIPELINE)({"docs": table(spark, sf_dir, "documents")})["quarantine"]


@query()
def pipeline_yaml_smoke(spark, sf_dir):
    return Pipeline.load(WHOLE_PIPELINE)({"docs": table(spark, sf_dir, "documents")})["items"]


@query("SELECT item_id, 'T: ' || text AS translated FROM benchmark")
def translate_distinct(spark, sf_dir):
    """A translator plugged in for the distinct texts."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return distinct_first(b, "text", lambda frame: frame.assign(translated="T: " + frame["text"]), "text string, translated string").select("item_id", "translated")


@query("""SELECT doc_id, bool_or(contains(lower(text), 'the')) AND bool_or(contains(lower(text), 'of')) AS multi FROM documents GROUP BY doc_id""")
def multi_order(spark, sf_dir):
    t = F.lower("text")
    return table(spark, sf_dir, "documents").groupBy("doc_id").agg((F.bool_or(F.contains(t, F.lit("the"))) & F.bool_or(F.contains(t, F.lit("of")))).alias("multi"))


# ---- further operators


@query("""SELECT item_id, CAST(5 + p AS INTEGER) AS start, CAST(10 + p AS INTEGER) AS "end" FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 3 ELSE 0 END AS p FROM benchmark)""")
def span_remap(spark, sf_dir):
    """A span of a view back in the text from which three characters at its start are removed, in every other row."""
    removed = F.when(F.col("item_id") % 2 == 0, F.array(S.span(F.lit(0), F.lit(3)))).otherwise(F.array().cast(f"array<{S.SPAN}>"))
    found = S.to_base(S.span(F.lit(5), F.lit(10)), removed)
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(found).alias("s")).select("item_id", "s.start", "s.end")


@query("""SELECT item_id, CAST(10 + CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS start, CAST(15 + CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS "end" FROM benchmark""")
def span_shift(spark, sf_dir):
    by = F.when(F.col("item_id") % 2 == 0, 2).otherwise(0)
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(S.shifted(F.array(S.span(F.lit(10), F.lit(15))), F.lit(4), by)).alias("s")).select("item_id", "s.start", "s.end")


@query("""SELECT item_id, '     ' || substr(text, 6) AS blank FROM benchmark WHERE length(text) >= 5""")
def span_blank(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").where("length(text) >= 5")
    return b.select("item_id", S.blanked(F.col("text"), F.array(S.span(F.lit(0), F.lit(5)))).alias("blank"))


@query(r"SELECT doc_id, md5(text) AS md5 FROM documents WHERE NOT regexp_matches(text, '\([^()]{7,}\)')")
def brackets_kept(spark, sf_dir):
    """Documents that the blanking of bracketed parts leaves as they are."""
    d = table(spark, sf_dir, "documents").withColumn("blank", X.brackets_blanked(F.col("text")))
    return d.where("blank = text").select("doc_id", F.md5("blank").alias("md5"))


@query("SELECT p_partkey, 'ba' || 'dc' AS text FROM part")
def glyph_reorder(spark, sf_dir):
    """Of a, b: b moves left; of c, d: c moves right."""
    chars = F.array(*[F.lit(c) for c in "abcd"])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(glyphs.reordered(chars, F.array(F.lit("b")), F.array(F.lit("c"))), "").alias("text"))


@query("""SELECT item_id AS doc_id, 0 AS page_idx, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS word_idx, w AS text FROM (SELECT item_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w, generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) AS i FROM benchmark) WHERE w <> ''""")
def glyph_words(spark, sf_dir):
    """Words put together from single glyphs on a line."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_idx"), F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), "")).alias("i", "ch")).where("ch <> ''")
    g = b.select("doc_id", "page_idx", "ch", F.lit("f").alias("font"), F.col("i").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("i") + 1).cast("double").alias("x1"))
    return glyphs.words(g).drop("font")


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 3")
def metadata_lookup(spark, sf_dir):
    """Rows with their metadata; what has none is the other result."""
    meta = table(spark, sf_dir, "region").where("r_regionkey <> 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return records.with_metadata(table(spark, sf_dir, "nation"), meta, "n_regionkey")[0].select("n_nationkey", "r_name")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 AND p_size * 50 >= 500 THEN 'embedded' ELSE 'raster' END AS image_source, CAST(greatest(p_size * 10, 72) AS INTEGER) AS raster_dpi FROM part")
def page_image_choice(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 2).alias("num_images"), (F.col("p_size") * 50).alias("image_width"), (F.col("p_size") * 50).alias("image_height"), (F.col("p_size") * 10).alias("image_dpi"))
    return documents.page_images(p).select("p_partkey", "image_source", "raster_dpi")


@query("SELECT doc_id, 'replaceStr pa0.wo1 <all> ' || chr(39) || lang || chr(39) AS script FROM documents")
def fix_scripts(spark, sf_dir):
    return sinks.fix_scripts(table(spark, sf_dir, "documents").select("doc_id", F.lit("pa0.wo1").alias("path"), F.col("lang").alias("text")))


@query("""SELECT event_id, CAST(10 + event_id % 40 AS INTEGER) AS kept_seconds FROM events""")
def kept_intervals(spark, sf_dir):
    """What removed intervals leave of a medium."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 40 + 30).cast("int").alias("duration"), F.array(S.span(F.lit(5), F.lit(20)), S.span(F.lit(15), F.lit(25))).alias("removed"))
    kept = timeline.kept_intervals(e)
    return kept.select("event_id", F.aggregate("kept", F.lit(0), lambda a, s: a + s["end"] - s["start"]).alias("kept_seconds"))


@query(f"WITH {_PLACES} SELECT c_custkey, min(node_id) FILTER (node_id >= 100) AS leaf FROM spans GROUP BY c_custkey")
def hierarchy_level_match(spark, sf_dir):
    """The groups whose deepest node is a nation."""
    found = vocabulary.matching(hierarchy_groups(spark, sf_dir), _tree(spark, sf_dir), level=1)
    return found.select("c_custkey", F.element_at("node_ids", 1).alias("leaf"))


@query("SELECT item_id AS doc_id, replace(replace(text, chr(10), ''), ' ', '') AS text FROM benchmark")
def glyph_merge(spark, sf_dir):
    """Glyphs that touch, joined into one word."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("page_idx"), F.posexplode(F.split(F.translate("text", "\n ", ""), "")).alias("seq", "text")).where("text <> ''")
    g = b.withColumn("x0", F.col("seq").cast("double")).withColumn("y0", F.lit(0.0)).withColumn("x1", (F.col("seq") + 1).cast("double"))
    return glyphs.merged(g).select("doc_id", "text")


@query("SELECT item_id, '0' || repeat(' ', greatest(length(string_split(t, ' ')[1]), 1)) || '1' AS ruler FROM (SELECT item_id, replace(text, chr(10), ' ') AS t FROM benchmark)")
def word_ruler(spark, sf_dir):
    first = F.array_join(F.slice(F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda w: w != ""), 1, 2), " ")
    return table(spark, sf_dir, "benchmark").select("item_id", X.ruler(first).alias("ruler"))
