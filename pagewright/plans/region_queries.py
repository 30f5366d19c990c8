"""Queries over regions, tables by page, scripts, edits and spans of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import glyphs
from pagewright.functions import text as X
from pagewright.operators import layout, models, records, regions, tables
from pagewright.plans.layout_queries import FIRST, GRIDS, LINES, WORDS, lines_of, table_grids, words_of
from pagewright.session import table
from pagewright.sources import documents, pdf, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query(f"""WITH {WORDS}, l AS (SELECT doc_id, page_idx, line_no AS region_idx, list(word_idx ORDER BY word_idx DESC) AS idxs FROM words GROUP BY ALL), u AS (SELECT doc_id, page_idx, region_idx, unnest(idxs) AS word_idx, generate_subscripts(idxs, 1) AS pos FROM l)
SELECT doc_id, page_idx, region_idx, count(*) AS n_words, string_agg(text, ' ' ORDER BY u.pos) AS text, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM u JOIN words USING (doc_id, page_idx, word_idx) GROUP BY ALL""")
def region_words(spark, sf_dir):
    """Each line a region that lists its words from the last to the first."""
    w = words_of(spark, sf_dir)
    listed = w.groupBy("doc_id", "page_idx", F.col("line_no").alias("region_idx")).agg(F.sort_array(F.collect_list("word_idx"), False).alias("word_idxs"))
    return regions.region_summary(listed, w)


_QUADS = "q AS (SELECT doc_id, page_idx, CAST(k AS INTEGER) AS region_idx, k % 2 * 500 AS x0, k // 2 * 500 + doc_id % 40 AS y0, k % 2 * 500 + 500 AS x1, k // 2 * 500 + 500 AS y1 FROM (SELECT DISTINCT doc_id, page_idx FROM words), range(4) t(k))"


def _quads(w: DataFrame) -> DataFrame:
    each = w.select("doc_id", "page_idx").distinct().withColumn("region_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    left, top = F.col("region_idx") % 2 * 500, F.floor(F.col("region_idx") / 2) * 500
    return each.withColumn("x0", left).withColumn("y0", top + F.col("doc_id") % 40).withColumn("x1", left + 500).withColumn("y1", top + 500)


@query(f"""WITH {WORDS}, {_QUADS}, p AS (SELECT *, least(xmax, x1) - greatest(xmin, x0) AS w, least(ymax, y1) - greatest(ymin, y0) AS h, (xmax - xmin) * (ymax - ymin) AS area FROM words JOIN q USING (doc_id, page_idx))
SELECT doc_id, page_idx, word_idx, region_idx FROM p WHERE w >= 0 AND h >= 0 AND CASE WHEN area = 0 THEN 100 ELSE w * h * 100 // area END > 80""")
def relevant_regions(spark, sf_dir):
    w = words_of(spark, sf_dir)
    return regions.relevant(w, _quads(w)).select("doc_id", "page_idx", "word_idx", "region_idx")


@query(f"""WITH {WORDS}, m AS (SELECT doc_id, page_idx, word_idx, xmin, ymin, xmax, ymax FROM words WHERE regexp_matches(text, '^[0-9]+[.]?$')), b AS (SELECT doc_id, page_idx, k * 50 AS x0, 0 AS y0, 1000 - k * 100 AS x1, 400 + k * 500 AS y1 FROM (SELECT DISTINCT doc_id, page_idx FROM words WHERE doc_id % 3 > 0), range(2) t(k)),
p AS (SELECT *, least(xmax, x1) - greatest(xmin, x0) AS w, least(ymax, y1) - greatest(ymin, y0) AS h, (xmax - xmin) * (ymax - ymin) AS area FROM m JOIN b USING (doc_id, page_idx))
SELECT doc_id, page_idx, word_idx FROM p GROUP BY ALL HAVING bool_and(w >= 0 AND h >= 0 AND CASE WHEN area = 0 THEN 100 ELSE w * h * 100 // area END > 1)""")
def markers_in_tables(spark, sf_dir):
    """Numbers that overlap both table boxes of their page; a third of the documents has none."""
    w = words_of(spark, sf_dir)
    marks = w.where(F.col("text").rlike("^[0-9]+[.]?$")).select("doc_id", "page_idx", "word_idx", "xmin", "ymin", "xmax", "ymax")
    boxes = w.where("doc_id % 3 > 0").select("doc_id", "page_idx").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    boxes = boxes.select("doc_id", "page_idx", (F.col("k") * 50).alias("x0"), F.lit(0).alias("y0"), (1000 - F.col("k") * 100).alias("x1"), (400 + F.col("k") * 500).alias("y1"))
    return regions.markers_in_tables(marks, boxes, 1).select("doc_id", "page_idx", "word_idx")


@query("""SELECT doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN doc_id % 900 - 50 WHEN doc_id % 3 = 0 THEN n_chars % 900 - 50 WHEN doc_id % 5 > 0 THEN 100 + doc_id % 7 END AS x_start, CASE WHEN doc_id % 2 = 0 THEN doc_id % 900 WHEN doc_id % 3 = 0 THEN n_chars % 900 WHEN doc_id % 5 > 0 THEN 130 END AS x_end,
 CASE WHEN doc_id % 2 = 0 THEN 'user_boundary_words' WHEN doc_id % 3 = 0 THEN 'conf_boundary_words' WHEN doc_id % 5 > 0 THEN 'cell_boundary' END AS strategy FROM documents""")
def cell_boundaries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id"))
    user, conf = d.where("doc_id % 2 = 0").select("path", (F.col("doc_id") % 900).alias("xmin")), d.where("doc_id % 3 = 0").select("path", (F.col("n_chars") % 900).alias("xmin"))
    gaps = d.where("doc_id % 5 > 0").select("path", (100 + F.col("doc_id") % 7).alias("gap_start"), F.lit(130).cast("bigint").alias("gap_end"))
    return regions.boundaries(d.select("path"), user, conf, gaps)


@query("""SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey % 3 AS page, l_partkey % 2 AS tab, l_linenumber - 1 AS r, r = 0 AS a, r = 0 AND page = 0 AS b, r = 0 AND (page = 0 OR tab > 0) AS c, r = 0 AND tab = 0 AS d, l_quantity < 25 AS merged FROM lineitem""")
def header_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 3).alias("page"), (F.col("l_partkey") % 2).alias("tab"), (F.col("l_linenumber") - 1).alias("r"), "l_quantity")
    heads = [regions.is_header_row(s, F.col("page"), F.col("tab"), F.col("r")).alias(c) for s, c in zip(regions.HEADER_STRATEGIES, "abcd")]
    cells = F.array(F.lit("x"), F.when(F.col("l_quantity") >= 25, F.lit("y")))
    return li.select("k", "n", "page", "tab", "r", *heads, regions.has_merged_cells(cells).alias("merged"))


from pagewright.plans.text_queries import BLOCK_SQL  # noqa: E402

_SCRIPTS = f"""_c AS (SELECT doc_id, page_idx, unnest(string_split(text, '')) AS ch FROM words), _b AS (SELECT doc_id, page_idx, {BLOCK_SQL} AS script, count(*) AS n FROM _c WHERE ch <> '' GROUP BY ALL),
scripts AS (SELECT doc_id, page_idx, arg_min(script, (-n, script)) AS script FROM _b GROUP BY ALL)"""
#: Letters that have Latin-1 signs alone, so that documents of several scripts occur.
_MIXED = f"""{WORDS.replace("words AS MATERIALIZED", "_all AS MATERIALIZED")}, words AS (SELECT * EXCLUDE (text), CASE WHEN (doc_id + page_idx) % 3 = 0 THEN 'आदेश' ELSE text END AS text FROM _all)"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(spark, sf_dir).withColumn("text", F.when((F.col("doc_id") + F.col("page_idx")) % 3 == 0, "आदेश").otherwise(F.col("text")))


@query(f"WITH {_MIXED}, {_SCRIPTS} SELECT * FROM scripts")
def page_scripts(spark, sf_dir):
    return regions.page_scripts(_mixed(spark, sf_dir))


@query(f"WITH {_MIXED}, {_SCRIPTS} SELECT doc_id, CASE WHEN count(DISTINCT script) = 1 THEN min(script) ELSE 'mixed' END AS language, count(*) AS n_pages FROM scripts GROUP BY doc_id")
def document_scripts(spark, sf_dir):
    return regions.document_scripts(regions.page_scripts(_mixed(spark, sf_dir)))


@query(f"""WITH {_MIXED}, {_SCRIPTS}, h AS (SELECT doc_id, page_idx, max(CASE WHEN (CASE WHEN script = 'Devanagari' THEN contains(lower(text), 'आदेश') ELSE contains(lower(text), 'er') OR contains(lower(text), 'on') END) AND xmin > 350 AND xmax < 650 AND ymin > 50 AND ymax < 350 THEN 1 ELSE 0 END) AS o,
 max(CASE WHEN (CASE WHEN script = 'Devanagari' THEN contains(lower(text), 'आ') ELSE contains(lower(text), 'a') END) AND xmin > 0 AND xmax < 400 AND ymin > 0 AND ymax < 1000 THEN 1 ELSE 0 END) AS c FROM words JOIN scripts USING (doc_id, page_idx) GROUP BY ALL)
SELECT doc_id, CAST(sum(o) AS BIGINT) AS order_pages, CAST(sum(c) AS BIGINT) AS copy_pages, sum(o) > 1 AND sum(c) > 1 AS multi FROM h GROUP BY doc_id""")
def multi_order(spark, sf_dir):
    """Pages with order words and copy words in their zones, by the page's script; with terms that these texts have."""
    w = _mixed(spark, sf_dir)
    return regions.multi_order(w, regions.page_scripts(w), {"Devanagari": (("आदेश",), ("आ",)), "": (("er", "on"), ("a",))})


@query(f"WITH {WORDS} SELECT doc_id, bool_and(NOT (doc_id % 4 = 0 AND page_idx = 0)) AS is_text FROM (SELECT DISTINCT doc_id, page_idx FROM words) GROUP BY doc_id")
def all_text_documents(spark, sf_dir):
    pages = words_of(spark, sf_dir).select("doc_id", "page_idx").distinct()
    return regions.all_text(pages.withColumn("num_images", F.when((F.col("doc_id") % 4 == 0) & (F.col("page_idx") == 0), 1)))


@query(f"""WITH {WORDS}, a AS (SELECT doc_id, page_idx, (degrees(atan((doc_id % 9) / (xmax - xmin)::DOUBLE)) + degrees(atan((word_idx % 5) / (xmax - xmin)::DOUBLE))) / 2 AS a FROM words WHERE length(text) >= 5 AND xmax > xmin)
SELECT doc_id, page_idx, round(avg(a), 6) AS angle, CASE WHEN abs(avg(a)) >= 0.25 THEN round(-avg(a), 6) ELSE 0 END AS turn FROM a GROUP BY ALL""")
def word_angles(spark, sf_dir):
    w = words_of(spark, sf_dir).where("xmax > xmin")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, x1, y = F.col("xmin"), F.col("xmax"), F.col("ymin")
    w = w.withColumn("coords", F.array(p(x0, y), p(x1, y + F.col("doc_id") % 9), p(x1, F.col("ymax") + F.col("word_idx") % 5), p(x0, F.col("ymax"))))
    return regions.deskew(regions.word_box_angle(w)).select("doc_id", "page_idx", F.round("angle", 6).alias("angle"), F.round("turn", 6).alias("turn"))


@query(f"""WITH {LINES}, l AS (SELECT doc_id, page_idx, line_idx, min(ymin) AS top FROM lined GROUP BY ALL), h AS (SELECT *, lead(top) OVER (PARTITION BY doc_id, page_idx ORDER BY line_idx) - top AS height FROM l)
SELECT *, round(avg(height) OVER (PARTITION BY doc_id, page_idx), 6) AS mean_height FROM h""")
def line_heights(spark, sf_dir):
    tops = lines_of(spark, sf_dir).groupBy("doc_id", "page_idx", "line_idx").agg(F.min("ymin").alias("top"))
    return regions.row_heights(tops, ("doc_id", "page_idx"), "line_idx", "top").withColumn("mean_height", F.round("mean_height", 6))


_CELLS = "cells AS (SELECT doc_id, page_idx, table_idx, row_idx, col_idx, string_agg(text, ' ' ORDER BY xmin, word_idx) AS text FROM placed JOIN words USING (doc_id, page_idx, word_idx) WHERE col_idx <> doc_id % 4 OR row_idx = 0 GROUP BY ALL)"
_FILL = """fill AS (SELECT doc_id, page_idx, table_idx, col_idx, count_if(text <> '')::BIGINT AS n_filled, any_value(n_rows) AS n_rows, any_value(n_rows) > 2 AND count_if(text <> '') <= 1 AS is_empty FROM cells JOIN (SELECT doc_id, page_idx, table_idx, count(DISTINCT row_idx) AS n_rows FROM cells GROUP BY ALL) USING (doc_id, page_idx, table_idx) GROUP BY doc_id, page_idx, table_idx, col_idx)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words_of(spark, sf_dir).where("xmax > xmin")
    placed = tables.cells_first_match(w, *table_grids(w), also=("text", "xmin")).where((F.col("col_idx") != F.col("doc_id") % 4) | (F.col("row_idx") == 0))
    # In order, so that the words of a cell are put together as they come.
    return placed.sortWithinPartitions(*tables.TABLE, "row_idx", "col_idx").groupBy(*tables.TABLE, "row_idx", "col_idx").agg(layout.joined(F.struct("xmin", "word_idx")).alias("text"))


@query(f"WITH {WORDS}, {FIRST}, {_CELLS}, {_FILL} SELECT * FROM fill")
def column_fill(spark, sf_dir):
    """Cells of which one column has texts in the first row only."""
    return regions.column_fill(_cells(spark, sf_dir), tables.TABLE)


@query(f"""WITH {WORDS}, {FIRST}, {_CELLS}, {_FILL}, k AS (SELECT *, CAST(col_idx - coalesce(sum(CASE WHEN is_empty THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx, table_idx ORDER BY col_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS new FROM fill)
SELECT c.doc_id, c.page_idx, c.table_idx, c.row_idx, new AS col_idx, c.text FROM cells c JOIN k USING (doc_id, page_idx, table_idx, col_idx) WHERE NOT is_empty""")
def empty_columns_deleted(spark, sf_dir):
    return regions.without_empty_columns(_cells(spark, sf_dir), tables.TABLE).select(*tables.TABLE, "row_idx", "col_idx", "text")


@query(f"WITH {WORDS} SELECT doc_id, page_idx, word_idx FROM words WHERE page_idx < 2")
def first_pages(spark, sf_dir):
    return regions.first_pages(words_of(spark, sf_dir), 2).select("doc_id", "page_idx", "word_idx")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, md5(line) AS line FROM l WHERE line_no >= n - 3")
def last_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return regions.last_lines(lines, 3, "line_no").select("doc_id", "line_no", F.md5("line").alias("line"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
s AS (SELECT *, ch || coalesce(lead(ch, 1) OVER w, '') || coalesce(lead(ch, 2) OVER w, '') || coalesce(lead(ch, 3) OVER w, '') || coalesce(lead(ch, 4) OVER w, '') || coalesce(lead(ch, 5) OVER w, '') AS six FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i - 1 AS s, CASE WHEN six = 'in the' THEN i + 5 ELSE i END AS e FROM s WHERE ch IN ('.', ',', ';', chr(39)) OR six = 'in the')
SELECT d.doc_id, count(f.s)::INTEGER AS n, md5(coalesce(string_agg(f.s || '-' || f.e, ' ' ORDER BY f.s, f.e), '')) AS spans FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def punctuation_spans(spark, sf_dir):
    spans = regions.punctuation_spans(F.col("text"))
    told = table(spark, sf_dir, "documents").select("doc_id", spans.alias("s"))
    return told.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), " ")).alias("spans"))


@query("""WITH p AS (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN text || ' The Prime Minister' WHEN 1 THEN 'the P.M. ' || text WHEN 2 THEN text || ' of prime minister of' ELSE text END) AS t FROM documents),
q AS (SELECT doc_id, CASE WHEN contains(t, 'the prime minister') THEN 'the prime minister' WHEN contains(t, 'prime minister') THEN 'prime minister' WHEN contains(t, 'p.m.') THEN 'p.m.' END AS w, t FROM p)
SELECT doc_id, instr(t, w)::INTEGER - 1 AS start, (instr(t, w) - 1 + length(w))::INTEGER AS "end" FROM q""")
def office_spans(spark, sf_dir):
    k, t = F.col("doc_id") % 4, F.col("text")
    made = F.when(k == 0, F.concat(t, F.lit(" The Prime Minister"))).when(k == 1, F.concat(F.lit("the P.M. "), t)).when(k == 2, F.concat(t, F.lit(" of prime minister of"))).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", regions.office_span(made).alias("s")).select("doc_id", "s.start", "s.end")


@query("""WITH d AS (SELECT doc_id, text, CAST(doc_id % 60 AS INTEGER) AS s, CAST(least(length(text), doc_id % 60 + 7) AS INTEGER) AS e FROM documents WHERE text <> ''), a AS (SELECT *, trim(regexp_replace(substring(text, e + 1, 1), '[!-/:-@\\[-`{-~]', ''), ' ') AS c, instr(substring(text, e + 1), ' ') AS b FROM d)
SELECT doc_id, CASE WHEN s < 25 THEN 0 ELSE s END AS start, CAST(CASE WHEN c = '' THEN e WHEN b > 0 THEN e + b - 1 ELSE length(text) END AS INTEGER) AS "end" FROM a""")
def spans_to_blanks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text <> ''").withColumn("s", (F.col("doc_id") % 60).cast("int")).withColumn("e", F.least(F.length("text"), (F.col("doc_id") % 60 + 7).cast("int")))
    return d.select("doc_id", regions.to_blank(F.col("text"), F.col("s"), F.col("e")).alias("x")).select("doc_id", "x.start", "x.end")


@query(f"""WITH {WORDS}, g AS (SELECT doc_id, page_idx, word_idx, text, string_split(text, '') AS cids, [CASE WHEN word_idx % 5 = 4 AND i = 1 THEN 'second' WHEN word_idx % 3 = 0 THEN 'gone' ELSE 'kept' END for i in range(length(text))] AS fonts, word_idx % 7 = 1 AS spaced, word_idx % 7 = 2 AS edited FROM words),
a AS (SELECT *, len(list_distinct(fonts)) = 1 AND fonts[1] = 'gone' AS gone FROM g),
b AS (SELECT doc_id, page_idx, word_idx, fonts, CASE WHEN gone THEN CASE WHEN edited THEN repeat(' ', 2) ELSE repeat(' ', length(text)) END WHEN spaced THEN repeat(' ', length(text)) WHEN edited THEN 'xy' WHEN len(list_distinct(fonts)) = 1 AND fonts[1] = 'kept' AND text = 'in' THEN 'IN!' ELSE text END AS t FROM a)
SELECT doc_id, page_idx, word_idx, t AS text FROM b""")
def edited_glyph_words(spark, sf_dir):
    """Words whose letters are glyphs, of one font or two, after corrections of four kinds."""
    letters = F.filter(F.split("text", ""), lambda c: c != "")
    font = F.when(F.col("word_idx") % 3 == 0, "gone").otherwise("kept")
    w = words_of(spark, sf_dir).select("doc_id", "page_idx", "word_idx", "text", letters.alias("cids"), F.col("word_idx").alias("k"))
    w = w.withColumn("fonts", F.transform("cids", lambda c, i: F.when((F.col("k") % 5 == 4) & (i == 1), "second").otherwise(font))).drop("k", "text")
    key = ["doc_id", "page_idx", "word_idx"]
    font_edits = spark.createDataFrame([("kept", ["i", "n"], "IN!")], "font string, cids array<string>, text string")
    out = regions.edit_font_words(w, ("gone",), w.where("word_idx % 7 = 1").select(*key), w.where("word_idx % 7 = 2").select(*key, F.lit("xy").alias("text")), font_edits)
    return out.select(*key, F.array_join("cids", "").alias("text"))


@query(f"""WITH {WORDS} SELECT doc_id, page_idx, word_idx, regexp_replace(replace(text, 'th', chr(1)), chr(1), 'ht', 'g') AS text FROM words""")
def swapped_glyphs(spark, sf_dir):
    letters = F.filter(F.split("text", ""), lambda c: c != "")
    w = words_of(spark, sf_dir).select("doc_id", "page_idx", "word_idx", letters.alias("cids"), F.transform(letters, lambda c: F.lit("f")).alias("fonts"))
    swaps = spark.createDataFrame([("f", "t", "h")], "font string, cid1 string, cid2 string")
    return regions.edit_font_words(w, swaps=swaps).select("doc_id", "page_idx", "word_idx", F.array_join("cids", "").alias("text"))


@query(f"""WITH {WORDS}, e AS (SELECT doc_id, page_idx, CAST(k AS INTEGER) AS edge_idx, 0.1 * k::DOUBLE AS x1, 0.05::DOUBLE AS y1, 0.1 * k::DOUBLE AS x2, 0.95::DOUBLE AS y2 FROM (SELECT DISTINCT doc_id, page_idx FROM words), range(5) t(k))
SELECT doc_id, page_idx, edge_idx, round(x1 + CASE WHEN page_idx = 0 AND edge_idx = doc_id % 5 AND doc_id % 2 = 1 THEN 0.005 ELSE 0 END, 6) AS x1, round(y1 - CASE WHEN page_idx = 0 AND edge_idx <= 2 THEN (doc_id % 7) / 1000 ELSE 0 END, 6) AS y1,
 round(x2 + CASE WHEN page_idx = 0 AND edge_idx = doc_id % 5 AND doc_id % 2 = 0 THEN 0.005 ELSE 0 END, 6) AS x2, round(y2, 6) AS y2 FROM e""")
def edge_edits(spark, sf_dir):
    pages = words_of(spark, sf_dir).select("doc_id", "page_idx").distinct()
    x = 0.1 * F.col("edge_idx").cast("double")
    edges = pages.withColumn("edge_idx", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("x1", x).withColumn("y1", F.lit(0.05)).withColumn("x2", x).withColumn("y2", F.lit(0.95))
    d = pages.where("page_idx = 0").select("doc_id")
    end = F.concat(F.lit("coord"), (2 - F.col("doc_id") % 2).cast("string"))
    one = d.select("doc_id", F.lit(0).alias("seq"), F.lit("moveEdge").alias("cmd"), F.array(F.concat(F.lit("pa0.ed"), (F.col("doc_id") % 5).cast("string")), end, F.lit("right")).alias("args"))
    more = d.select("doc_id", F.lit(1).alias("seq"), F.lit("moveEdges").alias("cmd"), F.array(F.lit("pa0.ed0:2"), F.lit("coord1"), F.lit("up"), (F.col("doc_id") % 7).cast("string")).alias("args"))
    return records.edited_edges(edges, one.unionByName(more)).select("doc_id", "page_idx", "edge_idx", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"""WITH {WORDS} SELECT doc_id, page_idx, 'r' || doc_id % 2 AS region, CASE WHEN doc_id % 2 = 0 THEN [0, doc_id % 9, doc_id % 4, 2, 7]::INTEGER[] ELSE [0]::INTEGER[] END AS word_idxs FROM words WHERE page_idx = 0 GROUP BY ALL""")
def region_edits(spark, sf_dir):
    pages = words_of(spark, sf_dir).where("page_idx = 0").select("doc_id", "page_idx").distinct()
    own = pages.withColumn("region", F.concat(F.lit("r"), (F.col("doc_id") % 2).cast("string"))).withColumn("word_idxs", F.array(F.lit(0)))
    wo = lambda n: F.concat(F.lit("pa0.wo"), (F.col("doc_id") % n).cast("string"))
    words_ = pages.select("doc_id", F.lit(0).alias("seq"), F.lit("addWords").alias("cmd"), F.array(F.lit("r0"), wo(9), wo(4)).alias("args"))
    idxs = pages.select("doc_id", F.lit(1).alias("seq"), F.lit("addWordIdxs").alias("cmd"), F.array(F.lit("r0"), F.lit("2"), F.lit("7")).alias("args"))
    return records.edited_regions(own, words_.unionByName(idxs))


# ---- geometry and texts that had no query of their own


@query(f"""WITH {WORDS} SELECT doc_id, page_idx, word_idx, xmin / 1000.0 * 612 AS ix, ymin / 1000.0 * 792 AS iy, round(xmin / 1000.0 * 612 / 612, 6) AS bx, least(xmin, xmax, xmin + word_idx % 7) AS px0, greatest(xmax, xmin + word_idx % 7) AS px1, least(ymin - word_idx % 3, ymin) AS py0, ymax AS py1 FROM words""")
def coordinates(spark, sf_dir):
    w = words_of(spark, sf_dir)
    x, y = G.doc_to_image(F.col("xmin") / 1000, F.col("ymin") / 1000, F.lit(612), F.lit(792))
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    polygon = F.array(p(F.col("xmin"), F.col("ymin")), p(F.col("xmax"), F.col("ymin") - F.col("word_idx") % 3), p(F.col("xmax"), F.col("ymax")), p(F.col("xmin") + F.col("word_idx") % 7, F.col("ymax")))
    b = G.polygon_box(polygon)
    return w.select("doc_id", "page_idx", "word_idx", x.alias("ix"), y.alias("iy"), F.round(G.image_to_doc(x, y, F.lit(612), F.lit(792))[0], 6).alias("bx"), b["xmin"].alias("px0"), b["xmax"].alias("px1"), b["ymin"].alias("py0"), b["ymax"].alias("py1"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '(' || replace(p_brand, '#', '') || '-cid:' || p_size || ') x (ab-cid:7)' ELSE 'none' END AS t, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN p_size % 3 = 0 THEN p_size END AS first_cid, (2300 + p_size * 2) BETWEEN 2325 AND 2361 OR (2300 + p_size * 2) BETWEEN 2309 AND 2314 AS consonant FROM part""")
def missing_glyphs(spark, sf_dir):
    t = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("("), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit("-cid:"), F.col("p_size").cast("string"), F.lit(") x (ab-cid:7)"))).otherwise("none")
    m = glyphs.missing(t)
    ch = F.decode(F.unhex(F.lpad(F.hex(2300 + F.col("p_size") * 2), 4, "0")), "UTF-16BE")
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t"), F.size(m).alias("n"), F.get(m, F.lit(0))["cid"].alias("first_cid"), glyphs.is_consonant(ch).alias("consonant"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, ' ([.,;:!?%)\\]])', '\\1', 'g'), '([(\\[]) ', '\\1', 'g'), '([A-Za-z0-9]) ?@ ?([A-Za-z0-9])', '\\1@\\2', 'g')) AS text FROM documents""")
def detokenised_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.detokenised(F.col("text"))).alias("text"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN substr('/data/in/' || CAST(o_orderdate AS VARCHAR), 7) ELSE '/other/' || CAST(o_orderdate AS VARCHAR) END AS path, md5(o_orderkey || chr(31) || coalesce(CAST(o_custkey AS VARCHAR), chr(0))) AS name FROM orders""")
def relative_paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.when(F.startswith(F.col("o_orderpriority"), F.lit("1")), F.concat(F.lit("/data/in/"), F.col("o_orderdate").cast("string"))).otherwise(F.concat(F.lit("/other/"), F.col("o_orderdate").cast("string")))
    return o.select("o_orderkey", regions.relative_path(path, "/data/").alias("path"), regions.unique_name(F.col("o_orderkey"), F.col("o_custkey")).alias("name"))


@query(f"""WITH {WORDS}, r AS (SELECT doc_id, page_idx, seq, CASE WHEN seq % 6 = 0 THEN '' WHEN seq % 6 = 1 THEN ' ' ELSE text END AS text, (xmin / 1000.0)::DOUBLE AS xmin, (CASE WHEN seq % 12 = 1 THEN xmin + 300 ELSE xmax END / 1000.0)::DOUBLE AS xmax FROM (SELECT *, word_idx AS seq FROM words)),
k AS (SELECT * FROM r WHERE length(text) > 0 AND (trim(text, ' ') <> '' OR xmax - xmin <= 0.2)) SELECT doc_id, page_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY seq) - 1 AS INTEGER) AS word_idx, text FROM k""")
def recogniser_rows(spark, sf_dir):
    s = F.col("seq")
    w = words_of(spark, sf_dir).withColumnRenamed("word_idx", "seq").withColumn("text", F.when(s % 6 == 0, "").when(s % 6 == 1, " ").otherwise(F.col("text")))
    w = w.withColumn("xmax", F.when(s % 12 == 1, F.col("xmin") + 300).otherwise(F.col("xmax")) / 1000).withColumn("xmin", F.col("xmin") / 1000)
    return documents.filtered_rows(w).select("doc_id", "page_idx", "word_idx", "text")


# ---- PDF files


def _pdfs(w: DataFrame) -> DataFrame:
    """Documents as PDF files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, words = batch.column(1).offsets.to_pylist(), batch.column(1).values
            numbers, texts, lefts, tops = (words.field(c).to_pylist() for c in ("page_idx", "text", "xmin", "ymin"))
            files = []
            for start, end in zip(ends, ends[1:]):
                pages: list[list] = [[] for _ in range(numbers[end - 1] + 1)]
                for k in range(start, end):
                    pages[numbers[k]].append((texts[k], lefts[k] * 0.612, tops[k] * 0.792))
                files.append(pdf.written([(612, 792, p) for p in pages], 12.24, [(30.6, 39.6, 581.4, 39.6)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["path", "content"])

    word = F.struct("page_idx", "word_idx", "text", "xmin", "ymin")
    each = w.groupBy("doc_id").agg(F.array_sort(F.collect_list(word)).alias("words"))
    return each.select(F.col("doc_id").cast("string").alias("path"), "words").mapInArrow(run, "path string, content binary")


@query(f"WITH {WORDS} SELECT doc_id, page_idx, word_idx, text, 'Courier' AS font, xmin, ymin FROM words")
def pdf_words(spark, sf_dir):
    """All documents written as PDF files, and their words scanned."""
    found = pdf.parsed(_pdfs(words_of(spark, sf_dir)))
    return found.select(F.col("path").cast("bigint").alias("doc_id"), "page_idx", "word_idx", "text", "font", F.round(F.col("xmin") * 1000).cast("int").alias("xmin"), F.round(F.col("ymin") * 1000).cast("int").alias("ymin"))


@query(f"WITH {WORDS} SELECT doc_id, page_idx, sum(length(text))::BIGINT AS n_chars, min(xmin) AS xmin, min(ymin) AS ymin, md5(string_agg(text, '' ORDER BY word_idx)) AS text FROM words GROUP BY ALL")
def pdf_chars(spark, sf_dir):
    found = pdf.chars_by_page(_pdfs(words_of(spark, sf_dir)))
    low = lambda c: F.round(F.array_min(c) * 1000).cast("int").alias(c)
    return found.select(F.col("path").cast("bigint").alias("doc_id"), "page_idx", F.size("text").cast("bigint").alias("n_chars"), low("xmin"), low("ymin"), F.md5(F.array_join("text", "")).alias("text"))


@query(f"""WITH {WORDS}, n AS (SELECT doc_id, page_idx, count(*)::INTEGER AS num_words FROM words GROUP BY ALL), p AS (SELECT doc_id, CAST(unnest(range(max(page_idx) + 1)) AS INTEGER) AS page_idx FROM words GROUP BY doc_id)
SELECT doc_id, page_idx, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 0 AS rotation, coalesce(num_words, 0) AS num_words, 0 AS num_images, CAST(NULL AS VARCHAR) AS error FROM p LEFT JOIN n USING (doc_id, page_idx)""")
def pdf_pages(spark, sf_dir):
    return pdf.parsed(_pdfs(words_of(spark, sf_dir)), "pages").withColumn("doc_id", F.col("path").cast("bigint")).drop("path")


@query(f"WITH {WORDS} SELECT doc_id, page_idx, 0 AS line_idx, 0.05::DOUBLE AS x1, 0.05::DOUBLE AS y1, 0.95::DOUBLE AS x2, 0.05::DOUBLE AS y2 FROM (SELECT doc_id, CAST(unnest(range(max(page_idx) + 1)) AS INTEGER) AS page_idx FROM words GROUP BY doc_id)")
def pdf_lines(spark, sf_dir):
    found = pdf.parsed(_pdfs(words_of(spark, sf_dir)), "lines").withColumn("doc_id", F.col("path").cast("bigint"))
    return found.select("doc_id", "page_idx", "line_idx", *[F.round(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")])


# ---- recognition of pages that differ


_LOWER = "CASE WHEN word_idx % 5 = 0 THEN ymin + 4 ELSE ymax END"


def _responses(w: DataFrame) -> DataFrame:
    """Pages as the response of a recogniser: a block a page, a paragraph a line, in thousandths as parts of 1."""
    p = lambda x, y: F.struct((F.col(x) / 1000).alias("x"), (F.col(y) / 1000).alias("y"))
    symbols = F.transform(X.characters(F.col("text")), lambda c, i: F.struct(c.alias("text"), F.when(i + 1 == F.length("text"), F.struct(F.struct(F.when(F.col("word_idx") % 2 == 0, "SPACE").otherwise("LINE_BREAK").alias("type")).alias("detectedBreak"))).alias("property")))
    word = F.struct("pos", "start", F.struct(F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "low"), p("xmin", "low")).alias("normalizedVertices")).alias("boundingBox"), symbols.alias("symbols"))
    lines = w.withColumn("low", F.when(F.col("word_idx") % 5 == 0, F.col("ymin") + 4).otherwise(F.col("ymax"))).sortWithinPartitions("doc_id", "page_idx", "line_no").groupBy("doc_id", "page_idx", "line_no").agg(F.array_sort(F.collect_list(word)).alias("words"))
    pages = lines.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(F.struct("line_no", "words"))).alias("paragraphs"))
    page = F.struct(F.lit(612).alias("width"), F.lit(792).alias("height"), F.array(F.struct("paragraphs")).alias("blocks"))
    return pages.select("doc_id", "page_idx", F.to_json(F.struct(F.array(F.struct(F.struct(F.array(page).alias("pages")).alias("fullTextAnnotation"))).alias("responses"))).alias("json"))


@query(f"""WITH {WORDS}, d AS (SELECT doc_id, page_idx, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_idx) - 1 AS p, word_idx, text, xmin, ymin, xmax, {_LOWER} AS low FROM words)
SELECT doc_id, CAST(p AS INTEGER) AS page_idx, word_idx, text, CASE WHEN word_idx % 2 = 0 THEN 1 ELSE 5 END AS break_type, round(xmin / 1000.0, 6)::DOUBLE AS xmin, round(low / 1000.0, 6)::DOUBLE AS ymax FROM d""")
def recognised_pages(spark, sf_dir):
    """Each page a part of its document's response."""
    found = documents.recognised_words(_responses(words_of(spark, sf_dir)), order="page_idx")
    return found.select("doc_id", F.col("page_idx").cast("int").alias("page_idx"), F.col("word_idx").cast("int").alias("word_idx"), "text", "break_type", F.round("xmin", 6).alias("xmin"), F.round("ymax", 6).alias("ymax"))


@query(f"""WITH {WORDS}, d AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_idx) - 1 AS p, word_idx, text, {_LOWER} - ymin AS h FROM words), m AS (SELECT *, avg(h) OVER (PARTITION BY doc_id, p) AS mean FROM d)
SELECT doc_id, CAST(p AS INTEGER) AS page_idx, CAST(row_number() OVER (PARTITION BY doc_id, p ORDER BY word_idx) - 1 AS INTEGER) AS word_idx, text FROM m WHERE h >= 0.4 * mean""")
def recognised_tall_words(spark, sf_dir):
    """As recognised_pages, without words that are low for their page."""
    found = documents.recognised_words(_responses(words_of(spark, sf_dir)), order="page_idx", least_height=0.4)
    return found.select("doc_id", F.col("page_idx").cast("int").alias("page_idx"), F.col("word_idx").cast("int").alias("word_idx"), "text")


# ---- before and after models


@query("""WITH p AS (SELECT l_orderkey AS doc_id, CAST(0 AS INTEGER) AS page_idx, l_quantity / 50 AS score, l_linenumber AS x0, l_suppkey % 90 AS y0, l_linenumber + 5 AS x1, l_suppkey % 90 + 5 AS y1 FROM lineitem)
SELECT doc_id, page_idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, y1, x1) - 1 AS INTEGER) AS box_idx, x0, y0, x1, y1 FROM p WHERE score > 0.6""")
def detected_boxes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    top = F.col("l_suppkey") % 90
    p = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_idx"), (F.col("l_quantity") / 50).alias("score"), F.lit("table").alias("label"), F.col("l_linenumber").alias("x0"), top.alias("y0"), (F.col("l_linenumber") + 5).alias("x1"), (top + 5).alias("y1"))
    return models.detected(p, 0.6, "table")


_PREDICTED = """p AS (SELECT l_orderkey AS doc_id, 0 AS page_idx, l_suppkey % 2 AS table_idx, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS orientation, unnest([l_partkey % 97, l_partkey % 97 + 8]) AS v, l_quantity AS q FROM lineitem),
g AS (SELECT *, CASE WHEN v - lag(v) OVER (PARTITION BY doc_id, table_idx, orientation ORDER BY v) >= 5 THEN 1 ELSE 0 END AS new FROM p WHERE q > 20),
l AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, table_idx, orientation ORDER BY v RANGE UNBOUNDED PRECEDING) AS line FROM g), m AS (SELECT doc_id, page_idx, table_idx, orientation, line, avg(v) AS v FROM l GROUP BY ALL),
edges AS (SELECT doc_id, page_idx, table_idx, orientation, list(round(v, 6) ORDER BY v) AS positions FROM m GROUP BY ALL)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, at, row = table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 97, F.col("l_linenumber") % 2 == 0
    box = [F.when(~row, at).alias("x0"), F.when(row, at).alias("y0"), F.when(~row, at + 8).alias("x1"), F.when(row, at + 8).alias("y1")]
    p = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_idx"), (F.col("l_suppkey") % 2).alias("table_idx"), F.col("l_quantity").alias("score"), F.when(row, "row").otherwise("column").alias("label"), *box)
    return models.table_edges(p, 20).withColumn("positions", F.transform("positions", lambda v: F.round(v, 6)))


@query(f"WITH {_PREDICTED} SELECT * FROM edges")
def detected_table_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"WITH {_PREDICTED} SELECT doc_id, page_idx, table_idx, CAST(len(positions) - 1 AS INTEGER) AS columns, CAST(1 + doc_id % 2 AS INTEGER) AS expected FROM edges WHERE orientation = 'v' AND len(positions) - 1 <> 1 + doc_id % 2")
def table_column_errors(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (1 + F.col("o_orderkey") % 2).cast("int").alias("expected"))
    return models.column_errors(_edges(spark, sf_dir), expected)


@query(f"""WITH {WORDS}, t AS (SELECT *, CASE WHEN length(text) % 4 = 0 THEN NULL WHEN length(text) % 4 = 1 THEN 'NAME' ELSE 'POST' END AS label FROM words) SELECT doc_id, page_idx, label, list(word_idx ORDER BY word_idx) AS word_idxs, string_agg(text, ' ' ORDER BY word_idx) AS text FROM t WHERE label IS NOT NULL GROUP BY ALL""")
def word_labels(spark, sf_dir):
    """Tags of words in two parts each, of which the second is always O."""
    w, n = words_of(spark, sf_dir), F.length("text") % 4
    tag = F.when(n == 0, "O").when(n == 1, "B-NAME").otherwise("I-POST")
    tags = w.withColumn("t", F.explode(F.array(F.struct(F.lit(0).alias("part"), tag.alias("tag")), F.struct(F.lit(1).alias("part"), F.lit("O").alias("tag"))))).select("doc_id", "page_idx", "word_idx", "t.part", "t.tag")
    return models.word_labels(tags, w)


@query(f"""WITH {WORDS}, c AS (SELECT doc_id, page_idx, word_idx, word_idx // 50 AS c FROM words), n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_idx, c) - 1 AS k FROM c) SELECT doc_id, page_idx, word_idx, CAST(k AS INTEGER) AS chunk_idx, CAST(k // 10 AS INTEGER) AS batch_idx FROM n""")
def model_batches(spark, sf_dir):
    return models.batches(words_of(spark, sf_dir).select("doc_id", "page_idx", "word_idx"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'UnequalLengths' ELSE 'BadBox' END AS error FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_custkey % 3 = 0""")
def training_errors(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    box = F.when(k % 7 == 0, F.array(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0), F.lit(0), F.when(F.col("o_custkey") % 3 == 0, 1001).otherwise(1000), F.lit(9)))
    return models.training_errors(o.select(k.alias("id"), F.array(F.lit("a"), F.lit("b")).alias("words"), F.array(box, F.array(*[F.lit(1)] * 4)).alias("boxes"), F.when(k % 5 == 0, F.array(F.lit("O"))).otherwise(F.array(F.lit("O"), F.lit("O"))).alias("labels")))


@query(f"""WITH {WORDS}, s AS (SELECT *, 300 + doc_id % 900 AS w, 400 + doc_id % 700 AS h FROM words), r AS (SELECT *, least(1.0::DOUBLE, 800.0::DOUBLE / greatest(w, h)) AS r FROM s)
SELECT doc_id, page_idx, word_idx, CAST(trunc(xmin / 1000.0::DOUBLE * w) AS INTEGER) AS "left", CAST(trunc(ymax / 1000.0::DOUBLE * h) AS INTEGER) AS bottom, CAST(trunc(w * r) AS INTEGER) AS width, CAST(trunc(h * r) AS INTEGER) AS height FROM r""")
def image_crops(spark, sf_dir):
    w = words_of(spark, sf_dir).withColumn("w", 300 + F.col("doc_id") % 900).withColumn("h", 400 + F.col("doc_id") % 700)
    box = models.crop_pixels(*[F.col(c) / 1000 for c in ("xmin", "ymin", "xmax", "ymax")], F.col("w"), F.col("h"))
    small = models.resized(F.col("w"), F.col("h"), 800)
    return w.select("doc_id", "page_idx", "word_idx", box.alias("c"), small.alias("s")).select("doc_id", "page_idx", "word_idx", "c.left", "c.bottom", "s.width", "s.height")


@query("""SELECT o_orderkey, 'out/' || CASE WHEN o_orderkey % 2 = 0 THEN 'pages/' ELSE '' END || o_orderkey AS path, 'out/pages/' || o_orderkey AS added, 'out/' || o_orderkey AS removed FROM orders""")
def image_paths(spark, sf_dir):
    path = F.concat(F.lit("out/"), F.when(F.col("o_orderkey") % 2 == 0, "pages/").otherwise(""), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), models.image_path(path, "out", "pages").alias("added"), models.image_path(path, "out", "pages", False).alias("removed"))


# ---- turns, texts and paths that vary by row


@query(f"""WITH {WORDS}, a AS (SELECT *, (doc_id % 4) * 90.0::DOUBLE + doc_id % 7 AS deg FROM words), f AS (SELECT *, xmin - 20.0::DOUBLE - 490 AS dx, ymin - 10.0::DOUBLE - 495 AS dy FROM a)
SELECT doc_id, page_idx, word_idx, round(cos(radians(deg)) * dx + sin(radians(deg)) * dy + 500, 5) AS fx, round(-sin(radians(deg)) * dx + cos(radians(deg)) * dy + 510, 5) AS fy, xmin::DOUBLE AS bx, ymin::DOUBLE AS by_ FROM f""")
def turned_chain(spark, sf_dir):
    """A crop and a turn by the document's angle, and the way back."""
    kind = "array<struct<op:string,dx:double,dy:double,angle:double,w:double,h:double,w2:double,h2:double>>"
    number = lambda v: F.lit(float(v))
    turn = F.struct(F.lit("rotate"), number(0), number(0), (F.col("doc_id") % 4 * 90 + F.col("doc_id") % 7).cast("double"), number(980), number(990), number(1000), number(1020))
    w = words_of(spark, sf_dir).withColumn("chain", F.array(F.struct(F.lit("crop"), number(20), number(10), *[number(0)] * 5), turn).cast(kind))
    w = w.withColumn("f", G.transformed(F.col("xmin"), F.col("ymin"), F.col("chain"))).withColumn("b", G.transformed(F.col("f.x"), F.col("f.y"), F.col("chain"), True))
    return w.select("doc_id", "page_idx", "word_idx", F.round("f.x", 5).alias("fx"), F.round("f.y", 5).alias("fy"), F.round("b.x", 5).alias("bx"), F.round("b.y", 5).alias("by_"))


@query(f"""WITH {WORDS}, a AS (SELECT *, doc_id % 4 * 90 AS g, xmin / 1000.0::DOUBLE AS x, ymin / 1000.0::DOUBLE AS y FROM words)
SELECT doc_id, page_idx, word_idx, round(greatest(0, least(1, CASE g WHEN 90 THEN y WHEN 180 THEN 1 - x WHEN 270 THEN 1 - y ELSE x END)), 6) AS nx, round(greatest(0, least(1, CASE g WHEN 90 THEN 1 - x WHEN 180 THEN 1 - y WHEN 270 THEN x ELSE y END)), 6) AS ny,
 CASE WHEN word_idx % 2 = 0 THEN round(y + 0.001, 6) ELSE round(x - 0.001, 6) END AS pulled FROM a""")
def reoriented_words(spark, sf_dir):
    w = words_of(spark, sf_dir).withColumn("x", F.col("xmin") / 1000).withColumn("y", F.col("ymin") / 1000)
    nx, ny = G.reoriented(F.col("x"), F.col("y"), F.col("doc_id") % 4 * 90)
    other = {"xmin": F.col("x"), "xmax": F.col("y")}
    pulled = F.when(F.col("word_idx") % 2 == 0, G.reduced_width(G.box(), other, "left")).otherwise(G.reduced_width(G.box(), other, "right"))
    return w.select("doc_id", "page_idx", "word_idx", F.round(nx, 6).alias("nx"), F.round(ny, 6).alias("ny"), F.round(pulled, 6).alias("pulled"))


@query("""SELECT doc_id, md5(translate(CAST(doc_id AS VARCHAR), '0123456789', '०१२३४५६७८९')) AS number, regexp_full_match(CAST(doc_id % 100 AS VARCHAR), '[0-9]+') AND doc_id % 2 = 0 AS is_number,
 'dir' || doc_id % 3 AS cadre, CASE doc_id % 3 WHEN 0 THEN 'Home' WHEN 1 THEN 'Law' END AS department FROM documents""")
def number_and_path_parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    nagari = F.translate(F.col("doc_id").cast("string"), "0123456789", "०१२३४५६७८९")
    path = F.concat(F.lit("/in/dir"), (F.col("doc_id") % 3).cast("string"), F.lit("/file.pdf"))
    part = X.path_part(path, -2)
    text = F.when(F.col("doc_id") % 2 == 0, nagari).otherwise(F.concat(nagari, F.lit("x")))
    return d.select("doc_id", F.md5(nagari).alias("number"), X.is_devanagari_number(text).alias("is_number"), part.alias("cadre"), X.literal_map({"dir0": "Home", "dir1": "Law"})[part].alias("department"))


@query(r"""SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN 'a' || repeat(' ', 13 + length(CAST(doc_id AS VARCHAR))) || 'b (short) ' || repeat(' ', 13) WHEN 1 THEN 'no brackets' ELSE '(keep no)' || repeat(' ', 11) END) AS text FROM documents""")
def brackets_blanked(spark, sf_dir):
    number = F.col("doc_id").cast("string")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a(a long part"), number, F.lit(")b (short) (another one)"))).when(F.col("doc_id") % 3 == 1, F.lit("no brackets")).otherwise(F.lit("(keep no)(something)"))
    blank = X.brackets_blanked(text, 8)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(blank).alias("text"))


# ---- pictures and word-processor files


@query(f"""WITH {WORDS}, {GRIDS}, i AS (SELECT doc_id, page_idx, 'marker' AS kind, word_idx AS idx, xmin AS x0, ymin AS y0, xmax AS x1, ymax AS y1, text AS label FROM words WHERE regexp_matches(text, '^[0-9]+[.]$')
 UNION ALL SELECT doc_id, page_idx, 'edge', table_idx * 10 + row_idx, 0, y0, 1000, y0, NULL FROM trows UNION ALL SELECT doc_id, page_idx, 'table', table_idx, 20, min(y0), 980, max(y1), 'table <' || table_idx || '>' FROM trows GROUP BY doc_id, page_idx, table_idx),
e AS (SELECT *, CASE WHEN kind = 'edge' THEN '<line class="edge" stroke="red" x1="' || x0 || '" y1="' || y0 || '" x2="' || x1 || '" y2="' || y1 || '"' ELSE '<rect class="' || kind || '" fill="none" stroke="' || CASE kind WHEN 'marker' THEN 'blue' ELSE 'green' END || '" x="' || x0 || '" y="' || y0 || '" width="' || (x1 - x0) || '" height="' || (y1 - y0) || '"' END
 || CASE WHEN label IS NULL THEN '/>' ELSE '><title>' || replace(replace(label, '<', '&lt;'), '>', '&gt;') || '</title></rect>' END AS s FROM i),
p AS (SELECT doc_id, page_idx, '<svg viewBox="0 0 1000 1000">' || chr(10) || string_agg(s, chr(10) ORDER BY kind, idx) || chr(10) || '</svg>' AS svg FROM e GROUP BY ALL)
SELECT doc_id, md5('<!DOCTYPE html>' || chr(10) || '<html><body>' || chr(10) || string_agg('<div class="page" id="pa' || page_idx || '"><img src="page' || page_idx || '.png"/>' || svg || '</div>', chr(10) ORDER BY page_idx) || chr(10) || '</body></html>') AS html FROM p GROUP BY doc_id""")
def overlay_html(spark, sf_dir):
    """Numbers as markers, tables and their lines, over each page's image."""
    w = words_of(spark, sf_dir)
    rows, _ = table_grids(w)
    named = lambda df, kind, idx, x0, y0, x1, y1, label: df.select("doc_id", "page_idx", F.lit(kind).alias("kind"), idx.cast("int").alias("idx"), *[c.cast("int").alias(n) for n, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))], label.alias("label"))
    marks = named(w.where(F.col("text").rlike("^[0-9]+[.]$")), "marker", F.col("word_idx"), *[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.col("text"))
    edges = named(rows, "edge", F.col("table_idx") * 10 + F.col("row_idx"), F.lit(0), F.col("y0"), F.lit(1000), F.col("y0"), F.lit(None).cast("string"))
    whole = rows.groupBy("doc_id", "page_idx", "table_idx").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    boxes = named(whole, "table", F.col("table_idx"), F.lit(20), F.col("y0"), F.lit(980), F.col("y1"), F.format_string("table <%d>", "table_idx"))
    pages = sinks.overlays(marks.unionByName(edges).unionByName(boxes))
    return sinks.page_html(pages, F.format_string("page%d.png", "page_idx")).select("doc_id", F.md5("html").alias("html"))


@query(f"""WITH {LINES}, l AS (SELECT doc_id, page_idx, line_idx, string_agg(text, ' ' ORDER BY xmin, word_idx) AS text, min(xmin) AS x, count(*) < 3 AS is_heading FROM lined GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, line_idx) - 1 AS INTEGER) AS seq, text, is_heading, x * 12 AS indent FROM l""")
def docx_round_trip(spark, sf_dir):
    """Each line a paragraph, written as word-processor files and read again."""
    ordered = lines_of(spark, sf_dir).sortWithinPartitions("doc_id", "page_idx", "line_idx")
    lines = ordered.groupBy("doc_id", "page_idx", "line_idx").agg(layout.joined(F.struct("xmin", "word_idx")).alias("text"), (F.count("*") < 3).alias("is_heading"), (F.min("xmin") * 12).alias("indent"))
    seq = F.col("page_idx") * 1_000_000 + F.col("line_idx")
    return sinks.docx_paragraphs(sinks.docx_files(lines.select("doc_id", seq.alias("seq"), "text", "is_heading", "indent")))
