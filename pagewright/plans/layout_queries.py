"""Queries over documents set as pages of words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as X
from pagewright.operators import layout, records, tables
from pagewright.session import table
from pagewright.sources import documents, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The layout in SQL, for the oracles.
WORDS = """
_line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
_tok AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS tok, generate_subscripts(string_split(line, ' '), 1) - 1 AS pos FROM _line),
_st AS (SELECT *, CAST(coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id ORDER BY line_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM _tok WHERE tok <> ''),
words AS MATERIALIZED (SELECT doc_id, CAST((s // 80) // 50 AS INTEGER) AS page_idx, CAST(row_number() OVER (PARTITION BY doc_id, (s // 80) // 50 ORDER BY s) - 1 AS INTEGER) AS word_idx, CAST(line_no AS INTEGER) AS line_no,
  CAST(pos AS INTEGER) AS pos, tok AS text, s AS start, CAST(20 + (s % 80) * 12 AS INTEGER) AS xmin, CAST(10 + ((s // 80) % 50) * 19 AS INTEGER) AS ymin,
  CAST(least(1000, 20 + (s % 80) * 12 + length(tok) * 12) AS INTEGER) AS xmax, CAST(22 + ((s // 80) % 50) * 19 AS INTEGER) AS ymax FROM _st)"""
LINES = f"""{WORDS},
_mid AS (SELECT *, (ymin + ymax) / 2.0 AS ymid, avg(ymax - ymin) OVER (PARTITION BY doc_id, page_idx) AS h FROM words),
_step AS (SELECT *, ymid - lag(ymid) OVER (PARTITION BY doc_id, page_idx ORDER BY ymid, word_idx) AS step FROM _mid),
lined AS (SELECT *, CAST(sum(CASE WHEN step > 5 THEN 1 + CASE WHEN step > h * 1.6 THEN 1 ELSE 0 END ELSE 0 END) OVER (PARTITION BY doc_id, page_idx ORDER BY ymid, word_idx ROWS UNBOUNDED PRECEDING) AS INTEGER) AS line_idx FROM _step)"""


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.words(table(spark, sf_dir, "documents"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.quick_lines(words_of(spark, sf_dir))


@query(f"WITH {WORDS} SELECT * FROM words")
def words_layout(spark, sf_dir):
    return words_of(spark, sf_dir)


@query(f"WITH {WORDS} SELECT doc_id, page_idx, word_idx FROM words WHERE xmin > 100 AND xmax < 400 AND ymin > 50 AND ymax < 500")
def words_in_range(spark, sf_dir):
    w, b = words_of(spark, sf_dir), G.box()
    return w.where(G.in_xrange(b, 100, 400) & G.in_yrange(b, 50, 500)).select("doc_id", "page_idx", "word_idx")


@query(f"WITH {WORDS} SELECT doc_id, page_idx, word_idx FROM words WHERE xmin <= 400 AND xmax >= 380 AND ymin <= 300 AND ymax >= 200")
def words_touching_range(spark, sf_dir):
    w, b = words_of(spark, sf_dir), G.box()
    return w.where(G.in_xrange(b, 380, 400, True) & G.in_yrange(b, 200, 300, True)).select("doc_id", "page_idx", "word_idx")


@query(f"""WITH {WORDS} SELECT doc_id, page_idx, word_idx, xmax - xmin AS width, ymax - ymin AS height, (xmax - xmin) * (ymax - ymin) AS area, (xmin + xmax) / 2.0 AS xmid, (ymin + ymax) / 2.0 AS ymid,
  xmax - xmin > ymax - ymin AS is_horizontal, 500 BETWEEN xmin AND xmax AND 200 BETWEEN ymin AND ymax AS holds_point,
  CAST(greatest(0, xmin - 20) AS DOUBLE) AS grown_left, CAST(least(1000, xmax + 20) AS DOUBLE) AS grown_right, CAST(least(1000, xmin + 20) AS DOUBLE) AS shrunk_left, CAST(greatest(0, xmax - 20) AS DOUBLE) AS shrunk_right FROM words""")
def box_measures(spark, sf_dir):
    b = G.box()
    grown, shrunk = G.expanded(b, 2.0, 1000), G.shrunk(b, 2.0, 1000)
    return words_of(spark, sf_dir).select(
        "doc_id", "page_idx", "word_idx", G.width(b).alias("width"), G.height(b).alias("height"), G.area(b).alias("area"), G.xmid(b).alias("xmid"), G.ymid(b).alias("ymid"), G.is_horizontal(b).alias("is_horizontal"),
        G.inside(F.lit(500), F.lit(200), b).alias("holds_point"), grown["xmin"].alias("grown_left"), grown["xmax"].alias("grown_right"), shrunk["xmin"].alias("shrunk_left"), shrunk["xmax"].alias("shrunk_right"),
    )


@query(f"""WITH {WORDS}, p AS (SELECT *, greatest(0, least(xmax, 600) - greatest(xmin, 300)) AS ow, greatest(0, least(ymax, 400) - greatest(ymin, 110)) AS oh, least(xmax, 600) - greatest(xmin, 300) AS rw, least(ymax, 400) - greatest(ymin, 110) AS rh FROM words)
SELECT doc_id, page_idx, word_idx, CAST(CASE WHEN rw < 0 OR rh < 0 THEN 0 WHEN (xmax - xmin) * (ymax - ymin) = 0 THEN 100 ELSE (ow * oh * 100) // ((xmax - xmin) * (ymax - ymin)) END AS INTEGER) AS percent,
  300 <= xmin AND 600 >= xmax AS x_inside, 110 <= ymin AND 400 >= ymax AS y_inside FROM p""")
def box_overlap(spark, sf_dir):
    b, region = G.box(), {"xmin": F.lit(300), "ymin": F.lit(110), "xmax": F.lit(600), "ymax": F.lit(400)}
    return words_of(spark, sf_dir).select("doc_id", "page_idx", "word_idx", G.overlap_percent(b, region).alias("percent"), G.x_subsumes(region, b).alias("x_inside"), G.y_subsumes(region, b).alias("y_inside"))


@query(f"WITH {LINES} SELECT doc_id, page_idx, line_idx, count(*) AS n_words, string_agg(text, ' ' ORDER BY xmin, word_idx) AS text FROM lined GROUP BY doc_id, page_idx, line_idx")
def quick_lines(spark, sf_dir):
    return layout.line_texts(lines_of(spark, sf_dir))


@query(f"WITH {LINES} SELECT doc_id, page_idx, string_agg(text, ' ' ORDER BY ymin, xmin, word_idx) AS text FROM lined GROUP BY doc_id, page_idx")
def reading_order_text(spark, sf_dir):
    return layout.reading_text(words_of(spark, sf_dir))


@query()
def full_lines(spark, sf_dir):
    return layout.full_lines(words_of(spark, sf_dir))


@query(f"WITH {WORDS} SELECT doc_id, page_idx, word_idx, start AS char_start, start + length(text) AS char_end FROM words")
def word_char_spans(spark, sf_dir):
    return words_of(spark, sf_dir).select("doc_id", "page_idx", "word_idx", F.col("start").alias("char_start"), (F.col("start") + F.length("text")).alias("char_end"))


@query(f"""WITH {WORDS} SELECT doc_id, page_idx, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax, count(*) AS n_words, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS text_len,
  bool_and(regexp_full_match(text, '[\\p{{L}}\\p{{N}}]+')) AS all_alnum FROM words GROUP BY doc_id, page_idx""")
def region_stats(spark, sf_dir):
    return layout.region_stats(words_of(spark, sf_dir))


@query(f"""WITH {WORDS} SELECT doc_id, page_idx, string_agg(text || CASE WHEN last THEN chr(10) ELSE ' ' END, '' ORDER BY word_idx) AS text FROM
 (SELECT *, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY start) <> line_no, false) AS last FROM words) GROUP BY doc_id, page_idx""")
def text_with_breaks(spark, sf_dir):
    after = F.lead("line_no").over(Window.partitionBy("doc_id").orderBy("start"))
    w = words_of(spark, sf_dir).withColumn("break_type", F.when(F.coalesce(after != F.col("line_no"), F.lit(False)), 5).otherwise(1))
    w = w.withColumn("text", X.with_break(F.col("text"), F.col("break_type")))
    return w.groupBy("doc_id", "page_idx").agg(layout.joined("word_idx", "text", "").alias("text"))


def _side(direction: str) -> str:
    if direction == "right":
        band, cond, pick = "a.xmax AS bx0, least(1000, a.xmax + 200) AS bx1", "b.xmin >= a.xmax", "arg_min(other_idx, o_xmin * 100000 + other_idx)"
    else:
        band, cond, pick = "greatest(0, a.xmin - 200) AS bx0, a.xmin AS bx1", "b.xmax <= a.xmin", "arg_max(other_idx, o_xmax * 100000 + other_idx)"
    return f"""WITH {WORDS}, p AS (SELECT a.doc_id, a.page_idx, a.word_idx, b.word_idx AS other_idx, b.xmin AS o_xmin, b.xmax AS o_xmax, {band}, a.ymin AS by0, a.ymax AS by1, b.xmin AS x0, b.xmax AS x1, b.ymin AS y0, b.ymax AS y1
 FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND a.word_idx <> b.word_idx AND {cond} AND b.ymin <= a.ymax AND b.ymax >= a.ymin),
o AS (SELECT *, least(x1, bx1) - greatest(x0, bx0) AS w, least(y1, by1) - greatest(y0, by0) AS h, (x1 - x0) * (y1 - y0) AS area FROM p)
SELECT doc_id, page_idx, word_idx, {pick} AS nearest_idx, count(*) AS n_found FROM o WHERE w >= 0 AND h >= 0 AND CASE WHEN area = 0 THEN 100 ELSE w * h * 100 // area END > 40 GROUP BY doc_id, page_idx, word_idx"""


@query(_side("right"))
def neighbours_right(spark, sf_dir):
    return layout.nearest(layout.neighbours(words_of(spark, sf_dir), "right", 200, 40), "right")


@query(_side("left"))
def neighbours_left(spark, sf_dir):
    return layout.nearest(layout.neighbours(words_of(spark, sf_dir), "left", 200, 40), "left")


@query(f"""WITH {WORDS}, p AS (SELECT a.doc_id, a.page_idx, a.word_idx, b.word_idx AS other_idx, least(b.xmax, a.xmax) - greatest(b.xmin, a.xmin) AS w, least(b.ymax, least(1000, a.ymax + 20)) - greatest(b.ymin, a.ymax) AS h, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS area
 FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND a.word_idx <> b.word_idx AND b.ymin >= a.ymax AND b.ymin <= a.ymax + 20)
SELECT doc_id, page_idx, word_idx, count(*) AS n_below, min(other_idx) AS first_below FROM p WHERE w >= 0 AND h >= 0 AND CASE WHEN area = 0 THEN 100 ELSE w * h * 100 // area END > 1 GROUP BY doc_id, page_idx, word_idx""")
def neighbours_below(spark, sf_dir):
    return layout.neighbours(words_of(spark, sf_dir), "below", 20, 1).groupBy("doc_id", "page_idx", "word_idx").agg(F.count("*").alias("n_below"), F.min("other_idx").alias("first_below"))


@query(f"""WITH {WORDS}, p AS (SELECT a.doc_id, a.page_idx, a.word_idx, b.word_idx AS other_idx, least(b.xmax, a.xmax) - greatest(b.xmin, a.xmin) AS w, least(b.ymax, a.ymin) - greatest(b.ymin, 0) AS h, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS area
 FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND a.word_idx <> b.word_idx AND b.ymax <= a.ymin AND b.xmin <= a.xmax AND b.xmax >= a.xmin)
SELECT doc_id, page_idx, word_idx, count(*) AS n_above, max(other_idx) AS last_above FROM p WHERE w >= 0 AND h >= 0 AND CASE WHEN area = 0 THEN 100 ELSE w * h * 100 // area END > 50 GROUP BY doc_id, page_idx, word_idx""")
def neighbours_above(spark, sf_dir):
    return layout.neighbours(words_of(spark, sf_dir), "above", 20, 50).groupBy("doc_id", "page_idx", "word_idx").agg(F.count("*").alias("n_above"), F.max("other_idx").alias("last_above"))


#: Two tables on each page, of five rows and four columns each, whose lines lie elsewhere in each document.
GRIDS = """
_tp AS (SELECT DISTINCT doc_id, page_idx FROM words),
trows AS (SELECT doc_id, page_idx, CAST(t.i AS INTEGER) AS table_idx, CAST(r.i AS INTEGER) AS row_idx, t.i * 475 + r.i * 95 + 10 + doc_id % 7 AS y0, t.i * 475 + r.i * 95 + 105 + doc_id % 7 AS y1 FROM _tp, range(2) t(i), range(5) r(i)),
tcols AS (SELECT doc_id, page_idx, CAST(t.i AS INTEGER) AS table_idx, CAST(c.i AS INTEGER) AS col_idx, c.i * 240 + 20 + (doc_id + t.i) % 11 AS x0, c.i * 240 + 260 + (doc_id + t.i) % 11 AS x1 FROM _tp, range(2) t(i), range(4) c(i))"""
FIRST = f"""{GRIDS},
_inr AS (SELECT doc_id, page_idx, table_idx, word_idx, min(row_idx) AS row_idx FROM words JOIN trows USING (doc_id, page_idx) WHERE xmax > xmin AND least(ymax, y1) - greatest(ymin, y0) >= 0 AND (least(ymax, y1) - greatest(ymin, y0)) * 100 // (ymax - ymin) >= 50 GROUP BY ALL),
_inc AS (SELECT doc_id, page_idx, table_idx, word_idx, min(col_idx) AS col_idx FROM words JOIN tcols USING (doc_id, page_idx) WHERE xmax > xmin AND least(xmax, x1) - greatest(xmin, x0) >= 0 AND (least(xmax, x1) - greatest(xmin, x0)) * 100 // (xmax - xmin) >= 50 GROUP BY ALL),
placed AS (SELECT * FROM _inr JOIN _inc USING (doc_id, page_idx, table_idx, word_idx))"""


def table_grids(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of rows and columns of GRIDS."""
    pages = words.select("doc_id", "page_idx").distinct().withColumn("table_idx", F.explode(F.array(F.lit(0), F.lit(1))))
    top, left = F.col("table_idx") * 475 + F.col("row_idx") * 95 + 10 + F.col("doc_id") % 7, F.col("col_idx") * 240 + 20 + (F.col("doc_id") + F.col("table_idx")) % 11
    rows = pages.withColumn("row_idx", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("y0", top).withColumn("y1", top + 95)
    columns = pages.withColumn("col_idx", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("x0", left).withColumn("x1", left + 240)
    return rows, columns


@query(f"WITH {WORDS}, {FIRST} SELECT * FROM placed")
def cells_first_match(spark, sf_dir):
    w = words_of(spark, sf_dir).where("xmax > xmin")
    return tables.cells_first_match(w, *table_grids(w))


@query(f"WITH {WORDS}, {FIRST} SELECT p.doc_id, p.page_idx, p.table_idx, w.word_idx FROM (SELECT DISTINCT doc_id, page_idx, table_idx FROM trows) p JOIN words w USING (doc_id, page_idx) ANTI JOIN placed USING (doc_id, page_idx, table_idx, word_idx) WHERE xmax > xmin")
def cells_leftover_words(spark, sf_dir):
    w = words_of(spark, sf_dir).where("xmax > xmin")
    rows, columns = table_grids(w)
    return tables.leftovers(w, rows, tables.cells_first_match(w, rows, columns)).select("doc_id", "page_idx", "table_idx", "word_idx")


@query(f"""WITH {WORDS}, {FIRST}, r AS (SELECT doc_id, page_idx, table_idx, row_idx, count(*) AS n_words, coalesce(string_agg(CASE WHEN col_idx = 0 THEN text END, ' ' ORDER BY xmin, word_idx), '') AS h FROM placed JOIN words USING (doc_id, page_idx, word_idx) GROUP BY ALL HAVING count(*) >= 3)
SELECT doc_id, page_idx, table_idx, row_idx, n_words, regexp_full_match(h, '[\\x00-\\x7F]*') AND (contains(lower(h), 's.') OR contains(lower(h), 'no.') OR contains(lower(h), 'sno')) AS is_header FROM r""")
def table_rows_kept(spark, sf_dir):
    w = words_of(spark, sf_dir).where("xmax > xmin")
    return tables.kept_rows(tables.cells_first_match(w, *table_grids(w)), w)


@query(f"""WITH {WORDS}, {GRIDS}, g AS (SELECT doc_id, page_idx, table_idx, row_idx, col_idx, y0, y1 + 15 AS y1, x0, x1 + 10 AS x1 FROM trows JOIN tcols USING (doc_id, page_idx, table_idx)),
p AS (SELECT *, least(xmax, x1) - greatest(xmin, x0) AS w, least(ymax, y1) - greatest(ymin, y0) AS h, (xmax - xmin) * (ymax - ymin) AS area FROM words JOIN g USING (doc_id, page_idx))
SELECT doc_id, page_idx, table_idx, word_idx, row_idx, col_idx FROM p WHERE w >= 0 AND h >= 0 AND CASE WHEN area = 0 THEN 100 ELSE w * h * 100 // area END > 70""")
def cells_all_matches(spark, sf_dir):
    w = words_of(spark, sf_dir)
    rows, columns = table_grids(w)
    cells = rows.join(columns, ["doc_id", "page_idx", "table_idx"]).withColumn("y1", F.col("y1") + 15).withColumn("x1", F.col("x1") + 10)
    return tables.cells_all_matches(w, cells)


@query(f"""WITH {WORDS}, {GRIDS}, g AS (SELECT * FROM trows JOIN tcols USING (doc_id, page_idx, table_idx)),
p AS (SELECT *, least(xmax, x1) - greatest(xmin, x0) AS w, least(ymax, y1) - greatest(ymin, y0) AS h, (xmax - xmin) * (ymax - ymin) AS area FROM words JOIN g USING (doc_id, page_idx) WHERE xmax > xmin),
m AS (SELECT doc_id, page_idx, table_idx, word_idx, min(row_idx * 100 + col_idx) AS k FROM p WHERE w > 0 AND h > 0 AND w * h * 2 > area GROUP BY ALL)
SELECT doc_id, page_idx, table_idx, word_idx, CAST(k // 100 AS INTEGER) AS row_idx, CAST(k % 100 AS INTEGER) AS col_idx FROM m""")
def cells_by_polygon(spark, sf_dir):
    """Cells as polygons, of five corners as one stands in the middle of a side; the SQL has them as boxes."""
    w = words_of(spark, sf_dir)
    rows, columns = table_grids(w)
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    cells = rows.join(columns, ["doc_id", "page_idx", "table_idx"]).withColumn("polygon", F.array(p(x0, y0), p((x0 + x1) / 2, y0), p(x1, y0), p(x1, y1), p(x0, y1)))
    return tables.cells_by_polygon(w, cells)


@query(f"""WITH {WORDS}, s AS (SELECT doc_id, page_idx, unnest(generate_series(xmin, least(xmax, 999))) AS slot FROM words WHERE xmin < 1000)
SELECT doc_id, page_idx, CAST(slot AS INTEGER) AS slot, count(*) AS depth FROM s GROUP BY ALL""")
def depth_histogram(spark, sf_dir):
    return tables.depth_histogram(words_of(spark, sf_dir))


@query(f"""WITH {WORDS}, s AS (SELECT DISTINCT doc_id, page_idx, unnest(generate_series(xmin, least(xmax, 999))) AS slot FROM words WHERE xmin < 1000),
k AS (SELECT doc_id, page_idx, list_sort(list(slot)) AS v FROM s GROUP BY ALL),
e AS (SELECT doc_id, page_idx, list_concat([-1], v, [1000]) AS e FROM k),
g AS (SELECT doc_id, page_idx, e[i] AS a, e[i + 1] AS b FROM e, LATERAL (SELECT unnest(generate_series(1, len(e) - 1)) AS i)),
m AS (SELECT doc_id, page_idx, arg_max(a, (b - a - 1) * 10000 - a) AS a, max(b - a - 1) AS size FROM g GROUP BY ALL)
SELECT doc_id, page_idx, CAST(a + 1 - 5 AS INTEGER) AS gap_start, CAST(a + 1 + size + 5 AS INTEGER) AS gap_end FROM m WHERE size > 0""")
def cell_boundary_gap(spark, sf_dir):
    return tables.widest_gap(words_of(spark, sf_dir))


@query(f"""WITH {LINES}, l AS (SELECT doc_id, page_idx, line_idx, min(xmin) AS x0, max(xmax) AS x1, count_if(text <> '') AS n FROM lined GROUP BY ALL),
m AS (SELECT *, x0 > min(x0) OVER (PARTITION BY doc_id, page_idx) + 100 AND x1 < max(x1) OVER (PARTITION BY doc_id, page_idx) - 100 AND n < 3 AS is_heading FROM l),
j AS (SELECT *, line_idx - lag(line_idx) OVER w > 1 AS blank, lag(is_heading) OVER w AS after, abs(x0 - lag(x0) OVER w) > 50 AS moved FROM m WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY line_idx)),
k AS (SELECT *, coalesce(((blank OR after OR moved) AND NOT is_heading) OR blank OR after, false) AS new FROM j)
SELECT doc_id, page_idx, line_idx, CAST(count_if(new) OVER (PARTITION BY doc_id, page_idx ORDER BY line_idx) AS INTEGER) AS para_idx, is_heading FROM k""")
def paragraphs(spark, sf_dir):
    return layout.paragraphs(lines_of(spark, sf_dir))


@query(f"""WITH {LINES}, l AS (SELECT doc_id, page_idx, line_idx, min(ymin) AS y0, max(ymax) AS y1, string_agg(text, ' ' ORDER BY xmin, word_idx) AS text, avg(ymax - ymin) AS h FROM lined GROUP BY ALL),
m AS (SELECT *, coalesce(y0 - lag(y1) OVER w > avg(h) OVER (PARTITION BY doc_id, page_idx) * 2, false) OR coalesce(regexp_matches(lag(text) OVER w, '[.,;][ ]*$'), false) AS stop FROM l WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY line_idx)),
n AS (SELECT *, count_if(stop) OVER (PARTITION BY doc_id, page_idx ORDER BY line_idx) AS stops FROM m)
SELECT doc_id, page_idx, line_idx, text FROM n WHERE stops = 0""")
def footer_trimming(spark, sf_dir):
    return layout.without_footer(lines_of(spark, sf_dir))


@query(f"""WITH {LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx, line_idx ORDER BY xmin, word_idx) AS rn FROM lined WHERE xmin <= 300 AND xmax >= 0)
SELECT doc_id, page_idx, line_idx, word_idx, text FROM f WHERE rn = 1 AND regexp_matches(text, '^[A-Z].*[a-z]')""")
def line_first_words(spark, sf_dir):
    return layout.first_words(lines_of(spark, sf_dir), (0, 300))


@query(f"""WITH {LINES}, m AS (SELECT *, regexp_full_match(text, '[A-Z][a-z]+[.]') AS mk FROM lined),
i AS (SELECT *, count_if(mk) OVER (PARTITION BY doc_id, page_idx ORDER BY line_idx, xmin, word_idx) AS item_idx FROM m)
SELECT doc_id, page_idx, CAST(item_idx AS BIGINT) AS item_idx, list(word_idx ORDER BY line_idx, xmin, word_idx) AS word_idxs, string_agg(text, ' ' ORDER BY line_idx, xmin, word_idx) AS text FROM i WHERE item_idx > 0 AND NOT mk GROUP BY ALL""")
def list_items(spark, sf_dir):
    return layout.list_items(lines_of(spark, sf_dir), F.col("text").rlike("^[A-Z][a-z]+[.]$"))


ROMAN_SQL = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in X.ROMAN.items()) + ") v(r, n)"
MARKER_SQL = f"""
_bare AS (SELECT *, replace(translate(translate(text, 'хі', 'xi'), '.,()', ''), 'X', 'x') AS num_text FROM words),
_kind AS (SELECT b.*, v.n, CASE WHEN regexp_full_match(num_text, '[0-9]{{1,9}}') THEN 1 WHEN v.r IS NOT NULL THEN 2 WHEN regexp_full_match(num_text, '[a-z]') THEN 3 ELSE 0 END AS num_type FROM _bare b LEFT JOIN {ROMAN_SQL} ON num_text = v.r AND regexp_full_match(num_text, '[ivx]+')),
_val AS (SELECT *, CAST(CASE num_type WHEN 1 THEN TRY_CAST(num_text AS INTEGER) WHEN 2 THEN n WHEN 3 THEN unicode(num_text) - 96 END AS INTEGER) AS num_val FROM _kind)"""


@query(f"WITH {WORDS}, {MARKER_SQL} SELECT doc_id, page_idx, word_idx, CAST(num_type AS INTEGER) AS num_type, num_text, num_val FROM _val WHERE num_type > 0")
def marker_parse(spark, sf_dir):
    return words_of(spark, sf_dir).withColumn("m", X.marker(F.col("text"))).where("m.num_type > 0").select("doc_id", "page_idx", "word_idx", "m.num_type", "m.num_text", "m.num_val")


@query(f"""WITH {WORDS}, {MARKER_SQL}, b AS (SELECT *, coalesce(max(CAST(regexp_full_match(text, '[\\p{{L}}\\p{{N}}]+') AS INTEGER)) OVER (PARTITION BY doc_id, page_idx, ymin ORDER BY xmin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS busy FROM _val)
SELECT doc_id, page_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY ymin, xmin, word_idx) - 1 AS INTEGER) AS idx, word_idx, CAST(num_type AS INTEGER) AS num_type, num_text, num_val, xmin, ymin, xmax, ymax
FROM b WHERE busy = 0 AND num_type > 0 AND num_val BETWEEN 1 AND 49 AND xmin > 0 AND xmax < 600""")
def number_markers(spark, sf_dir):
    return layout.markers(words_of(spark, sf_dir))


@query(f"""WITH {WORDS}, p AS (SELECT *, 1000 * CAST(text[1:1] = upper(text[1:1]) AS INTEGER) AS up FROM words WHERE regexp_matches(text, '^[A-Z]'))
SELECT doc_id, page_idx, count(*) AS n_points, CASE WHEN count(*) >= 3 THEN round(degrees(atan(CASE WHEN var_pop(CAST(ymin AS DOUBLE)) = 0 THEN 0 ELSE regr_slope(CAST(xmin AS DOUBLE), CAST(ymin AS DOUBLE)) END)), 4) END AS angle FROM p GROUP BY ALL""")
def skew_angle(spark, sf_dir):
    capital = words_of(spark, sf_dir).where(F.col("text").rlike("^[A-Z]"))
    return layout.skew(capital, layout.PAGE, F.col("xmin").cast("double"), F.col("ymin").cast("double")).withColumn("angle", F.round("angle", 4))


_TURN = """SELECT *, cos(radians(a)) AS c, sin(radians(a)) AS s, ceil(595 * abs(cos(radians(a)))) + ceil(842 * abs(sin(radians(a)))) AS w2, ceil(595 * abs(sin(radians(a)))) + ceil(842 * abs(cos(radians(a)))) AS h2 FROM (SELECT *, CAST(doc_id % 7 - 3 AS DOUBLE) AS a FROM words)"""


def _turned(x: str, y: str) -> tuple[str, str]:
    dx, dy = f"({x} * 595 / 1000.0 - 297.5)", f"({y} * 842 / 1000.0 - 421)"
    return f"round_even(greatest(0, least(c * {dx} + s * {dy} + w2 / 2, w2)), 0)", f"round_even(greatest(0, least(-s * {dx} + c * {dy} + h2 / 2, h2)), 0)"


_CORNERS = [_turned(x, y) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]


@query(f"""WITH {WORDS}, t AS ({_TURN}) SELECT doc_id, page_idx, word_idx, least({', '.join(c[0] for c in _CORNERS)}) AS x0, least({', '.join(c[1] for c in _CORNERS)}) AS y0, greatest({', '.join(c[0] for c in _CORNERS)}) AS x1, greatest({', '.join(c[1] for c in _CORNERS)}) AS y1 FROM t""")
def rotate_words(spark, sf_dir):
    turned = layout.rotated(words_of(spark, sf_dir), (F.col("doc_id") % 7 - 3).cast("double"), 595, 842)
    return turned.select("doc_id", "page_idx", "word_idx", F.col("xmin").alias("x0"), F.col("ymin").alias("y0"), F.col("xmax").alias("x1"), F.col("ymax").alias("y1"))


@query(f"""WITH {WORDS}, o AS (SELECT doc_id, page_idx, CAST(doc_id % 4 * 90 AS INTEGER) AS turn FROM words WHERE length(text) > 4) SELECT doc_id, page_idx, min(turn) AS angle, count(*) AS n_words FROM o GROUP BY ALL""")
def reorient_mode(spark, sf_dir):
    """Words' corners begin at another one for each document; the most frequent reading of a page's long words tells its turn."""
    w = words_of(spark, sf_dir).where(F.length("text") > 4)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(point("xmin", "ymin"), point("xmax", "ymin"), point("xmax", "ymax"), point("xmin", "ymax"))
    turn = F.when(F.col("doc_id") % 4 == 0, 0).when(F.col("doc_id") % 4 == 1, 1).when(F.col("doc_id") % 4 == 2, 2).otherwise(3)
    shift = F.concat(F.slice(ring, turn + 1, F.lit(4)), F.slice(ring, F.lit(1), turn))
    # The ring begun at its k-th corner puts the upper pair at (4 - k) and (5 - k).
    angle = G.corner_orientation(shift)
    return w.withColumn("angle", angle).groupBy("doc_id", "page_idx").agg(F.mode("angle", True).alias("angle"), F.count("*").alias("n_words"))


@query(f"""WITH {WORDS} SELECT doc_id, page_idx, format('<svg viewBox="0 0 1000 1000">{{}}', chr(10)) || string_agg('<rect class="word" x="' || xmin || '" y="' || ymin || '" width="' || (xmax - xmin) || '" height="' || (ymax - ymin) || '" data-idx="' || word_idx || '"/>', chr(10) ORDER BY word_idx) || chr(10) || '</svg>' AS svg
FROM words GROUP BY doc_id, page_idx""")
def svg_pages(spark, sf_dir):
    return sinks.svg_pages(sinks.svg_elements(words_of(spark, sf_dir)))


@query(f"""WITH {WORDS} SELECT doc_id, page_idx, '<p>' || string_agg('<span id="w' || word_idx || '">' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</span>', ' ' ORDER BY word_idx) || '</p>' AS html FROM words GROUP BY doc_id, page_idx""")
def html_pages(spark, sf_dir):
    return sinks.html_pages(words_of(spark, sf_dir))


@query(f"WITH {WORDS} SELECT doc_id, page_idx, list(text ORDER BY word_idx) AS tokens, list([xmin, ymin, xmax, ymax] ORDER BY word_idx) AS boxes FROM words GROUP BY doc_id, page_idx")
def layout_boxes(spark, sf_dir):
    return sinks.layout_boxes(words_of(spark, sf_dir))


@query(f"WITH {WORDS} SELECT doc_id, page_idx, word_idx, text, CAST(xmin AS DOUBLE) AS xmin, CAST(ymax AS DOUBLE) AS ymax FROM words")
def json_round_trip(spark, sf_dir):
    """Documents as JSON and read again."""
    written = documents.to_json(words_of(spark, sf_dir))
    kind = "doc_id bigint, pages array<struct<page_idx: int, words: array<struct<word_idx: int, text: string, xmin: double, ymin: double, xmax: double, ymax: double>>>>"
    parsed = written.select(F.from_json("json", kind).alias("d")).select("d.*")
    w = documents.document_words(parsed, "doc_id")
    return w.select("doc_id", "page_idx", "word_idx", "text", "xmin", "ymax")


@query(f"""WITH {WORDS} SELECT w.doc_id, CASE WHEN page_idx > 0 THEN page_idx - 1 ELSE page_idx END AS page_idx, word_idx, text FROM words w WHERE page_idx <> 0""")
def page_delete(spark, sf_dir):
    return records.delete_page(words_of(spark, sf_dir), 0).select("doc_id", "page_idx", "word_idx", "text")


_EDITS = "SELECT doc_id, page_idx, word_idx, CASE WHEN word_idx = 0 THEN '<all>' ELSE 'e' END AS old, CASE WHEN word_idx = 0 THEN '' ELSE 'E' END AS new FROM words WHERE word_idx < 3"


@query(f"""WITH {WORDS}, e AS ({_EDITS}) SELECT doc_id, page_idx, word_idx, CASE WHEN old IS NULL THEN text WHEN old = '<all>' THEN new ELSE replace(text, old, new) END AS text, CASE WHEN old IS NOT NULL THEN text END AS orig_text FROM words LEFT JOIN e USING (doc_id, page_idx, word_idx)""")
def replace_strings(spark, sf_dir):
    w = words_of(spark, sf_dir)
    edits = w.where("word_idx < 3").select("doc_id", "page_idx", "word_idx", F.when(F.col("word_idx") == 0, "<all>").otherwise("e").alias("old"), F.when(F.col("word_idx") == 0, "").otherwise("E").alias("new"))
    return records.replace_strings(w.select("doc_id", "page_idx", "word_idx", "text"), edits)


@query(f"""WITH {WORDS}, l AS (SELECT doc_id, max(word_idx) AS last FROM words WHERE page_idx = 0 GROUP BY doc_id),
a AS (SELECT w.*, last, page_idx = 0 AND last >= 7 AS e FROM words w JOIN l USING (doc_id)), t AS (SELECT doc_id, word_idx, text, xmin, ymin, xmax, ymax, last FROM a WHERE e),
m AS (SELECT doc_id, page_idx, word_idx, CASE WHEN NOT e THEN text WHEN word_idx = 0 OR word_idx = 3 THEN '' WHEN word_idx = 1 THEN translate(text, 'ae', '') WHEN word_idx = 2 THEN text || (SELECT text FROM t WHERE t.doc_id = a.doc_id AND t.word_idx = 3)
  WHEN word_idx = 4 THEN left(text, 1) WHEN word_idx = 5 THEN replace(text, 'e', 'E') WHEN word_idx = 6 THEN 'New' || doc_id ELSE text END AS text, CASE WHEN e AND word_idx <= 6 THEN text END AS orig_text, xmin::DOUBLE AS xmin,
  CASE WHEN e AND word_idx = 4 THEN xmin + (xmax - xmin) / length(text) ELSE xmax END::DOUBLE AS xmax FROM a)
SELECT doc_id, page_idx, word_idx, text, orig_text, xmin, round(xmax, 6) AS xmax FROM m
UNION ALL SELECT t.doc_id, 0, last + 1, right(text, length(text) - 1), NULL, xmin + (xmax - xmin) / length(text)::DOUBLE, xmax FROM t WHERE word_idx = 4
UNION ALL SELECT a.doc_id, 0, a.last + 2, 'Added', NULL, a.xmin, a.xmax FROM t a WHERE a.word_idx = 5
UNION ALL SELECT doc_id, 0, last + 3, 'ab', NULL, xmax + 20, xmax + 20 + (xmax - xmin) / length(text)::DOUBLE * 2 FROM t WHERE word_idx = 7""")
def apply_edits(spark, sf_dir):
    """Nine commands on the first page of each document that has eight words there."""
    w = words_of(spark, sf_dir)
    docs = w.where("page_idx = 0").groupBy("doc_id").agg(F.max("word_idx").alias("last"), F.max(F.when(F.col("word_idx") == 4, F.substring("text", 1, 1))).alias("head")).where("last >= 7")
    lit = lambda *xs: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    todo = [
        ("clearWord", lit("pa0.wo0")), ("clearChar", lit("pa0.wo1", "ae")), ("mergeWords", lit("pa0.wo2", "pa0.wo3")), ("splitWord", lit("pa0.wo4", F.col("head"))), ("replaceStr", lit("pa0.wo5", "e", "E")),
        ("replaceStr", lit("pa0.wo6", "<all>", F.concat(F.lit("New"), F.col("doc_id").cast("string")))), ("newWord", lit("Added", "pa0.wo5", "pa0.wo6")), ("newAdjWord", lit("ab", "pa0.wo7", "right")), ("moveEdge", lit("pa0.ed0", "coord1", "up")),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(c).alias("cmd"), a.alias("args")) for k, (c, a) in enumerate(todo)]))
    return records.apply_edits(w, docs.select("doc_id", each.alias("e")).select("doc_id", "e.*")).select("doc_id", "page_idx", "word_idx", "text", "orig_text", "xmin", F.round("xmax", 6).alias("xmax"))


@query(f"""WITH {WORDS}, a AS (SELECT *, lead(text) OVER (PARTITION BY doc_id, page_idx, line_no ORDER BY pos, word_idx) AS nx FROM words) SELECT doc_id, page_idx, word_idx, text || coalesce(' ' || nx, '') AS gram, CASE WHEN nx IS NULL THEN 1 ELSE 2 END AS gram_size FROM a""")
def adjacent_words(spark, sf_dir):
    return layout.adjacent(words_of(spark, sf_dir)).select("doc_id", "page_idx", "word_idx", "gram", "gram_size")


@query(f"""WITH {WORDS}, w AS (SELECT doc_id, page_idx, count(*) AS n FROM words GROUP BY ALL), p AS (SELECT DISTINCT doc_id, page_idx FROM words)
SELECT doc_id, page_idx, 595 AS width, 842 AS height, n AS num_words, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS num_images, doc_id % 3 = 0 AND doc_id % 2 = 0 AS has_one_large_image FROM p JOIN w USING (doc_id, page_idx)""")
def pdf_profile(spark, sf_dir):
    w = words_of(spark, sf_dir)
    pages = w.select("doc_id", "page_idx").distinct().withColumn("width", F.lit(595)).withColumn("height", F.lit(842))
    images = pages.where("doc_id % 3 = 0").select("doc_id", "page_idx", F.when(F.col("doc_id") % 2 == 0, 590).otherwise(100).alias("width"), F.lit(840).alias("height"))
    return documents.profile(pages, w, images).withColumn("num_images", F.col("num_images").cast("int"))


@query(f"""WITH {WORDS}, t AS (SELECT doc_id, page_idx, 0 AS table_idx, 200 AS top FROM words GROUP BY ALL)
SELECT w.doc_id, w.page_idx, table_idx, string_agg(text, ' ' ORDER BY ymin, xmin, word_idx) AS title FROM words w JOIN t ON w.doc_id = t.doc_id AND w.page_idx = t.page_idx
WHERE regexp_matches(text, '[A-Z]') AND text = upper(text) AND ymax <= top AND ymin >= top - 50 GROUP BY ALL""")
def table_titles(spark, sf_dir):
    w = words_of(spark, sf_dir)
    return tables.titles(w, w.select("doc_id", "page_idx").distinct().withColumn("table_idx", F.lit(0)).withColumn("top", F.lit(200)))


@query()
def token_batches(spark, sf_dir):
    w = words_of(spark, sf_dir).groupBy("doc_id", "line_no").agg(F.count("*").cast("int").alias("size"))
    return layout.batches(w.select("doc_id", F.col("line_no").alias("idx"), "size"), 64)


@query(f"""WITH {WORDS}, p AS (SELECT *, xmin / 1000.0 AS x, ymin / 1000.0 AS y, doc_id % 2 = 0 AS raster FROM words)
SELECT doc_id, page_idx, word_idx, round_even(greatest(0, least(CASE WHEN raster THEN x * 668 ELSE (x * 595 - 73) / (524.3 - 73) * 506 END, CASE WHEN raster THEN 668 ELSE 506 END)), 0) AS px,
 round_even(greatest(0, least(CASE WHEN raster THEN y * 945 ELSE (y * 842 - 72) / (701.7 - 72) * 706 END, CASE WHEN raster THEN 945 ELSE 706 END)), 0) AS py FROM p""")
def page_image_coords(spark, sf_dir):
    raster = F.col("doc_id") % 2 == 0
    number = lambda a, b: F.when(raster, F.lit(float(a))).otherwise(F.lit(float(b)))
    box = F.struct(F.lit(73.0).alias("xmin"), F.lit(72.0).alias("ymin"), F.lit(524.3).alias("xmax"), F.lit(701.7).alias("ymax"))
    image = F.struct(number(668, 506).alias("image_width"), number(945, 706).alias("image_height"), F.when(raster, "raster").otherwise("embedded").alias("image_type"), box.alias("box"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"))
    w = words_of(spark, sf_dir).withColumn("page_image", image)
    x, y = G.image_point(F.col("xmin") / 1000, F.col("ymin") / 1000)
    return w.select("doc_id", "page_idx", "word_idx", x.alias("px"), y.alias("py"))


@query(f"""WITH {WORDS} SELECT doc_id, page_idx, word_idx, CAST(xmin - 20 AS DOUBLE) AS fx, CAST(ymin - 10 AS DOUBLE) AS fy, CAST(xmin AS DOUBLE) AS bx, CAST(ymin AS DOUBLE) AS by_ FROM words""")
def transform_chain(spark, sf_dir):
    """A crop and a turn by nothing there, and the way back."""
    kind = "array<struct<op:string,dx:double,dy:double,angle:double,w:double,h:double,w2:double,h2:double>>"
    crop = F.struct(F.lit("crop"), F.lit(20.0), F.lit(10.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    turn = F.struct(F.lit("rotate"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(980.0), F.lit(990.0), F.lit(980.0), F.lit(990.0))
    w = words_of(spark, sf_dir).withColumn("chain", F.array(crop, turn).cast(kind))
    w = w.withColumn("f", G.transformed(F.col("xmin"), F.col("ymin"), F.col("chain"))).withColumn("b", G.transformed(F.col("f.x"), F.col("f.y"), F.col("chain"), True))
    return w.select("doc_id", "page_idx", "word_idx", F.round("f.x", 6).alias("fx"), F.round("f.y", 6).alias("fy"), F.round("b.x", 6).alias("bx"), F.round("b.y", 6).alias("by_"))
