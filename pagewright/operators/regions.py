"""Regions over words, and what pages, tables and word forms tell about documents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as X
from pagewright.operators.layout import PAGE, joined
from pagewright.operators.vocabulary import checked


def region_words(regions: DataFrame, words: DataFrame) -> DataFrame:
    """The words of regions (doc_id, page_idx, region_idx, word_idxs), with pos, their place in the region's list; indices without a word are left out."""
    at = regions.select(*PAGE, "region_idx", F.posexplode("word_idxs").alias("pos", "word_idx"))
    return at.join(words.drop("pos", "region_idx"), [*PAGE, "word_idx"])


def region_summary(regions: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page_idx, region_idx, n_words, text, xmin, ymin, xmax, ymax) of regions, their words in the order of the list."""
    return region_words(regions, words).groupBy(*PAGE, "region_idx").agg(F.count("*").alias("n_words"), joined(F.struct("pos", "word_idx")).alias("text"), *G.union_aggregates(G.box()))


def relevant(probes: DataFrame, regions: DataFrame, percent: int = 80) -> DataFrame:
    """Probes (boxes of pages) with each region (doc_id, page_idx, region_idx, x0, y0, x1, y1) of their page that covers more than ``percent`` of the probe, truncated."""
    cell = {"xmin": F.col("x0"), "ymin": F.col("y0"), "xmax": F.col("x1"), "ymax": F.col("y1")}
    return probes.join(regions, list(PAGE)).where(G.overlap_percent(G.box(), cell) > percent)


def markers_in_tables(markers: DataFrame, boxes: DataFrame, percent: int = 0) -> DataFrame:
    """Markers of pages that overlap every table box (doc_id, page_idx, x0, y0, x1, y1) of their page; none of pages without a box."""
    cell = {"xmin": F.col("x0"), "ymin": F.col("y0"), "xmax": F.col("x1"), "ymax": F.col("y1")}
    held = markers.join(boxes, list(PAGE)).groupBy(*markers.columns).agg(F.bool_and(G.overlap_percent(G.box(), cell) > percent).alias("_all"))
    return held.where("_all").drop("_all")


def boundaries(items: DataFrame, user: DataFrame, configured: DataFrame, gaps: DataFrame, reach: int = 50) -> DataFrame:
    """Items (path) with the range of a cell's boundary: before the word that the user named (path, xmin), else before the configured one, else the widest gap (path, gap_start, gap_end); and which it was."""
    u, c = user.select("path", F.col("xmin").alias("_u")), configured.select("path", F.col("xmin").alias("_c"))
    both = items.join(u, "path", "left").join(c, "path", "left").join(gaps, "path", "left")
    word = F.coalesce("_u", "_c")
    strategy = F.when(F.col("_u").isNotNull(), "user_boundary_words").when(F.col("_c").isNotNull(), "conf_boundary_words").when(F.col("gap_start").isNotNull(), "cell_boundary")
    return both.select(*items.columns, F.coalesce(word - reach, F.col("gap_start")).alias("x_start"), F.coalesce(word, F.col("gap_end")).alias("x_end"), strategy.alias("strategy"))


HEADER_STRATEGIES = ("first_row", "first_page_first_row", "new_page_first_row", "first_table_first_row")


def is_header_row(strategy: str, page: Column, table: Column, row: Column) -> Column:
    """Whether a row is a header by its place, under one of HEADER_STRATEGIES; of any other, none is."""
    first = row == 0
    return {
        "first_row": first, "first_page_first_row": first & (page == 0), "new_page_first_row": first & ((page == 0) | ((page != 0) & (table > 0))), "first_table_first_row": first & (table == 0),
    }.get(strategy, F.lit(False))


def has_merged_cells(cells: Column) -> Column:
    """Whether a row's array of cells has a null one, which is how merged cells are told."""
    return F.exists(cells, lambda c: c.isNull())


HINDI_HEADERS = ("क्र", "सं", "क.", "क ०", "कम", "कृ0स०", "क .", "क्र.स.", "कृ ० स ०", "क स ०", "क्रस", "वा . स .")


def names_a_serial(cell: Column) -> Column:
    """Whether a first cell's text is the head of a serial number column, in ASCII or in Devanagari."""
    low = F.lower(cell)
    any_of = lambda parts: F.greatest(*[F.contains(low, F.lit(p)).cast("int") for p in parts]) == 1
    return F.when(X.is_ascii(low), any_of(("s.", "no.", "sno"))).otherwise(any_of(HINDI_HEADERS))


def page_scripts(words: DataFrame) -> DataFrame:
    """(doc_id, page_idx, script): the block of most of the page's characters; of equals the one whose name is first."""
    chars = words.select(*PAGE, F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy(*PAGE, "ch").agg(F.count("*").alias("n"))
    blocks = chars.withColumn("script", X.block(F.col("ch"))).groupBy(*PAGE, "script").agg(F.sum("n").alias("n"))
    return blocks.groupBy(*PAGE).agg(F.min(F.struct(-F.col("n"), "script"))["script"].alias("script"))


def document_scripts(pages: DataFrame) -> DataFrame:
    """(doc_id, language, n_pages): the script of all pages, or 'mixed'."""
    return pages.groupBy("doc_id").agg(F.when(F.countDistinct("script") == 1, F.min("script")).otherwise("mixed").alias("language"), F.count("*").alias("n_pages"))


ORDER_WORDS = {"Devanagari": (("आदेश", "आज्ञा", "आंज्ञा", "संशोधन"), ("प्रतिलिपि", "प्रतिलपि", "प्रतिलिपी")), "": (("order", "notification"), ("copies", "copy"))}
ORDER_ZONE, COPY_ZONE = (350, 650, 50, 350), (0, 400, 0, 1000)


def multi_order(words: DataFrame, pages: DataFrame, terms: dict = ORDER_WORDS, order_zone: tuple = ORDER_ZONE, copy_zone: tuple = COPY_ZONE) -> DataFrame:
    """(doc_id, order_pages, copy_pages, multi): pages that have an order word, and a copy word, in their zones (x0, x1, y0, y1); a document of more than one of both holds several orders.
    ``pages``: (doc_id, page_idx, script); the words looked for go by the page's script, '' standing for all others."""
    low = F.lower("text")

    def has(which: int) -> Column:
        holds = lambda kind: F.greatest(*[F.contains(low, F.lit(t)).cast("int") for t in terms[kind][which]], F.lit(0)) == 1
        out = None
        for kind in terms:
            if kind:
                out = F.when(F.col("script") == kind, holds(kind)) if out is None else out.when(F.col("script") == kind, holds(kind))
        return holds("") if out is None else out.otherwise(holds(""))

    b = G.box()
    inside = lambda z: G.in_xrange(b, z[0], z[1]) & G.in_yrange(b, z[2], z[3])
    per_page = words.join(pages, list(PAGE)).groupBy(*PAGE).agg(F.max((has(0) & inside(order_zone)).cast("int")).alias("o"), F.max((has(1) & inside(copy_zone)).cast("int")).alias("c"))
    return per_page.groupBy("doc_id").agg(F.sum("o").alias("order_pages"), F.sum("c").alias("copy_pages")).withColumn("multi", (F.col("order_pages") > 1) & (F.col("copy_pages") > 1))


def all_text(pages: DataFrame) -> DataFrame:
    """(doc_id, is_text): whether no page (doc_id, page_idx, num_images) has an image."""
    return pages.groupBy("doc_id").agg(F.bool_and(F.coalesce("num_images", F.lit(0)) == 0).alias("is_text"))


def word_box_angle(words: DataFrame, least_len: int = 5) -> DataFrame:
    """(doc_id, page_idx, angle): the mean slope in degrees of the upper and lower edges of four-cornered words (coords: array of x, y; two upper, then two lower) of at least a length."""
    slope = lambda a, b: F.when(b["x"] == a["x"], 0.0).otherwise(F.degrees(F.atan((b["y"] - a["y"]) / (b["x"] - a["x"]))))
    c = F.col("coords")
    angle = (slope(c[0], c[1]) + slope(c[2], c[3])) / 2
    return words.where((F.size("coords") == 4) & (F.length("text") >= least_len)).groupBy(*PAGE).agg(F.avg(angle).alias("angle"))


def deskew(pages: DataFrame, least: float = 0.25) -> DataFrame:
    """Pages (angle) with turn: the angle to turn the image by, 0 if it is smaller than ``least``."""
    return pages.withColumn("turn", F.when(F.abs("angle") >= least, -F.col("angle")).otherwise(0.0))


def row_heights(edges: DataFrame, group: tuple[str, ...], order: str, top: str) -> DataFrame:
    """Rows' edges with height, from each to the next below (null at the last), and mean_height of the group."""
    w = Window.partitionBy(*group)
    tall = edges.withColumn("height", F.lead(top).over(w.orderBy(order)) - F.col(top))
    return tall.withColumn("mean_height", F.avg("height").over(w))


def column_fill(cells: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """(group, col_idx, n_rows, n_filled, is_empty) of cells (row_idx, col_idx, text): a column is empty if its table has more than two rows and it at most one text."""
    cells = cells.where(" and ".join(f"{c} is not null" for c in group))
    # A row counts where it has its first cell, so cells are read once.
    new = F.col("row_idx").isNotNull() & (F.row_number().over(Window.partitionBy(*group, "row_idx").orderBy("col_idx")) == 1)
    columns = cells.withColumn("_new", new).groupBy(*group, "col_idx").agg(F.count_if(F.coalesce("text", F.lit("")) != "").alias("n_filled"), F.count_if("_new").alias("_new"))
    filled = columns.withColumn("n_rows", F.sum("_new").over(Window.partitionBy(*group))).drop("_new")
    return filled.withColumn("is_empty", (F.col("n_rows") > 2) & (F.col("n_filled") <= 1))


def without_empty_columns(cells: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Cells without those of empty columns; the columns after them are one less for each."""
    whole, column = Window.partitionBy(*group), Window.partitionBy(*group, "col_idx")
    told = cells.where(" and ".join(f"{c} is not null" for c in (*group, "col_idx")))
    told = told.withColumn("_new", F.col("row_idx").isNotNull() & (F.row_number().over(Window.partitionBy(*group, "row_idx").orderBy("col_idx")) == 1))
    told = told.withColumn("_filled", F.count_if(F.coalesce("text", F.lit("")) != "").over(column)).withColumn("_head", F.row_number().over(column.orderBy("row_idx")) == 1)
    told = told.withColumn("_empty", (F.count_if("_new").over(whole) > 2) & (F.col("_filled") <= 1))
    # Up to and with a column that isn't empty, as many empty ones as before it.
    before = F.count_if(F.col("_empty") & F.col("_head")).over(whole.orderBy("col_idx"))
    return told.withColumn("_before", before).where("not _empty").withColumn("col_idx", (F.col("col_idx") - F.col("_before")).cast("int")).select(*cells.columns)


def first_pages(words: DataFrame, most: int | None) -> DataFrame:
    """The first pages only, where a limit is given."""
    return words if most is None else words.where(F.col("page_idx") < most)


def last_lines(lines: DataFrame, n: int, order: str, group: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The last n lines of each file (group), in no order."""
    w = Window.partitionBy(*group).orderBy(F.desc(order))
    return lines.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


#: A dictionary of corrections of up to so many words is held by each worker.
BROADCAST_EDITS = 100_000


def _exchanged(swaps: DataFrame) -> Callable[..., Column]:
    """A function of (cids, fonts) that exchanges glyphs in a row that ``swaps``, a dictionary whose size is checked, names."""
    named = swaps.sparkSession.sparkContext.broadcast([(r["font"], r["cid1"], r["cid2"]) for r in checked(swaps.select("font", "cid1", "cid2").distinct())])

    def run(cids: pa.Array, fonts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(cids), 0).to_numpy()
        if not np.array_equal(sizes, pc.fill_null(pc.list_value_length(fonts), 0).to_numpy()):
            fonts = pa.array([[*(f or []), *[None] * len(c)][: len(c)] if c is not None else None for c, f in zip(cids.to_pylist(), fonts.to_pylist())], pa.list_(pa.string()))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        letters, own = cids.flatten(), fonts.flatten()
        place, codes = {}, {}
        for values, told in ((letters, codes), (own, place)):
            told["of"] = pc.fill_null(pc.dictionary_encode(values).indices, -1).to_numpy(zero_copy_only=False).astype("int64")
            told["by"] = {v: k for k, v in enumerate(pc.dictionary_encode(values).dictionary.to_pylist())}
        n = len(codes["by"]) + 1
        wanted = [(place["by"][f] * n + codes["by"][a]) * n + codes["by"][b] for f, a, b in named.value if f in place["by"] and a in codes["by"] and b in codes["by"]]
        if not wanted:
            return cids
        c, f = codes["of"], place["of"]
        hit = np.isin((f[:-1] * n + c[:-1]) * n + c[1:], wanted) & (f[:-1] == f[1:]) & (f[:-1] >= 0) & (c[:-1] >= 0) & (c[1:] >= 0)
        last = ends[1:-1] - 1  # a word's last glyph has none behind it
        hit[last[(last >= 0) & (last < len(hit))]] = False
        at = np.arange(len(c))
        for k in np.nonzero(hit)[0]:
            at[k], at[k + 1] = at[k + 1], at[k]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), letters.take(pa.array(at)), mask=pc.is_null(cids) if cids.null_count else None)

    return F.arrow_udf(run, "array<string>")


def edit_font_words(words: DataFrame, space_fonts: tuple[str, ...] = (), space_words: DataFrame | None = None, edits: DataFrame | None = None, font_edits: DataFrame | None = None, swaps: DataFrame | None = None) -> DataFrame:
    """Words of glyphs (doc_id, page_idx, word_idx, cids: array<string>, fonts: array<string>) after a document's corrections.

    In this order: words named in ``space_words`` (doc_id, page_idx, word_idx) become blanks; those in ``edits`` (…, text) have another text; words of one font, if it is among ``space_fonts``, become blanks, or, if (font, cids) stands in
    ``font_edits`` (font, cids, text), have that text; and two glyphs in a row that ``swaps`` (font, cid1, cid2) name change places, looked for as they stood."""
    key = [*PAGE, "word_idx"]
    out = words if space_words is None else words.withColumn("_own", F.col("cids"))
    letters = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    blank = lambda a: F.transform(a, lambda c: F.lit(" "))
    if edits is not None:
        out = out.join(edits.select(*key, F.col("text").alias("_edit")), key, "left").withColumn("cids", F.coalesce(letters(F.col("_edit")), F.col("cids"))).drop("_edit")
    if space_words is not None:
        out = out.join(space_words.select(*key).distinct().withColumn("_spaced", F.lit(True)), key, "left").withColumn("cids", F.coalesce(F.when(F.col("_spaced"), blank(F.col("_own"))), F.col("cids"))).drop("_spaced", "_own")
    one = F.size(F.array_distinct("fonts")) == 1
    font = F.get("fonts", F.lit(0))
    if space_fonts:
        out = out.withColumn("cids", F.when(one & font.isin(*space_fonts), blank(F.col("cids"))).otherwise(F.col("cids")))
    if font_edits is not None:
        named = font_edits.select(F.col("font").alias("_font"), F.col("cids").alias("_cids"), F.col("text").alias("_text"))
        if named.limit(BROADCAST_EDITS + 1).count() <= BROADCAST_EDITS:  # else words would be sent by font and glyphs, the frequent ones to one task each
            named = F.broadcast(named)
        out = out.join(named, one & (font == F.col("_font")) & (F.col("cids") == F.col("_cids")), "left").withColumn("cids", F.coalesce(letters(F.col("_text")), F.col("cids"))).drop("_font", "_cids", "_text")
    if swaps is not None:
        out = out.withColumn("cids", _exchanged(swaps)("cids", "fonts"))
    return out


# ---- spans of texts


def punctuation_spans(text: Column) -> Column:
    """(start, end) of . , ; ' and of "in the", in order."""

    def found(letters: Column) -> Column:
        def size(c: Column, i: Column) -> Column:
            phrase = c == "i"
            for k, x in enumerate("n the", 1):
                phrase = phrase & F.coalesce(F.get(letters, i + k) == x, F.lit(False))
            return F.when(c.isin(".", ",", ";", "'"), 1).when(phrase, 6).otherwise(0)

        return F.filter(F.transform(letters, lambda c, i: F.struct(i.cast("int").alias("start"), (i + size(c, i)).cast("int").alias("end"))), lambda s: s["end"] > s["start"])

    # The letters are one element of an array, so that they are split once and not for each of them.
    return F.get(F.transform(F.array(X.characters(text)), found), F.lit(0))


OFFICES = ("the prime minister", "prime minister", "p.m.")


def office_span(text: Column) -> Column:
    """(start, end) of the first of the OFFICES that the text has, in their order; null without one."""
    low = F.lower(text)
    found = None
    for name in OFFICES:
        at = F.instr(low, name) - 1
        span = F.struct(at.cast("int").alias("start"), (at + len(name)).cast("int").alias("end"))
        found = F.when(at >= 0, span) if found is None else found.when(at >= 0, span)
    return found


def to_blank(text: Column, start: Column, end: Column) -> Column:
    """(start, end) of a span whose end, if it lies inside a word, moves to the next blank (to the text's end without one); one that starts among the first 25 characters starts at 0."""
    after = F.trim(F.regexp_replace(F.substr(text, end + 1, F.lit(1)), "[\\p{Punct}]", ""))
    blank = F.instr(F.substr(text, end + 1), F.lit(" "))
    far = F.when(after == "", end).when(blank > 0, end + blank - 1).otherwise(F.length(text))
    return F.struct(F.when(start < 25, 0).otherwise(start).cast("int").alias("start"), far.cast("int").alias("end"))


def relative_path(path: Column, root: str) -> Column:
    """A path below a root, without it; others as they are."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def unique_name(*parts: Column) -> Column:
    """A name that is as unique as its parts, and the same each time they are: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
