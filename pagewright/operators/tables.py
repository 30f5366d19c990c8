"""Tables from words and boxes: cells, boundaries, row and column lines, and their checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.operators.layout import PAGE, joined
from pagewright.operators.regions import names_a_serial


TABLE = (*PAGE, "table_idx")


def _bands(bands: DataFrame, index: str, low: str, high: str, name: str) -> DataFrame:
    """A table's bands as one array, in the order of their index; as long as a table has rows or columns."""
    return bands.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(low).alias("low"), F.col(high).alias("high")))).alias(name))


#: So many bands of a table are tried by compiled code; those behind them, where there are any, one by one.
COMPILED_BANDS = 8


def _first_band(bands: str, holds: Callable[[Column], Column]) -> Column:
    """The index of the first band of an array for which a condition holds; null of none."""
    n, out = F.size(bands), F
    for k in range(COMPILED_BANDS):
        band = F.get(bands, F.lit(k))
        out = out.when((n > k) & holds(band), band["i"])
    return out.when(n > COMPILED_BANDS, F.get(F.filter(F.slice(bands, COMPILED_BANDS + 1, F.greatest(n - COMPILED_BANDS, F.lit(0))), holds), F.lit(0))["i"])


def cells_first_match(words: DataFrame, rows: DataFrame, columns: DataFrame, percent: int = 50, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page_idx, table_idx, word_idx, row_idx, col_idx): each word of a page in its first cell of each table there: the least (row_idx, col_idx) of which the row's and the column's band both cover ``percent`` of the word.
    rows: (doc_id, page_idx, table_idx, row_idx, y0, y1); columns: (…, col_idx, x0, x1). A word that no row takes is offered to the next, so the least row that takes it is the one; see leftovers for the others. ``also``: columns of the words to keep."""
    grid = _bands(rows, "row_idx", "y0", "y1", "_rows").join(_bands(columns, "col_idx", "x0", "x1", "_columns"), list(TABLE))
    own = G.box()
    across = {"xmin": F.lit(-1), "xmax": F.lit(1001)}
    down = {"ymin": F.lit(-1), "ymax": F.lit(1001)}
    in_row = _first_band("_rows", lambda r: G.overlap_percent(own, across | {"ymin": r["low"], "ymax": r["high"]}) >= percent)
    in_column = _first_band("_columns", lambda c: G.overlap_percent(own, down | {"xmin": c["low"], "xmax": c["high"]}) >= percent)
    # As an array's element, a cell is looked for once; a condition on it would else be put before the look-up and look for it, too.
    cell = F.explode(F.array(F.struct(in_row.alias("row_idx"), in_column.alias("col_idx")))).alias("_cell")
    placed = words.join(grid, list(PAGE)).select(*TABLE, "word_idx", *also, cell).where("_cell.row_idx is not null and _cell.col_idx is not null")
    return placed.select(*TABLE, "word_idx", "_cell.row_idx", "_cell.col_idx", *also)


def leftovers(words: DataFrame, tables: DataFrame, placed: DataFrame) -> DataFrame:
    """Words (with table_idx) of the pages of tables (doc_id, page_idx, table_idx) that are in no cell of theirs."""
    key = [*TABLE, "word_idx"]
    return words.join(tables.select(*TABLE).distinct(), list(PAGE)).join(placed.select(*key).distinct(), key, "left_anti")


def cells_all_matches(words: DataFrame, cells: DataFrame, percent: int = 70) -> DataFrame:
    """(doc_id, page_idx, table_idx, word_idx, row_idx, col_idx): each word with every cell of its page (doc_id, page_idx, table_idx, row_idx, col_idx, x0, y0, x1, y1) that covers more than ``percent`` of it."""
    fields = ("row_idx", "col_idx", "x0", "y0", "x1", "y1")
    grid = cells.groupBy(*TABLE).agg(F.collect_list(F.struct(*fields)).alias("_cells"))
    cell = lambda c: {"xmin": c["x0"], "ymin": c["y0"], "xmax": c["x1"], "ymax": c["y1"]}
    held = words.join(grid, list(PAGE)).select(*TABLE, "word_idx", F.explode(F.filter("_cells", lambda c: G.overlap_percent(G.box(), cell(c)) > percent)).alias("c"))
    return held.select(*TABLE, "word_idx", "c.row_idx", "c.col_idx")


def kept_rows(placed: DataFrame, words: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, page_idx, table_idx, row_idx, n_words, is_header) of rows of placed words that have ``least`` words with a text; a header's first cell names a serial number."""
    both = placed.join(words.select(*PAGE, "word_idx", "text", "xmin"), [*PAGE, "word_idx"])
    first = joined(F.struct("xmin", "word_idx"), F.when(F.col("col_idx") == 0, F.col("text")).otherwise(""))
    rows = both.groupBy(*TABLE, "row_idx").agg(F.count_if(F.col("text") != "").alias("n_words"), first.alias("_head"))
    return rows.where(F.col("n_words") >= least).withColumn("is_header", names_a_serial(F.col("_head"))).drop("_head")


def clipped_area(polygon: list[tuple[float, float]], window: list[tuple[float, float]]) -> float:
    """The area that two convex polygons share (both clockwise or both not; any order of the window's turn is put right)."""

    def area(p: list[tuple[float, float]]) -> float:
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2

    if area(window) < 0:
        window = window[::-1]
    out = polygon
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1]):
        source, out = out, []
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in source]
        for k, (p, s) in enumerate(zip(source, side)):
            q, r = source[k - 1], side[k - 1]
            if (s >= 0) != (r >= 0):
                t = r / (r - s)
                out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if s >= 0:
                out.append(p)
    return abs(area(out)) if len(out) > 2 else 0.0


def hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The convex hull of points, counter-clockwise from the least."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ps: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    low, high = half(points), half(points[::-1])
    return low[:-1] + high[:-1]


def cells_by_polygon(words: DataFrame, cells: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id, page_idx, table_idx, word_idx, row_idx, col_idx): each word in the first (row, column) of its page's convex cells (doc_id, page_idx, table_idx, row_idx, col_idx, polygon: array of x, y, turning either way)
    that covers more than ``share`` of its box. A page's words and a table's cells meet as arrays: boxes that lie whole in a cell are told by their corners, those across a side of a cell that is a box itself by the shared box; all others are clipped."""
    double = lambda c: F.col(c).cast("double").alias(c)
    points = F.transform("polygon", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    grid = cells.where(F.size("polygon") > 0).groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", points.alias("p")))).alias("_cells"))
    boxes = words.select(*PAGE, F.struct("word_idx", *[double(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("w")).where((F.col("w.xmax") > F.col("w.xmin")) & (F.col("w.ymax") > F.col("w.ymin")))
    both = boxes.groupBy(*PAGE).agg(F.collect_list("w").alias("_words")).join(grid, list(PAGE)).select(*TABLE, "_words", "_cells")
    kinds = {c: f.dataType.simpleString() for f in [*cells.schema, *words.schema] for c in [f.name]}

    def first_cells(own: pa.StructArray, table: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that have a cell, and of their cells."""
        x0, y0, x1, y1 = (own.field(c).to_numpy() for c in ("xmin", "ymin", "xmax", "ymax"))
        polygons = [[(q["x"], q["y"]) for q in p] for p in table.field("p").to_pylist()]
        most = max(map(len, polygons))
        corners = np.array([p + p[-1:] * (most - len(p)) for p in polygons], dtype="float64")  # those of fewer repeat the last one
        px, py = corners[:, :, 0], corners[:, :, 1]
        left, right, top, bottom = px.min(1), px.max(1), py.min(1), py.max(1)
        word, cell = np.nonzero((x1[:, None] > left) & (x0[:, None] < right) & (y1[:, None] > top) & (y0[:, None] < bottom))
        ax, ay = px[cell], py[cell]
        dx, dy = np.roll(ax, -1, 1) - ax, np.roll(ay, -1, 1) - ay
        above = below = np.ones(len(word), dtype=bool)
        for x in (x0[word, None], x1[word, None]):
            for y in (y0[word, None], y1[word, None]):
                side = dx * (y - ay) - dy * (x - ax)
                above, below = above & (side >= 0).all(1), below & (side <= 0).all(1)
        inside = above | below
        size = np.abs((px * np.roll(py, -1, 1) - np.roll(px, -1, 1) * py).sum(1)) / 2
        is_box = (size == (right - left) * (bottom - top))[cell]
        shared = (np.minimum(x1[word], right[cell]) - np.maximum(x0[word], left[cell])) * (np.minimum(y1[word], bottom[cell]) - np.maximum(y0[word], top[cell]))
        for k in np.nonzero(~inside & ~is_box)[0]:
            a, b, c, d = x0[word[k]], y0[word[k]], x1[word[k]], y1[word[k]]
            shared[k] = clipped_area([(a, b), (c, b), (c, d), (a, d)], polygons[cell[k]])
        taken = np.nonzero(inside | (shared / ((x1 - x0) * (y1 - y0))[word] > share))[0]
        number = own.field("word_idx").to_numpy()[word[taken]]
        order = taken[np.lexsort((cell[taken], number))]
        first = np.unique(own.field("word_idx").to_numpy()[word[order]], return_index=True)[1]
        return word[order][first], cell[order][first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, table = batch.column(3)[k].values, batch.column(4)[k].values
                word, cell = first_cells(own, table)
                keys = [pa.repeat(batch.column(c)[k], len(word)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, own.field("word_idx").take(pa.array(word)), *[table.field(c).take(pa.array(cell)) for c in ("row_idx", "col_idx")]], [*TABLE, "word_idx", "row_idx", "col_idx"])

    return both.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*TABLE, "word_idx", "row_idx", "col_idx")))


def depth_histogram(words: DataFrame, group: tuple[str, ...] = PAGE) -> DataFrame:
    """(group, slot, depth): how many words cover each thousandth of the width."""
    a, b = F.col("xmin").cast("int"), F.least(F.col("xmax").cast("int"), F.lit(999))
    # A word counts where it begins and behind its end; only the runs between such places are made slots.
    steps = F.explode(F.array(F.struct(F.least(a, b).alias("at"), F.lit(1).alias("d")), F.struct((F.greatest(a, b) + 1).alias("at"), F.lit(-1).alias("d")))).alias("s")
    changes = words.where("xmin < 1000").select(*group, steps).groupBy(*group, F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    order = Window.partitionBy(*group).orderBy("at")
    runs = changes.withColumn("depth", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("to", F.lead("at").over(order)).where("depth > 0")
    return runs.select(*group, F.explode(F.sequence("at", F.col("to") - 1)).alias("slot"), "depth")


def widest_gap(words: DataFrame, group: tuple[str, ...] = PAGE, x_range: tuple[int, int] = (0, 1000), widen: int = 5) -> DataFrame:
    """(group, gap_start, gap_end): the longest run of slots without a word within a range (the first of equals), ``widen`` slots wider on both sides. Groups without one are left out."""
    low, high = x_range
    kept = words.where((F.col("xmin") < min(1000, high)) & (F.least(F.col("xmax"), F.lit(999)) >= low))
    covered = kept.select(*group, F.greatest(F.col("xmin").cast("int"), F.lit(low)).alias("a"), F.least(F.col("xmax").cast("int"), F.lit(min(999, high - 1))).alias("b"))
    # A gap lies before each word that begins behind all words before it, and behind the last; no slot is looked at by itself.
    order = Window.partitionBy(*group).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    reach = covered.withColumn("reach", F.coalesce(F.max("b").over(order), F.lit(low - 1)))
    gap = lambda to, before: F.struct((to - before - 1).alias("size"), (-before).alias("before"))
    found = reach.groupBy(*group).agg(F.greatest(F.max(gap(F.col("a"), F.col("reach"))), gap(F.lit(high), F.max("b"))).alias("gap")).where("gap.size > 0")
    start = 1 - F.col("gap.before")
    return found.select(*group, (start - widen).alias("gap_start"), (start + F.col("gap.size") + widen).alias("gap_end"))


def serial_errors(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows of numbered tables whose number isn't the one expected: one more than the last that could be read, and two more for each unreadable one (null or 0) since.
    The first readable number of a table is taken as it is."""
    w = Window.partitionBy(group).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    readable = F.when(F.col(value) != 0, F.col(value))
    at = F.row_number().over(w)
    marked = rows.withColumn("v", readable).withColumn("at", at)
    last = F.last("v", ignorenulls=True).over(before)
    last_at = F.last(F.when(F.col("v").isNotNull(), F.col("at")), ignorenulls=True).over(before)
    expected = last + 1 + 2 * (F.col("at") - last_at - 1)
    return marked.withColumn("expected", expected).where(F.col("expected").isNotNull() & (F.col("v").isNull() | (F.col("v") != F.col("expected")))).select(group, order, value, "expected")


def split_tables(rows: DataFrame, group: tuple[str, ...], order: str, value: str) -> DataFrame:
    """Rows with table_idx: a new table begins where the value is 1, the first row aside."""
    w = Window.partitionBy(*group).orderBy(order)
    new = ((F.col(value) == 1) & (F.row_number().over(w) > 1)).cast("int")
    return rows.withColumn("new", new).withColumn("table_idx", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("new")


def table_errors(cells: DataFrame) -> DataFrame:
    """(table, error_name, row_idx, col_idx) of cells (table, row_idx, col_idx, text): empty cells, and rows of another number of cells than the table's most frequent."""
    empty = cells.where(F.trim(F.coalesce("text", F.lit(""))) == "").select("table", F.lit("EmptyCell").alias("error_name"), "row_idx", "col_idx")
    sizes = cells.groupBy("table", "row_idx").agg(F.count("*").alias("n"))
    usual = sizes.groupBy("table", "n").agg(F.count("*").alias("times")).groupBy("table").agg(F.max_by("n", F.struct("times", -F.col("n"))).alias("usual"))
    wrong = sizes.join(usual, "table").where("n <> usual").select("table", F.lit("ColumnCount").alias("error_name"), "row_idx", F.lit(None).cast("int").alias("col_idx"))
    return empty.unionByName(wrong)


def leader_clusters(rows: DataFrame, group: str, value: str, tolerance: float) -> DataFrame:
    """(group, cluster_idx, leader, members): values in order, each in the open cluster if it is within a tolerance of the cluster's first value."""
    ordered = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("vs"))
    kind = "array<struct<leader:double,members:array<double>>>"

    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["leader"].alias("leader"), F.concat(last["members"], F.array(v)).alias("members"))))
        fresh = F.concat(acc, F.array(F.struct(v.alias("leader"), F.array(v).alias("members"))))
        return F.when((F.size(acc) > 0) & (v - last["leader"] <= tolerance), grown).otherwise(fresh)

    folded = ordered.select(group, F.posexplode(F.aggregate("vs", F.array().cast(kind), step)).alias("cluster_idx", "c"))
    return folded.select(group, "cluster_idx", F.col("c.leader").alias("leader"), F.size("c.members").alias("n_members"))


def merged_lines(rows: DataFrame, group: str, value: str, gap: float) -> DataFrame:
    """(group, lines): positions in order, each averaged with the last one kept if they are closer than a gap."""
    ordered = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("vs"))

    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (v - last < gap), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array((last + v) / 2))).otherwise(F.concat(acc, F.array(v)))

    return ordered.select(group, F.aggregate("vs", F.array().cast("array<double>"), step).alias("lines"))


def merged_ranges(rows: DataFrame, group: tuple[str, ...], start: str, end: str, gap: float) -> DataFrame:
    """(group, start, end): ranges joined where the next begins within a gap of all before it."""
    w = Window.partitionBy(*group).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) - reach <= gap, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("island", island).groupBy(*group, "island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("island")


def longest_cut(rows: DataFrame, group: str, length: str, share: float = 0.05) -> DataFrame:
    """The rows of each group on the long side of the widest step between lengths in order, if that is more than a share of the longest."""
    w = Window.partitionBy(group).orderBy(length)
    steps = rows.withColumn("step", F.lead(length).over(w) - F.col(length))
    cut = steps.groupBy(group).agg(F.max_by(length, F.struct("step", length)).alias("at"), F.max("step").alias("widest"), F.max(length).alias("longest"))
    return rows.join(cut, group).where((F.col("widest") > F.col("longest") * share) & (F.col(length) > F.col("at")) | (F.coalesce("widest", F.lit(0)) <= F.col("longest") * share)).select(*rows.columns)


def titles(page_words: DataFrame, tables: DataFrame, band: int = 50) -> DataFrame:
    """(doc_id, page_idx, table_idx, title): capital words in a band above tables (doc_id, page_idx, table_idx, top)."""
    capital = F.col("text").rlike("[A-Z]") & (F.col("text") == F.upper("text"))
    above = page_words.where(capital).join(tables, list(PAGE)).where((F.col("ymax") <= F.col("top")) & (F.col("ymin") >= F.col("top") - band))
    return above.groupBy(*PAGE, "table_idx").agg(joined(F.struct("ymin", "xmin", "word_idx")).alias("title"))
