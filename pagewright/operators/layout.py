"""Documents as pages of words with boxes, and the lines, neighbours, markers and paragraphs on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as X

PAGE = ("doc_id", "page_idx")
COLUMNS, ROWS = 80, 50
#: Bytes of a documents table that one task splits: some hundred thousand words, whose sorts stay in memory.
PART_BYTES = 1 << 20


def by_document(docs: DataFrame) -> DataFrame:
    """Documents partitioned by doc_id, in as many parts as their plan's size asks for. Parts of a told number aren't put together again by their size as texts, which is a fraction of what their words take.

    The partitioning serves all later joins and groups by document, page and word: so joins are let off the rule that both sides be partitioned by all keys, and groups whose rows are in order already are read in that order, not hashed."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 50:  # not known
        return docs.repartition("doc_id")
    return docs.repartition(max(-(-size // PART_BYTES), 4), "doc_id")


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, page_idx, word_idx, line_no, pos, text, start, xmin, ymin, xmax, ymax): texts set in 80 columns and 50 rows a page, in thousandths of a page.

    Texts are partitioned by document once, before they are split; all windows by document or page keep that partitioning.
    """
    lines = by_document(docs).select("doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    tokens = lines.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("pos", "text")).where("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("line_no", "pos")
    start = F.coalesce(F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    placed = tokens.withColumn("start", start).withColumn("row", F.expr(f"start div {COLUMNS}")).withColumn("column", F.col("start") % COLUMNS)
    placed = placed.withColumn("page_idx", F.expr(f"cast(row div {ROWS} as int)"))
    left = (20 + F.col("column") * 12).cast("int")
    return placed.select(
        "doc_id", "page_idx", (F.row_number().over(Window.partitionBy(*PAGE).orderBy("start")) - 1).alias("word_idx"), "line_no", "pos", "text", "start",
        left.alias("xmin"), (10 + F.col("row") % ROWS * 19).cast("int").alias("ymin"),
        F.least(F.lit(1000), left + F.length("text") * 12).alias("xmax"), (22 + F.col("row") % ROWS * 19).cast("int").alias("ymax"),
    )


def joined(order: Column | str, text: Column | str = "text", separator: str = " ") -> Column:
    """Aggregate: the non-empty texts of a group in an order, joined."""
    pair = F.struct(F.col(order) if isinstance(order, str) else order, (F.col(text) if isinstance(text, str) else text).alias("t"))
    return F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(pair)), lambda p: p["t"] != ""), lambda p: p["t"]), separator)


def quick_lines(page_words: DataFrame, cutoff: float = 5, blank_multiple: float | None = 1.6) -> DataFrame:
    """Words with line_idx: sorted by their middles, a new line begins where the step to the word before is more than ``cutoff``
    thousandths; a step of more than ``blank_multiple`` mean heights leaves an empty line between."""
    mid = (F.col("ymin") + F.col("ymax")) / 2
    order = Window.partitionBy(*PAGE).orderBy("ymid", "word_idx")
    measured = page_words.withColumn("ymid", mid).withColumn("mean_height", F.avg(F.col("ymax") - F.col("ymin")).over(Window.partitionBy(*PAGE)))
    step = F.col("ymid") - F.lag("ymid").over(order)
    jump = F.when(step > cutoff, 1 + (F.when(step > F.col("mean_height") * blank_multiple, 1).otherwise(0) if blank_multiple else F.lit(0))).otherwise(0)
    return measured.withColumn("jump", jump).withColumn("line_idx", F.sum("jump").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("jump", "mean_height", "ymid")


def line_texts(lined: DataFrame) -> DataFrame:
    """(doc_id, page_idx, line_idx, n_words, text) of words with line_idx, left to right."""
    # In order, so that a line is put together as its words come.
    return lined.sortWithinPartitions(*PAGE, "line_idx").groupBy(*PAGE, "line_idx").agg(F.count("*").alias("n_words"), joined(F.struct("xmin", "word_idx")).alias("text"))


def reading_text(page_words: DataFrame, cutoff: float = 5) -> DataFrame:
    """(doc_id, page_idx, text): a page's words line by line."""
    lined = quick_lines(page_words, cutoff, None)
    return lined.groupBy(*PAGE).agg(joined(F.struct("line_idx", "xmin", "word_idx")).alias("text"))


def region_stats(page_words: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Bounding box, words, text length with blanks, and whether all is letters and digits, of each region."""
    shown = F.col("text") != ""
    return page_words.groupBy(*keys).agg(
        *G.union_aggregates(G.box()), F.count("*").alias("n_words"),
        F.greatest(F.lit(0), F.sum(F.length("text")) + F.count_if(shown) - 1).alias("text_len"),
        F.coalesce(F.bool_and(F.when(shown, F.col("text").rlike("^[\\p{L}\\p{N}]+$"))), F.lit(False)).alias("all_alnum"),
    )


def neighbours(page_words: DataFrame, direction: str, offset: float = 1000, overlap: float = 1.0, min_height: float | None = None) -> DataFrame:
    """(doc_id, page_idx, word_idx, other_idx): the words in a direction of each word, within ``offset`` thousandths, that share more than ``overlap`` percent of its
    band. The page and a cell of the band, across the direction, are the equality of the join, so that the residual condition sees few pairs. Above takes no account of the offset."""
    a = page_words.select(*PAGE, "word_idx", "xmin", "ymin", "xmax", "ymax")
    if min_height is not None:
        lack = F.greatest(F.lit(0), F.lit(min_height) - (F.col("ymax") - F.col("ymin"))) / 2
        a = a.withColumn("ymin", F.col("ymin") - lack).withColumn("ymax", F.col("ymax") + lack)
    b = page_words.select(*PAGE, F.col("word_idx").alias("other_idx"), *[F.col(c).alias(f"o_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    own, other = G.box(), G.box("o_")
    page = {"left": F.lit(0), "right": F.lit(1000), "above": F.lit(0), "below": F.lit(1000)}
    if direction in ("left", "right"):
        # Cells of 100 thousandths of the height: a pair meets in the first one that both reach.
        cell = lambda low, high: F.sequence(F.floor(low / 100).cast("int"), F.floor(high / 100).cast("int"))
        a = a.withColumn("cell", F.explode(cell(F.col("ymin"), F.col("ymax"))))
        b = b.withColumn("cell", F.explode(cell(F.col("o_ymin"), F.col("o_ymax"))))
        low = own["xmin"] - offset if direction == "left" else own["xmax"]
        high = own["xmin"] if direction == "left" else own["xmax"] + offset
        band = {"xmin": F.greatest(low, page["left"]), "xmax": F.least(high, page["right"]), "ymin": own["ymin"], "ymax": own["ymax"]}
        first = F.col("cell") == F.floor(F.greatest(own["ymin"], other["ymin"]) / 100)
        side = (other["xmax"] <= own["xmin"]) if direction == "left" else (other["xmin"] >= own["xmax"])
        joined_ = a.join(b, [*PAGE, "cell"]).where(first & side)
    else:
        low = F.lit(0) if direction == "above" else own["ymax"]
        high = own["ymin"] if direction == "above" else own["ymax"] + offset
        band = {"xmin": own["xmin"], "xmax": own["xmax"], "ymin": F.greatest(low, page["above"]), "ymax": F.least(high, page["below"])}
        side = (other["ymax"] <= own["ymin"]) if direction == "above" else (other["ymin"] >= own["ymax"])
        # Cells of 100 thousandths of the width: only words that share a part of their bands can overlap.
        cell = lambda low, high: F.sequence(F.floor(low / 100).cast("int"), F.floor(high / 100).cast("int"))
        a = a.withColumn("cell", F.explode(cell(F.col("xmin"), F.col("xmax"))))
        b = b.withColumn("cell", F.explode(cell(F.col("o_xmin"), F.col("o_xmax"))))
        first = F.col("cell") == F.floor(F.greatest(own["xmin"], other["xmin"]) / 100)
        joined_ = a.join(b, [*PAGE, "cell"]).where(first & side)
    found = joined_.where((F.col("word_idx") != F.col("other_idx")) & (G.overlap_percent(other, band) > overlap))
    return found.select(*PAGE, "word_idx", "other_idx", "o_xmin", "o_xmax")


def nearest(found: DataFrame, direction: str) -> DataFrame:
    """Of each word's neighbours the rightmost to the left, or the leftmost to the right."""
    pick = F.max_by("other_idx", F.struct("o_xmax", "other_idx")) if direction == "left" else F.min_by("other_idx", F.struct("o_xmin", "other_idx"))
    return found.groupBy(*PAGE, "word_idx").agg(pick.alias("nearest_idx"), F.count("*").alias("n_found"))


def markers(page_words: DataFrame, max_value: int = 49, kinds: tuple[int, ...] = (1, 2, 3), x_range: tuple[int, int] = (0, 600), zero: bool = False) -> DataFrame:
    """List markers: words of a marker's form, of an enabled kind and value, strictly within a range of the page, with no letters or digits alone to their left."""
    formed = page_words.withColumn("m", X.marker(F.col("text"))).where(F.col("m.num_type").isin(*kinds) & F.col("m.num_val").between(0 if zero else 1, max_value))
    formed = formed.where(G.in_xrange(G.box(), *x_range))
    # Words of the same row further left: a running maximum says whether one of them is of letters and digits.
    row = Window.partitionBy(*PAGE, "ymin").orderBy("xmin").rowsBetween(Window.unboundedPreceding, -1)
    lefts = page_words.withColumn("busy", F.coalesce(F.max(F.col("text").rlike("^[\\p{L}\\p{N}]+$").cast("int")).over(row), F.lit(0))).where("busy = 0").select(*PAGE, "word_idx")
    kept = formed.join(lefts, [*PAGE, "word_idx"], "left_semi")
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy(*PAGE).orderBy("ymin", "xmin", "word_idx")) - 1).select(*PAGE, "idx", "word_idx", "m.num_type", "m.num_text", "m.num_val", "xmin", "ymin", "xmax", "ymax")


def sequence_errors(marked: DataFrame, group: tuple[str, ...], order: tuple[str, ...], value: str) -> DataFrame:
    """Rows whose value is neither 1 nor one more than the value before, with ``expected``."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*order))
    expected = F.coalesce(before + 1, F.lit(1))
    return marked.withColumn("expected", expected).where((F.col(value) != 1) & (F.col(value) != F.col("expected")))


def list_items(lined: DataFrame, is_marker: Column, keep_marker: bool = False, has_footer: bool = True) -> DataFrame:
    """(doc_id, page_idx, item_idx, word_idxs, text): words between successive markers in reading order; what precedes the first is in no item. Without a footer rule the last item isn't told."""
    order = Window.partitionBy(*PAGE).orderBy("line_idx", "xmin", "word_idx")
    numbered = lined.withColumn("is_marker", is_marker).withColumn("item_idx", F.sum(F.col("is_marker").cast("int")).over(order)).where("item_idx > 0")
    if not has_footer:
        numbered = numbered.withColumn("last", F.max("item_idx").over(Window.partitionBy(*PAGE))).where("item_idx < last")
    inside = numbered if keep_marker else numbered.where(~F.col("is_marker"))
    at = F.struct("line_idx", "xmin", "word_idx")
    return inside.groupBy(*PAGE, "item_idx").agg(F.transform(F.sort_array(F.collect_list(at)), lambda s: s["word_idx"]).alias("word_idxs"), joined(at).alias("text"))


def without_footer(lined: DataFrame, gap: float = 2.0) -> DataFrame:
    """Lines of a page up to the first that ends in a stop, comma or semicolon (that one included) or that stands before a gap of more than ``gap`` mean heights."""
    per_line = lined.groupBy(*PAGE, "line_idx").agg(F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax"), joined(F.struct("xmin", "word_idx")).alias("text"), F.avg(F.col("ymax") - F.col("ymin")).alias("h"))
    order = Window.partitionBy(*PAGE).orderBy("line_idx")
    height = F.avg("h").over(Window.partitionBy(*PAGE))
    after_gap = F.col("ymin") - F.lag("ymax").over(order) > height * gap
    ended = F.lag(F.col("text").rlike("[.,;][ ]*$")).over(order)
    stop = F.sum((after_gap | ended).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return per_line.withColumn("stop", F.coalesce(stop, F.lit(0))).where("stop = 0").select(*PAGE, "line_idx", "text")


def first_words(lined: DataFrame, x_range: tuple[int, int]) -> DataFrame:
    """The first word of each line within a range of the page, if it begins with a capital and has small letters."""
    inside = lined.where(G.in_xrange(G.box(), *x_range, partial=True))
    first = inside.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE, "line_idx").orderBy("xmin", "word_idx"))).where("rank = 1")
    return first.where(F.col("text").rlike("^[A-Z].*[a-z]")).select(*PAGE, "line_idx", "word_idx", "text")


def paragraphs(lined: DataFrame, indent: int = 50) -> DataFrame:
    """(doc_id, page_idx, line_idx, para_idx, is_heading): a new paragraph begins behind a blank line, at a change of indentation of more than ``indent`` thousandths, and
    around a centred line of fewer than 3 words, which is a heading."""
    lines = lined.groupBy(*PAGE, "line_idx").agg(F.min("xmin").alias("x0"), F.max("xmax").alias("x1"), F.count_if(F.col("text") != "").alias("n"))
    page, order = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE).orderBy("line_idx")
    marked = lines.withColumn("left", F.min("x0").over(page)).withColumn("right", F.max("x1").over(page))
    marked = marked.withColumn("is_heading", (F.col("x0") > F.col("left") + 100) & (F.col("x1") < F.col("right") - 100) & (F.col("n") < 3))
    new = (F.col("line_idx") - F.lag("line_idx").over(order) > 1) | F.lag("is_heading").over(order) | (F.abs(F.col("x0") - F.lag("x0").over(order)) > indent)
    new = F.coalesce(new & ~F.col("is_heading") | (F.col("line_idx") - F.lag("line_idx").over(order) > 1) | F.lag("is_heading").over(order), F.lit(False))
    return marked.withColumn("para_idx", F.sum(new.cast("int")).over(order).cast("int")).select(*PAGE, "line_idx", "para_idx", "is_heading")


def full_lines(page_words: DataFrame, para_indent: bool = False, blank_multiple: float = 1.6) -> DataFrame:
    """(doc_id, page_idx, word_idx, line_num) by neighbour positions and a profile of the page's columns, page by page in one worker: each word gets the number after the
    largest of the slots above it and writes it into them, to the page's edges for first and last words. Coordinates in thousandths."""

    def number(texts: list[str], x0: list[float], x1: list[float], y0: list[float], y1: list[float]) -> list[int]:
        n = len(texts)
        tallest = max((b - a for a, b in zip(y0, y1)), default=0)
        height = sum(b - a for a, b in zip(y0, y1)) / max(n, 1)
        by_row = sorted(range(n), key=lambda i: (y0[i], i))
        lefts: list[list[int]] = [[] for _ in range(n)]
        rights: list[list[int]] = [[] for _ in range(n)]
        at = 0
        for k, i in enumerate(by_row):
            lack = max(0.0, height - (y1[i] - y0[i])) / 2
            low, high = y0[i] - lack, y1[i] + lack
            # What ends above the word, whatever its lack of height, is passed by for good.
            far = max(low - 2 * height - 100, y0[i] - height / 2 - tallest - 1e-9)
            while at < k and y0[by_row[at]] < far:
                at += 1
            for p in range(at, n):
                j = by_row[p]
                if y0[j] > high:
                    break
                if j == i or y1[j] < low:
                    continue
                tall = y1[j] - y0[j]
                shared = min(y1[j], high) - max(y0[j], low)
                if (100 if tall == 0 else int(shared * 100 / tall)) > 40:
                    if x1[j] <= x0[i] + 1e-9:
                        lefts[i].append(j)
                    elif x0[j] >= x1[i] - 1e-9:
                        rights[i].append(j)
        slots = [0] * 1000
        if para_indent and (first := next((i for i in by_row if not lefts[i] and rights[i]), None)) is not None:
            slots[: max(int(x0[first]) - 5, 0)] = [1] * max(int(x0[first]) - 5, 0)
        merged: dict[int, int] = {}
        for i in by_row:
            if 0 < len(texts[i]) < 3 and i not in merged:
                near = [(j, x0[i] - x1[j]) for j in sorted(lefts[i], key=lambda j: -x1[j])[:1]] + [(j, x0[j] - x1[i]) for j in sorted(rights[i], key=lambda j: x0[j])[:1]]
                for j, gap in near:
                    if j not in merged and i not in merged.values() and gap < 50:
                        merged[i] = j
                        break
        numbers = [0] * n
        previous = None
        for i in by_row:
            if i in merged:
                continue
            if previous is not None and y0[i] - previous > height * blank_multiple:
                slots = [max(slots) + 1] * 1000
            previous = y0[i]
            a, b = min(abs(int(x0[i])), 999), min(int(x1[i]), 1000)
            own = max(slots[a:b], default=slots[a])
            numbers[i] = own if not texts[i] else own + 1
            left = 0 if not lefts[i] else a
            right = 1000 if not rights[i] else max(b, a + 1)
            slots[left:right] = [numbers[i]] * (right - left)
        for i, j in merged.items():
            while j in merged:
                j = merged[j]
            numbers[i] = numbers[j]
        return numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, rows = batch.column(2).offsets.to_pylist(), batch.column(2).values
            fields = [rows.field(c).to_pylist() for c in ("text", "xmin", "xmax", "ymin", "ymax")]
            numbers = [v for a, b in zip(ends, ends[1:]) for v in number(*(f[a:b] for f in fields))]
            page = pa.array(np.repeat(np.arange(len(ends) - 1), np.diff(ends)))
            words_ = rows.field("word_idx")[ends[0] : ends[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(page), batch.column(1).take(page), words_, pa.array(numbers, pa.int32())], [*PAGE, "word_idx", "line_num"])

    word = F.struct(F.col("word_idx").cast("int").alias("word_idx"), "text", *[F.col(c).cast("double").alias(c) for c in ("xmin", "xmax", "ymin", "ymax")])
    pages = page_words.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_idx").cast("int").alias("page_idx")).agg(F.array_sort(F.collect_list(word)).alias("_words"))
    return pages.mapInArrow(run, "doc_id bigint, page_idx int, word_idx int, line_num int")


def rotated(page_words: DataFrame, angle: Column, width: int, height: int) -> DataFrame:
    """The words of pages turned by an angle: the boxes around their turned corners, in pixels of the turned page."""
    size = (F.lit(width), F.lit(height))
    after = G.rotated_size(*size, angle)
    corners = [(F.col(x) * width / 1000, F.col(y) * height / 1000) for x in ("xmin", "xmax") for y in ("ymin", "ymax")]
    turned = [G.rotated_point(x, y, angle, size, after) for x, y in corners]
    return page_words.withColumns({"xmin": F.least(*(p[0] for p in turned)), "ymin": F.least(*(p[1] for p in turned)), "xmax": F.greatest(*(p[0] for p in turned)), "ymax": F.greatest(*(p[1] for p in turned))})


def skew(points: DataFrame, group: tuple[str, ...], x: Column, y: Column, least: int = 3) -> DataFrame:
    """(group, angle): the slope of x over y, in degrees; null of fewer than ``least`` points."""
    slope = F.degrees(F.atan(F.coalesce(F.regr_slope(x, y), F.lit(0.0))))
    return points.groupBy(*group).agg(F.count("*").alias("n_points"), F.when(F.count("*") >= least, slope).alias("angle"))


def adjacent(lined: DataFrame, n: int = 2) -> DataFrame:
    """Runs of up to ``n`` words that follow one another in a line."""
    order = Window.partitionBy(*PAGE, "line_no").orderBy("pos", "word_idx")
    run = F.collect_list("text").over(order.rowsBetween(0, n - 1))
    return lined.withColumn("gram", F.array_join(run, " ")).withColumn("gram_size", F.size(run))


def batches(page_words: DataFrame, budget: int) -> DataFrame:
    """Texts with batch_idx: a batch takes texts in order while their words are within a budget; a longer text has a batch of its own."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        batch, used, out = 0, 0, []
        for size in rows["size"]:
            if used and used + size > budget:
                batch, used = batch + 1, 0
            used += size
            out.append(batch)
        return rows.assign(batch_idx=out)[["doc_id", "idx", "size", "batch_idx"]]

    return page_words.groupBy("doc_id").applyInPandas(fold, "doc_id bigint, idx int, size int, batch_idx int")


