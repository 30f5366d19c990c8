"""What goes before and after models that are plugged in: boxes, labels, edges, angles and checks of training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.layout import PAGE, joined


def detected(predictions: DataFrame, least: float = 0.9, label: str | None = None) -> DataFrame:
    """Boxes (doc_id, page_idx, box_idx, x0, y0, x1, y1) of predictions (doc_id, page_idx, score, label, x0, y0, x1, y1) above a score, numbered down the page and from left to right; a null score is none."""
    kept = predictions.where(F.col("score") > least)
    if label is not None:
        kept = kept.where(F.col("label") == label)
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "y1", "x1")
    return kept.select(*PAGE, (F.row_number().over(order) - 1).alias("box_idx"), "x0", "y0", "x1", "y1")


def table_edges(predictions: DataFrame, least: float = 0.6, gap: float = 5.0) -> DataFrame:
    """(doc_id, page_idx, table_idx, orientation, positions): the lines between detected rows ('h') and columns ('v'): their boxes' upper and lower, or left and right, sides above a score; sides closer than ``gap``, each to the one before it, are one line, at their mean."""
    kept = predictions.where((F.col("score") > least) & F.col("label").isin("row", "column"))
    sides = kept.select(*PAGE, "table_idx", F.when(F.col("label") == "row", "h").otherwise("v").alias("orientation"), F.explode(F.when(F.col("label") == "row", F.array("y0", "y1")).otherwise(F.array("x0", "x1"))).alias("at"))
    group = [*PAGE, "table_idx", "orientation"]
    order = Window.partitionBy(*group).orderBy("at")
    new = F.coalesce((F.col("at") - F.lag("at").over(order) >= gap).cast("int"), F.lit(0))
    lines = sides.withColumn("_new", new).withColumn("_line", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*group, "_line").agg(F.avg("at").alias("at"))
    return lines.groupBy(*group).agg(F.array_sort(F.collect_list("at")).alias("positions"))


def column_errors(edges: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, page_idx, table_idx, columns, expected) of tables whose 'v' positions bound another number of columns than expected of their document (doc_id, expected)."""
    n = F.size("positions") - 1
    return edges.where("orientation = 'v'").join(expected, "doc_id").where(n != F.col("expected")).select(*PAGE, "table_idx", n.alias("columns"), "expected")


def label_of(tag: Column) -> Column:
    """A tag's label: without its B- or I-; null of O."""
    return F.when(tag != "O", F.substring(tag, 3, 1 << 30))


def word_labels(tags: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page_idx, label, word_idxs, text) of tags (doc_id, page_idx, word_idx, tag): the words of each label of a page, in order. Of several tags of one word, as those of parts of a word, the first by ``part`` counts."""
    first = tags.groupBy(*PAGE, "word_idx").agg(F.min_by("tag", "part").alias("tag"))
    labelled = first.withColumn("label", label_of(F.col("tag"))).where("label is not null").join(words.select(*PAGE, "word_idx", "text"), [*PAGE, "word_idx"])
    return labelled.groupBy(*PAGE, "label").agg(F.array_sort(F.collect_list("word_idx")).alias("word_idxs"), joined("word_idx").alias("text"))


def batches(words: DataFrame, chunk: int = 50, together: int = 10) -> DataFrame:
    """Words with chunk_idx and batch_idx of their document: ``chunk`` successive words of a page at a time, ``together`` chunks in a batch, as a model takes them."""
    at = F.row_number().over(Window.partitionBy(*PAGE).orderBy("word_idx")) - 1
    chunks = words.withColumn("_c", F.floor(at / chunk).cast("int"))
    numbered = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page_idx", "_c")) - 1
    return chunks.withColumn("chunk_idx", numbered).withColumn("batch_idx", F.floor(F.col("chunk_idx") / together).cast("int")).drop("_c")


def training_errors(rows: DataFrame) -> DataFrame:
    """(id, error) of rows (id, words, boxes, labels: arrays) that can't be learned from: of unequal lengths, or with a box that hasn't four numbers in 0 … 1000."""
    unequal = (F.size("words") != F.size("boxes")) | (F.size("words") != F.size("labels"))
    bad = F.exists("boxes", lambda b: (F.size(b) != 4) | F.exists(b, lambda v: v.isNull() | (v < 0) | (v > 1000)))
    return rows.select("id", F.when(unequal, "UnequalLengths").when(bad, "BadBox").alias("error")).where("error is not null")


def crop_pixels(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """struct<left, top, right, bottom> in whole pixels of a box in parts of a page."""
    at = lambda v, size: (v * size).cast("int")
    return F.struct(at(x0, width).alias("left"), at(y0, height).alias("top"), at(x1, width).alias("right"), at(y1, height).alias("bottom"))


def image_path(path: Column, prefix: str, stub: str, add: bool = True) -> Column:
    """A page image's path with a stub behind the prefix, or without it; paths of another prefix stay."""
    long, short = f"{prefix}/{stub}/", f"{prefix}/"
    if add:
        return F.when(F.startswith(path, F.lit(short)) & ~F.startswith(path, F.lit(long)), F.concat(F.lit(long), F.substring(path, len(short) + 1, 1 << 30))).otherwise(path)
    return F.when(F.startswith(path, F.lit(long)), F.concat(F.lit(short), F.substring(path, len(long) + 1, 1 << 30))).otherwise(path)


def resized(width: Column, height: Column, most: int) -> Column:
    """struct<width, height, ratio> of an image brought to at most a length on its longer side; smaller ones stay."""
    ratio = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct((width * ratio).cast("int").alias("width"), (height * ratio).cast("int").alias("height"), ratio.alias("ratio"))
