"""Media as tables of time: transcripts, intervals, scenes and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept_intervals(media: DataFrame, removed: str = "removed", duration: str = "duration") -> DataFrame:
    """Rows with ``kept``: what of [0, duration) the removed intervals (array of struct<start, end>) leave."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, s: Column) -> Column:
        gap = F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end"))).cast(kind)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] > acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    def last(acc: Column) -> Column:
        return F.when(acc["at"] < F.col(duration), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), F.col(duration).cast("int").alias("end"))).cast(kind))).otherwise(acc["out"])

    return media.withColumn("kept", F.aggregate(F.array_sort(removed), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, last))


def trimmed_duration(intervals: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """(group, duration): the seconds of the intervals, as they are, added."""
    return intervals.groupBy(group).agg(F.sum(F.col(end) - F.col(start)).alias("duration"))


def scenes(rows: DataFrame, group: tuple[str, ...], order: str, value: str) -> DataFrame:
    """(group, scene_idx, value, start, end, n): runs of equal values in order; null equals null."""
    w = Window.partitionBy(*group).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = rows.withColumn("_new", new).withColumn("scene_idx", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*group, "scene_idx").agg(F.first(value).alias(value), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))


def grid(intervals: DataFrame, start: str, end: str, step: int) -> DataFrame:
    """Intervals with t: every ``step`` seconds from the start, up to the end."""
    return intervals.where(F.col(end) >= F.col(start)).withColumn("t", F.explode(F.sequence(F.col(start), F.col(end), F.lit(step))))


def fine_grid(coarse_hits: DataFrame, group: str, coarse: int, fine: int) -> DataFrame:
    """(group, t): the finer times around the hits of a first pass, each once."""
    return coarse_hits.select(group, F.explode(F.sequence(F.greatest(F.lit(0), F.col("t") - coarse), F.col("t") + coarse - fine, F.lit(fine))).alias("t")).distinct()


def scene_text(frames: DataFrame, group: str, text: str = "text", least: int = 10) -> DataFrame:
    """(group, text): the most frequent text of more than ``least`` characters; the longer, then the greater among equals."""
    counted = frames.withColumn("_t", F.trim(F.col(text))).where(F.length("_t") > least).groupBy(group, "_t").agg(F.count("*").alias("_n"))
    return counted.groupBy(group).agg(F.max_by("_t", F.struct("_n", F.length("_t"), "_t")).alias("text"))


def frame_index(rate: Column, secs: Column) -> Column:
    return F.floor(rate * secs).cast("int")


def crop_pixels(box: dict[str, Column], width: Column, height: Column) -> list[Column]:
    """A box of 0 … 1 in whole pixels: x, y, width, height."""
    x, y = F.floor(box["xmin"] * width).cast("int"), F.floor(box["ymin"] * height).cast("int")
    return [x.alias("x"), y.alias("y"), (F.floor(box["xmax"] * width).cast("int") - x).alias("w"), (F.floor(box["ymax"] * height).cast("int") - y).alias("h")]


def transcript_words(results: DataFrame) -> DataFrame:
    """(file, word_idx, text, start_ms, end_ms, chunk_idx) of recognition results (file, chunk_idx, chunk_start_ms, words array<struct<word, start, end>>), times such as '1.5s' from the chunk's start."""
    ms = lambda c: F.bround(F.rtrim(c, F.lit("s")).cast("decimal(18,6)") * 1000).cast("int")
    each = results.select("file", "chunk_idx", "chunk_start_ms", F.posexplode("words").alias("pos", "w"))
    order = Window.partitionBy("file").orderBy("chunk_idx", "pos")
    return each.select("file", (F.row_number().over(order) - 1).alias("word_idx"), F.col("w.word").alias("text"), (ms(F.col("w.start")) + F.col("chunk_start_ms")).alias("start_ms"), (ms(F.col("w.end")) + F.col("chunk_start_ms")).alias("end_ms"), "chunk_idx")
