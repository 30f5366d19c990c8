"""Documents from JSON, recognition responses and files; pages and words through a pluggable reader."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.operators.layout import PAGE

DOCUMENT = """pdf_name STRING, pdf_path STRING, pipe_names ARRAY<STRING>,
 pages ARRAY<STRUCT<page_idx INT, width INT, height INT, words ARRAY<STRUCT<word_idx INT, text STRING, orig_text STRING, break_type INT, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE>>>>"""
VERTEX = "ARRAY<STRUCT<x DOUBLE, y DOUBLE>>"
_WORD = f"STRUCT<boundingBox: STRUCT<normalizedVertices: {VERTEX}>, symbols: ARRAY<STRUCT<text: STRING, property: STRUCT<detectedBreak: STRUCT<type: STRING>>>>>"
_BLOCK = f"STRUCT<paragraphs: ARRAY<STRUCT<words: ARRAY<{_WORD}>>>>"
RESPONSE = f"STRUCT<responses: ARRAY<STRUCT<fullTextAnnotation: STRUCT<pages: ARRAY<STRUCT<width: INT, height: INT, blocks: ARRAY<{_BLOCK}>>>>>>>"
BREAKS = {"SPACE": 1, "SURE_SPACE": 2, "EOL_SURE_SPACE": 3, "HYPHEN": 4, "LINE_BREAK": 5}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON lines, plain or gzip."""
    return spark.read.schema(DOCUMENT).json(path)


def document_words(documents: DataFrame, key: str = "pdf_name") -> DataFrame:
    """One row for each word; empty words keep theirs."""
    pages = documents.select(key, F.explode("pages").alias("p"))
    return pages.select(key, "p.page_idx", F.explode("p.words").alias("w")).select(key, "page_idx", "w.*")


def nested(words: DataFrame) -> DataFrame:
    """Words as one document a row, as documents are written: doc_id, pages of words in order."""
    word = F.struct("word_idx", "text", "xmin", "ymin", "xmax", "ymax")
    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(word)).alias("words"))
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", "words"))).alias("pages"))


def to_json(words: DataFrame) -> DataFrame:
    return nested(words).select("doc_id", F.to_json(F.struct("doc_id", "pages")).alias("json"))


def recognised_words(responses: DataFrame, key: str = "doc_id", json: str = "json", order: str | None = None, least_height: float | None = None) -> DataFrame:
    """Words of recognition responses: (key, page_idx, word_idx, text, break_type, xmin, ymin, xmax, ymax); missing coordinates are 0. Several parts of a document follow in ``order``.
    Words lower than ``least_height`` times the page's mean are left out, and the others numbered anew."""
    parsed = responses.withColumn("r", F.from_json(json, RESPONSE)).withColumn("_part", F.col(order) if order else F.lit(0))
    pages = parsed.select(key, "_part", F.posexplode("r.responses").alias("_r", "resp")).select(key, "_part", "_r", F.posexplode("resp.fullTextAnnotation.pages").alias("_p", "page"))
    numbered = pages.withColumn("page_idx", F.row_number().over(Window.partitionBy(key).orderBy("_part", "_r", "_p")) - 1)
    flat = numbered.select(key, "page_idx", F.posexplode("page.blocks").alias("b", "block")).select(key, "page_idx", "b", F.posexplode("block.paragraphs").alias("a", "para")).select(key, "page_idx", "b", "a", F.posexplode("para.words").alias("k", "w"))
    coords = F.coalesce("w.boundingBox.normalizedVertices", F.array())
    xs, ys = F.transform(coords, lambda c: F.coalesce(c["x"], F.lit(0.0))), F.transform(coords, lambda c: F.coalesce(c["y"], F.lit(0.0)))
    kind = X.literal_map(BREAKS)[F.element_at("w.symbols", -1)["property"]["detectedBreak"]["type"]]
    words = flat.select(
        key, "page_idx", "b", "a", "k", F.array_join(F.transform("w.symbols", lambda s: s["text"]), "").alias("text"), F.coalesce(kind, F.lit(6)).alias("break_type"),
        F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"),
    )
    if least_height is not None:
        mean = F.avg(F.col("ymax") - F.col("ymin")).over(Window.partitionBy(key, "page_idx"))
        words = words.withColumn("_mean", mean).where(F.col("ymax") - F.col("ymin") >= F.lit(least_height) * F.col("_mean"))
    at = Window.partitionBy(key, "page_idx").orderBy("b", "a", "k")
    return words.withColumn("word_idx", F.row_number().over(at) - 1).select(key, "page_idx", "word_idx", "text", "break_type", "xmin", "ymin", "xmax", "ymax")


def filtered_rows(words: DataFrame, widest: float = 0.2) -> DataFrame:
    """Words of a recogniser's table (doc_id, page_idx, seq, text, xmin …) without empty ones and without blanks wider than ``widest``, numbered anew."""
    kept = words.where((F.length("text") > 0) & ((F.trim("text") != "") | (F.col("xmax") - F.col("xmin") <= widest)))
    return kept.withColumn("word_idx", F.row_number().over(Window.partitionBy(*PAGE).orderBy("seq")) - 1).drop("seq")


def recognition_route(pages: DataFrame, synchronous: int = 5, most: int = 2000) -> DataFrame:
    """Documents with route: at once up to a number of pages, else in the background; above ``most`` an error."""
    n = F.col("num_pages")
    return pages.withColumn("route", F.when(n > most, "error").when(n <= synchronous, "sync").otherwise("async")).withColumn("parts", F.when(n <= most, F.ceil(n / 100)))


def profile(pages: DataFrame, words: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page_idx, width, height, num_words, num_images, has_one_large_image) over pages; a large image covers nine tenths of its page."""
    w = words.groupBy(*PAGE).agg(F.count("*").alias("num_words"))
    i = images.groupBy(*PAGE).agg(F.count("*").alias("num_images"), F.max(F.col("width") * F.col("height")).alias("largest"))
    both = pages.join(w, list(PAGE), "left").join(i, list(PAGE), "left")
    large = (F.coalesce("num_images", F.lit(0)) == 1) & (F.col("largest") >= F.lit(0.9) * F.col("width") * F.col("height"))
    return both.select(*PAGE, "width", "height", F.coalesce("num_words", F.lit(0)).alias("num_words"), F.coalesce("num_images", F.lit(0)).alias("num_images"), F.coalesce(large, F.lit(False)).alias("has_one_large_image"))


def page_images(pages: DataFrame, small: int = 500) -> DataFrame:
    """Pages with image_source: the embedded image where a page has exactly one that isn't small, else a raster; small ones are flagged."""
    own = (F.col("num_images") == 1) & (F.col("image_width") >= small) & (F.col("image_height") >= small)
    return pages.withColumn("image_source", F.when(own, "embedded").otherwise("raster")).withColumn("raster_dpi", F.greatest(F.coalesce("image_dpi", F.lit(72)), F.lit(72)))


Reader = Callable[[bytes], list[tuple[int, int, int, list[tuple[str, float, float, float, float]]]]]


def read_files(spark: SparkSession, path: str, reader: Reader) -> DataFrame:
    """(path, page_idx, width, height, word_idx, text, xmin, ymin, xmax, ymax) of binary files, through a reader that gives (page_idx, width, height, words) of their bytes; boxes are divided by the
    page's whole width and height. The reader is what an installed PDF or recognition library is wrapped in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "page_idx", "width", "height", "word_idx", "text", "xmin", "ymin", "xmax", "ymax"]
        for frame in frames:
            rows = [(p, i, w, h, k, t, x0 / int(w), y0 / int(h), x1 / int(w), y1 / int(h)) for p, content in zip(frame["path"], frame["content"]) for i, w, h, words in reader(content) for k, (t, x0, y0, x1, y1) in enumerate(words)]
            yield pd.DataFrame(rows, columns=names)

    schema = "path string, page_idx int, width int, height int, word_idx int, text string, xmin double, ymin double, xmax double, ymax double"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def text_reader(content: bytes) -> list[tuple[int, int, int, list[tuple[str, float, float, float, float]]]]:
    """A reader of plain text, a page for each form feed, set in a grid of 612 by 792 points: for tests, and where no library is installed."""
    out = []
    for i, page in enumerate(content.decode("utf-8", "replace").split("\f")):
        words = []
        for row, line in enumerate(page.split("\n")):
            at = 0
            for token in line.split(" "):
                if token:
                    words.append((token, at * 6.0, row * 12.0, (at + len(token)) * 6.0, row * 12.0 + 10))
                at += len(token) + 1
        out.append((i, 612, 792, words))
    return out
