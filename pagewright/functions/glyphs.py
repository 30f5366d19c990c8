"""Text from glyph numbers of fonts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_font(name: Column) -> Column:
    """A font's name without its subset prefix, in small letters and without blanks, commas and dashes."""
    return F.translate(F.lower(F.regexp_replace(name, "^[A-Z]{6}[+]", "")), " ,-", "")


def is_bold(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("bold"))


def is_italic(name: Column) -> Column:
    """Only names that say 'italics'."""
    return F.contains(F.lower(name), F.lit("italics"))


def characters(glyphs: DataFrame, cmap: DataFrame) -> DataFrame:
    """Glyphs (font, cid) with ch: the character of the font's map (font, cid, ch), else (font-cid:n)."""
    return glyphs.join(cmap, ["font", "cid"], "left").withColumn("ch", F.coalesce("ch", F.format_string("(%s-cid:%d)", "font", "cid")))


def missing(text: Column) -> Column:
    """The (font, cid) pairs that a text tells as unknown."""
    return F.transform(F.regexp_extract_all(text, F.lit("(\\([A-Za-z0-9]+-cid:[0-9]+\\))"), F.lit(1)), lambda m: F.struct(F.regexp_extract(m, "\\(([A-Za-z0-9]+)-", 1).alias("font"), F.regexp_extract(m, "cid:([0-9]+)", 1).cast("int").alias("cid")))


def is_consonant(ch: Column) -> Column:
    """Devanagari consonants and the independent vowels before them that take signs."""
    return F.ascii(ch).between(2325, 2361) | F.ascii(ch).between(2309, 2314)


def reordered(chars: Column, left: Column, right: Column) -> Column:
    """An array of characters in which each one of ``left`` moves before the character ahead of it, and each one of ``right`` behind the next."""

    def step(acc: Column, c: Column) -> Column:
        n = F.size(acc["out"])
        waiting = F.array_compact(F.array(acc["wait"]))
        back = F.concat(F.slice(acc["out"], 1, F.greatest(n - 1, F.lit(0))), F.array(c), F.slice(acc["out"], F.greatest(n, F.lit(1)), F.least(n, F.lit(1))))
        return F.when(F.array_contains(right, c), F.struct(F.concat(acc["out"], waiting).alias("out"), c.alias("wait"))).when(F.array_contains(left, c) & (n > 0), F.struct(back.alias("out"), acc["wait"].alias("wait"))).otherwise(F.struct(F.concat(acc["out"], F.array(c), waiting).alias("out"), F.lit(None).cast("string").alias("wait")))

    zero = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("wait"))
    return F.aggregate(chars, zero, step, lambda a: F.concat(a["out"], F.array_compact(F.array(a["wait"]))))


def words(glyphs: DataFrame, line_gap: float = 3.0) -> DataFrame:
    """(doc_id, page_idx, word_idx, text, font) of glyphs (doc_id, page_idx, ch, font, x0, y0, x1): lines by steps of y0 of more than a gap, in them by middle, cut at blanks; a word's font is its most frequent."""
    page = ("doc_id", "page_idx")
    down = Window.partitionBy(*page).orderBy(F.desc("y0"), "x0")
    lined = glyphs.withColumn("step", F.coalesce((F.abs(F.col("y0") - F.lag("y0").over(down)) > line_gap).cast("int"), F.lit(0)))
    lined = lined.withColumn("line", F.sum("step").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("mid", (F.col("x0") + F.col("x1")) / 2)
    across = Window.partitionBy(*page).orderBy("line", "mid", "x0")
    blank = F.trim("ch") == ""
    new_line = F.coalesce((F.col("line") != F.lag("line").over(across)).cast("int"), F.lit(0))
    cut = lined.withColumn("cut", F.greatest(new_line, blank.cast("int"))).withColumn("word", F.sum("cut").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    found = cut.where(~blank).groupBy(*page, "word").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("mid", "x0", "ch"))), lambda s: s["ch"]), "").alias("text"), F.mode("font", True).alias("font"))
    return found.withColumn("word_idx", F.row_number().over(Window.partitionBy(*page).orderBy("word")) - 1).select(*page, "word_idx", "text", "font")


def font_statistics(words_: DataFrame) -> DataFrame:
    """(doc_id, page_idx, font, n_words, n_mixed) over words (doc_id, page_idx, word_idx, font), a row for each font of a word: words that have the font, and those of them that have others, too."""
    each = words_.select("doc_id", "page_idx", "word_idx", "font").distinct()
    fonts = each.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "page_idx", "word_idx")))
    return fonts.groupBy("doc_id", "page_idx", "font").agg(F.count("*").alias("n_words"), F.count_if(F.col("_n") > 1).alias("n_mixed"))


def merged(words_: DataFrame, gap: float = 2.0, rise: float = 1.0) -> DataFrame:
    """(doc_id, page_idx, word_idx, text, x0, y0, x1): words (doc_id, page_idx, seq, text, x0, y0, x1) that follow the word before by less than a gap, at its height, joined to it; the box grows with each."""

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for doc, number, text, x0, y0, x1 in page.sort_values("seq", kind="stable")[["doc_id", "page_idx", "text", "x0", "y0", "x1"]].itertuples(index=False):
            last = out[-1] if out else None
            if last and abs(x0 - last[6]) < gap and abs(y0 - last[5]) < rise:
                last[3], last[6] = last[3] + text, max(last[6], x1)
            else:
                out.append([doc, number, len(out), text, x0, y0, x1])
        return pd.DataFrame(out, columns=["doc_id", "page_idx", "word_idx", "text", "x0", "y0", "x1"])

    return words_.groupBy("doc_id", "page_idx").applyInPandas(fold, "doc_id bigint, page_idx int, word_idx int, text string, x0 double, y0 double, x1 double")
