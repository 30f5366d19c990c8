"""The stages that pipelines can name."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.operators import layout, records
from pagewright.plans.registry import Bundle, guarded, stage
from pagewright.sources import sinks


@stage("words", requires=("docs",), assigns=("words",))
def words(bundle: Bundle) -> Bundle:
    return {"words": layout.words(bundle["docs"])}


@stage("line_finder", requires=("words",), assigns=("lines",), cutoff=5, blank_multiple=1.6)
def line_finder(bundle: Bundle, cutoff: float, blank_multiple: float) -> Bundle:
    return {"lines": layout.quick_lines(bundle["words"], float(cutoff), float(blank_multiple))}


@stage("num_marker", requires=("words",), assigns=("markers", "errors"), max_value=49)
def num_marker(bundle: Bundle, max_value: int) -> Bundle:
    found = layout.markers(bundle["words"], int(max_value))
    wrong = layout.sequence_errors(found, ("doc_id", "num_type"), ("page_idx", "idx"), "num_val")
    errors = wrong.select("doc_id", F.lit("num_marker").alias("pipe"), F.lit("IncorrectValue").alias("error_name"), X.word_path(F.col("page_idx"), F.col("word_idx")).alias("path"))
    return {"markers": found, "errors": bundle["errors"].unionByName(errors) if "errors" in bundle else errors}


@stage("list_finder", requires=("lines", "markers"), assigns=("items",))
def list_finder(bundle: Bundle) -> Bundle:
    marked = bundle["markers"].select(*layout.PAGE, "word_idx", F.lit(True).alias("hit"))
    lined = bundle["lines"].join(marked, [*layout.PAGE, "word_idx"], "left")
    return {"items": layout.list_items(lined, F.coalesce("hit", F.lit(False)))}


@stage("wordfreq_writer", requires=("docs",), assigns=("frequencies",), least=1)
def wordfreq_writer(bundle: Bundle, least: int) -> Bundle:
    return {"frequencies": sinks.word_frequencies(bundle["docs"], int(least))}


@stage("ascii_converter", requires=("docs",), assigns=("docs",))
def ascii_converter(bundle: Bundle) -> Bundle:
    return {"docs": bundle["docs"].withColumn("text", X.to_ascii(F.col("text")))}


@stage("script_normalizer", requires=("docs",), assigns=("scripts",))
def script_normalizer(bundle: Bundle) -> Bundle:
    return {"scripts": records.dominant_script(bundle["docs"], X.block)}


@stage("quarantine", requires=("docs",), assigns=("docs", "quarantine"), most_chars=20000, fail_fast=False)
def quarantine(bundle: Bundle, most_chars: int, fail_fast: bool) -> Bundle:
    ok, bad = guarded(bundle["docs"], F.length("text") <= int(most_chars), "quarantine", F.lit("TextTooLong"), bool(fail_fast))
    return {"docs": ok, "quarantine": bad}


@stage("do_nothing")
def do_nothing(bundle: Bundle) -> Bundle:
    return {}


@stage("height_calc", requires=("words",), assigns=("heights",))
def height_calc(bundle: Bundle) -> Bundle:
    return {"heights": bundle["words"].groupBy(*layout.PAGE).agg(F.avg(F.col("ymax") - F.col("ymin")).alias("mean_height"))}


@stage("svg_generator", requires=("words",), assigns=("svg",))
def svg_generator(bundle: Bundle) -> Bundle:
    return {"svg": sinks.svg_pages(sinks.svg_elements(bundle["words"]))}


@stage("html_generator", requires=("words",), assigns=("html",))
def html_generator(bundle: Bundle) -> Bundle:
    return {"html": sinks.html_pages(bundle["words"])}
