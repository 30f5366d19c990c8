"""What queries move and hold when tables grow."""

import re

import pytest
from pyspark.sql import functions as F

from pagewright import plans
from pagewright.operators import layout, records, regions, tables
from pagewright.sources import pdf

SF = "/root/testdata/sf0.001"


def exchanges(frame) -> list[str]:
    """The shuffles of a plan."""
    return re.findall(r"Exchange (?:hash|range)partitioning\(.*|Exchange SinglePartition.*", frame._jdf.queryExecution().executedPlan().toString())


#: Queries of which words, once split, stay where they are.
IN_PLACE = """apply_edits cells_leftover_words column_fill depth_histogram docx_round_trip edited_glyph_words empty_columns_deleted font_statistics footer_trimming full_lines json_round_trip layout_boxes line_first_words list_items number_markers paragraphs
 pipeline_yaml_smoke quick_lines reading_order_text recognised_pages recognised_tall_words region_words svg_pages swapped_glyphs text_with_breaks word_labels""".split()


@pytest.mark.parametrize("name", IN_PLACE)
def test_only_texts_are_shuffled(spark, name):
    found = exchanges(plans.QUERIES[name](spark, SF))
    assert found and all(re.search(r"partitioning\(doc_id#\d+L, \d+\), REPARTITION_BY_NUM", x) for x in found), found


def test_parts_by_size(spark, tmp_path):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2((F.col("id") * 31 + k).cast("string"), 256) for k in range(3)]).alias("text"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/d.parquet")
    found = layout.by_document(spark.read.parquet(f"{tmp_path}/d.parquet"))
    size = sum(p.stat().st_size for p in (tmp_path / "d.parquet").glob("*.parquet"))
    assert found.rdd.getNumPartitions() >= size // layout.PART_BYTES >= 3
    assert layout.by_document(spark.createDataFrame([(1, "a")], "doc_id bigint, text string")).count() == 1


def test_texts_are_grouped_without_a_call_for_each(spark):
    for name in ("hierarchy_groups", "select_non_overlapping"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan


def test_words_meet_their_tables_once(spark):
    """Cells are placed with the words' texts, and their columns counted without placing them again; polygons need no call for each word."""
    for name in ("column_fill", "empty_columns_deleted"):
        assert plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 3  # words, and the pages of rows and of columns
    assert "ArrowEvalPython" not in plans.QUERIES["cells_by_polygon"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_many_bands(spark):
    words = spark.createDataFrame([(1, 0, k, 10, k * 50, 20, k * 50 + 10) for k in range(20)], "doc_id bigint, page_idx int, word_idx int, xmin int, ymin int, xmax int, ymax int")
    rows = spark.createDataFrame([(1, 0, 0, k, k * 50, k * 50 + 50) for k in range(20)], "doc_id bigint, page_idx int, table_idx int, row_idx int, y0 int, y1 int")
    columns = spark.createDataFrame([(1, 0, 0, 0, 0, 100)], "doc_id bigint, page_idx int, table_idx int, col_idx int, x0 int, x1 int")
    assert {(r.word_idx, r.row_idx, r.col_idx) for r in tables.cells_first_match(words, rows, columns).collect()} == {(k, k, 0) for k in range(20)}


def test_pdf_tables_need_no_call_for_each_document(spark):
    for name in ("pdf_chars", "pdf_lines", "pdf_pages", "pdf_words"):
        frame = plans.QUERIES[name](spark, SF)
        assert "FlatMapGroups" not in frame._jdf.queryExecution().executedPlan().toString() and len(exchanges(frame)) == 1


def test_pages_without_glyphs():
    data = pdf.written([(612, 792, [("One", 72, 72)])], lines=[(10, 20, 110, 20)])
    whole, bare = list(pdf.Pdf(data).pages()), list(pdf.Pdf(data, text=False).pages())
    assert whole[0].lines == bare[0].lines and len(whole[0].chars) == 3 and not bare[0].chars


def test_documents_and_pages_need_no_call_for_each(spark):
    for name in ("apply_edits", "docx_round_trip", "full_lines"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and "FlatMapCoGroups" not in plan


def test_letters_and_slots_are_not_made_rows(spark):
    for name in ("swapped_glyphs", "edited_glyph_words"):
        assert "explode(arrays_zip" not in plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([(1, 10, 20), (1, 15, 2000), (1, 20, 30), (1, 12, 11), (2, 998, 999), (2, 1000, 1005)], "g int, xmin int, xmax int")
    wanted = [(g, s) for g, a, b in [(1, 10, 20), (1, 15, 999), (1, 20, 30), (1, 11, 12), (2, 998, 999)] for s in range(a, b + 1)]
    found = tables.depth_histogram(words, ("g",))
    assert sorted((r.g, r.slot, r.depth) for r in found.collect()) == sorted((*k, wanted.count(k)) for k in set(wanted))
    assert "Window" in found._jdf.queryExecution().executedPlan().toString()


def test_swaps_in_words_of_several_kinds(spark):
    rows = [(1, 0, 0, ["t", "h", "t", "h"], ["f"] * 4), (1, 0, 1, ["t"], ["f"]), (1, 0, 2, ["h", "t"], ["f", "f"]), (1, 0, 3, None, None), (1, 0, 4, [], []), (1, 0, 5, ["t", "h"], ["f", "g"]), (1, 0, 6, ["t", None, "t", "h"], ["f"] * 4), (1, 0, 7, ["t", "h", "x"], ["f"]), (1, 0, 8, ["a", "a", "b"], ["f"] * 3)]
    words = spark.createDataFrame(rows, "doc_id bigint, page_idx int, word_idx int, cids array<string>, fonts array<string>").coalesce(1)
    swaps = spark.createDataFrame([("f", "t", "h"), ("f", "a", "a"), ("f", "a", "b")], "font string, cid1 string, cid2 string")
    got = {r.word_idx: r.cids for r in regions.edit_font_words(words, swaps=swaps).collect()}
    assert got == {0: ["h", "t", "h", "t"], 1: ["t"], 2: ["h", "t"], 3: None, 4: [], 5: ["t", "h"], 6: ["t", None, "h", "t"], 7: ["t", "h", "x"], 8: ["a", "b", "a"]}


def test_only_named_words_are_folded(spark):
    rows = [(1, p, k, f"w{k}", k * 10, 10, k * 10 + 9, 20) for p in (0, 1) for k in range(30)]
    words = spark.createDataFrame(rows, "doc_id bigint, page_idx int, word_idx int, text string, xmin int, ymin int, xmax int, ymax int")
    edits = spark.createDataFrame([(1, 0, "newWord", ["new", "pa0.wo3", "pa0.wo4"]), (1, 1, "clearWords", ["pa1.wo5:7"]), (1, 2, "newAdjWord", ["pa0.wo9", "pa0.wo3", "left"])], "doc_id bigint, seq int, cmd string, args array<string>")
    found = records.apply_edits(words, edits)
    got = {(r.page_idx, r.word_idx): r.text for r in found.collect()}
    assert len(got) == 62 and got[0, 30] == "new" and got[0, 31] == "pa0.wo9" and [k for k, t in got.items() if t == ""] == [(1, 5), (1, 6), (1, 7)]
    assert "wo([0-9]+)" in found._jdf.queryExecution().executedPlan().toString()
