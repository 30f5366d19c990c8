import math

import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import glyphs
from pagewright.functions import spans as S
from pagewright.functions import text as X


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return tuple(row) if len(columns) > 1 else row[0]


def spans(*pairs):
    return F.array(*[S.span(F.lit(a), F.lit(b)) for a, b in pairs]) if pairs else F.array().cast(f"array<{S.SPAN}>")


def pairs(rows):
    return [tuple(row) for row in rows]


def test_span_algebra(spark):
    text = F.lit("0123 5678 abcd")
    assert pairs(one(spark, S.accumulated(spans((5, 9), (0, 4), (10, 12)), text))) == [(0, 12)]
    assert pairs(one(spark, S.accumulated(spans((5, 9), (0, 3)), text))) == [(0, 3), (5, 9)]
    assert pairs(one(spark, S.accumulated(spans(), text))) == []
    assert pairs(one(spark, S.without_subsumed(spans((0, 5), (1, 3), (0, 5), (4, 8))))) == [(0, 5), (4, 8)]
    assert one(spark, S.non_overlapping(spans((0, 2), (2, 4))), S.non_overlapping(spans((0, 3), (2, 4))), S.non_overlapping(spans())) == (True, False, True)
    assert pairs(one(spark, S.complement(spans((2, 4), (3, 6)), F.lit(10)))) == [(0, 2), (6, 10)]
    assert pairs(one(spark, S.complement(spans((0, 10)), F.lit(10)))) == []
    a, b = S.span(F.lit(0), F.lit(4)), S.span(F.lit(5), F.lit(9))
    assert one(spark, S.adjoins(a, b, text), S.overlaps(a, b), S.overlaps_all(a, spans())) == (True, False, False)
    assert one(spark, S.is_valid(a, text), S.is_valid(S.span(F.lit(0), F.lit(5)), text)) == (True, False)
    assert pairs(one(spark, S.to_base(S.span(F.lit(2), F.lit(6)), spans((4, 7))))) == [(2, 4), (7, 9)]
    assert pairs(one(spark, S.shifted(spans((0, 3), (5, 8)), F.lit(3), F.lit(-1)))) == [(0, 3), (4, 7)]
    assert one(spark, S.blanked(text, spans((0, 4)))) == "     5678 abcd"
    assert one(spark, S.view_text(F.lit("The quick brown fox"), spans((4, 9)))) == "The brown fox"
    assert pairs(one(spark, S.word_spans(F.lit("The quick fox")))) == [(0, 3), (4, 9), (10, 13)]


@pytest.mark.parametrize(
    "text, kind, value",
    [("1.", 1, 1), ("(12)", 1, 12), ("iv", 2, 4), ("X", 2, 10), ("хі", 2, 11), ("iiii", 0, None), ("b)", 3, 2), ("word", 0, None), ("", 0, None), ("xxxx", 2, 40), ("9999999999", 0, None)],
)
def test_marker(spark, text, kind, value):
    m = one(spark, X.marker(F.lit(text)))
    assert (m["num_type"], m["num_val"]) == (kind, value)


def test_text(spark):
    assert one(spark, X.number_ranges(F.lit("1,3-5"))) == [1, 3, 4, 5]
    assert one(spark, X.seconds(F.lit("1:02:03")), X.seconds(F.lit("45")), X.time_string(F.lit(3723)), X.milliseconds(F.lit("1.5s"))) == (3723, 45, "01:02:03", 1500)
    assert str(one(spark, X.find_date(F.lit("dated 3/4/2021 at noon")))) == "2021-04-03"
    assert str(one(spark, X.find_date(F.lit("on 5 March 2020")))) == "2020-03-05"
    assert one(spark, X.find_date(F.lit("no date"))) is None
    assert one(spark, X.to_ascii(F.lit("Ájumpèd fóx's ß")), X.is_ascii(F.lit("abc")), X.is_ascii(F.lit("é"))) == ("Ajumped foxs ss", True, False)
    assert one(spark, X.block(F.lit("ह")), X.single_script(F.lit("a.b!")), X.single_script(F.lit("aह"))) == ("Devanagari", True, False)
    assert one(spark, X.indic_to_ascii(F.lit("१२३")), X.ascii_to_devanagari(F.lit("12")), X.is_devanagari_number(F.lit("१२"))) == ("123", "१२", True)
    assert one(spark, X.occurrences(F.lit("aaa"), F.lit("aa"))) == [0, 1]
    assert one(spark, X.on_word_boundary(F.lit("a cat."), F.lit(2), F.lit(5)), X.on_word_boundary(F.lit("acat"), F.lit(1), F.lit(4))) == (True, False)
    p = one(spark, X.parsed_path(F.lit("pa0.wo3:7")))
    assert (p["page_idx"], p["kind"], p["idx_from"], p["idx_to"]) == (0, "wo", 3, 7)
    assert one(spark, X.parsed_path(F.lit("nonsense"))) is None
    assert one(spark, X.brackets_blanked(F.lit("x (a long one) y (no)"))) == "x              y (no)"
    assert one(spark, X.markdown_row(F.array(F.lit("a"), F.lit("b")))) == "|a|b|"
    assert one(spark, X.replaced(F.lit("old"), F.lit("<ALL>"), F.lit("n")), X.replaced(F.lit("old"), F.lit("o"), F.lit("0"))) == ("n", "0ld")
    assert one(spark, X.file_kind(F.lit("a/b.PDF")), X.file_kind(F.lit("b.json.gz")), X.file_kind(F.lit("b.xyz"))) == ("pdf", "document", None)
    assert one(spark, X.protected(F.lit("at a.b@c.org or 12.5"))) == "at <dnt> a.b@c.org </dnt> or <dnt> 12.5 </dnt>"
    assert one(spark, glyphs.clean_font(F.lit("ABCDEF+Noto Sans-Bold")), glyphs.is_italic(F.lit("X-Italic"))) == ("notosansbold", False)


def test_geometry(spark):
    lit = lambda *v: dict(zip(("xmin", "ymin", "xmax", "ymax"), map(F.lit, v)))
    small, big = lit(0, 0, 10, 10), lit(5, 0, 20, 20)
    assert one(spark, G.overlap_percent(small, big), G.overlap_percent(small, lit(50, 50, 60, 60)), G.overlap_percent(lit(5, 5, 5, 5), big)) == (50, 0, 100)
    assert one(spark, G.overlaps(small, lit(0, 0, 10, 0.15)), G.overlaps(small, lit(0, 0, 10, 0.25))) == (False, True)
    assert one(spark, G.in_xrange(small, -1, 11), G.in_xrange(small, 0, 11), G.in_xrange(small, 10, 20, True)) == (True, False, True)
    x, y = G.intersection([F.lit(float(v)) for v in (0, 0, 10, 10)], [F.lit(float(v)) for v in (0, 10, 10, 0)])
    assert one(spark, x, y) == (5.0, 5.0)
    assert one(spark, G.intersection([F.lit(v) for v in (0.0, 0.0, 1.0, 0.0)], [F.lit(v) for v in (0.0, 1.0, 1.0, 1.0)])[0]) is None
    w, h = G.rotated_size(F.lit(100), F.lit(50), F.lit(90.0))
    assert one(spark, w, h) == (pytest.approx(51, abs=1), pytest.approx(101, abs=1))
    assert one(spark, *G.reoriented(F.lit(0.2), F.lit(0.3), F.lit(180))) == (pytest.approx(0.8), pytest.approx(0.7))
    shrunk = G.shrunk(lit(0.2, 0.2, 0.6, 0.6), 10)
    assert one(spark, *shrunk.values()) == pytest.approx((0.3, 0.3, 0.5, 0.5))
    assert one(spark, G.edge_length(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0))) == 5.0
    corners = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0, 0), (4, 0), (4, 2), (0, 2))])
    assert one(spark, G.corner_orientation(corners)) == 0
    assert one(spark, *G.polygon_box(corners).values()) == (0, 0, 4, 2)
    assert math.isclose(one(spark, G.point_along(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), 0.25)[0]), 2.5)


def test_glyph_order(spark):
    chars = F.array(*[F.lit(c) for c in "kiR"])
    assert one(spark, F.array_join(glyphs.reordered(chars, F.array(F.lit("i")), F.array().cast("array<string>")), "")) == "ikR"
    assert [tuple(r) for r in one(spark, glyphs.missing(F.lit("a (font-cid:12) b (x-cid:3)")))] == [("font", 12), ("x", 3)]
