"""Half-open character spans: predicates on (start, end) columns, and algebra on arrays of struct<start, end>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int>"


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def overlap_length(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))


def overlaps(a: Column, b: Column) -> Column:
    return overlap_length(a, b) > 0


def overlaps_any(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: overlaps(a, s))


def overlaps_all(a: Column, spans: Column) -> Column:
    """Of no span at all: false."""
    return (F.size(spans) > 0) & F.forall(spans, lambda s: overlaps(a, s))


def subsumes(a: Column, b: Column) -> Column:
    return (a["start"] <= b["start"]) & (a["end"] >= b["end"])


def between(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def adjoins(a: Column, b: Column, text: Column, ignore: str = " ") -> Column:
    """Disjoint, with nothing but ignorable characters between."""
    low, high = F.least(a["end"], b["end"]), F.greatest(a["start"], b["start"])
    return ~overlaps(a, b) & (F.trim(between(text, low, high), F.lit(ignore)) == "")


def overlaps_or_adjoins(a: Column, b: Column, text: Column, ignore: str = " ") -> Column:
    return overlaps(a, b) | adjoins(a, b, text, ignore)


def is_valid(s: Column, text: Column) -> Column:
    """Within the text, not empty, and without blanks at its ends."""
    own = between(text, s["start"], s["end"])
    return (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)) & (own == F.trim(own))


def ordered(spans: Column) -> Column:
    return F.array_sort(spans)


def accumulated(spans: Column, text: Column | None, ignore: str = " ") -> Column:
    """Spans merged where they overlap or touch, or, given their text, only ignorable characters are between them."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = s["start"] <= last["end"]
        if text is not None:
            joins = joins | (F.trim(between(text, last["end"], s["start"]), F.lit(ignore)) == "")
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(span(last["start"], F.greatest(last["end"], s["end"]))))
        return F.when(F.size(acc) == 0, F.array(s)).when(joins, grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered(spans), F.array().cast(f"array<{SPAN}>"), step)


def without_subsumed(spans: Column) -> Column:
    """Spans that no earlier or longer one contains; of equal ones the first."""
    by = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    return F.aggregate(by, F.array().cast(f"array<{SPAN}>"), lambda acc, s: F.when((F.size(acc) > 0) & (s["end"] <= F.array_max(F.transform(acc, lambda x: x["end"]))), acc).otherwise(F.concat(acc, F.array(s))))


def non_overlapping(spans: Column) -> Column:
    s = ordered(spans)
    return F.forall(F.sequence(F.lit(2), F.greatest(F.size(s), F.lit(2))), lambda i: (i > F.size(s)) | (F.try_element_at(s, i - 1)["end"] <= F.try_element_at(s, i)["start"]))


def complement(spans: Column, length: Column) -> Column:
    """What of [0, length) no span covers, in order."""
    merged = F.aggregate(
        ordered(spans), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] > acc["at"], F.concat(acc["out"], F.array(span(acc["at"], s["start"])))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.when(acc["at"] < length, F.concat(acc["out"], F.array(span(acc["at"], length)))).otherwise(acc["out"]),
    )
    return merged


def texts(spans: Column, text: Column) -> Column:
    return F.transform(spans, lambda s: between(text, s["start"], s["end"]))


def blanked(text: Column, spans: Column) -> Column:
    """The text with its spans as blanks; its length stays."""
    return F.aggregate(spans, text, lambda t, s: F.overlay(t, F.repeat(F.lit(" "), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))


def shifted(spans: Column, at: Column, by: Column) -> Column:
    """Spans after an edit at a position made the text longer by ``by``: what lies behind moves, what contains it grows; empty ones go."""
    moved = F.transform(spans, lambda s: span(F.when(s["start"] > at, s["start"] + by).otherwise(s["start"]), F.when(s["end"] > at, s["end"] + by).otherwise(s["end"])))
    return F.filter(moved, lambda s: s["end"] > s["start"])


def to_base(view: Column, removed: Column) -> Column:
    """Spans of the base text that a span of the view without the removed spans stands for; one that reaches over a removed span falls in parts."""

    def step(acc: Column, r: Column) -> Column:
        size = r["end"] - r["start"]
        before = F.struct((acc["start"] + size).alias("start"), (acc["end"] + size).alias("end"), acc["out"].alias("out"))
        across = F.struct(r["end"].alias("start"), (acc["end"] + size).alias("end"), F.concat(acc["out"], F.array(span(acc["start"], r["start"]))).alias("out"))
        return F.when(r["start"] <= acc["start"], before).when(r["start"] < acc["end"], across).otherwise(acc)

    start = F.struct(view["start"].alias("start"), view["end"].alias("end"), F.array().cast(f"array<{SPAN}>").alias("out"))
    found = F.aggregate(ordered(removed), start, step, lambda a: F.concat(a["out"], F.array(span(a["start"], a["end"]))))
    return F.filter(found, lambda s: s["end"] > s["start"])


def word_spans(text: Column) -> Column:
    """The spans of the words of a text whose words stand one blank apart; deleted (empty) words have none."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.aggregate(words, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), lambda a, w: F.struct((a["at"] + F.length(w) + 1).alias("at"), F.concat(a["out"], F.array(span(a["at"], a["at"] + F.length(w)))).alias("out")), lambda a: a["out"])


def measures(spans: Column) -> Column:
    """struct<min_start, max_end, span_len, sum_span_len, sum_match_len, sum_gap>: extent, added lengths, covered characters, and gaps between covered stretches."""
    covered = accumulated(spans, None)
    total = lambda xs: F.aggregate(F.transform(xs, lambda s: s["end"] - s["start"]), F.lit(0), lambda a, x: a + x)
    low, high = F.array_min(F.transform(spans, lambda s: s["start"])), F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.struct(low.alias("min_start"), high.alias("max_end"), (high - low).alias("span_len"), total(spans).alias("sum_span_len"), total(covered).alias("sum_match_len"), (high - low - total(covered)).alias("sum_gap"))


def view_text(text: Column, removed: Column) -> Column:
    """The text without the removed spans: words that are gone leave no blank, what is left of a word that is cut stays together."""
    keep = texts(complement(removed, F.length(text)), text)
    return F.trim(F.regexp_replace(F.array_join(keep, ""), " +", " "))
