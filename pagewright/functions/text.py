"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BREAKS = {0: "", 1: " ", 2: " ", 3: " ", 4: "-", 5: "\n", 6: ""}
_ONES = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
#: Small roman numerals up to 46, tens written out, and a plain zero.
ROMAN = {"0": 0} | {"x" * (n // 10) + _ONES[n % 10]: n for n in range(1, 47)}
#: Script blocks by first and last code point.
BLOCKS = (
    (0x0000, 0x007F, "Basic Latin"), (0x0080, 0x00FF, "Latin-1 Supplement"), (0x0100, 0x017F, "Latin Extended-A"), (0x0180, 0x024F, "Latin Extended-B"), (0x0250, 0x02AF, "IPA Extensions"),
    (0x02B0, 0x02FF, "Spacing Modifier Letters"), (0x0300, 0x036F, "Combining Diacritical Marks"), (0x0370, 0x03FF, "Greek and Coptic"), (0x0400, 0x04FF, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B00, 0x0B7F, "Oriya"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"),
    (0x1E00, 0x1EFF, "Latin Extended Additional"), (0x2000, 0x206F, "General Punctuation"), (0x20A0, 0x20CF, "Currency Symbols"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x4E00, 0x9FFF, "CJK Unified Ideographs"), (0xAC00, 0xD7AF, "Hangul Syllables"),
)
INDIC_ZEROS = (0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66)
INDIC = "".join(chr(z + k) for z in INDIC_ZEROS for k in range(10))


def literal_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def with_break(text: Column, break_type: Column, lines_as_blanks: bool = False) -> Column:
    """A word with what follows it."""
    after = F.coalesce(literal_map({k: (" " if lines_as_blanks and v == "\n" else v) for k, v in BREAKS.items()})[break_type.cast("int")], F.lit(""))
    return F.concat(text, after)


def replaced(text: Column, old: Column, new: Column) -> Column:
    """``old`` replaced by ``new``; '<all>' stands for the whole text."""
    return F.when(F.lower(old) == "<all>", new).when(old == "", text).otherwise(F.replace(text, old, new))


def without_punctuation(text: Column) -> Column:
    """ASCII punctuation as blanks, trimmed."""
    return F.trim(F.translate(text, PUNCTUATION, " " * len(PUNCTUATION)))


def is_ascii(text: Column) -> Column:
    return text.rlike("^[\\x00-\\x7F]*$")


ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def to_ascii(text: Column) -> Column:
    """Latin letters without their marks, ß as ss; other characters beyond ASCII and apostrophes go."""
    plain = F.translate(text, *ACCENTS)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE"), ("'", "")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.regexp_replace(plain, "[^\\x00-\\x7F]", "")


def marker(text: Column) -> Column:
    """struct<num_type, num_text, num_val> of a list marker: 1 digits, 2 roman (up to 46), 3 one letter, 0 anything else (value null).
    Brackets and stops at its ends don't count, Cyrillic look-alikes of x and i do as those, and so does X."""
    bare = F.replace(F.translate(F.translate(text, "хі", "xi"), ".,()", ""), F.lit("X"), F.lit("x"))
    roman = literal_map(ROMAN)
    kind = F.when(bare.rlike("^[0-9]{1,9}$"), 1).when(bare.rlike("^[ivx]+$") & F.array_contains(F.map_keys(roman), bare), 2).when(bare.rlike("^[a-z]$"), 3).otherwise(0)
    value = F.when(kind == 1, F.expr("0") + bare.try_cast("int")).when(kind == 2, roman[bare]).when(kind == 3, F.ascii(bare) - 96)
    return F.struct(kind.alias("num_type"), bare.alias("num_text"), value.cast("int").alias("num_val"))


def number_ranges(text: Column) -> Column:
    """'1,3-5' as [1, 3, 4, 5]."""
    parts = F.split(text, ",")
    low = lambda p: F.trim(F.element_at(F.split(p, "-"), 1)).cast("int")
    high = lambda p: F.trim(F.element_at(F.split(p, "-"), -1)).cast("int")
    return F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p))))


def block(character: Column) -> Column:
    """The script block of a character; 'Other' of none of BLOCKS."""
    point = F.ascii(character)
    found = F.when(F.lit(False), "")
    for low, high, name in BLOCKS:
        found = found.when(point.between(low, high), name)
    return found.otherwise("Other")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def single_script(text: Column) -> Column:
    """Whether all characters but punctuation and blanks are of one block."""
    plain = F.translate(text, PUNCTUATION + " ", "")
    return F.size(F.array_distinct(F.transform(characters(plain), block))) <= 1


def indic_to_ascii(text: Column) -> Column:
    return F.translate(text, INDIC, "0123456789" * len(INDIC_ZEROS))


def ascii_to_devanagari(text: Column) -> Column:
    return F.translate(text, "0123456789", "".join(chr(0x966 + k) for k in range(10)))


def is_devanagari_number(text: Column) -> Column:
    return text.rlike("^[०-९.,]*[०-९][०-९.,]*$")


def normal_punctuation(text: Column) -> Column:
    """Typographic quotes, dashes, dots and blanks in their plain forms; blanks before stops and runs of blanks go."""
    out = F.translate(text, "“”„«»‘’‚´`–—‐ ", "\"\"\"\"\"'''''--- ".replace("--- ", "--- "))
    out = F.replace(out, F.lit("…"), F.lit("..."))
    out = F.regexp_replace(out, " +([.,;:!?%])", "$1")
    return F.regexp_replace(F.regexp_replace(out, "\\( +", "("), " {2,}", " ")


DNT = "[%+._0-9A-Za-z-]+@[.0-9A-Za-z-]+[.][A-Za-z]{2,}|https?://[^ \\t\\n]+|[#@][A-Za-z0-9_]+|[0-9]+(?:[.,:/-][0-9]+)*"


def protected(text: Column) -> Column:
    """E-mail addresses, links, tags and numbers between marks that keep them from translation."""
    return F.regexp_replace(text, f"({DNT})", "<dnt> $1 </dnt>")


def sentences(text: Column) -> Column:
    """A text cut after . ! ? । followed by blanks, and at line breaks; empty pieces go."""
    return F.filter(F.split(F.regexp_replace(text, "([.!?।])[ \\n]+", "$1\n"), "\n"), lambda s: F.trim(s) != "")


def tagged_for_translation(sentence: Column, source: str, target: str, limit: int = 256) -> Column:
    """Array: the sentence in parts of ``limit`` tokens, as many as a translator takes at once, each with language tags before it. No token is dropped."""
    tokens = F.split(sentence, " ")
    nth = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / limit).cast("int"))
    return F.transform(nth, lambda i: F.concat_ws(" ", F.lit(source), F.lit(target), F.array_join(F.slice(tokens, i * limit + 1, limit), " ")))


def detokenised(text: Column) -> Column:
    """Blanks before closing and behind opening signs go, and those around @ and . of addresses."""
    out = F.regexp_replace(F.regexp_replace(text, " ([.,;:!?%)\\]])", "$1"), "([(\\[]) ", "$1")
    return F.regexp_replace(out, "([A-Za-z0-9]) ?@ ?([A-Za-z0-9])", "$1@$2")


def html_escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), "|"), F.lit("|"))


def file_kind(path: Column) -> Column:
    """What a file is read as, by its suffix; null of unknown ones."""
    suffix = F.lower(F.regexp_extract(path, "[.]([^./]+)$", 1))
    gz = F.lower(path).endswith(".json.gz")
    return F.when(gz | suffix.isin("json", "jsn"), "document").when(suffix == "pdf", "pdf").when(suffix.isin("webm", "mp3", "wav"), "audio").when(suffix == "mp4", "video")


def document_name(path: Column) -> Column:
    """The name of a document's file up to .pdf, or all of it."""
    name = F.element_at(F.split(path, "/"), -1)
    pdf = F.regexp_extract(name, "^(.*?[.]pdf)", 1)
    return F.when(pdf != "", pdf).otherwise(name)


def path_part(path: Column, at: int) -> Column:
    """A part of a path, counted from the end (-1 is the file)."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= abs(at), F.element_at(parts, at))


def word_path(page_idx: Column, word_idx: Column) -> Column:
    return F.format_string("pa%d.wo%d", page_idx, word_idx)


def parsed_path(path: Column) -> Column:
    """struct<page_idx, kind, idx_from, idx_to> of paths such as pa0.wo3 and pa0.wo3:7 (to inclusive)."""
    pattern = "^pa([0-9]+)[.]([a-z]{2})([0-9]+)(?::([0-9]+))?$"
    low = F.regexp_extract(path, pattern, 3)
    high = F.regexp_extract(path, pattern, 4)
    return F.when(path.rlike(pattern), F.struct(F.regexp_extract(path, pattern, 1).try_cast("int").alias("page_idx"), F.regexp_extract(path, pattern, 2).alias("kind"), low.try_cast("int").alias("idx_from"), F.when(high != "", high).otherwise(low).try_cast("int").alias("idx_to")))


def seconds(time: Column) -> Column:
    """h:m:s, m:s or s as seconds."""
    return F.aggregate(F.split(time, ":"), F.lit(0), lambda a, x: a * 60 + F.trim(x).cast("int"))


def time_string(secs: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(secs / 3600).cast("int"), F.floor(secs % 3600 / 60).cast("int"), (secs % 60).cast("int"))


def milliseconds(text: Column) -> Column:
    """'1.5s' as 1500."""
    return F.bround(F.rtrim(text, F.lit("s")).cast("decimal(18,6)") * 1000).cast("int")


DATE_FORMS = ("dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy")
_DATE = "[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2} [A-Z][a-z]+ [0-9]{4}|[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}"


def find_date(text: Column) -> Column:
    """The first date in a text, the day before the month; null of none."""
    found = F.regexp_extract(text, f"({_DATE})", 1)
    padded = F.regexp_replace(F.regexp_replace(found, "^([0-9])([/.-])", "0$1$2"), "([/.-])([0-9])([/.-])", "$10$2$3")
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(form)).cast("date") for form in DATE_FORMS for x in (padded,)))


def occurrences(text: Column, pattern: Column) -> Column:
    """0-based starts of all occurrences of a string, those that overlap included."""
    n = F.length(text) - F.length(pattern) + 1
    at = F.when((n > 0) & (pattern != ""), F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(at, lambda i: F.substring(text, i, F.length(pattern)) == pattern), lambda i: i - 1)


def on_word_boundary(text: Column, start: Column, end: Column) -> Column:
    """Whether no letter or digit stands right before or behind a span."""
    before, after = F.substring(text, start, F.lit(1)), F.substring(text, end + 1, F.lit(1))
    return ((start == 0) | ~before.rlike("^[\\p{L}\\p{N}]")) & ((end >= F.length(text)) | ~after.rlike("^[\\p{L}\\p{N}]"))


def brackets_blanked(text: Column, least: int = 7, exempt: tuple[str, ...] = ()) -> Column:
    """Bracketed parts of ``least`` characters or more without an exempt word as blanks of the same length."""
    inner = "|".join(["(?!.*" + e + ")" for e in exempt])
    whole = F.regexp_extract_all(text, F.lit(f"(\\({''.join(inner.split('|'))}[^()]{{{least},}}\\))"), F.lit(1))
    return F.aggregate(F.array_distinct(whole), text, lambda t, p: F.replace(t, p, F.repeat(F.lit(" "), F.length(p))))


def ruler(text: Column) -> Column:
    """The numbers of the words of a text, each above the beginning of its word, from 0."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.rtrim(F.array_join(F.transform(words, lambda w, i: F.rpad(i.cast("string"), F.greatest(F.length(w), F.length(i.cast("string"))), F.lit(" "))), " "))
