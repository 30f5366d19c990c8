"""Documents written as JSON, HTML, SVG, Markdown and frequency lists."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.operators.layout import PAGE


def svg_elements(words: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Words with svg, a rectangle each; ``classes``: (doc_id, page_idx, word_idx, class), joined by blanks in order."""
    if classes is not None:
        named = classes.groupBy(*PAGE, "word_idx").agg(F.array_join(F.array_sort(F.collect_set("class")), " ").alias("class"))
        words = words.join(named, [*PAGE, "word_idx"], "left")
    label = F.coalesce(F.col("class"), F.lit("word")) if classes is not None else F.lit("word")
    svg = F.format_string('<rect class="%s" x="%d" y="%d" width="%d" height="%d" data-idx="%d"/>', label, "xmin", "ymin", F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), "word_idx")
    return words.withColumn("svg", svg)


def svg_pages(elements: DataFrame) -> DataFrame:
    """(doc_id, page_idx, svg): one picture a page."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "svg"))), lambda s: s["svg"]), "\n")
    return elements.groupBy(*PAGE).agg(F.concat(F.lit('<svg viewBox="0 0 1000 1000">\n'), body, F.lit("\n</svg>")).alias("svg"))


def html_pages(words: DataFrame) -> DataFrame:
    """(doc_id, page_idx, html): escaped words in spans."""
    span = F.format_string('<span id="w%d">%s</span>', "word_idx", X.html_escaped(F.col("text")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", span.alias("s")))), lambda s: s["s"]), " ")
    return words.groupBy(*PAGE).agg(F.concat(F.lit("<p>"), body, F.lit("</p>")).alias("html"))


def markdown_rows(cells: DataFrame, group: tuple[str, ...], order: str, cell: Column) -> DataFrame:
    """(group, markdown) of rows of cells in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, cell.alias("c")))), lambda s: s["c"])
    return cells.groupBy(*group).agg(X.markdown_row(texts).alias("markdown"))


def word_frequencies(docs: DataFrame, least: int = 1) -> DataFrame:
    """(word, n) over all texts: punctuation as blanks, in small letters; at least ``least`` times."""
    words = F.filter(F.split(F.lower(F.translate("text", X.PUNCTUATION + "\n", " " * (len(X.PUNCTUATION) + 1))), " "), lambda w: w != "")
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def fix_scripts(errors: DataFrame) -> DataFrame:
    """(doc_id, script): for errors (doc_id, path, text) the edit commands that someone can fill in, a line each."""
    line = F.format_string("replaceStr %s <all> '%s'", "path", F.replace("text", F.lit("'"), F.lit("")))
    return errors.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("script"))


def write_json(documents: DataFrame, path: str, gzip: bool = True) -> None:
    documents.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def layout_boxes(words: DataFrame, height: int = 1000) -> DataFrame:
    """(doc_id, page_idx, tokens, boxes): words and whole-number boxes scaled to a page of that height, as layout models read them."""
    box = F.array(*[F.floor(F.col(c) * height / 1000).cast("int") for c in ("xmin", "ymin", "xmax", "ymax")])
    rows = F.array_sort(F.collect_list(F.struct("word_idx", "text", box.alias("box"))))
    return words.groupBy(*PAGE).agg(F.transform(rows, lambda r: r["text"]).alias("tokens"), F.transform(rows, lambda r: r["box"]).alias("boxes"))


COLOURS = {"word": "grey", "marker": "blue", "edge": "red", "table": "green", "box": "orange"}


def overlays(items: DataFrame, colours: Mapping[str, str] = COLOURS) -> DataFrame:
    """(doc_id, page_idx, svg): a picture a page of items (doc_id, page_idx, kind, idx, x0, y0, x1, y1, label), in thousandths: edges as lines, all others as boxes, in the colour of their kind (black of others), with the label as title where there is one;
    the kinds one upon the other in the order of their names, items by idx."""
    colour = F.coalesce(X.literal_map(dict(colours))[F.col("kind")], F.lit("black"))
    head = F.when(F.col("kind") == "edge", F.format_string('<line class="edge" stroke="%s" x1="%d" y1="%d" x2="%d" y2="%d"', colour, "x0", "y0", "x1", "y1")).otherwise(
        F.format_string('<rect class="%s" fill="none" stroke="%s" x="%d" y="%d" width="%d" height="%d"', F.col("kind"), colour, F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    )
    tail = F.when(F.col("label").isNull(), F.lit("/>")).otherwise(F.concat(F.lit("><title>"), X.html_escaped(F.col("label")), F.lit("</title></"), F.when(F.col("kind") == "edge", "line").otherwise("rect"), F.lit(">")))
    drawn = items.select(*PAGE, "kind", "idx", F.concat(head, tail).alias("svg"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "idx", "svg"))), lambda s: s["svg"]), "\n")
    return drawn.groupBy(*PAGE).agg(F.concat(F.lit('<svg viewBox="0 0 1000 1000">\n'), body, F.lit("\n</svg>")).alias("svg"))


def page_html(pages: DataFrame, image: Column | None = None) -> DataFrame:
    """(doc_id, html): a document's page pictures (doc_id, page_idx, svg) one below the other, each with its image below the picture if it has one."""
    picture = F.when(image.isNotNull(), F.concat(F.lit('<img src="'), X.html_escaped(image), F.lit('"/>'))).otherwise("") if image is not None else F.lit("")
    part = F.concat(F.format_string('<div class="page" id="pa%d">', "page_idx"), picture, F.col("svg"), F.lit("</div>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", part.alias("p")))), lambda s: s["p"]), "\n")
    return pages.groupBy("doc_id").agg(F.concat(F.lit("<!DOCTYPE html>\n<html><body>\n"), body, F.lit("\n</body></html>")).alias("html"))


_DOCX = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" '
    'Target="word/document.xml"/></Relationships>',
}
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs: list[tuple[str, bool, int]]) -> bytes:
    """A word-processor file of paragraphs (text, whether it is a heading, indentation in twentieths of a point). Signs that XML doesn't allow are left out."""
    parts = []
    for text, heading, indent in paragraphs:
        own = ('<w:pStyle w:val="Heading1"/>' if heading else "") + (f'<w:ind w:left="{indent}"/>' if indent else "")
        clean = escape("".join(c for c in text if c >= " " or c in "\t\n"))
        parts.append(f'<w:p>{f"<w:pPr>{own}</w:pPr>" if own else ""}<w:r>{"<w:rPr><w:b/></w:rPr>" if heading else ""}<w:t xml:space="preserve">{clean}</w:t></w:r></w:p>')
    body = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{"".join(parts)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (_DOCX | {"word/document.xml": body}).items():
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def docx_files(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, content): a file of each document's paragraphs (doc_id, seq, text, is_heading, indent) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, rows = batch.column(1).offsets.to_pylist(), batch.column(1).values
            parts = [(t or "", bool(h), int(i)) for t, h, i in zip(*(rows.field(c).to_pylist() for c in ("text", "is_heading", "indent")))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([docx(parts[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())], ["doc_id", "content"])

    each = paragraphs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "is_heading", "indent"))).alias("_rows"))
    return each.mapInArrow(run, f"doc_id {paragraphs.schema['doc_id'].dataType.simpleString()}, content binary")


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """(doc_id, seq, text, is_heading, indent) of such files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as tree

        at = lambda name: f"{{{_W}}}{name}"
        for frame in frames:
            rows = []
            for doc, content in zip(frame["doc_id"], frame["content"]):
                body = tree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                for k, p in enumerate(body.iter(at("p"))):
                    indent, style = p.find(f".//{at('ind')}"), p.find(f".//{at('pStyle')}")
                    rows.append((doc, k, "".join(t.text or "" for t in p.iter(at("t"))), style is not None, int(indent.get(at("left"))) if indent is not None else 0))
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "text", "is_heading", "indent"])

    return files.select("doc_id", "content").mapInPandas(run, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, seq int, text string, is_heading boolean, indent int")


def copy_files(files: DataFrame, folder: str) -> DataFrame:
    """(path, target, n_bytes): files (path) copied below a folder by the tasks, each under its name, written under another and then renamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        located = lambda p: fs.FileSystem.from_uri(p) if "://" in p else (fs.LocalFileSystem(), p.removeprefix("file:"))
        system, base = located(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                own, at = located(path)
                name, size = at.rsplit("/", 1)[-1], 0
                with own.open_input_stream(at) as source, system.open_output_stream(f"{base}/.{name}.part") as target:
                    while chunk := source.read(4 << 20):
                        size += len(chunk)
                        target.write(chunk)
                system.move(f"{base}/.{name}.part", f"{base}/{name}")
                out.append((path, f"{base}/{name}", size))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], ["path", "target", "n_bytes"])

    return files.select("path").mapInArrow(run, "path string, target string, n_bytes bigint")
