"""Edits, errors, configuration and bookkeeping of documents."""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.layout import PAGE
from pagewright.session import durable

#: command: least and most arguments.
WORD_COMMANDS = {"clearWord": (1, 1), "clearWords": (1, None), "clearChar": (2, 2), "newWord": (3, 3), "newAdjWord": (3, 3), "mergeWords": (1, None), "splitWord": (2, 2), "replaceStr": (3, 3), "deletePage": (1, 1)}
EDGE_COMMANDS = {"moveEdge": (3, 4), "moveEdges": (3, 4)}
REGION_COMMANDS = {"addWords": (1, None), "addWordIdxs": (1, None)}
COMMANDS = WORD_COMMANDS | EDGE_COMMANDS | REGION_COMMANDS


class UnknownCommand(ValueError):
    """An edit command that isn't known, or that has the wrong number of parts; tells where."""


def parsed(lines: list[str], source: str = "edits") -> list[tuple[int, str, list[str]]]:
    """(seq, command, arguments) of edit lines, split as a shell does; blank lines and lines after # are left out."""
    out = []
    for k, line in enumerate(lines, 1):
        parts = shlex.split(line, comments=True)
        if not parts:
            continue
        low, high = COMMANDS.get(parts[0], (1 << 30, None))
        if len(parts) - 1 < low or (high is not None and len(parts) - 1 > high):
            raise UnknownCommand(f"{source}:{k}: {line!r} isn't a known command")
        out.append((len(out), parts[0], parts[1:]))
    return out


def known_edits(edits: DataFrame, commands: dict[str, tuple[int, int | None]]) -> DataFrame:
    """The edits (doc_id, seq, cmd, args) of some commands; a command that is none at all is an error."""
    named = F.col("cmd").isin(*COMMANDS)
    checked = F.when(named, F.col("cmd")).otherwise(F.raise_error(F.concat(F.lit("unknown edit command "), F.coalesce("cmd", F.lit("null")))))
    return edits.withColumn("cmd", checked).where(F.col("cmd").isin(*commands))


def apply_edits(page_words: DataFrame, edits: DataFrame) -> DataFrame:
    """Words after edits (doc_id, seq, cmd, args), in order within a document. Only words that an edit names are folded, and all of a document of which a page is deleted; all others pass by untouched.
    Edits of edges and regions don't concern words (see edited_edges, edited_regions); unknown commands and paths without a word are errors.

    Columns doc_id, page_idx, word_idx, text, orig_text, xmin, ymin, xmax, ymax. A cleared word keeps its row; new words come last; deletePage makes later pages one less.
    """
    columns = [*PAGE, "word_idx", "text", "orig_text", "xmin", "ymin", "xmax", "ymax"]
    slim = page_words.select(*PAGE, "word_idx", "text", F.lit(None).cast("string").alias("orig_text"), *[F.col(c).cast("double") for c in columns[5:]])
    own = known_edits(edits, WORD_COMMANDS).select("doc_id", "seq", "cmd", "args")
    path = "^pa([0-9]+)[.]wo([0-9]+)(?::([0-9]+))?$"
    part = lambda k: F.regexp_extract("arg", path, k).try_cast("int")
    named = own.select("doc_id", "cmd", F.explode("args").alias("arg")).where(F.col("arg").rlike(path) | (F.col("cmd") == "deletePage"))
    at_ = F.struct(part(1).alias("page"), part(2).alias("low"), F.coalesce(part(3), part(2)).alias("high"))
    per_doc = named.groupBy("doc_id").agg(F.collect_set(at_).alias("_paths"), F.bool_or(F.col("cmd") == "deletePage").alias("_whole"))
    is_named = F.exists("_paths", lambda x: (x["page"] == F.col("page_idx")) & F.col("word_idx").between(x["low"], x["high"]))
    # New words come behind the page's last one, which may be none that is folded.
    numbered = slim.withColumn("_last", F.max("word_idx").over(Window.partitionBy(*PAGE)))
    marked = numbered.join(per_doc, "doc_id", "left").withColumn("_edited", F.coalesce(F.col("_whole") | is_named, F.lit(False))).drop("_paths", "_whole")

    def fold(doc: object, own_words: list[dict] | None, todo: list[dict]) -> list[dict]:
        if not own_words:
            raise UnknownCommand(f"document {doc}: {todo[0]['args'][-1]!r} isn't a word, nor has any page a word that its edits name")
        rows = {(r["page_idx"], r["word_idx"]): r | {"doc_id": doc} for r in own_words}

        def at(path: str) -> list[tuple[int, int]]:
            found = re.fullmatch(r"pa(\d+)[.]wo(\d+)(?::(\d+))?", path)
            keys = [(int(found[1]), k) for k in range(int(found[2]), int(found[3] or found[2]) + 1)] if found else []
            if not keys or not all(k in rows for k in keys):
                raise UnknownCommand(f"document {doc}: {path!r} isn't a word")
            return keys

        def put(key: tuple[int, int], text: str) -> None:
            r = rows[key]
            if r["orig_text"] is None:
                r["orig_text"] = r["text"]
            r["text"] = text

        def add(page: int, text: str, x0: float, y0: float, x1: float, y1: float) -> None:
            k = max(max(w, r["_last"]) for (p, w), r in rows.items() if p == page) + 1
            rows[page, k] = {"_last": k, "doc_id": doc, "page_idx": page, "word_idx": k, "text": text, "orig_text": None, "xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1}

        for cmd, args in ((t["cmd"], t["args"]) for t in todo):
            if cmd in ("clearWord", "clearWords"):
                for p in args:
                    for key in at(p):
                        put(key, "")
            elif cmd == "clearChar":
                for key in at(args[0]):
                    put(key, "".join(c for c in rows[key]["text"] if c not in args[1]))
            elif cmd == "replaceStr":
                for key in at(args[0]):
                    old = rows[key]["text"]
                    put(key, args[2] if args[1].lower() == "<all>" else old.replace(args[1], args[2]))
            elif cmd == "newWord":
                px, py = rows[at(args[1])[0]], rows[at(args[2])[0]]
                add(px["page_idx"], args[0], px["xmin"], py["ymin"], px["xmax"], py["ymax"])
            elif cmd == "newAdjWord":
                r = rows[at(args[1])[0]]
                size = (r["xmax"] - r["xmin"]) / max(len(r["text"]), 1) * len(args[0])
                if args[2] == "left":
                    add(r["page_idx"], args[0], r["xmin"] - 20 - size, r["ymin"], r["xmin"] - 20, r["ymax"])
                else:
                    add(r["page_idx"], args[0], r["xmax"] + 20, r["ymin"], r["xmax"] + 20 + size, r["ymax"])
            elif cmd == "mergeWords":
                keys = [k for p in args for k in at(p)]
                whole = "".join(rows[k]["text"] for k in keys)
                put(keys[0], whole)
                for k in keys[1:]:
                    put(k, "")
            elif cmd == "splitWord":
                key = at(args[0])[0]
                r = rows[key]
                cut = r["text"].find(args[1]) + len(args[1])
                if cut < len(args[1]):
                    raise UnknownCommand(f"{args[1]!r} isn't in {args[0]}")
                share = r["xmin"] + (r["xmax"] - r["xmin"]) * cut / max(len(r["text"]), 1)
                add(r["page_idx"], r["text"][cut:], share, r["ymin"], r["xmax"], r["ymax"])
                put(key, r["text"][:cut])
                r["xmax"] = share
            elif cmd == "deletePage":
                gone = int(args[0][2:])
                rows = {(p - (p > gone), w): r | {"page_idx": p - (p > gone)} for (p, w), r in rows.items() if p != gone}
            else:
                raise UnknownCommand(f"document {doc}: {cmd!r} isn't a command of words")
        return [rows[k] for k in sorted(rows)]

    kinds = [f.dataType.simpleString() for f in slim.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for args in zip(*(c.to_pylist() for c in batch.columns)) for r in fold(*args)]
            number, whole = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}, [[r[c] for r in out] for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(v, number[k]) for v, k in zip(whole, kinds)], columns)

    # A document's words and edits travel as one row each.
    texts = marked.where("_edited").groupBy("doc_id").agg(F.collect_list(F.struct(*columns[1:], "_last")).alias("_words"))
    todo = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "cmd", "args"))).alias("_todo"))
    changed = texts.join(todo, "doc_id", "full").select("doc_id", "_words", "_todo").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in zip(columns, kinds)))
    return marked.where("not _edited").select(*columns).unionByName(changed)


def edited_edges(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Edges (doc_id, page_idx, edge_idx, x1, y1, x2, y2, in parts of a page) after moveEdge and moveEdges (path, coord1 or coord2, direction, thousandths: 5 if not told); a path is pa0.ed3, or pa0.ed3:5 for a range.
    Moves add up, so their order doesn't count; a path of another form is an error."""
    own = known_edits(edits, EDGE_COMMANDS)
    path, form = F.get("args", F.lit(0)), "^pa([0-9]+)[.]ed([0-9]+)(:([0-9]+))?$"
    good = path.rlike(form) & F.get("args", F.lit(1)).isin("coord1", "coord2")
    checked = F.when(good, path).otherwise(F.raise_error(F.concat(F.lit("not an edge: "), F.array_join("args", " "))))
    part = lambda k: F.regexp_extract(checked, form, k)
    first = part(2).cast("int")
    moves = own.select(
        "doc_id", part(1).cast("int").alias("page_idx"), F.explode(F.sequence(first, F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), first))).alias("edge_idx"),
        F.get("args", F.lit(1)).alias("which"), F.get("args", F.lit(2)).alias("direction"), F.coalesce(F.get("args", F.lit(3)).cast("int"), F.lit(5)).alias("thou"),
    )
    return move_edges(edges, moves, (*PAGE, "edge_idx"))


def edited_regions(regions: DataFrame, edits: DataFrame) -> DataFrame:
    """Regions (doc_id, page_idx, region, word_idxs) with the words that addWords (region, paths of words of its page) and addWordIdxs (region, indices) put behind their own, in the edits' order."""
    own = known_edits(edits, REGION_COMMANDS).select("doc_id", F.get("args", F.lit(0)).alias("region"), "seq", "cmd", F.expr("slice(args, 2, size(args))").alias("what"))
    added = own.select("doc_id", "region", "seq", "cmd", F.posexplode("what").alias("pos", "word"))
    index = F.when(F.col("cmd") == "addWords", F.regexp_extract("word", "^pa[0-9]+[.]wo([0-9]+)$", 1)).otherwise(F.col("word")).cast("int")
    each = added.withColumn("_i", index).groupBy("doc_id", "region").agg(F.array_sort(F.collect_list(F.struct("seq", "pos", "_i"))).alias("_new"))
    out = regions.join(each, ["doc_id", "region"], "left")
    return out.select(*[c for c in regions.columns if c != "word_idxs"], F.concat("word_idxs", F.coalesce(F.transform("_new", lambda n: n["_i"]), F.array().cast("array<int>"))).alias("word_idxs"))


def replace_strings(page_words: DataFrame, edits: DataFrame) -> DataFrame:
    """Words after edits (doc_id, page_idx, word_idx, old, new) of which each word has one at most: one join, no fold."""
    both = page_words.join(edits, [*PAGE, "word_idx"], "left")
    new = F.when(F.col("old").isNull(), F.col("text")).when(F.lower("old") == "<all>", F.col("new")).otherwise(F.replace("text", "old", "new"))
    return both.withColumn("orig_text", F.when(F.col("old").isNotNull(), F.col("text"))).withColumn("text", new).select(*page_words.columns, "orig_text")


def move_edges(edges: DataFrame, moves: DataFrame, key: tuple[str, ...] = ("edge_idx",)) -> DataFrame:
    """Edges (key, x1, y1, x2, y2) after moves (key, which, direction, thou): an end shifted by thousandths of the page."""
    step = lambda axis, plus, minus: F.sum(F.when(F.col("direction") == plus, F.col("thou")).when(F.col("direction") == minus, -F.col("thou")).otherwise(0))
    each = moves.groupBy(*key, "which").agg((step("x", "right", "left") / 1000).alias("dx"), (step("y", "down", "up") / 1000).alias("dy"))
    first = each.where("which = 'coord1'").select(*key, F.col("dx").alias("dx1"), F.col("dy").alias("dy1"))
    second = each.where("which = 'coord2'").select(*key, F.col("dx").alias("dx2"), F.col("dy").alias("dy2"))
    out = edges.join(first, list(key), "left").join(second, list(key), "left")
    return out.select(*key, *[(F.col(c) + F.coalesce(F.col(f"d{c}"), F.lit(0.0))).alias(c) for c in ("x1", "y1", "x2", "y2")])


def delete_page(words: DataFrame, page_idx: int) -> DataFrame:
    return words.where(F.col("page_idx") != page_idx).withColumn("page_idx", F.when(F.col("page_idx") > page_idx, F.col("page_idx") - 1).otherwise(F.col("page_idx")))


def error_counts(errors: DataFrame, *by: str) -> DataFrame:
    return errors.groupBy(*by, "error_name").agg(F.count("*").alias("n"))


def without_ignored(errors: DataFrame, ignored: DataFrame) -> DataFrame:
    """Errors that no row of (error_name, path) names."""
    return errors.join(ignored, ["error_name", "path"], "left_anti")


def to_do(docs: DataFrame, done: DataFrame, ignored: list[str] = (), substrings: list[str] = (), key: str = "pdf_name") -> DataFrame:
    """Documents not yet in the output catalogue, not ignored by name, and without an ignored part in their names."""
    out = docs.join(done.select(key).distinct(), key, "left_anti")
    if ignored:
        out = out.where(~F.col(key).isin(*ignored))
    for part in substrings:
        out = out.where(~F.contains(F.col(key), F.lit(part)))
    return out


def layered_config(defaults: dict[str, str], layers: DataFrame) -> DataFrame:
    """(doc_id, stub, key, value) by priority from layers (doc_id, stub, key, value, priority): the highest wins; documents without a layer have the defaults."""
    w = Window.partitionBy("doc_id", "stub", "key").orderBy(F.desc("priority"))
    chosen = layers.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("doc_id", "stub", "key", "value")
    docs = layers.select("doc_id", "stub").distinct().withColumn("kv", F.explode(F.map_entries(F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]))))
    base = docs.select("doc_id", "stub", F.col("kv.key").alias("key"), F.col("kv.value").alias("default"))
    return base.join(chosen, ["doc_id", "stub", "key"], "full").select("doc_id", "stub", "key", F.coalesce("value", "default").alias("value"))


def with_metadata(docs: DataFrame, meta: DataFrame, key: str = "pdf_name") -> tuple[DataFrame, DataFrame]:
    """(documents with their metadata, documents that have none)."""
    return docs.join(meta, key), docs.join(meta, key, "left_anti")


def folds(rows: DataFrame, order: Column, k: int) -> DataFrame:
    """Rows with fold: k parts of successive rows, cut at int(i * n / k). Ranks come from a range partitioning, so no task sorts all rows."""
    sorted_ = rows.withColumn("_o", order).repartitionByRange("_o").sortWithinPartitions("_o").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % F.lit(1 << 33))
    sorted_ = durable(sorted_)  # the partitions have to be the same both times they are read
    sizes = sorted_.groupBy("_p").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each partition
    total = sizes.agg(F.sum("_n").alias("_total"))
    at = F.col("_base") + F.col("_i")
    fold = F.floor(((at + 1) * k - 1) / F.col("_total")).cast("int")
    return sorted_.join(base.select("_p", "_base"), "_p").crossJoin(total).withColumn("fold", F.greatest(F.lit(0), F.least(F.lit(k - 1), fold))).select(*rows.columns, "fold")


def entity_scores(gold: DataFrame, found: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(label, n_gold, n_found, n_right, precision, recall, f1) by label, of entities equal in all keys."""
    a, b = gold.select(*keys, label).withColumn("g", F.lit(1)), found.select(*keys, label).withColumn("f", F.lit(1))
    n = a.join(b, [*keys, label], "full").groupBy(label).agg(F.count("g").alias("n_gold"), F.count("f").alias("n_found"), F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("n_right"))
    p, r = F.coalesce(F.try_divide("n_right", "n_found"), F.lit(0.0)), F.coalesce(F.try_divide("n_right", "n_gold"), F.lit(0.0))
    return n.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def iob(rows: DataFrame, group: tuple[str, ...], order: str, label: str) -> DataFrame:
    """Rows with tag: O without a label, B- where a label begins, I- where it goes on."""
    before = F.lag(label).over(Window.partitionBy(*group).orderBy(order))
    return rows.withColumn("tag", F.when(F.col(label).isNull(), "O").when(~F.col(label).eqNullSafe(before), F.concat(F.lit("B-"), label)).otherwise(F.concat(F.lit("I-"), label)))


def dominant_script(docs: DataFrame, block_of) -> DataFrame:
    """(doc_id, script, n_chars, n_scripts): the most frequent block of a text's characters; the first by name among equals."""
    chars = docs.select("doc_id", F.explode(F.split("text", "")).alias("ch")).groupBy("doc_id", "ch").agg(F.count("*").alias("n")).where("ch <> ''")
    blocks = chars.withColumn("script", block_of(F.col("ch"))).groupBy("doc_id", "script").agg(F.sum("n").alias("n"))
    first = F.min(F.struct(-F.col("n"), "script"))
    return blocks.groupBy("doc_id").agg(first["script"].alias("script"), F.max("n").alias("n_chars"), F.count("*").alias("n_scripts"))
