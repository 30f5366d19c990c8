"""Vocabularies, dictionaries and name trees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.session import durable


def exact(words: DataFrame, vocab: DataFrame, text: str = "text", fold: bool = False) -> DataFrame:
    """The rows whose text is in the vocabulary (pos, text)."""
    key = (lambda c: F.lower(c)) if fold else (lambda c: c)
    return words.join(vocab.select(key(F.col("text")).alias("_v")).distinct(), key(F.col(text)) == F.col("_v"), "left_semi")


def fuzzy(words: DataFrame, vocab: DataFrame, distance: int, text: str = "text") -> DataFrame:
    """(text, entry, dist, pos) of every entry within an edit distance of each distinct text. Deleting up to ``distance`` characters in all ways from both sides makes the search an
    equi-join: two texts within the distance share a form."""
    found = words.select(F.col(text).alias("text")).distinct()
    if distance <= 2:
        def forms(c: Column) -> Column:
            once = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
            out = F.array(c)
            level = F.array(c)
            for _ in range(distance):
                level = F.array_distinct(F.flatten(F.transform(level, lambda s: F.when(F.length(s) > 0, once(s)).otherwise(F.array().cast("array<string>")))))
                out = F.concat(out, level)
            return F.array_distinct(out)

        left = found.withColumn("form", F.explode(forms(F.col("text"))))
        right = vocab.select("pos", F.col("text").alias("entry")).withColumn("form", F.explode(forms(F.col("entry"))))
        pairs = left.join(right, "form").select("text", "entry", "pos").distinct()
    else:
        pairs = found.join(vocab.select("pos", F.col("text").alias("entry")), F.abs(F.length("text") - F.length("entry")) <= distance)
    return pairs.withColumn("dist", F.levenshtein("text", "entry", distance)).where("dist >= 0")


def nearest(found: DataFrame) -> DataFrame:
    """Each text's entry of least distance; the first of the vocabulary among equals."""
    return found.groupBy("text").agg(F.min_by("entry", F.struct("dist", "pos")).alias("entry"), F.min("dist").alias("dist"))


OF_FORMS = tuple(f"{c}f" for c in "abcnqu")


def corrected(words: DataFrame, vocab: DataFrame, distance: int = 1) -> DataFrame:
    """Words with ``corrected``: words of the vocabulary as they are, six misread forms as 'of', other words of up to two characters as they are, the rest by the nearest entry within a distance."""
    bare = X.without_punctuation(F.col("text"))
    marked = words.withColumn("bare", bare)
    near = nearest(fuzzy(marked.where(F.length("bare") > 2), vocab, distance, "bare")).select(F.col("text").alias("bare"), "entry")
    fixed = F.when(F.length("bare") <= 2, F.when(F.col("bare").isin(*OF_FORMS), F.replace("text", "bare", F.lit("of"))).otherwise(F.col("text"))).when(F.col("entry").isNotNull(), F.replace("text", "bare", "entry")).otherwise(F.col("text"))
    return marked.join(near, "bare", "left").withColumn("corrected", fixed).drop("bare", "entry")


def merged(words: DataFrame, vocab: DataFrame, group: tuple[str, ...], order: str) -> DataFrame:
    """Words that were split: of two neighbours whose texts together are in the vocabulary the first takes both and the second goes, from left to right, so that no word is used twice."""
    w = Window.partitionBy(*group).orderBy(order)
    pair = words.withColumn("both", F.concat("text", F.lead("text").over(w)))
    known = pair.join(vocab.select(F.col("text").alias("both")).distinct().withColumn("hit", F.lit(1)), "both", "left")
    # Within a run of hits every other one merges.
    run = known.withColumn("at", F.row_number().over(w)).withColumn("stop", F.when(F.col("hit").isNull(), F.col("at")))
    last = F.coalesce(F.last("stop", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    taking = run.withColumn("takes", F.col("hit").isNotNull() & ((F.col("at") - last) % 2 == 1)).withColumn("taken", F.coalesce(F.lag("takes").over(w), F.lit(False)))
    return taking.where("not taken").withColumn("text", F.when(F.col("takes"), F.col("both")).otherwise(F.col("text"))).select(*words.columns)


def looked_up(words: DataFrame, dictionary: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their replacement, rows without one) by a dictionary (key, value)."""
    both = words.join(dictionary, key, "left")
    return both.where("value is not null"), both.where("value is null").drop("value")


def todo(texts: DataFrame, memory: DataFrame, key: str = "text") -> DataFrame:
    """The distinct texts that a translation memory hasn't got."""
    return texts.select(key).where(f"{key} is not null").distinct().join(memory.select(key), key, "left_anti")


def differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left, right) of keys whose values differ, or that one side hasn't got."""
    a, b = left.select(key, F.col(value).alias("left")), right.select(key, F.col(value).alias("right"))
    return a.join(b, key, "full").where(~F.col("left").eqNullSafe(F.col("right")))


# ---- name trees


class Circular(ValueError):
    """A tree in which a node is its own ancestor."""


def closure(nodes: DataFrame) -> DataFrame:
    """(node_id, ancestor_id, distance) of nodes (node_id, parent_id), each its own ancestor at 0; for trees of any depth. What is known of a node's ancestors is joined with what is known of theirs, so that
    each round doubles the distance. A circle is an error."""
    links = nodes.where("parent_id is not null").select("node_id", "parent_id").distinct()
    if not links.where("node_id = parent_id").isEmpty():
        raise Circular("a node is its own parent")
    known = durable(nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance")).distinct().unionByName(links.select("node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))))
    reach = 1
    while True:
        far = known.where(F.col("distance") == reach).select("node_id", F.col("ancestor_id").alias("via"))
        more = far.join(known.select(F.col("node_id").alias("via"), "ancestor_id", (F.col("distance") + reach).alias("distance")).where(F.col("distance") > reach), "via").select("node_id", "ancestor_id", "distance")
        more = durable(more)
        if more.isEmpty():
            return known
        if not more.where("node_id = ancestor_id").isEmpty():
            raise Circular("a node is its own ancestor")
        known, reach = durable(known.unionByName(more)), 2 * reach


MOST_NAMES = 2_000_000


def checked(rows: DataFrame) -> list:
    """The rows of a dictionary that all workers hold; an error above MOST_NAMES."""
    found = rows.limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names: split the tree, or join by the names' first words")
    return found


def named_spans(texts: DataFrame, names: DataFrame, key: str, boundary: bool = True, fold: bool = True) -> DataFrame:
    """(key, node_id, name, start, end) of all occurrences of names (node_id, name) in texts, those inside a longer one of the same node left out.

    All names are one automaton, held by each worker, so that a text is read once whatever their number. ``names`` is a dictionary; its size is checked.
    """
    import ahocorasick

    rows = checked(names.select("node_id", "name").distinct().orderBy("node_id", "name"))
    by_name: dict[str, list[int]] = {}
    for r in rows:
        if r["name"]:
            by_name.setdefault(r["name"].lower() if fold else r["name"], []).append(r["node_id"])
    shared = texts.sparkSession.sparkContext.broadcast(by_name)
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for name in shared.value:
            machine.add_word(name, name)
        if shared.value:
            machine.make_automaton()
        for frame in frames:
            out = []
            for k, text in zip(frame[key], frame["text"]):
                if not text or not shared.value:
                    continue
                read = text.lower() if fold and len(text.lower()) == len(text) else text
                last: dict[int, int] = {}
                found = sorted(((end - len(name) + 1, -(end + 1), node, name) for end, name in machine.iter(read) for node in shared.value[name]))
                for start, minus_end, node, name in found:
                    end = -minus_end
                    if boundary and (start and read[start - 1].isalnum() or end < len(read) and read[end].isalnum()):
                        continue
                    if end > last.get(node, 0):
                        out.append((k, node, name, start, end))
                        last[node] = end
            yield pd.DataFrame(out, columns=[key, "node_id", "name", "start", "end"])

    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, node_id bigint, name string, start int, end int")


def grouped_spans(spans: DataFrame, texts: DataFrame, tree: DataFrame, key: str, ignore: str = " (),.;") -> DataFrame:
    """(key, group_id, node_ids, starts, ends): matches joined upwards. From the leaves on, a parent's span is added to each child group whose extent it adjoins through ignorable
    characters and does not overlap; one that adjoins none begins a group."""
    tree_rows = {r["node_id"]: r["parent_id"] for r in checked(tree.select("node_id", "parent_id"))}
    shared = spans.sparkSession.sparkContext.broadcast(tree_rows)
    kind = spans.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent = shared.value
        paths: dict[int, list[int]] = {}

        def path(n: int) -> list[int]:
            """A node and its ancestors, the root last."""
            if n not in paths:
                out = [n]
                while (up := parent.get(out[-1])) is not None:
                    out.append(up)
                    if len(out) > len(parent) + 1:
                        raise Circular(f"node {n} is its own ancestor")
                paths[n] = out
            return paths[n]

        for batch in batches:
            rows: list[tuple] = []
            for k, text, nodes, starts, ends in zip(*[c.to_pylist() for c in batch.columns]):
                groups: list[list] = []  # of each its spans, its nodes, and where it begins and ends
                for _, node, start, end in sorted((1 - len(path(n)), n, s, e) for n, s, e in zip(nodes, starts, ends)):
                    hit = False
                    for g in groups:
                        own, known, low, high = g
                        if node not in known and (end <= low or start >= high) and node in path(own[0][0]) and not text[min(end, high) : max(start, low)].strip(ignore):
                            own.append((node, start, end))
                            known.add(node)
                            g[2], g[3] = min(low, start), max(high, end)
                            hit = True
                    if not hit:
                        groups.append([[(node, start, end)], {node}, start, end])
                rows += [(k, i, *([x[c] for x in own] for c in range(3))) for i, (own, *_) in enumerate(groups)]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [batch.schema.field(0).type, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [key, "group_id", "node_ids", "starts", "ends"])

    # A text's spans travel as one row, as calling Python for each text by itself takes longer than all the rest.
    found = spans.join(texts.select(key, "text"), key).groupBy(key).agg(F.first("text").alias("text"), F.collect_list(F.struct("node_id", "start", "end")).alias("_s"))
    return found.select(key, "text", "_s.node_id", "_s.start", "_s.end").mapInArrow(run, f"{key} {kind}, group_id int, node_ids array<bigint>, starts array<int>, ends array<int>")


#: What a selection keeps: the groups whose measure is largest.
SELECTIONS = {
    "left_most": "-array_min(starts)",
    "sum_span_len": "aggregate(zip_with(starts, ends, (s, e) -> e - s), 0, (a, x) -> a + x)",
    "connected_sum_span_len": "aggregate(zip_with(starts, ends, (s, e) -> e - s), 0, (a, x) -> a + x)",
    "deeper": "size(node_ids)",
    "inv_span_gap": "-(array_max(ends) - array_min(starts) - aggregate(zip_with(starts, ends, (s, e) -> e - s), 0, (a, x) -> a + x))",
    "sum_matching_len": "aggregate(zip_with(starts, ends, (s, e) -> e - s), 0, (a, x) -> a + x)",
    "first": "-group_id",
}


def selected(groups: DataFrame, key: str, strategy: str) -> DataFrame:
    """The groups of each text that a strategy keeps, all of those that tie: one of SELECTIONS (for 'connected_sum_span_len' only groups of two names or more), 'at_start', 'none' (all groups, as nothing is
    selected), 'non_overlapping' (greedily: of two that overlap the shorter goes, of equals the earlier) or 'unique' (of equal spans of equal nodes the first)."""
    if strategy == "none":
        return groups
    if strategy == "connected_sum_span_len":
        groups = groups.where("size(node_ids) >= 2")
    if strategy == "at_start":
        return groups.where("array_min(starts) = 0")
    if strategy == "unique":
        w = Window.partitionBy(key, "node_ids", "starts", "ends").orderBy("group_id")
        return groups.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    if strategy == "non_overlapping":

        def kept(groups: pa.Array) -> pa.Array:
            out = []
            for own in groups.to_pylist():
                low, high = [min(g["starts"]) for g in own], [max(g["ends"]) for g in own]
                gone: set[int] = set()
                for i in range(len(own)):
                    for j in range(i + 1, len(own)):
                        if i not in gone and j not in gone and low[i] < high[j] and low[j] < high[i]:
                            gone.add(j if high[j] - low[j] < high[i] - low[i] else i)
                out.append([i for i in range(len(own)) if i not in gone])
            return pa.array(out, pa.list_(pa.int32()))

        left = F.arrow_udf(kept, "array<int>")("_groups")
        together = groups.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("group_id", *[c for c in groups.columns if c not in (key, "group_id")]))).alias("_groups"))
        each = together.withColumn("_left", left).select(key, F.explode(F.transform("_left", lambda i: F.get("_groups", i))).alias("_g"))
        return each.select(*[F.col(c) if c == key else F.col("_g")[c].alias(c) for c in groups.columns])
    w = Window.partitionBy(key).orderBy(F.expr(SELECTIONS[strategy]).desc())
    return groups.withColumn("_rank", F.rank().over(w)).where("_rank = 1").drop("_rank")


def group_accessors(groups: DataFrame, tree: DataFrame, key: str) -> DataFrame:
    """(key, group_id, leaf_id, root_id, depth, level, span_start, span_end, is_contiguous): what groups (node_ids from the leaf up, starts, ends) tell: how many names they have, how deep the leaf lies in the tree, and whether
    each name's span begins where another ends, but for a sign and a blank."""
    level = closure(tree).groupBy("node_id").agg(F.max("distance").alias("level"))
    low, high = F.array_min("starts"), F.array_max("ends")
    gaps = high - low - F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0), lambda a, x: a + x)
    told = groups.select(
        key, "group_id", F.element_at("node_ids", 1).alias("node_id"), F.element_at("node_ids", -1).alias("root_id"), F.size("node_ids").alias("depth"), low.alias("span_start"), high.alias("span_end"),
        (gaps <= 2 * (F.size("node_ids") - 1)).alias("is_contiguous"),
    )
    return told.join(level, "node_id").withColumnRenamed("node_id", "leaf_id")


def path_match(groups: DataFrame, tree: DataFrame, path: list[str]) -> DataFrame:
    """The groups whose leaf's path (the names from the root to the node above it) has the given names in a row, whatever their case."""
    names = tree.select(F.col("node_id").alias("ancestor_id"), "name")
    above = closure(tree).where("distance > 0").join(names, "ancestor_id").groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("distance", "name")), False), lambda x: x["name"]), ".").alias("_path"))
    hits = above.where(F.contains(F.lower("_path"), F.lit(".".join(path).lower()))).select(F.col("node_id").alias("_leaf"))
    return groups.join(hits, F.element_at("node_ids", 1) == F.col("_leaf"), "left_semi")


_RESERVED = ("name", "alias", "unicode", "description", "expand_names")


def tree_of(text: str, ignored_levels: tuple[str, ...] = (), expand: tuple[tuple[str, str], ...] = ()) -> list[tuple[int, int | None, str, list[str], str | None, list[str], dict[str, str]]]:
    """(node_id, parent_id, name, aliases, level, path, info) of a YAML tree, numbered in depth-first order: a node has a name, perhaps aliases, at most one other key of a list of nodes, which names their level, and
    other keys that tell of it. Nodes of ignored levels are left out. ``expand``: each name that holds the first text is an alias with the second in its place, too."""
    import yaml

    out: list[tuple] = []

    def add(node: dict, parent: int | None, path: list[str], level: str | None) -> None:
        if "name" not in node:
            raise ValueError(f"a node below {'.'.join(path)!r} has no name")
        levels = [k for k, v in node.items() if k not in _RESERVED and not k.startswith("_") and isinstance(v, list)]
        if len(levels) > 1:
            raise ValueError(f"{node['name']!r} has children of several levels: {', '.join(levels)}")
        aliases = [str(a) for a in node.get("alias") or []]
        for old, new in expand:
            aliases += [n.replace(old, new).strip() for n in [str(node["name"]), *aliases] if old in n]
        info = {k: str(v) for k, v in node.items() if k not in ("name", "alias", *levels)}
        number = len(out)
        out.append((number, parent, str(node["name"]), aliases, level, path, info))
        for k in levels:
            if k not in ignored_levels:
                for child in node[k]:
                    add(child, number, [*path, str(node["name"])], k)

    add(yaml.safe_load(text), None, [], None)
    return out


def read_tree(spark: SparkSession, text: str, ignored_levels: tuple[str, ...] = (), expand: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The nodes of a YAML tree as a table."""
    return spark.createDataFrame(tree_of(text, ignored_levels, expand), "node_id bigint, parent_id bigint, name string, aliases array<string>, level string, path array<string>, info map<string,string>")


def tree_names(tree: DataFrame) -> DataFrame:
    """(node_id, parent_id, name): a row for each name and alias of the nodes, the longest first in each node."""
    return tree.select("node_id", "parent_id", F.explode(F.array_distinct(F.concat(F.array("name"), "aliases"))).alias("name")).orderBy("node_id", F.desc(F.length("name")), "name")


def alias_record(spans: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, aliases): the names by which each node was found, in order; none of nodes that weren't."""
    used = spans.groupBy("node_id").agg(F.array_sort(F.collect_set("name")).alias("aliases"))
    return nodes.select("node_id").join(used, "node_id", "left").select("node_id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def matching(groups: DataFrame, tree: DataFrame, level: int | None = None, below: int | None = None) -> DataFrame:
    """Groups whose deepest node is at a level of the tree (the root is 0), or below a node."""
    ancestors = closure(tree)
    leaf = groups.withColumn("node_id", F.element_at("node_ids", 1))
    if level is not None:
        depth = ancestors.groupBy("node_id").agg(F.max("distance").alias("depth"))
        leaf = leaf.join(depth.where(F.col("depth") == level), "node_id", "left_semi")
    if below is not None:
        leaf = leaf.join(ancestors.where(F.col("ancestor_id") == below), "node_id", "left_semi")
    return leaf.select(groups.columns)
