"""Verification of candidate pairs: each node's payload is sent once for many pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import durable

BLOCK = 256


def cells(pairs: DataFrame) -> DataFrame:
    """(hub, p, q, a, b) from (a, b): nodes that share their least partner meet in a hub, which is split into blocks of about BLOCK nodes
    by their ids' hash; a pair belongs to one pair of blocks."""
    both = pairs.union(pairs.select("b", "a"))
    hubs = both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("least")).select("x", F.least("x", "least").alias("hub"))
    placed = pairs.join(hubs, pairs["a"] == hubs["x"]).select("hub", "a", "b")
    members = placed.select("hub", F.col("a").alias("x")).union(placed.select("hub", "b")).groupBy("hub").agg(F.approx_count_distinct("x").alias("members"))
    blocks = F.ceil(F.col("members") / F.lit(BLOCK))
    return durable(placed.join(members, "hub").select("hub", F.pmod(F.xxhash64("a"), blocks).alias("p"), F.pmod(F.xxhash64("b"), blocks).alias("q"), "a", "b"))


def wanted(cell: DataFrame) -> DataFrame:
    """(hub, p, q, node): where each node's payload has to be."""
    return cell.select("hub", "p", "q", F.col("a").alias("node")).union(cell.select("hub", "p", "q", "b")).distinct()


BITMAP_BITS = 23


def slot(column: str) -> Column:
    """The bit of an id in a bitmap."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - BITMAP_BITS)


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of the ids, of a fixed size (1 MB). It says which rows of a large table to look at; what it lets through by chance has to be harmless."""
    words = ids.select(slot(column).alias("slot")).groupBy(F.expr("cast(shiftright(slot, 6) as int)").alias("w"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in words.agg(F.expr("bit_or(shiftleft(1L, cast(pmod(slot, 64) as int)))").alias("v")).toLocalIterator():
        out[r["w"]] = r["v"]
    return out


def hits(table: np.ndarray, slots: pa.Array) -> pa.Array:
    """Which slots are set."""
    s = slots.to_numpy()
    return pa.array(((table.view(np.uint64)[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)).astype(bool))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(edges, columns) of rows ordered by their first column, a batch at a time: edges[k] : edges[k + 1] is one whole group of equal keys."""
    open_: list[list[np.ndarray]] = []  # pieces of the group that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        edges = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
        if open_ and open_[0][0][0] != columns[0][0]:
            held = [np.concatenate(x) for x in zip(*open_)]
            yield np.array([0, len(held[0])]), held
            open_ = []
        if len(edges) > 1:
            if open_:
                columns = [np.concatenate(x) for x in zip(*open_, columns)]
                edges = np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])
            yield edges, columns
            open_ = [[c[edges[-1] :] for c in columns]]
        else:
            open_.append(columns)
    if open_:
        held = [np.concatenate(x) for x in zip(*open_)]
        yield np.array([0, len(held[0])]), held


def compare(cell: DataFrame, payloads: DataFrame, measure: Callable[[np.ndarray, np.ndarray], float], least: float, name: str) -> DataFrame:
    """(a, b, name) of the pairs whose measure is at least ``least``; ``payloads``: (node, payload), an array of longs or numbers."""
    kind = payloads.schema["payload"].dataType.simpleString()
    rows = wanted(cell).join(payloads, "node").select("hub", "p", "q", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("bigint").alias("b"), "payload")
    rows = rows.unionByName(cell.select("hub", "p", "q", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast(kind).alias("payload")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: dict[int, Any] = {}
        group = None
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(6)))
            lists = batch.column("payload")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            out = []
            for i, (hub, p, q, is_pair, a, b) in enumerate(keys):
                if (hub, p, q) != group:
                    here, group = {}, (hub, p, q)
                if is_pair:
                    m = measure(here[a], here[b])
                    if m >= least - 1e-9:
                        out.append((a, b, m))
                else:
                    here[a] = values[offsets[i] : offsets[i + 1]].copy()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["a", "b", name])

    return rows.repartition("hub", "p", "q").sortWithinPartitions("hub", "p", "q", "kind").mapInArrow(run, f"a bigint, b bigint, {name} double")


def listed(nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(ids_a, ids_b, name) from (node, ids) and (a, b, name): nodes of several ids with themselves, and the pairs, least id first."""
    equal = nodes.where(F.size("ids") > 1).select(F.col("ids").alias("ids_a"), F.col("ids").alias("ids_b"), F.lit(1.0).alias(name))
    a, b = nodes.select(F.col("node").alias("a"), F.col("ids").alias("ia")), nodes.select(F.col("node").alias("b"), F.col("ids").alias("ib"))
    near = pairs.join(a, "a").join(b, "b").where(F.size(F.array_union("ia", "ib")) > 1)
    swap = F.col("ia") > F.col("ib")
    return equal.unionByName(near.select(F.when(swap, F.col("ib")).otherwise(F.col("ia")).alias("ids_a"), F.when(swap, F.col("ia")).otherwise(F.col("ib")).alias("ids_b"), name))
