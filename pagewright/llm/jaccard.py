"""N-gram Jaccard join: adaptive multi-match prefixes, then exact verification.

All texts whose sets of word n-grams are equal are one node. A node posts the first (rarest) grams of its set: with l extra
ones, two nodes of Jaccard similarity >= t share at least min of their l among them. Each node chooses its l by the
candidates that its grams are estimated to bring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.blocks import bitmap, cells, compare, grouped, hits, slot, wanted
from pagewright.llm.columns import cuts, gram_hashes, mix, quoted, release, signed, utf8, word_hashes, words
from pagewright.session import durable

N, THRESHOLD = 3, 0.6
LONGEST = 8
SLOT_BITS = 20
HOT_GRAMS = 1 << 18
BLOCK_BITS = 13
FLUSH = 1 << 20
POSTINGS_TOGETHER = 4_000_000
#: Places are told in parts of a set, rounded down, so that they take a byte beside the gram, where shuffled rows compress.
PLACES = 256
#: Grams of a node's sketch, and nodes whose groups are known where pairs are formed: neither changes the result.
SKETCH, KNOWN = 8, 1 << 20
#: Nodes are grouped where likely pairs have this part of the threshold; a group is compared in blocks of about so many nodes and grams. Neither changes the result.
LOOSE, GROUP_NODES, GROUP_GRAMS = 0.5, 1024, 1 << 20
_U = np.uint64


def gram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; one of all its words if they are fewer than n; none without a word."""
    data, offsets = utf8(texts)
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    grams = gram_hashes(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.array([hashes[a:b].sum() + _U(b - a)], _U) * _U(0x9E3779B97F4A7C15)))
        else:
            out.append(np.zeros(0, _U))
    return out


def node_of(grams: np.ndarray) -> int:
    """A set's hash, as a long."""
    return int(signed(mix(np.array([mix(grams ^ _U(0x5851F42D4C957F2D)).sum() + _U(len(grams))], _U)))[0])


def choose(frequencies: np.ndarray, size: int, t: float) -> tuple[int, int]:
    """(l, grams to post) of least estimated cost: reading the postings of the prefix, and verifying who shares l of them.
    ``frequencies``: estimated, of the grams in the order of posting."""
    need = int(np.ceil(t * size - 1e-9))
    base = size - need
    best = (0.0, 0, 0)
    for l in range(1, min(LONGEST, need) + 1):
        others = float((frequencies[: base + l] - 1).sum())
        cost = base + l + others + 20.0 * others / l
        if l == 1 or cost < best[0]:
            best = (cost, l, base + l)
    return best[1], best[2]


def summarise(docs: DataFrame, n: int) -> DataFrame:
    """One pass: rows (doc_id, node, size, sketch) of texts with a word, where the sketch has the grams of least hash and size says how many there are, (null, gram, times) of grams that a part of the table holds
    more than once, and (0, null, times) of how many grams there are."""

    def sketch(grams: np.ndarray) -> np.ndarray:
        hashes = mix(grams ^ _U(0x2545F4914F6CDD1D))
        return signed(np.partition(hashes, SKETCH)[:SKETCH] if len(hashes) > SKETCH else hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()

        def counted() -> pa.RecordBatch:
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times > 1
            told = np.append(signed(grams[keep]), 0), np.append(times[keep], total).astype(np.int64)
            return batch_of(pa.array([None] * int(keep.sum()) + [0], pa.int64()), pa.array(told[0], mask=np.arange(len(told[0])) == len(told[0]) - 1), pa.array(told[1]))

        def batch_of(ids: pa.Array, keys: pa.Array, times: pa.Array, sketches: list[np.ndarray] | None = None) -> pa.RecordBatch:
            told = pa.nulls(len(ids), pa.list_(pa.int64())) if sketches is None else pa.array(sketches, pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([ids, keys, times, told], ["doc_id", "key", "times", "sketch"])

        for batch in batches:
            for at, rows in cuts(batch.column("text")):
                piece = batch.slice(at, rows)
                sets = gram_sets(piece.column("text"), n)
                nodes = np.array([node_of(s) if len(s) else 0 for s in sets], np.int64)
                some = np.array([len(s) > 0 for s in sets], bool)
                ids = piece.column("doc_id").filter(pa.array(some))
                yield batch_of(ids, pa.array(nodes[some]), pa.array([len(s) for s in sets if len(s)], pa.int64()), [sketch(s) for s in sets if len(s)])
                for s, node in zip(sets, nodes.tolist()):
                    if len(s) and node not in seen:
                        seen.add(node)
                        held.append(s)
                        total += len(s)
                if total > 2 * FLUSH:
                    yield counted()
                    held, total = [], 0
        if held:
            yield counted()
        release()

    return docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, key bigint, times bigint, sketch array<bigint>")


def hot_levels(grams: DataFrame, all_grams: int) -> tuple[np.ndarray, float]:
    """log2 of the estimated frequency by slot (the top bits of a gram's hash); of a fixed size: only the most frequent grams,
    down to a frequency that leaves at most HOT_GRAMS of them, have one. And the mean frequency of all others. Postings are ordered by
    these estimates, and prefixes lengthened; results don't depend on them."""
    levels = durable(grams.groupBy("key").agg(F.sum("times").alias("times")).select(F.shiftrightunsigned("key", 64 - SLOT_BITS).cast("int").alias("slot"), "times", F.floor(F.log2(F.col("times").cast("double"))).cast("int").alias("level")))
    counts = levels.groupBy("level").agg(F.count("*").alias("n"), F.sum("times").alias("times")).collect()
    by_level = {r["level"]: r["n"] for r in counts}
    lowest, total = 64, 0
    while lowest > 1 and total + by_level.get(lowest - 1, 0) <= HOT_GRAMS:
        lowest -= 1
        total += by_level.get(lowest, 0)
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in levels.where(F.col("level") >= lowest).groupBy("slot").agg(F.max("level").alias("level")).toLocalIterator():
        table[r["slot"]] = r["level"]
    return table, 1 + sum(r["times"] for r in counts if r["level"] < lowest) / all_grams


def blocks(grams: np.ndarray, level: np.ndarray, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sides, places of the grams) under which a node posts its grams. Nodes of a gram that is estimated to be in more than 2**BLOCK_BITS of them are dealt to blocks, and each two
    blocks meet under a key of their own; there the sides are 1 and 2, and only nodes of different sides are paired (0: all are)."""
    hot = level >= BLOCK_BITS
    if not hot.any():
        return grams, np.zeros(len(grams), np.int64), np.arange(len(grams))
    keys, sides, places = [grams[~hot]], [np.zeros(int((~hot).sum()), np.int64)], [np.flatnonzero(~hot)]
    for place, g, bits in zip(np.flatnonzero(hot).tolist(), grams[hot], level[hot].tolist()):
        count = 1 << (int(bits) - BLOCK_BITS + 1)
        own, other = int(mix(np.array([node], np.int64).view(_U))[0]) % count, np.arange(count)
        low, high = np.minimum(own, other).astype(_U), np.maximum(own, other).astype(_U)
        keys.append(mix(g ^ mix((low << _U(32)) + high + _U(1))))
        sides.append(np.where(other == own, 0, np.where(other > own, 1, 2)).astype(np.int64))
        places.append(np.full(count, place))
    return np.concatenate(keys), np.concatenate(sides), np.concatenate(places)


def postings(docs: DataFrame, levels: np.ndarray, cold: float, n: int, t: float) -> DataFrame:
    """(gram, info, node, size) of the grams that each node posts. info: the gram's place in the node's order, in parts of 1 / PLACES of the set, in its lowest 8 bits, l in the next 8, then the side (see blocks)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for batch in batches:
            for at, rows in cuts(batch.column("text")):
                out = []
                for grams in gram_sets(batch.column("text").slice(at, rows), n):
                    if not len(grams) or (node := node_of(grams)) in seen:
                        continue
                    seen.add(node)
                    level = table[(grams >> _U(64 - SLOT_BITS)).astype(np.int64)]
                    order = np.argsort(level, kind="stable")
                    l, post = choose(np.where(level[order] > 0, np.exp2(level[order].astype(np.float64)), cold), len(grams), t)
                    out.append((*blocks(grams[order[:post]], level[order[:post]], node), node, len(grams), l))
                if out:
                    count = [len(o[0]) for o in out]
                    node, size, l = (np.repeat(np.array([o[k] for o in out], kind), count) for k, kind in ((3, np.int64), (4, np.int32), (5, np.int64)))
                    place, side = np.concatenate([o[2] for o in out]) * PLACES // size, np.concatenate([o[1] for o in out])
                    columns = signed(np.concatenate([o[0] for o in out])), (place | l << 8 | side << 16).astype(np.int32), node, size
                    for a in range(0, len(node), 200_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 200_000]) for c in columns], ["gram", "info", "node", "size"])
        release()

    return docs.select("text").where("text is not null and doc_id is not null").mapInArrow(run, "gram bigint, info int, node bigint, size int")


def met(group: np.ndarray, node: np.ndarray, size: np.ndarray, info: np.ndarray, t: float, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, grams that they must share), about FLUSH at a time, of each two nodes of a group that can have a similarity of t as far as their sizes and the gram's places tell.

    Two sets of Jaccard similarity >= t have least = t / (1 + t) * (their sizes) grams in common or more, and behind the l-th of these in x stand at least least - l others: it is among
    the first |x| - least + l of x, and likewise of y. A gram that stands further behind in one of them is none of those first l.
    With ``root``, nodes of equal roots aren't paired."""
    order = np.lexsort((node, size, group))
    group, node, size, info = group[order], node[order], size[order], info[order]
    root = node if root is None else root[order]
    # A node that several tasks have posted counts once. Then by growing size, each with those of at most 1 / t of its size.
    first = np.r_[True, (group[1:] != group[:-1]) | (node[1:] != node[:-1])]
    group, node, size, info, root = group[first], node[first], size[first].astype(np.int64), info[first], root[first]
    l, side, place = info >> 8 & 255, info >> 16, -((info & 255).astype(np.int64) * -size // PLACES)
    span = int(size.max(initial=0)) + 1
    upto = np.searchsorted(group * span + size, group * span + np.minimum((size / t + 1e-9).astype(np.int64), span - 1), "right")
    count = upto - np.arange(len(group)) - 1
    total = np.cumsum(count)
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FLUSH, "right")))
        c = count[at:to]
        i = np.repeat(np.arange(at, to), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        need = np.minimum(l[i], l[j])
        least = np.ceil(t / (1 + t) * (1 - 1e-8) * (size[i] + size[j]) - 1e-6).astype(np.int64)
        keep = (place[i] < size[i] - least + need) & (place[j] < size[j] - least + need) & ((side[i] == 0) | (side[i] != side[j])) & (root[i] != root[j])
        i, j = i[keep], j[keep]
        yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), need[keep].astype(np.int32)
        at = to


def summed(a: np.ndarray, b: np.ndarray, need: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same with times added up for equal pairs. They are ordered by a hash; pairs of one hash may be left in several parts, which is harmless."""
    order = np.argsort(mix(a.view(_U) ^ mix(b.view(_U))))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], need[order[first]], np.add.reduceat(times[order], first, dtype=np.int32)


def candidates(posted: DataFrame, t: float, rows: float, known: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(a, b): nodes, a < b, that share as many of their posted grams as they must. About ``rows`` postings are divided so that many are
    together: a pair is told once for each part in which it shares grams. ``known``: nodes, in order, and their roots; nodes of one root are left out as pairs."""
    shared = posted.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        pairs, held, total = none, [], 0
        nodes, roots = shared.value or (none[0], none[0])

        def told() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(pairs[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 200_000]) for c in pairs], ["a", "b", "need", "times"])

        for edges, (_, info, node, size) in grouped(batches):
            count = np.diff(edges)
            several = np.flatnonzero(np.repeat(count > 1, count))
            if not len(several):
                continue
            group = np.repeat(np.arange(len(count)), count)[several]
            node, root = node[several], None
            if len(nodes):
                at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
                root = np.where(nodes[at] == node, roots[at], node)
                # Grams that stand in one group of nodes only are the many.
                start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                mixed = np.repeat(np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start), np.diff(np.r_[start, len(group)]))
                several, group, node, root = several[mixed], group[mixed], node[mixed], root[mixed]
                if not len(several):
                    continue
            for a, b, need in met(group, node, size[several], info[several], t, root):
                held.append((a, b, need, np.ones(len(a), np.int32)))
                total += len(a)
                if total > FLUSH:
                    pairs = summed(*map(np.concatenate, zip(pairs, *held)))
                    held, total = [], 0
                    if len(pairs[0]) > 2 * FLUSH:
                        yield from told()
                        pairs = none
        if total:
            pairs = summed(*map(np.concatenate, zip(pairs, *held)))
        yield from told()
        release()

    parts = max(posted.sparkSession.sparkContext.defaultParallelism, int(np.ceil(rows / POSTINGS_TOGETHER)))
    found = posted.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(run, "a bigint, b bigint, need int, times int")
    return found.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("need").alias("need")).where("times >= need").select("a", "b")


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return both / (len(x) + len(y) - both)


def payloads(docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(node, payload): the sets of the nodes in (node, rep), among some others; one may be there more than once."""
    # Only documents in the bitmap are looked at; what it lets through by chance finds no partner.
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(reps, "rep"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece = batch.filter(hits(shared.value, batch.column("slot")))
            for at, rows in cuts(piece.column("text")):
                grams = gram_sets(piece.column("text").slice(at, rows), n)
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
                values = pa.array(np.concatenate([np.sort(signed(g)) for g in grams]))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(g) for g in grams], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["node", "payload"])

    texts = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("rep"), "text").select(slot("rep").alias("slot"), "text")
    return texts.mapInArrow(sets, "node bigint, payload array<bigint>")


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int, t: float) -> DataFrame:
    """(a, b, jaccard) of the pairs of at least t, from the sets themselves; ``nodes``: (node, rep), a document of each."""
    cell = cells(pairs)
    return compare(cell, payloads(docs, durable(wanted(cell).select("node").distinct().join(nodes, "node")), n), overlap, t, "jaccard")


def summarised(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(summary, (doc_id, node) of the documents, (node, rep), how many grams there are)."""
    summary = durable(summarise(docs, n))
    ids = summary.where("doc_id is not null and key is not null").select("doc_id", F.col("key").alias("node")).distinct()
    grams = summary.where("key is null").agg(F.sum("times")).first()[0] or 1
    return summary, ids, ids.groupBy("node").agg(F.min("doc_id").alias("rep")), grams


def likely(summary: DataFrame) -> DataFrame:
    """(a, b): of each node and the least nodes that share a gram of their sketches, the one with most of them; at most one pair a node."""
    sketches = summary.where("sketch is not null").groupBy(F.col("key").alias("node")).agg(F.first("sketch").alias("sketch")).select("node", F.explode("sketch").alias("gram"))
    least = sketches.groupBy("gram").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("gram", "least")
    met = sketches.join(least, "gram").where("least < node").groupBy("node", "least").count()
    return met.groupBy("node").agg(F.max_by("least", F.struct("count", "least")).alias("least")).select(F.col("least").alias("a"), F.col("node").alias("b"))


def largest(roots: DataFrame) -> DataFrame:
    """(node, root) of at most KNOWN nodes, and of their roots: those of the largest groups, by powers of two; whole groups."""
    sized = durable(roots.join(roots.groupBy("root").agg(F.floor(F.log2(F.count("*").cast("double"))).cast("int").alias("level")), "root"))
    counts = {r["level"]: r["count"] for r in sized.groupBy("level").count().collect()}
    lowest, total = 64, 0
    while lowest and total + counts.get(lowest - 1, 0) <= KNOWN:
        lowest -= 1
        total += counts.get(lowest, 0)
    own = sized.where(F.col("level") >= lowest)
    return own.select("node", "root").union(own.select(F.col("root").alias("node"), "root").distinct())


def in_order(members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, their roots) of ``largest``."""
    found = members.toArrow()  # bounded by KNOWN, and as many roots at most
    node, root = (found.column(k).to_numpy().astype(np.int64) for k in range(2))
    order = np.argsort(node)
    return node[order], root[order]


def common(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """How many grams each two of two lists of sets have in common, from (set, gram) entries of either list, where grams are numbered from 0. Grams of many sets are met in a product of matrices, others one by one."""
    both = np.zeros(shape, np.int32)
    grams = 1 + max(x[1].max(initial=-1), y[1].max(initial=-1))
    cx, cy = np.bincount(x[1], minlength=grams), np.bincount(y[1], minlength=grams)
    meetings = cx * cy
    many = meetings > max(shape[0] * shape[1] / 64, 1)
    found = np.flatnonzero(many)
    for a in range(0, len(found), 1024):
        column = np.full(grams, -1)
        column[found[a : a + 1024]] = np.arange(len(found[a : a + 1024]))
        sides = []
        for (own, gram), rows in zip((x, y), shape):
            sides.append(np.zeros((rows, len(found[a : a + 1024])), np.float32))
            at = column[gram]
            sides[-1][own[at >= 0], at[at >= 0]] = 1
        both += (sides[0] @ sides[1].T).astype(np.int32)  # at most 1024: exact
    own, gram = (c[(meetings[x[1]] > 0) & ~many[x[1]]] for c in x)
    order = np.argsort(y[1], kind="stable")
    first, count = np.cumsum(cy) - cy, cy[gram]
    total = np.cumsum(count)
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FLUSH, "right")))
        c = count[at:to]
        j = y[0][order[np.repeat(first[gram[at:to]], c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)]]
        both += np.bincount(np.repeat(own[at:to], c) * shape[1] + j, minlength=both.size).reshape(shape).astype(np.int32)
        at = to
    return both


def met_whole(node: np.ndarray, block: np.ndarray, size: np.ndarray, several: np.ndarray, sets: list[np.ndarray], p: int, q: int, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, a, b), from each two nodes of blocks p and q that have a similarity of t or more: (0, node, how many documents its partners have), (1, a, b) of as many pairs as connect what these connect, and
    (2, a, b) of pairs in which both are ``several``."""
    x, y = np.flatnonzero(block == p), np.flatnonzero(block == q)
    length = np.array([len(s) for s in sets], np.int64)
    gram = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.repeat(np.arange(len(sets)), length)

    def entries(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(len(sets), -1)
        place[side] = np.arange(len(side))
        at = place[own]
        return at[at >= 0], gram[at >= 0]

    both = common(entries(x), entries(y), (len(x), len(y)))
    hit = both / (length[x][:, None] + length[y][None] - both) >= t - 1e-9
    if p == q:
        np.fill_diagonal(hit, False)
    near = np.zeros(len(sets), np.int64)
    near[x] += np.where(hit, size[y][None], 0).sum(axis=1)
    if p != q:
        near[y] += np.where(hit, size[x][:, None], 0).sum(axis=0)
    label = np.arange(len(sets))
    while True:
        before = label.copy()
        label[x] = np.minimum(label[x], np.where(hit, label[y][None], len(sets)).min(axis=1, initial=len(sets)))
        label[y] = np.minimum(label[y], np.where(hit, label[x][:, None], len(sets)).min(axis=0, initial=len(sets)))
        label = label[label]
        if (label == before).all():
            break
    some, led = np.flatnonzero(near), np.flatnonzero(label != np.arange(len(sets)))
    i, j = np.nonzero(hit & several[x][:, None] & several[y][None])
    once = (i < j) | (p != q)
    i, j = x[i[once]], y[j[once]]
    kind = np.repeat([0, 1, 2], [len(some), len(led), len(i)]).astype(np.int32)
    return kind, np.concatenate([node[some], node[led], node[i]]), np.concatenate([near[some], node[label[led]], node[j]])


def whole_groups(docs: DataFrame, summary: DataFrame, ids: DataFrame, nodes: DataFrame, members: DataFrame, n: int, t: float) -> DataFrame:
    """(kind, a, b) of met_whole, for all pairs of nodes within each of the groups (node, root). Each two blocks of a group meet in a task; no pair has a row."""
    lengths = summary.where("doc_id is not null and key is not null").groupBy(F.col("key").alias("node")).agg(F.max("times").alias("length"))
    several = ids.join(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "doc_id").select("node").distinct().withColumn("several", F.lit(True))
    known = members.join(lengths, "node").join(ids.groupBy("node").agg(F.count("*").alias("size")), "node").join(several, "node", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    known = durable(known)
    blocks_of = known.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / F.lit(GROUP_NODES), F.sum("length") / F.lit(GROUP_GRAMS))).cast("int").alias("blocks"))
    placed = known.join(blocks_of, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.select("node", "root", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "size", "several")
    rows = placed.join(payloads(docs, durable(known.select("node").join(nodes, "node")), n), "node").select("root", "p", "q", "block", "node", "size", "several", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        cell, out, told = None, [], 0

        def close() -> int:
            block, size, several = (np.array(c) for c in zip(*(h[:3] for h in held.values())))
            out.append(met_whole(np.array(list(held), np.int64), block, size, several, [h[3] for h in held.values()], cell[1], cell[2], t))
            return len(out[-1][0])

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["kind", "a", "b"])

        for batch in batches:
            lists = batch.column("payload")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, (root, p, q, block, node, size, several) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(7)))):
                if (root, p, q) != cell:
                    told += close() if held else 0
                    held, cell = {}, (root, p, q)
                    if told > FLUSH:
                        yield batch_of()
                        out, told = [], 0
                held[node] = block, size, several, values[offsets[i] : offsets[i + 1]].copy()
        if held:
            close()
        if out:
            yield batch_of()
        release()

    return rows.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(run, "kind int, a bigint, b bigint")


def similar_nodes(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, node) of the documents, (a, b, jaccard) of the pairs of nodes of different groups, and (kind, a, b) of met_whole, of the pairs within groups. Groups are what likely pairs, by sketches, connect;
    which they are doesn't change what is found. So large groups of near copies aren't expanded into candidates, and the exact join is left with what lies between groups."""
    summary, ids, nodes, grams = summarised(docs, n)
    loose = durable(verified(docs, nodes, durable(likely(summary)), n, t * LOOSE))
    members = durable(largest(components(loose.select("a", "b"))))
    within = durable(whole_groups(docs, summary, ids, nodes, members, n, t))
    levels, cold = hot_levels(summary.where("doc_id is null"), grams)
    pairs = durable(candidates(postings(docs, levels, cold, n, t), t, grams * (1 - t), in_order(members)))
    return ids, durable(verified(docs, nodes, pairs, n, t)), within


def spanning_nodes(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """As similar_nodes, with fewer pairs: as many of those of at least t as lead from each node to all that are reached over any. First the likely pairs are verified; then, of all others,
    those whose nodes these don't connect. So a group of near copies isn't expanded into its pairs."""
    summary, ids, nodes, grams = summarised(docs, n)
    some = durable(verified(docs, nodes, durable(likely(summary)), n, t))
    levels, cold = hot_levels(summary.where("doc_id is null"), grams)
    rest = durable(candidates(postings(docs, levels, cold, n, t), t, grams * (1 - t), in_order(largest(components(some.select("a", "b"))))))
    return ids, durable(some.union(verified(docs, nodes, rest, n, t)))


def linked(ids: DataFrame, pairs: DataFrame, name: str, within: DataFrame | None = None) -> DataFrame:
    """(name, class_id, n_links) of the ids that have a link, from (name, node) and pairs (a, b) of nodes; an id may be of several nodes.

    Ids of one node are linked, and those of two nodes of a pair. n_links counts an id's links to other ids (once for each two nodes that link them); class_id is the
    least id that is reached over links. Nothing is expanded into pairs of ids. ``within``: (kind, a, b) of met_whole, of further pairs."""
    sizes = ids.groupBy("node").agg(F.count("*").alias("size"))
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    near = both.join(sizes.withColumnRenamed("node", "other"), "other").select("node", F.col("size").alias("near"))
    edges = pairs.select("a", "b")
    if within is not None:
        near = near.union(within.where("kind = 0").select("a", "b"))
        edges = edges.union(within.where("kind = 1").select("a", "b"))
        both = both.union(within.where("kind = 2").select("a", "b")).union(within.where("kind = 2").select("b", "a"))
    near = near.groupBy("node").agg(F.sum("near").alias("near"))
    several = durable(ids.groupBy(name).agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1").select(name, "first"))
    again = ids.join(several, name).select(name, "node", "first")
    own = again.select(name, "node").join(both, "node").select(name, F.col("other").alias("node")).join(again, [name, "node"]).groupBy(name).agg(F.count("*").alias("own"))
    roots = components(edges.union(again.select(F.col("node").alias("a"), F.col("first").alias("b"))))
    told = ids.join(sizes.join(near, "node", "left").join(roots, "node", "left"), "node")
    told = durable(told.select(name, F.coalesce("root", "node").alias("root"), (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links")).where("links > 0"))
    least = told.groupBy("root").agg(F.min(name).alias("class_id"))
    found = told.join(least, "root").groupBy(name).agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links")).join(own, name, "left")
    return found.select(name, "class_id", (F.col("links") - F.coalesce("own", F.lit(0))).cast("bigint").alias("n_links")).where("n_links > 0")


def join(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of each document that has a Jaccard similarity of at least t to another one: n_links is the number of those others, and class_id the least
    doc_id that is reached over links. A document that is like no other is a class of its own, and has no row. Exact, without caps: all links between different sets are found and counted,
    and documents with equal sets, which are all linked, are counted without being paired.

    Words are runs of characters other than ASCII white space. A text of fewer than n words has one gram. Null doc_id, null text, or a text without a
    word: no row. Repeated rows count once; two texts of one doc_id are compared apart, are not a link with themselves, and are in one class. Other columns play no part. An empty table gives an empty result.
    """
    ids, pairs, within = similar_nodes(docs, n, t)
    return linked(ids, pairs, "doc_id", within)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for edges (a, b); by alternating large and small stars. A star's centre is aggregated and
    joined, so that one of very many edges is divided among tasks."""
    current = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = durable(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower)
        current = durable(small.distinct())
        found = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(found)


def one_of_each(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """The documents without those that are, directly or through others, similar to one of a smaller doc_id; rows with a null doc_id or
    without a word stay. Of repeated rows (doc_id and text) one stays."""
    ids, pairs = spanning_nodes(docs, n, t)
    gone = linked(ids, pairs, "doc_id").where("doc_id <> class_id").select("doc_id")
    kept = docs.join(durable(gone), "doc_id", "left_anti")
    again = durable(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    single = kept.join(again, "doc_id", "left_anti")
    return single.unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*[F.col(quoted(c)) for c in docs.columns])
