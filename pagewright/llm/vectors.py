"""Embedding near-dedup: a subspace pigeonhole join.

Vectors are turned by the principal axes of all of them and split into blocks of axes. Two vectors within a squared distance D have, in at
least one block, a squared distance within D times the block's share of the variance, as the shares add up to 1. Each block
is range-joined on a grid of some of its axes, which whole vectors are sent to, so that a pair is verified where it meets; it is told by the first block that has it within its budget, once.
How many blocks there are, and how many axes of each the grid takes, is chosen by estimated cost, which the results don't depend on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.columns import release
from pagewright.llm.jaccard import linked
from pagewright.session import durable

COSINE = 0.97
CELL_VECTORS = 8192
SLOT_BITS = 20
STRIP = 256
FLUSH = 1 << 18
#: Most grid axes of a block.
GRID_AXES = 8


def rotation(vectors: DataFrame, axes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(principal axes as columns, variance along each, vectors), from sums over all vectors; only axes x axes numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((axes + 1, axes + 1))
        for batch in batches:
            x = np.ones((batch.num_rows, axes + 1))
            x[:, :axes] = matrix(batch.column("unit"), axes)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    total = np.zeros((axes + 1, axes + 1))
    for r in vectors.select("unit").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    n = max(total[axes, axes], 1)
    mean = total[:axes, axes] / n
    values, turned = np.linalg.eigh(total[:axes, :axes] / n - np.outer(mean, mean))
    return turned[:, ::-1], np.maximum(values[::-1], 1e-12), int(total[axes, axes])


def matrix(column: pa.Array, axes: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), axes)


def deal(axes: int, m: int) -> list[list[int]]:
    """The axes of m blocks, dealt to and fro, so that each gets a like share of the variance, its strongest axes first."""
    return [[a for k, a in enumerate(range(axes)) if (k % (2 * m) if k % (2 * m) < m else 2 * m - 1 - k % (2 * m)) == b] for b in range(m)]


def met(spread: float, radius: float) -> float:
    """Of vectors spread normally along an axis, the share of pairs that meet in a cell of twice the radius: one at home there, the other within the radius of it."""
    below = lambda x: 0.5 * (1 + math.erf(x / (spread * math.sqrt(2))))
    far = min(40, 1 + int(6 * spread / (2 * radius)))
    return min(1.0, sum((below(2 * radius * (k + 1)) - below(2 * radius * k)) * (below(2 * radius * (k + 1) + radius) - below(2 * radius * k - radius)) for k in range(-far, far)))


def visits(g: int) -> float:
    """Cells of a grid of g axes, twice the radius wide, that a ball reaches, on the average."""
    return sum(math.comb(g, k) * math.pi ** (k / 2) / (2**k * math.gamma(k / 2 + 1)) for k in range(g + 1))


def plan(variance: np.ndarray, squared: float, vectors: int) -> tuple[list[list[int]], list[float], list[int]]:
    """(axes, budget, grid axes) of each block, at the least estimated cost: of postings, and of distances looked at in cells, in microseconds."""
    axes, best = len(variance), None
    for m in sorted({min(m, axes) for m in (2, 4, 8, 16)}):
        dealt = deal(axes, m)
        budget = [squared * variance[d].sum() / variance.sum() * (1 + 1e-6) + 1e-9 for d in dealt]
        cost, grid = 0.0, []
        for d, own in zip(dealt, budget):
            radius = math.sqrt(own)
            spread = np.sqrt(variance[d])
            near = (own / (4 * variance[d].mean())) ** (len(d) / 2) / math.gamma(len(d) / 2 + 1) if len(d) < 300 else 0.0
            options, share = [], 1.0
            for g in range(min(len(d), GRID_AXES) + 1):
                if g:
                    share *= met(float(spread[g - 1]), radius)
                seen = vectors * share
                options.append((visits(g) * max(1.0, seen / CELL_VECTORS) * 6 + seen * (0.0006 + 0.00003 * len(d)) + vectors * min(1.0, near) * 0.1, g))
            least = min(options)
            cost += least[0]
            grid.append(least[1])
        if best is None or cost < best[0]:
            best = (cost, dealt, budget, grid)
    return best[1:]


def near_nodes(vectors: DataFrame, axes: int, cosine: float) -> DataFrame:
    """(a, b, sure): nodes, a < b, of at least that cosine; each once. Those within rounding of it aren't sure. ``vectors``: (node, unit)."""
    turned, variance, count = rotation(vectors, axes)
    squared = 2 - 2 * cosine
    dealt, budget, grid = plan(variance, squared, count)
    order = np.array([a for d in dealt for a in d])
    edges = np.cumsum([0] + [len(d) for d in dealt])
    side = [2 * math.sqrt(b * (1 + 1e-4) + 1e-6) for b in budget]
    shared = vectors.sparkSession.sparkContext.broadcast((turned[:, order], edges, budget, side, grid))
    split = CELL_VECTORS

    def places(y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, rows, keys of their cells, whether they are at home there)."""
        _, edges, budget, side, grid = shared.value
        for b, g in enumerate(grid):
            on = y[:, edges[b] : edges[b] + g] / side[b]
            home = np.floor(on).astype(np.int64)
            # In each grid axis the ball reaches into at most one neighbour, below or above.
            step = np.where(on - home < 0.5, -1, 1)
            off = np.where(step < 0, on - home, home + 1 - on) * side[b]
            for mask in range(1 << g):
                move = np.array([(mask >> k) & 1 for k in range(g)], np.int64)
                ok = np.flatnonzero((off**2 * move).sum(axis=1) <= side[b] ** 2 / 4)
                if len(ok):
                    cell = home[ok] + step[ok] * move
                    key = np.full(len(ok), b + 1, np.int64)
                    for k in range(g):
                        key = (key * np.int64(-7046029254386353131) + cell[:, k]) * np.int64(6364136223846793005)
                    key ^= (key.view(np.uint64) >> np.uint64(29)).view(np.int64)
                    yield b, ok, key * np.int64(-4417276706812531889), np.full(len(ok), mask == 0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for _, _, key, _ in places(matrix(batch.column("unit"), axes) @ shared.value[0]):
                    keys, times = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["cell", "n"])

    # Cells of more than CELL_VECTORS are divided into parts, each two of which meet on their own. All that is known of them on the tasks is a table of a fixed size.
    cells = vectors.select("unit").mapInArrow(counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > split)
    parts = np.ones(1 << SLOT_BITS, np.int32)
    for r in cells.groupBy(F.shiftrightunsigned("cell", 64 - SLOT_BITS).cast("int").alias("slot")).agg(F.max("n").alias("n")).toLocalIterator():
        parts[r["slot"]] = -(-r["n"] // split)
    hot = vectors.sparkSession.sparkContext.broadcast(parts)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                ids = piece.column("node").to_numpy()
                y = matrix(piece.column("unit"), axes) @ shared.value[0]
                z = y.astype(np.float32)
                own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for b, ok, key, home in places(y):
                    into = hot.value[(key.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64)
                    mine = (own[ok] % into.astype(np.uint64)).astype(np.int64)
                    upto = np.cumsum(into)
                    for first in range(0, int(upto[-1]), 20_000):
                        nth = np.arange(first, min(first + 20_000, int(upto[-1])))
                        again = np.searchsorted(upto, nth, "right")
                        other = nth - (upto - into)[again]
                        low, high = np.minimum(mine[again], other), np.maximum(mine[again], other)
                        side = np.where(low == high, 0, np.where(mine[again] == low, 1, 2))
                        flat = pa.array(z[ok[again]].ravel())
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, axes, dtype=np.int32)), flat)
                        code = (b * 8 + side * 2 + ~home[again]).astype(np.int16)
                        columns = [key[again], (low << 20) + high, code, ids[ok[again]]]
                        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), lists], ["cell", "part", "code", "node", "z"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, edges, budget, _, _ = shared.value
        least = cosine - 1e-5
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def told() -> pa.RecordBatch:
            a, b, sure = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure)], ["a", "b", "sure"])

        def group(block: int, side: np.ndarray, visit: np.ndarray, ids: np.ndarray, z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Homes meet homes and visits; two that visit meet at the home of one of them, and of two homes the one of the lesser id tells of the pair."""
            order = np.argsort(ids)
            side, visit, ids, z = side[order], visit[order], ids[order], z[order]
            own = np.ascontiguousarray(z[:, edges[block] : edges[block + 1]])
            half = (own * own).sum(axis=1) / 2
            home = np.flatnonzero(~visit)
            for at in range(0, len(home), STRIP):
                h = home[at : at + STRIP]
                near = own[h] @ own[h[0] :].T
                near -= half[h][:, None]
                near -= half[h[0] :]
                i, j = np.divmod(np.flatnonzero(near.ravel() >= -(budget[block] + 1e-5) / 2), near.shape[1])
                i, j = h[i], j + h[0]
                keep = ids[i] < ids[j]
                if side[0]:
                    keep &= side[i] != side[j]
                i, j = i[keep], j[keep]
                for k in range(0, len(i), 20_000):
                    x, y = z[i[k : k + 20_000]].astype(np.float64), z[j[k : k + 20_000]].astype(np.float64)
                    cos = (x * y).sum(axis=1)
                    d2 = np.add.reduceat((x - y) ** 2, edges[:-1], axis=1)
                    within = d2 <= np.array(budget) * (1 + 1e-5) + 2e-7
                    ok = (cos >= least) & within[:, block] & ~within[:, :block].any(axis=1)
                    if ok.any():
                        yield ids[i[k : k + 20_000][ok]], ids[j[k : k + 20_000][ok]], cos[ok] >= cosine + 1e-5

        total = 0
        for keys, columns, z in whole(batches, axes):
            code = columns[0]
            for pairs in group(int(code[0]) >> 3, (code >> 1) & 3, (code & 1) > 0, columns[1], z):
                held.append(pairs)
                total += len(pairs[0])
                if total > FLUSH:
                    yield told()
                    held, total = [], 0
        if held:
            yield told()
        release()

    posted = vectors.mapInArrow(post, "cell bigint, part bigint, code smallint, node bigint, z array<float>")
    return posted.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(meet, "a bigint, b bigint, sure boolean")


def whole(batches: Iterator[pa.RecordBatch], axes: int) -> Iterator[tuple[tuple[int, int], list[np.ndarray], np.ndarray]]:
    """(key, [code, node], vectors) of each group of two or more rows of (cell, part, code, node, z), ordered by cell and part; its pieces are put together once."""
    key, held = None, []

    def together() -> Iterator[tuple[tuple[int, int], list[np.ndarray], np.ndarray]]:
        if sum(len(p[0]) for p in held) > 1:
            code, node, z = (np.concatenate(x) for x in zip(*held))
            yield key, [code, node], z

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edge = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]), True])
        code, node, z = batch.column(2).to_numpy(), batch.column(3).to_numpy(), matrix(batch.column(4), axes)
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if (own := (int(cell[x]), int(part[x]))) != key:
                yield from together()
                key, held = own, []
            held.append((code[x:y].copy(), node[x:y].copy(), z[x:y].copy()))
    yield from together()


def join(vectors: DataFrame, cosine: float = COSINE, axes: int | None = None) -> DataFrame:
    """(vec_id, class_id, n_links) of each vector that has a cosine of at least ``cosine`` to another one: n_links is the number of those others, and class_id the least
    vec_id that is reached over links. A vector near no other is a class of its own, and has no row. Exact up to rounding, without caps: links between
    vectors that differ are found and counted, and equal vectors, which are all linked, are counted without being paired.

    Vectors are compared with those of the same length, one join for each length that two or more rows have; with ``axes`` only those of that length.
    Null, empty or zero vectors, those with a null or not finite element, and rows with a null vec_id: no row. Repeated rows count once; different vectors of one vec_id are
    compared apart, are not a link with themselves, and are in one class (of those of one length; an id whose vectors have several lengths has a row for each). Other columns play no part. An empty table gives an empty result.
    """
    sized = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    good = sized.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0))
    if axes is None:
        found = good.groupBy(F.size("embedding").alias("axes")).count().where("count > 1").orderBy("axes").collect()  # as many as there are lengths
        lengths = [r["axes"] for r in found] or [1]
    else:
        lengths = [axes]
    return reduce(DataFrame.unionByName, [of_length(good, k, cosine) for k in lengths])


def of_length(good: DataFrame, axes: int, cosine: float) -> DataFrame:
    """As join, of the vectors of one length."""
    # Equal vectors are one node, named by a 64-bit fingerprint. Adding 0 makes -0.0 and 0.0 one.
    own = good.where(F.size("embedding") == axes).select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding")).select("vec_id", F.xxhash64("embedding").alias("node"), "embedding")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    units = durable(own.groupBy("node").agg(F.first("embedding").alias("embedding")).withColumn("norm", norm).select("node", F.transform("embedding", lambda x: x / F.col("norm")).alias("unit")))
    placed = durable(own.select("vec_id", "node").distinct())
    pairs = durable(near_nodes(units, axes, cosine))
    a, b = units.select(F.col("node").alias("a"), F.col("unit").alias("x")), units.select(F.col("node").alias("b"), F.col("unit").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    unsure = pairs.where("not sure").join(a, "a").join(b, "b").where(dot >= cosine - 1e-9).select("a", "b")
    return linked(placed, durable(pairs.where("sure").select("a", "b").union(unsure)), "vec_id")
