"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.blocks import bitmap, hits, slot
from pagewright.llm.columns import cuts, named, numbered, others, utf8, word_hashes, words
from pagewright.session import durable

HASHED = 1 << 18
LENGTH_POWER = 0.5
DENSE = 13
#: Size of the blocks in which all labelled rows are learned from: about so many rows and bytes of their texts, and preference pairs drawn within each.
SAMPLE_ROWS, SAMPLE_BYTES, PAIRS = 6000, 96 << 20, 60000
_CLASSES = np.zeros((6, 256), np.float32)
_CLASSES[0, 65:91] = 1  # capitals
_CLASSES[1, 48:58] = 1  # digits
_CLASSES[2, [35, 36, 37, 38, 42, 64, 94, 95, 124, 126, 60, 62, 61, 43, 92, 47]] = 1  # signs
_CLASSES[3, [33, 63]] = 1  # exclamations
_CLASSES[4, [46, 44, 59, 58]] = 1  # stops
_CLASSES[5, [9, 10, 13, 32]] = 1  # white space


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dense features of each text, hash buckets of its distinct words, where those of each text begin)."""
    data, offsets = utf8(texts)
    n = len(offsets) - 1
    dense = np.zeros((n, DENSE), np.float64)
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    size = np.diff(offsets)
    some = np.flatnonzero(size > 0)
    if len(some):
        at = offsets[:-1][some]
        for k, table in enumerate(_CLASSES):
            dense[some, k] = np.add.reduceat(table[data], at, dtype=np.float64) / size[some]
    count = np.diff(first)
    distinct, of = np.zeros(0, np.int64), np.zeros(0, np.int64)
    filled = np.flatnonzero(count > 0)
    if len(filled):
        at = first[:-1][filled]
        own = np.repeat(np.arange(n), count)
        length = (ends - starts).astype(np.float64)
        mean = np.add.reduceat(length, at) / count[filled]
        dense[filled, 6] = mean / 10
        dense[filled, 7] = np.add.reduceat((length > 20).astype(np.float64), at) / count[filled]
        # Repetition: the share of words that stand for the first time in their text.
        keyed = np.unique(np.bitwise_or(hashes & np.uint64(0xFFFFFFFF), own.astype(np.uint64) << np.uint64(32)))
        of, distinct = (keyed >> np.uint64(32)).astype(np.int64), (keyed & np.uint64(HASHED - 1)).astype(np.int64)
        dense[:, 8] = np.bincount(of, minlength=n) / np.maximum(count, 1)
        again = np.zeros(len(hashes), np.float64)
        again[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
        dense[filled, 12] = np.add.reduceat(again, at) / count[filled]
        dense[filled, 9] = np.log1p(count[filled]) / 10
    dense[:, 10] = (count < 3).astype(np.float64)
    dense[:, 11] = 1.0
    return dense, distinct, np.searchsorted(of, np.arange(n + 1))


def all_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As features, worked out on a piece of the texts at a time."""
    return joined([features(texts.slice(at, rows)) for at, rows in cuts(texts)] or [features(texts)])


def joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of successive pieces of texts, as those of one."""
    base = np.cumsum([0] + [len(b) for _, b, _ in parts])
    return np.concatenate([d for d, _, _ in parts]), np.concatenate([b for _, b, _ in parts]), np.concatenate([[0]] + [f[1:] + o for (_, _, f), o in zip(parts, base)])


_HEAD = 8 * DENSE + 4 * (HASHED >> 16)


def packed(texts: pa.Array) -> pa.Array:
    """The features of each text in a few bytes: dense ones, how many buckets lie in each stretch of 2**16, and the places of the ordered buckets in these."""
    out = []
    for at, rows in cuts(texts):
        dense, buckets, first = features(texts.slice(at, rows))
        own, buckets = np.divmod(np.sort(np.repeat(np.arange(rows), np.diff(first)) * HASHED + buckets), HASHED)
        many = np.bincount(own * (HASHED >> 16) + (buckets >> 16), minlength=rows * (HASHED >> 16)).reshape(rows, -1)
        dense, many, low = dense.astype("<f8"), many.astype("<i4"), (buckets & 0xFFFF).astype("<u2")
        out += [dense[k].tobytes() + many[k].tobytes() + low[first[k] : first[k + 1]].tobytes() for k in range(rows)]
    return pa.array(out, pa.binary())


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As features, from packed; the buckets of each text are ordered."""
    n = len(column)
    if not n:
        return np.zeros((0, DENSE)), np.zeros(0, np.int64), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data, offsets = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]
    at = offsets[:-1, None] + np.arange(_HEAD)
    heads, rest = data[at], np.ones(len(data), bool)
    rest[at] = False
    dense = np.ascontiguousarray(heads[:, : 8 * DENSE]).view("<f8").astype(np.float64)
    many = np.ascontiguousarray(heads[:, 8 * DENSE :]).view("<i4").astype(np.int64)
    high = np.repeat(np.tile(np.arange(HASHED >> 16), n), many.ravel())
    return dense, high << 16 | data[rest].view("<u2"), np.concatenate([[0], np.cumsum(many.sum(axis=1))])


def hashed_sum(weights: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the word weights of each text over a power of the number of its distinct words."""
    total = np.concatenate([[0.0], np.cumsum(weights[buckets])])
    count = np.diff(first)
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(count, 1) ** LENGTH_POWER


def strongest(odds: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The largest of the words' log odds in each text, however long it is; 0 of a text without a word."""
    out = np.zeros(len(first) - 1)
    filled = np.flatnonzero(np.diff(first) > 0)
    if len(filled):
        out[filled] = np.maximum.reduceat(odds[buckets], first[:-1][filled])
    return out


def with_bucket(buckets: np.ndarray, own: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each rank and bucket, how many texts have it; how many texts each rank has)."""
    bucket, text = np.divmod(np.unique(buckets * len(rank) + own), max(len(rank), 1))
    ranks = int(rank.max(initial=0)) + 1
    return np.bincount(rank[text] * HASHED + bucket, minlength=ranks * HASHED).reshape(ranks, HASHED), np.bincount(rank, minlength=ranks)


def odds_of(texts_with: np.ndarray, texts: np.ndarray, min_texts: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(how many texts have each bucket, its odds) from with_bucket."""
    best = int(np.flatnonzero(texts).max(initial=0))
    best_with, poor_with = texts_with[best], texts_with[1:best].sum(axis=0)
    odds = np.log((poor_with + 0.5) / (texts[1:best].sum() + 1)) - np.log((best_with + 0.5) / (texts[best] + 1))
    return texts_with.sum(axis=0), np.where(poor_with >= min_texts, np.maximum(odds, 0.0), 0.0)


class BradleyTerry:
    """score(text) = w · φ(text); P(a preferred to b) = 1 / (1 + exp(score(b) - score(a))).
    ``odds``: of each word's bucket, how much likelier texts of a middle rank (toxic ones) have it than the best-ranked (log, at least 0). The
    strongest word of a text counts undiluted, by ``strong``."""

    def __init__(self, dense: np.ndarray, hashed: np.ndarray, threshold: float = -np.inf, odds: np.ndarray | None = None, strong: float = 0.0):
        self.dense, self.hashed, self.threshold, self.strong = dense, hashed, threshold, strong
        self.odds = np.zeros(HASHED) if odds is None else odds

    def score(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for at, rows in cuts(texts):
            out.append(self.score_features(*features(texts.slice(at, rows))))
        return np.concatenate(out)

    def score_features(self, dense: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return dense @ self.dense + hashed_sum(self.hashed, buckets, first) + self.strong * strongest(self.odds, buckets, first)

    @staticmethod
    def fit(texts: list[str | None], rank: np.ndarray, pairs: int = PAIRS, steps: int = 400, seed: int = 7, l2: float = 1e-4, min_texts: int = 10) -> BradleyTerry:
        """Learn from up to ``pairs`` random preference pairs: in each, the text of higher rank is preferred.
        With no pair of different ranks all weights are 0, so that every text ties."""
        return BradleyTerry.fit_features(*all_features(pa.array(texts, pa.large_string())), rank, pairs, steps, seed, l2, min_texts)

    @staticmethod
    def fit_features(dense: np.ndarray, buckets: np.ndarray, first: np.ndarray, rank: np.ndarray, pairs: int = PAIRS, steps: int = 400, seed: int = 7, l2: float = 1e-4, min_texts: int = 10, known: tuple[np.ndarray, np.ndarray] | None = None) -> BradleyTerry:
        """As fit, from the texts' features. ``known``: how many texts have each bucket, and its odds, where the texts are a part of more."""
        rng, n = np.random.default_rng(seed), len(rank)
        model = BradleyTerry(np.zeros(DENSE), np.zeros(HASHED))
        a, b = rng.integers(0, n, (2, 4 * pairs)) if n else np.zeros((2, 0), int)
        keep = np.flatnonzero(rank[a] != rank[b])[:pairs] if n else np.zeros(0, int)
        if not len(keep):
            return model
        a, b = a[keep], b[keep]
        a, b = np.where(rank[a] > rank[b], a, b), np.where(rank[a] > rank[b], b, a)
        own = np.repeat(np.arange(n), np.diff(first))
        root = np.maximum(np.diff(first), 1) ** -LENGTH_POWER
        scale = dense.std(axis=0) + 1e-3
        dense = dense / scale
        # A bucket that few of the texts have says nothing that would hold for others.
        texts_with, model.odds = known or odds_of(*with_bucket(buckets, own, rank), min_texts)
        common = texts_with >= min_texts
        worst = strongest(model.odds, buckets, first)
        worst_scale = worst.std() + 1e-3
        worst = worst / worst_scale
        g2s = 1e-8
        g2d, g2h = np.full(DENSE, 1e-8), np.full(HASHED, 1e-8)
        for _ in range(steps):
            s = dense @ model.dense + hashed_sum(model.hashed, buckets, first) + model.strong * worst
            p = 1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))  # the gradient of the logistic loss
            pull = (np.bincount(a, p, n) - np.bincount(b, p, n)) / len(a)
            gd = dense.T @ pull - l2 * model.dense
            gh = np.where(common, np.bincount(buckets, (pull * root)[own], HASHED), 0.0) - l2 * model.hashed
            gs = float(worst @ pull) - l2 * model.strong
            g2s += gs * gs
            model.strong += 0.2 * gs / np.sqrt(g2s)
            g2d += gd * gd
            g2h += gh * gh
            model.dense += 0.2 * gd / np.sqrt(g2d)
            model.hashed += 0.2 * gh / np.sqrt(g2h)
        model.dense /= scale
        model.strong /= worst_scale
        return model


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 7, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str | None], np.ndarray]:
    """At most ``rows`` labelled texts, those of smallest hashed doc_id, as far as they have ``most_bytes`` together; whole texts. A document labelled twice counts by its worst label; of
    several texts of one doc_id the least teaches. Rank: 0 of low quality, 1 toxic, 2 neither. Rows without a label, or with a null one, teach nothing. A look at the labels; train doesn't use it."""
    order = F.xxhash64("doc_id", F.lit(seed))
    ranked = (
        labels.select("doc_id", F.when(F.col("quality") == 0, 0).otherwise(2 - F.col("toxic")).alias("rank"))
        .where("doc_id is not null and rank is not null")
        .groupBy("doc_id").agg(F.min("rank").alias("rank"))
        .orderBy(order, "doc_id").limit(rows)
    )
    rank = {r["doc_id"]: r["rank"] for r in ranked.collect()}  # bounded by ``rows``
    if not rank:
        return [], np.zeros(0, np.int64)
    own = durable(docs.where(F.col("doc_id").isin(list(rank))).groupBy("doc_id").agg(F.min("text").alias("text")))
    upto, taken = 0, []
    for r in own.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy(order, "doc_id").collect():  # bounded by ``rows``
        upto += r["size"]
        if upto > most_bytes:
            break
        taken.append(r["doc_id"])
    texts = sorted(own.where(F.col("doc_id").isin(taken)).collect(), key=lambda r: r["doc_id"])  # bounded by ``most_bytes``
    return [r["text"] for r in texts], np.array([rank[r["doc_id"]] for r in texts], np.int64)


def labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, seed: int = 7, content: str = "text") -> DataFrame:
    """(block, held, rank, text) of all labelled documents, ranked as in labelled_sample; of several texts of one doc_id that of the least hash teaches, a null only where there is no other. Blocks, by a hash of the
    doc_id, are of about ``rows`` rows and ``most_bytes`` of text; each lies whole and in order in one partition. Every third row of a block is held out. With ``content`` "features", what packed makes of the
    texts is there in their place: rows are chosen and placed by their ids and hashes alone, and no text is sent."""
    ranks = durable(
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(F.col("quality") == 0, 0).otherwise(2 - F.col("toxic")).cast("int").alias("rank"))
        .where("doc_id is not null and rank is not null")
        .groupBy("doc_id").agg(F.min("rank").alias("rank"))
    )
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").where("doc_id is not null")
    least = F.min(F.struct(F.col("text").isNull(), "hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("least")
    own = durable(texts.groupBy("doc_id").agg(least).join(ranks, "doc_id").select("doc_id", "rank", "least.hash", "least.size"))
    n, size = own.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(1, -(-n // rows), -(-size // most_bytes))
    placed = own.select("doc_id", "rank", "hash", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).cast("int").alias("block"))
    placed = placed.withColumn("held", F.row_number().over(Window.partitionBy("block").orderBy("doc_id")) % 3 == 0)
    # Only documents in the bitmap are sent; what it lets through by chance has no rank.
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ranks, "doc_id"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(hits(shared.value, batch.column("slot")))
            found = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), packed(found) if content == "features" else found], ["doc_id", "hash", content])

    sent = texts.select("doc_id", "hash", slot("doc_id").alias("slot"), "text").mapInArrow(some, f"doc_id bigint, hash bigint, {content} {'binary' if content == 'features' else 'string'}")
    # Repeated rows have one hash, so that one of them is left.
    found = sent.join(placed, ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(*[F.min(c).alias(c) for c in ("block", "held", "rank", content)])
    parts = min(blocks, 8 * docs.sparkSession.sparkContext.defaultParallelism)
    return durable(found.repartitionById(parts, F.col("block")).sortWithinPartitions("block", "doc_id").select("block", "held", "rank", content))


def content_of(rows: DataFrame) -> str:
    """Which column labelled has put the texts, or their features, in."""
    return "features" if "features" in rows.columns else "text"


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(rows, their features) of a piece of a batch at a time; the last column holds texts or packed features."""
    own = batch.column(batch.num_columns - 1)
    for at, rows in cuts(own):
        yield batch.slice(at, rows), (unpacked if batch.schema.names[-1] == "features" else features)(own.slice(at, rows))


def bucket_counts(teaching: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """with_bucket of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, HASHED + 1), np.int64)
        for batch in batches:
            for piece, (_, buckets, first) in pieces(batch):
                rank = piece.column("rank").to_numpy().astype(np.int64)
                have, texts = with_bucket(buckets, np.repeat(np.arange(len(rank)), np.diff(first)), rank)
                total[: len(texts), :HASHED] += have
                total[: len(texts), HASHED] += texts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["at", "n"])

    out = np.zeros((3, HASHED + 1), np.int64)
    found = teaching.select("rank", content_of(teaching)).mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # bounded by three ranks' buckets
    out.ravel()[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out[:, :HASHED], out[:, HASHED]


def fit_blocks(teaching: DataFrame) -> BradleyTerry:
    """The mean of the blocks' models, each learned from preference pairs of its own rows; which words are common, and their odds, are those of all rows. Sums are of whole numbers (parts of 2**-40), whatever their order."""
    known = odds_of(*bucket_counts(teaching))
    shared = teaching.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(HASHED + DENSE + 2, np.int64)
        parts, ranks, block = [], [], None

        def close() -> None:
            rank = np.concatenate([np.zeros(0, np.int64), *ranks])
            if len(np.unique(rank)) > 1:
                own = BradleyTerry.fit_features(*joined(parts), rank, known=shared.value)
                total[:] += np.rint(np.concatenate([own.hashed, own.dense, [own.strong, 1.0]]) * 2.0**40).astype(np.int64)

        for batch in batches:
            of = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else []
            for start, end in zip(edges, edges[1:]):
                if of[start] != block:
                    close()
                    parts, ranks, block = [], [], of[start]
                for piece, found in pieces(batch.slice(start, end - start)):
                    parts.append(found)
                    ranks.append(piece.column("rank").to_numpy().astype(np.int64))
        close()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "v"])

    total = np.zeros(HASHED + DENSE + 2)
    found = teaching.select("block", "rank", content_of(teaching)).mapInArrow(run, "at int, v bigint").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # bounded by the buckets
    total[found.column(0).to_numpy()] = found.column(1).to_numpy()
    total /= total[-1] or 1.0
    return BradleyTerry(total[HASHED : HASHED + DENSE], total[:HASHED], odds=known[1], strong=float(total[-2]))


def quantiles(scores: DataFrame, levels: dict[bool, float]) -> dict[bool, float]:
    """The exact quantile, of the level given, of each kind's scores, by sorting (kind, score); kinds without a score are left out."""
    counts = {r["kind"]: r["count"] for r in scores.groupBy("kind").count().collect()}
    ordered = durable(scores.orderBy("kind", "score").withColumn("place", F.monotonically_increasing_id()))
    parts = sorted((r["part"], r["count"]) for r in ordered.groupBy(F.shiftright("place", 33).alias("part")).count().collect())
    before, ends = 0, {}
    for kind in sorted(counts):
        at = levels[kind] * (counts[kind] - 1)
        ends[kind] = before + int(np.floor(at)), before + int(np.ceil(at)), at - np.floor(at)
        before += counts[kind]
    wanted, upto = {}, 0
    for part, count in parts:
        wanted |= {(part << 33) + at - upto: at for low, high, _ in ends.values() for at in (low, high) if upto <= at < upto + count}
        upto += count
    found = {wanted[r["place"]]: r["score"] for r in ordered.where(F.col("place").isin(list(wanted))).collect()} if wanted else {}
    return {kind: found[low] + share * (found[high] - found[low]) for kind, (low, high, share) in ends.items()}


def train(docs: DataFrame, labels: DataFrame, good_quantile: float = 0.002, bad_quantile: float = 0.98, rows: int = SAMPLE_ROWS) -> BradleyTerry:
    """Fit on two thirds of all labelled rows, in blocks of about ``rows``. The threshold comes from exact score quantiles of the other third: it lies a quarter
    of the way from the ``bad_quantile`` quantile of the low-quality and toxic texts to the ``good_quantile`` quantile of the best-ranked
    ones, or at the latter where they overlap. Without labels of both kinds nothing is rejected."""
    own = labelled(docs, labels, rows, content="features")
    model = fit_blocks(own.where("not held"))
    shared = docs.sparkSession.sparkContext.broadcast((model.dense, model.hashed, model.threshold, model.odds, model.strong))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, found in pieces(batch):
                yield pa.RecordBatch.from_arrays([piece.column("kind"), pa.array(BradleyTerry(*shared.value).score_features(*found))], ["kind", "score"])

    held = quantiles(own.where("held").select((F.col("rank") == 2).alias("kind"), "features").mapInArrow(run, "kind boolean, score double"), {True: good_quantile, False: bad_quantile})
    if len(held) == 2:
        low, high = held[True], held[False]
        model.threshold = float(min(low, high + 0.25 * (low - high)))
    return model


def score(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """Every row with ``quality_score`` DOUBLE and ``quality_keep`` BOOLEAN (score >= threshold), in one pass without a shuffle.

    Null text: score null, not kept. Empty text: scored by its (zero) features like any other. Ties and repeated rows score
    alike. Other columns are kept, whatever their names; columns of the two new names, in whatever case, are replaced. An empty table gives an empty result.
    """
    rest = others(docs.columns, ("quality_score", "quality_keep"))
    plain, at = numbered(docs, rest), rest.index("text")
    schema = T.StructType([*plain.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_keep", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.dense, model.hashed, model.threshold, model.odds, model.strong))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BradleyTerry(*shared.value)
        for batch in batches:
            texts = batch.column(at)
            none = texts.is_null().to_numpy(zero_copy_only=False)
            s = own.score(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, mask=none), pa.array((s >= own.threshold) & ~none)], schema.names)

    return named(plain.mapInArrow(run, schema), rest, "quality_score", "quality_keep")


def accept(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """The rows that the model keeps, with their own columns, whatever these are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.dense, model.hashed, model.threshold, model.odds, model.strong))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BradleyTerry(*shared.value)
        for batch in batches:
            texts = batch.column(at)
            yield batch.filter(pa.array((own.score(texts) >= own.threshold) & ~texts.is_null().to_numpy(zero_copy_only=False)))

    plain = numbered(docs, docs.columns)
    return named(plain.mapInArrow(run, plain.schema), docs.columns)


def corpus_quantiles(scored: DataFrame, levels: tuple[float, ...] = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) -> Column:
    """Aggregate: score quantiles over all documents, for a report."""
    return F.percentile_approx("quality_score", list(levels), 10000).alias("quantiles")
