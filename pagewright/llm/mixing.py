"""Mixing sources to target weights: nested token budgets met by hash thresholds, without a sort.

Sources that hold enough are brought to exactly their weights, relative to one another, at the largest total that allows it: so only a real surplus goes, and a
corpus that is at its target stays whole. Each row has a hash of its id. Tokens are summed by source and hash bucket; a prefix sum over the buckets finds where each
budget is crossed, only that boundary bucket is histogrammed again on the next bits of the hash, and so on until a
threshold separates single hashes. Rows below their source's threshold stay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.columns import others, quoted
from pagewright.session import durable

BITS = 60
SHORT = 0.5
#: Sources whose thresholds are broadcast; those of more are joined.
BROADCAST_SOURCES = 20_000
LEVEL_BITS = (20, 20, 20)


def tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 of a null text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f\\x0b]+")), F.lit(0)).cast("bigint")


def hash60(key: Column, seed: int) -> Column:
    """60 bits of the MD5 of key and seed, as SQL engines agree on; null keys share one hash."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("bigint")


def targets(totals: DataFrame, weights: Mapping[str, float] | None, default_weight: float, share: float, short: float) -> DataFrame:
    """(_source, _all, _weight, _target, _short) from (_source, _all): each source's weight is its own or ``default_weight``. Its target in the corpus is its weight over the sum
    of all sources' weights. A source that holds less than ``short`` of that is short: it stays whole, and below its weight. All others are given the same
    number of tokens for each unit of weight, as many as the one of them that has the least can give; ``share`` of that is their target."""
    given = F.create_map(*[F.lit(x) for kv in (weights or {}).items() for x in kv])[F.col("_source")] if weights else F.lit(None)
    weighed = totals.withColumn("_weight", F.coalesce(given.cast("double"), F.lit(float(default_weight))))
    whole = weighed.agg(F.sum("_weight").alias("_weights"), F.sum("_all").alias("_corpus"))
    sized = weighed.crossJoin(whole).withColumn("_short", (F.col("_weight") > 0) & (F.col("_all") < F.lit(float(short)) * F.col("_corpus") * F.col("_weight") / F.col("_weights")))
    rate = sized.agg(F.coalesce(F.min(F.when((F.col("_weight") > 0) & ~F.col("_short"), F.col("_all") / F.col("_weight"))), F.lit(0.0)).alias("_rate"))
    return sized.crossJoin(rate).select("_source", "_all", "_weight", F.floor(F.lit(float(share)) * F.col("_rate") * F.col("_weight") + F.lit(1e-6)).cast("bigint").alias("_target"), "_short")


def budgets(totals: DataFrame, weights: Mapping[str, float] | None, default_weight: float, share: float, short: float, tiers: Sequence[float]) -> DataFrame:
    """(_source, _tier, _budget): the tokens that each source may have in each tier, the tier's part of its target."""
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(float(f)).alias("part")) for k, f in enumerate(tiers)]))
    return targets(totals, weights, default_weight, share, short).withColumn("_step", steps).select("_source", F.col("_step.tier").alias("_tier"), F.floor(F.col("_step.part") * F.col("_target")).cast("bigint").alias("_budget"))


def thresholds(slim: DataFrame, weights: Mapping[str, float] | None, default_weight: float, share: float, short: float, tiers: Sequence[float]) -> DataFrame:
    """(_source, _tier, _threshold) from rows (_source, _hash, _tokens): the largest threshold below which the tokens of the
    source stay within the tier's budget. Rows with the same hash are on the same side of it. Sources are compared with null equal to null."""
    totals = slim.groupBy("_source").agg(F.sum("_tokens").alias("_all"))
    # What is still open: the tier's boundary lies in the bucket [_low, _low + 2**_left), before which _used tokens lie.
    open_ = budgets(totals, weights, default_weight, share, short, tiers).withColumn("_low", F.lit(0).cast("bigint")).withColumn("_used", F.lit(0).cast("bigint"))
    left = BITS
    for bits in LEVEL_BITS:
        width = 1 << (left - bits)
        if left == BITS:
            bucket = F.shiftright("_hash", left - bits)
            sums = slim.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("_tokens").alias("_sum"))
            here = open_.select("_source", "_tier", "_budget", "_low", "_used")
            filled = here.join(sums.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
        else:
            spots = open_.select(F.col("_source").alias("_s"), F.col("_low").alias("_l")).distinct()
            inside = slim.join(spots, F.col("_source").eqNullSafe(F.col("_s")) & F.col("_hash").between(F.col("_l"), F.col("_l") + F.lit((1 << left) - 1)))
            sums = inside.groupBy("_s", "_l", F.shiftright(F.col("_hash") - F.col("_l"), left - bits).alias("_bucket")).agg(F.sum("_tokens").alias("_sum"))
            filled = open_.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_low") == F.col("_l")), "left")
        order = Window.partitionBy("_source", "_tier").orderBy("_bucket")
        running = filled.withColumn("_to", F.col("_used") + F.coalesce(F.sum("_sum").over(order), F.lit(0)))
        # The first bucket that would go over the budget; none: everything below the end of the range fits.
        over = F.col("_to") > F.col("_budget")
        open_ = running.groupBy("_source", "_tier", "_budget", "_low", "_used").agg(
            F.min(F.when(over, F.col("_bucket"))).alias("_first"), F.max(F.when(~over, F.col("_to"))).alias("_fits")
        ).select(
            "_source", "_tier", "_budget",
            (F.col("_low") + F.coalesce(F.col("_first") * F.lit(width), F.lit(1 << left))).alias("_low"),
            F.coalesce("_fits", "_used").alias("_used"),
        )
        left -= bits
        open_ = durable(open_)
    return open_.select("_source", "_tier", F.col("_low").alias("_threshold"))


def slimmed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(F.col("source").alias("_source"), hash60(F.col("doc_id"), seed).alias("_hash"), tokens(F.col("text")).alias("_tokens"))


def report(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 1.0, share: float = 1.0, short: float = SHORT) -> DataFrame:
    """(source, tokens, weight, target, short) of each source: what it has, what mix aims at, and whether it is short of its weight and so stays whole."""
    totals = docs.select(F.col("source").alias("_source"), tokens(F.col("text")).alias("_tokens")).groupBy("_source").agg(F.sum("_tokens").alias("_all"))
    found = targets(totals, weights, default_weight, share, short)
    return found.select(F.col("_source").alias("source"), F.col("_all").alias("tokens"), F.col("_weight").alias("weight"), F.col("_target").alias("target"), F.col("_short").alias("short"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 1.0, share: float = 1.0, tiers: Sequence[float] = (0.25, 0.5, 1.0), seed: int = 17, short: float = SHORT) -> DataFrame:
    """The rows that the last tier holds, with ``mix_tokens`` BIGINT and ``mix_tier`` INT, the first tier that holds them;
    each tier's rows are among those of the next.

    Targets are told in ``targets``; ``report`` gives them. Null source: a source of its own. Null doc_id: all such rows share one hash, so they stay or go together, as rows of the
    same doc_id do. Null or empty text: 0 tokens; such a row stays if its hash is below the threshold. An empty table gives an empty result. Columns of the new names, in whatever case, are replaced; others are kept,
    whatever their names. Texts aren't shuffled: thresholds are broadcast, which are a few numbers a source; only beyond BROADCAST_SOURCES sources are they joined.
    """
    rest = others(docs.columns, ("mix_tokens", "mix_tier"))
    found = thresholds(durable(slimmed(docs, seed)), weights, default_weight, share, short, tiers)
    wide = durable(found.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("_tier", "_threshold"))).alias("_bounds")))
    if wide.count() <= BROADCAST_SOURCES:
        wide = F.broadcast(wide)
    # The row travels as one value, so that no name of its columns can clash; its fields are numbered.
    packed = docs.select(F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(rest)]).alias("_row"), F.col("source").alias("_own"), hash60(F.col("doc_id"), seed).alias("_hash"), F.col("text").alias("_text"))
    marked = packed.join(wide, F.col("_own").eqNullSafe(F.col("_source"))).where(F.col("_hash") < F.element_at("_bounds", -1)["_threshold"])
    inside = F.filter("_bounds", lambda b: F.col("_hash") < b["_threshold"])
    tiered = marked.select("_row", tokens(F.col("_text")).alias("_own"), F.array_min(F.transform(inside, lambda b: b["_tier"])).alias("_first"))
    return tiered.select(*[F.col("_row")[f"c{k}"].alias(c) for k, c in enumerate(rest)], F.col("_own").alias("mix_tokens"), F.col("_first").alias("mix_tier"))
