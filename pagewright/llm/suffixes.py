"""Suffix-array dedup: passages that documents share, by blockwise sorting of suffixes with a difference cover.

Words are tokens. A difference cover D of period V gives for any two positions i and j a shift s < V with i + s and j + s both in the
cover. So where two suffixes agree on L >= V + S - 1 tokens, two cover samples within them agree on S tokens. First only the samples are
sorted, by S tokens: the tied ones are the only places where a longer tie can be. Then the suffixes around tied samples are
divided into buckets by their first L tokens and sorted one bucket at a time; those of a bucket agree on L tokens. Memory is bounded by a bucket's
batch, not by the corpus. Token sequences are compared by 64-bit fingerprints, so the order of suffixes is that of fingerprints rather than of letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pagewright.llm.blocks import bitmap, grouped, hits, slot
from pagewright.llm.columns import characters, cuts, long_gram_hashes, signed, utf8, word_hashes, words
from pagewright.session import durable

LEAST = 50
#: Difference covers by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def period_for(least: int) -> int:
    """The largest period that leaves samples of two fifths of the passage at least."""
    return max(v for v in COVERS if least - v + 1 >= max(1, 2 * least // 5))


def samples(docs: DataFrame, least: int) -> DataFrame:
    """(rank, doc_id, at): the fingerprint of S tokens at each position of the cover."""
    period = period_for(least)
    size = least - period + 1
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows in cuts(batch.column("text")):
                piece = batch.slice(k, rows)
                data, offsets = utf8(piece.column("text"))
                starts, ends, first = words(data, offsets)
                prints = long_gram_hashes(word_hashes(data, starts, ends), size)
                count = np.diff(first)
                own = np.repeat(np.arange(piece.num_rows), count)
                at = np.arange(len(starts)) - first[own]
                # Only documents with a whole passage, and only samples that a whole passage can hold.
                ok = np.flatnonzero(cover[at % period] & (at + size <= count[own]) & (count[own] >= least))
                if len(ok):
                    ids = piece.column("doc_id").to_numpy()[own[ok]]
                    for a in range(0, len(ok), 200_000):
                        part = slice(a, a + 200_000)
                        yield pa.RecordBatch.from_arrays([pa.array(signed(prints[ok[part]])), pa.array(ids[part]), pa.array(at[ok[part]].astype(np.int32))], ["rank", "doc_id", "at"])

    return docs.mapInArrow(run, "rank bigint, doc_id bigint, at int")


def tied(rows: DataFrame, key: str, extra: str = "") -> DataFrame:
    """The rows of which the key stands in two or more documents, with ``first_doc``, the least of them; a bucket of keys is sorted at a time."""
    names = [f.name for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, columns in grouped(batches):
            columns = [c[: edges[-1]] for c in columns]
            size = np.diff(edges)
            low, high = np.minimum.reduceat(columns[1], edges[:-1]), np.maximum.reduceat(columns[1], edges[:-1])
            keep = np.repeat(low < high, size)
            if keep.any():
                columns.append(np.repeat(low, size))
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], [*names, "first_doc"])

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, StructType([*rows.schema.fields, StructField("first_doc", LongType())]))


def suffixes(docs: DataFrame, spots: DataFrame, least: int) -> DataFrame:
    """(prefix, doc_id, at, start, end): of the suffixes around tied samples, the fingerprint of the first ``least`` tokens and where those stand."""
    period = period_for(least)
    table = docs.sparkSession.sparkContext.broadcast(bitmap(spots, "doc_id"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece = batch.filter(hits(table.value, batch.column("slot")))
            if piece.num_rows:
                yield piece.select(["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows in cuts(batch.column("text")):
                piece = batch.slice(k, rows)
                data, offsets = utf8(piece.column("text"))
                starts, ends, first = words(data, offsets)
                chars = characters(data)
                prints = long_gram_hashes(word_hashes(data, starts, ends), least)
                spots = piece.column("spots")
                where, values = spots.offsets.to_numpy(), spots.values.to_numpy()
                own = np.repeat(np.arange(piece.num_rows), np.diff(where))
                at = first[own] + values[where[0] : where[-1]]
                # A passage that holds the sample begins up to period - 1 tokens before it.
                edge = np.zeros(len(starts) + period + 1, np.int64)
                np.add.at(edge, np.maximum(at - period + 1, first[own]), 1)
                np.add.at(edge, at + 1, -1)
                document = np.repeat(np.arange(piece.num_rows), np.diff(first))
                place = np.arange(len(starts))
                ok = np.flatnonzero((np.cumsum(edge)[: len(starts)] > 0) & (place + least <= first[document + 1]))
                ids = piece.column("doc_id").to_numpy()[document[ok]]
                base = chars[offsets[document[ok]]]
                columns = [signed(prints[ok]), ids, (ok - first[document[ok]]).astype(np.int32), (chars[starts[ok]] - base).astype(np.int32), (chars[ends[ok + least - 1]] - base).astype(np.int32)]
                for a in range(0, len(ok), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 200_000]) for c in columns], ["prefix", "doc_id", "at", "start", "end"])

    found = docs.withColumn("slot", slot("doc_id")).mapInArrow(some, "doc_id bigint, text string")
    per_doc = spots.groupBy("doc_id").agg(F.collect_list("at").alias("spots"))
    return found.join(per_doc, "doc_id").mapInArrow(run, "prefix bigint, doc_id bigint, at int, start int, end int")


def passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, first_word, n_words, start, end, first_doc): the longest stretches of each text that are covered by passages of ``least`` words
    or more, overlapping or side by side, each of which also stands in another document. start and end are characters; first_doc is the least doc_id that has the stretch's first ``least`` words, so
    that a stretch is the one to keep where first_doc is its own doc_id.

    Words are runs of characters other than ASCII white space, compared as they are. Null doc_id, null or empty text, or fewer than ``least`` words: no rows. What repeats only
    within one document isn't reported; rows of the same doc_id are one document (of two texts of one doc_id, stretches are told for both together). All
    copies are compared, without caps. An empty table gives an empty result. Other columns play no part.
    """
    slim = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    spots = durable(tied(samples(slim, least), "rank").select("doc_id", "at").distinct())
    ties = tied(suffixes(slim, spots, least), "prefix").select("doc_id", "at", "start", "end", "first_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges, columns in grouped(batches):
            upto = int(edges[-1])
            ids, at, start, end, first = (c[:upto] for c in columns)
            if not upto:
                continue
            new = np.ones(upto, bool)
            new[1:] = (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + least)
            a = np.flatnonzero(new)
            b = np.append(a[1:], upto) - 1
            out = [ids[a], at[a], (at[b] + least - at[a]).astype(np.int32), start[a], np.maximum.reduceat(end, a), first[a]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["doc_id", "first_word", "n_words", "start", "end", "first_doc"])

    return ties.repartition("doc_id").sortWithinPartitions("doc_id", "at", "first_doc").mapInArrow(run, "doc_id bigint, first_word int, n_words int, start int, end int, first_doc bigint")
