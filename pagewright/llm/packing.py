"""Packing: order-preserving windows cut at document or sentence boundaries by dynamic programming.

Documents of a shard follow one another in order. Of all ways to cut their sequence into windows of at most ``length`` tokens, the
one with the least padding plus penalties for documents cut short of their end is found in linear time with a monotone queue.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.columns import characters, utf8, words

LENGTH = 2048
SENTENCE_CUT, HARD_CUT = 32, 256
SHARD_DOCS = 4096
#: A window ends at the first document behind so many characters of a shard, so that a shard of any size passes through a bounded memory.
STRETCH_CHARS = 8 << 20
#: Shards of the rows without an id.
NULL_SHARDS = 1024
SEGMENTS = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def cut(sizes: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Ends (indices into 1 … n) of the windows over pieces of ``sizes`` <= length, at least total cost: a window ending
    after piece i costs length less its tokens (padding), plus penalties[i]. Of equal costs the later start wins."""
    n = len(sizes)
    if not n:
        return []
    at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    penalty = penalties.tolist()
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (best[j] + at[j], j): increasing from front to back
    for i in range(1, n + 1):
        floor = at[i] - length
        while at[queue[0][1]] < floor:
            queue.popleft()
        value, j = queue[0]
        best[i], back[i] = value - at[i] + length + penalty[i - 1], j
        value = best[i] + at[i]
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, i))
    ends, i = [], n
    while i:
        ends.append(i)
        i = back[i]
    return ends[::-1]


def pieces(texts: pa.Array, length: int, sentence_cut: float, hard_cut: float) -> tuple[np.ndarray, ...]:
    """Of all texts in order: (tokens, penalty for a cut after it, text, first byte, byte behind it) of each piece. A piece is a
    sentence (up to a word ending in . ! ? or before a line break), or ``length`` tokens of a longer one. The last piece of a text counts a token more, for the
    end-of-text mark. Texts without a word have no piece."""
    data, offsets = utf8(texts)
    starts, ends, first = words(data, offsets)
    n = len(starts)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    stop = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8))
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.ones(n, bool)
    last[:-1] = own[1:] != own[:-1]
    stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
    stop |= last
    sentence = np.cumsum(stop) - stop
    begin = np.flatnonzero(np.r_[True, stop[:-1]])
    place = np.arange(n) - begin[sentence]
    room = length - 1  # so that an end-of-text mark always fits
    hard = (place % room == room - 1) & ~stop
    piece_end = np.flatnonzero(stop | hard)
    piece_start = np.r_[0, piece_end[:-1] + 1]
    is_last = last[piece_end]
    sizes = piece_end - piece_start + 1 + is_last
    penalty = np.where(is_last, 0.0, np.where(stop[piece_end], sentence_cut, hard_cut))
    text = own[piece_end]
    return sizes, penalty, text, starts[piece_start] - offsets[text], ends[piece_end] - offsets[text]


def windows(ids: list[int | None], texts: list[str | None], length: int, sentence_cut: float, hard_cut: float) -> Iterator[tuple[list[tuple[int | None, int, int]], str, int]]:
    """(segments (doc_id, start, end) in characters, text, tokens) of each window of one shard."""
    column = pa.array(texts, pa.large_string())
    sizes, penalty, text, start, end = pieces(column, length, sentence_cut, hard_cut)
    if not len(sizes):
        return
    data, offsets = utf8(column)
    chars = characters(data)
    low = chars[offsets[text] + start] - chars[offsets[text]]
    high = chars[offsets[text] + end] - chars[offsets[text]]
    done = 0
    for upto in cut(sizes, penalty, length):
        segments: list[list] = []
        k = done
        for k in range(done, upto):
            if k > done and text[k] == text[k - 1]:
                segments[-1][2] = int(high[k])
            else:
                segments.append([int(text[k]), int(low[k]), int(high[k])])
        body = "\n\n".join(texts[t][a:b] for t, a, b in segments)
        yield [(ids[t], a, b) for t, a, b in segments], body, int(sizes[done:upto].sum())
        done = upto


SCHEMA = T.StructType(
    [
        T.StructField("shard", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("segments", SEGMENTS),
        T.StructField("text", T.StringType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("padding", T.IntegerType()),
    ]
)
_ARROW = pa.schema(
    [
        ("shard", pa.int64()), ("window", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("segments", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))),
        ("text", pa.string()), ("n_tokens", pa.int32()), ("padding", pa.int32()),
    ]
)


def pack(docs: DataFrame, length: int = LENGTH, sentence_cut: float = SENTENCE_CUT, hard_cut: float = HARD_CUT, shard_docs: int = SHARD_DOCS, stretch_chars: int = STRETCH_CHARS) -> DataFrame:
    """Windows (shard, window, doc_ids, segments, text, n_tokens, padding) of whole documents in the order of doc_id.

    Tokens are runs of characters other than ASCII white space, and one end-of-text mark for each document. A shard
    holds the documents of ``shard_docs`` successive ids; windows don't span shards, nor stretches of a shard of STRETCH_CHARS characters, which costs at most a window's padding for each. One shuffle, by shard.
    Null doc_id: shards below 0 (one of NULL_SHARDS by the text's hash), with null ids. Rows of the same id follow one another in the order of their texts. Null or empty
    texts, or of white space alone: in no window. A sentence longer than a window is cut every length - 1 tokens. An empty table
    gives an empty result. Other columns play no part.
    """
    slim = docs.select(F.coalesce(F.expr(f"floor(doc_id / {int(shard_docs)})").cast("bigint"), -F.lit(1) - F.pmod(F.xxhash64("text"), F.lit(NULL_SHARDS))).alias("shard"), F.col("doc_id").cast("bigint"), "text")
    ordered = slim.repartition("shard").sortWithinPartitions("shard", "doc_id", "text")

    def emit(shard: int, first: int, ids: list, texts: list) -> pa.RecordBatch:
        rows = [(shard, k, list(dict.fromkeys(i for i, _, _ in seg)), [{"doc_id": i, "start": a, "end": b} for i, a, b in seg], body, n, length - n) for k, (seg, body, n) in enumerate(windows(ids, texts, length, sentence_cut, hard_cut), first)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts, size, done = None, [], [], 0, 0
        for batch in batches:
            for s, i, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if ids and (s != shard or size >= stretch_chars):
                    out = emit(shard, done, ids, texts)
                    yield out
                    ids, texts, size, done = [], [], 0, done + out.num_rows
                if s != shard:
                    shard, done = s, 0
                ids.append(i)
                texts.append(t)
                size += len(t or "")
        if ids:
            yield emit(shard, done, ids, texts)

    return ordered.mapInArrow(run, SCHEMA)
