"""Language-model scoring: an n-gram trie of Elias-Fano levels, counted over the whole corpus.

Words are numbered by the order of their hashes, so that a context's successors lie evenly among the numbers. A node is kept relative to its context: with
n successors from place p on, the word w is held as p + w n / V, in fixed point; so nodes rise and lie evenly over the level, as Elias-Fano
sequences like it, and a search looks at one or two of them. The pointers p rise too. Next to
them lie 16-bit codes of the smoothed probability's own part and of what a context leaves to the shorter one. The trie is split by the first word
into shards, each a file per level in the shared folder, memory-mapped by the tasks that score.

Smoothing is Witten and Bell's, interpolated: P(w | h) = n(hw) / (n(h) + t(h)) + left(h) P(w | shorter h), t(h) being the kinds of words after h.
What n-grams that are pruned would have had is left to the shorter context, so that P(. | h) adds up to 1.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.columns import cuts, release, utf8, word_hashes, words
from pagewright.llm.eliasfano import EliasFano
from pagewright.session import scratch

MIN_WORD, MIN_GRAM = 1, 2
SHARD_BYTES = 32 << 20
PIECE = 300_000
FLUSH = 3 << 20
#: How much of the pointers a task may hold as plain numbers, which are looked up faster; the rest is searched as it lies. The same is found either way.
DECODED_BYTES = 256 << 20
STEP = 1 / 2000
_U = np.uint64


def code(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities: the natural logarithm in steps of 1 / 2000; 65535 is 0."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.where(p > 0, np.rint(-np.log(np.maximum(p, 1e-300)) / STEP), 65535), 65535).astype(np.uint16)


_DECODED = np.append(np.exp(-np.arange(65535) * STEP), 0.0)


def save(path: str, **arrays: np.ndarray | int) -> None:
    """One file of arrays, written under another name and renamed."""
    system, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        a = np.atleast_1d(np.asarray(a))
        parts.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        head[name] = (a.dtype.str, at, len(a))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    temporary = f"{own}.{uuid.uuid4().hex}"
    system.create_dir(own.rpartition("/")[0], recursive=True)
    with system.open_output_stream(temporary) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for p in parts:
            out.write(p)
    system.move(temporary, own)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped on a file system that is mounted, else read."""
    system, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    raw = np.asarray(np.memmap(own, np.uint8, "r")) if isinstance(system, fs.LocalFileSystem) else np.frombuffer(system.open_input_file(own).read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    return {k: raw[8 + size + at :][: n * np.dtype(kind).itemsize].view(kind) for k, (kind, at, n) in json.loads(raw[8 : 8 + size].tobytes()).items()}


def sequence(values: np.ndarray, universe: int, name: str) -> dict[str, np.ndarray | int]:
    e = EliasFano.build(values, universe)
    return {f"{name}_n": e.n, f"{name}_width": e.width} | {f"{name}_{k}": getattr(e, k) for k in EliasFano.PARTS}


def sequence_of(file: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano(int(file[f"{name}_n"][0]), int(file[f"{name}_width"][0]), *(file[f"{name}_{k}"] for k in EliasFano.PARTS))


@dataclass
class Trie:
    """Where the levels are, and what all tasks need to know of them."""

    folder: str
    bits: int  # shards: 2 ** bits
    offsets: list[int]  # of the words' numbers by shard, and their total
    tokens: int
    unknown: float
    nodes: list[int]  # offsets of the bigrams' numbers by shard; empty before they are counted

    @property
    def size(self) -> int:
        return self.offsets[-1]

    def file(self, level: int, shard: int) -> dict[str, np.ndarray] | None:
        """The file of a level and shard; None where there is none."""
        cache = self.__dict__.setdefault("_files", {})
        if (level, shard) not in cache:
            path = f"{self.folder}/level{level}-{shard:05}"
            try:
                f = load(path)
                f["nodes"] = sequence_of(f, "nodes")
                if level > 1:
                    f["pointers"] = sequence_of(f, "pointers")
                    if (size := 4 * f["pointers"].n) <= self.__dict__.setdefault("_room", DECODED_BYTES):
                        self._room -= size
                        f["plain"] = f["pointers"].values()
            except FileNotFoundError:
                f = None
            cache[level, shard] = f
        return cache[level, shard]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_files", "_room")}

    def numbers(self, hashes: np.ndarray, mark: bool = False) -> np.ndarray:
        """The words' numbers; -1 of unknown ones. Each distinct word is looked up once. ``mark``: -2 - number of words that stand once in the corpus."""
        distinct, index = np.unique(hashes, return_inverse=True)
        out = np.full(len(distinct), -1, np.int64)
        rest = distinct & _U((1 << (64 - self.bits)) - 1)
        edges = np.searchsorted(distinct >> _U(64 - self.bits), np.arange((1 << self.bits) + 1).astype(_U)) if self.bits else [0, len(distinct)]
        for s in range(1 << self.bits):
            where = slice(int(edges[s]), int(edges[s + 1]))
            if where.start < where.stop and (f := self.file(1, s)):
                i = f["nodes"].find(rest[where])
                out[where] = np.where(i >= 0, i + self.offsets[s], -1)
                if mark and len(f["once"]):
                    out[where] = np.where((i >= 0) & (f["once"][np.maximum(i, 0)] > 0), -2 - out[where], out[where])
        return out[index]

    def children(self, level: int, shard: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The places of words below local contexts in a level of a shard; -1 where they aren't."""
        f = self.file(level, shard)
        if not f or not f["nodes"].n:
            return np.full(len(context), -1, np.int64)
        low, high = (v.astype(np.int64) for v in ((f["plain"][context], f["plain"][context + 1]) if "plain" in f else f["pointers"].pair(context)))
        n = high - low
        out = np.full(len(context), -1, np.int64)
        some = np.flatnonzero(n)
        out[some] = f["nodes"].find(relative(low[some], n[some], word[some], self.size))
        return out

    @staticmethod
    def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if len(shard) and shard.max() < 1 << 15:
            shard = shard.astype(np.int16)  # sorted by radix
        order = np.argsort(shard, kind="stable")
        ordered = shard[order]
        edges = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else []
        for a, b in zip(edges, [*edges[1:], len(order)]):
            if ordered[a] >= 0:
                yield int(ordered[a]), order[a:b]

    def shard_of(self, number: np.ndarray) -> np.ndarray:
        return np.where(number >= 0, np.searchsorted(np.array(self.offsets), number, "right") - 1, -1)

    def bigrams(self, shard: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Each bigram's number; -1 where it isn't in the trie."""
        out = np.full(len(first), -1, np.int64)
        for s, where in self._by_shard(np.where(second >= 0, shard, -1)):
            i = self.children(2, s, first[where] - self.offsets[s], second[where])
            out[where] = np.where(i >= 0, i + self.nodes[s], -1)
        return out

    def successors(self, first: int) -> list[int]:
        """The words after a word in the trie, by the pointers."""
        s = int(self.shard_of(np.array([first]))[0])
        if not (f := self.file(2, s)):
            return []
        low, high = f["pointers"].get(np.array([first - self.offsets[s], first - self.offsets[s] + 1])).astype(np.int64).tolist()
        scale = 1 << fraction_bits(self.size)
        return [-(-((int(x) - low * scale) * self.size) // ((high - low) * scale)) for x in f["nodes"].get(np.arange(low, high))]

    def probabilities(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """P of each word given the up to two before it; ``start``: whether a text begins with it. Words may be marked: no bigram ends in such a one."""
        n = len(ids)
        marked, ids = ids < -1, unmarked(ids)
        shard = self.shard_of(ids)
        p = np.full(n, self.unknown)
        left1, own2, left2, own3 = np.ones(n), np.zeros(n), np.ones(n), np.zeros(n)
        for s, where in self._by_shard(shard):
            local = ids[where] - self.offsets[s]
            p[where] = _DECODED[self.file(1, s)["own"][local]]
            if f := self.file(2, s):
                left1[where] = _DECODED[f["left"][local]]
        before = np.full(n, -1, np.int64)
        before[1:] = np.where(start[1:], -1, ids[:-1])
        shard2 = np.full(n, -1, np.int64)
        shard2[1:] = np.where(start[1:], -1, shard[:-1])
        node = self.bigrams(shard2, before, np.where(marked, -1, ids))  # of (i - 1, i)
        for s, where in self._by_shard(np.where(node >= 0, shard2, -1)):
            f2, f3 = self.file(2, s), self.file(3, s)
            local = node[where] - self.nodes[s]
            own2[where] = _DECODED[f2["own"][local]]
            if f3:
                left2[where] = _DECODED[f3["left"][local]]
        p = np.where(before >= 0, own2 + np.where(before >= 0, np.r_[1.0, left1[:-1]], 1.0) * p, p)
        context = np.full(n, -1, np.int64)
        context[1:] = np.where(start[1:], -1, node[:-1])
        shard3 = np.r_[-1, shard2[:-1]] if n else shard2
        # A trigram in the trie has both its bigrams there.
        for s, where in self._by_shard(np.where((context >= 0) & (node >= 0), shard3, -1)):
            if f := self.file(3, s):
                i = self.children(3, s, context[where] - self.nodes[s], ids[where])
                own3[where[i >= 0]] = _DECODED[f["own"][i[i >= 0]]]
        return np.where(context >= 0, own3 + (np.r_[1.0, left2[:-1]] if n else left2) * p, p)


def unmarked(ids: np.ndarray) -> np.ndarray:
    return np.where(ids < -1, -2 - ids, ids)


def fraction_bits(size: int) -> int:
    return max(size - 1, 1).bit_length()


def relative(low: np.ndarray, n: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """A word among the n successors from place low on: low + word * n / size in fixed point, distinct for distinct words."""
    bits = _U(fraction_bits(size))
    share = word.astype(_U) * n.astype(_U)
    whole = share // _U(size)
    return ((low.astype(_U) + whole) << bits) + ((share - whole * _U(size)) << bits) // _U(size)


def packed(key: np.ndarray, n: np.ndarray) -> bytes:
    """Ordered keys and their counts as bytes: the steps between keys, and the counts, byte by byte of their places, so that what is 0 stands together and compresses."""
    steps = np.diff(key, prepend=_U(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes() + n.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(data) // 12
    steps = np.ascontiguousarray(data[: 8 * size].reshape(8, size).T).view(_U).ravel()
    return np.cumsum(steps, dtype=_U), np.ascontiguousarray(data[8 * size :].reshape(4, size).T).view(np.uint32).ravel()


def counted(held: list[np.ndarray], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(shard, counts) of pieces of keys, each key once, a row for each shard: what passes through the shuffle is a few long rows, not one for each key. A shard's keys are those from its bound on."""
    key = np.sort(np.concatenate(held))
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(edges, len(key)))
    key = key[edges]
    cut = np.append(np.searchsorted(key, bounds), len(key))
    cut[0] = 0
    some = np.flatnonzero(np.diff(cut))
    for k in range(0, len(some), 64):
        part = some[k : k + 64]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([packed(key[cut[s] : cut[s + 1]], n[cut[s] : cut[s + 1]]) for s in part.tolist()], pa.binary())], ["shard", "counts"])


ROWS = "shard int, counts binary"


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys, sums), one shard at a time, of rows ordered by shard."""

    def total(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")  # merges the pieces, which are in order
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.add.reduceat(n[order], first, dtype=np.int64).astype(np.int64)

    open_: list[tuple[np.ndarray, np.ndarray]] = []
    shard = None
    for batch in batches:
        rows = batch.column(1)
        for k, own in enumerate(batch.column(0).to_pylist()):
            if open_ and own != shard:
                yield int(shard), *total(open_)
                open_ = []
            shard = own
            open_.append(unpacked(np.frombuffer(rows[k].as_buffer(), np.uint8)))
    if open_:
        yield int(shard), *total(open_)
    release()


def by_shard(rows: DataFrame, shards: int) -> DataFrame:
    return rows.repartition(shards, "shard").sortWithinPartitions("shard")


#: Stands for all words that follow a context once and that stand once themselves, or whose own bigram does: each of them is a kind of its own.
ONCE = 0xFFFFFFFF


def smoothed(context: np.ndarray, word: np.ndarray, n: np.ndarray, contexts: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which n-grams stay, code of each one's own part, code of what each context leaves), n-grams ordered by context."""
    once = word == _U(ONCE)
    total, kinds = np.bincount(context, n, contexts), np.bincount(context, np.where(once, n, 1), contexts)
    keep = (n >= least) & ~once
    own = n / (total + kinds)[context]
    left = 1 - np.bincount(context[keep], own[keep], contexts)
    return keep, code(own[keep]), code(np.clip(left, 0, 1))


def train(docs: DataFrame, min_word: int = MIN_WORD, min_gram: int = MIN_GRAM, shard_bytes: int = SHARD_BYTES) -> tuple[Trie, DataFrame]:
    """(the trie, (doc_id, ids) of all texts): three counts over the whole corpus, each with one shuffle of what tasks have counted.
    Words of fewer than ``min_word`` occurrences are unknown; bigrams and trigrams of fewer than ``min_gram`` are pruned."""
    spark = docs.sparkSession
    folder = scratch(spark, "lm")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (int(size) // shard_bytes).bit_length())
    shards = 1 << bits
    bounds = np.arange(shards).astype(_U) << _U(64 - bits) if bits else np.zeros(1, _U)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for k, rows in cuts(batch.column(0)):
                data, offsets = utf8(batch.column(0).slice(k, rows))
                starts, ends, _ = words(data, offsets)
                held.append(word_hashes(data, starts, ends))
                total += len(held[-1])
                if total > FLUSH:
                    yield from counted(held, bounds)
                    held, total = [], 0
        if held:
            yield from counted(held, bounds)
        release()

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, key, n in summed(batches):
            keep = n >= min_word
            save(f"{folder}/words-{shard:05}", key=key[keep] & _U((1 << (64 - bits)) - 1), n=n[keep])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([int(keep.sum())]), pa.array([int(n[keep].sum())]), pa.array([int(n.sum())])], ["shard", "kept", "known", "tokens"])

    told = by_shard(docs.select("text").mapInArrow(count_words, ROWS), shards).mapInArrow(write_words, "shard int, kept bigint, known bigint, tokens bigint").collect()
    kept = {r["shard"]: r["kept"] for r in told}
    offsets = np.concatenate([[0], np.cumsum([kept.get(s, 0) for s in range(shards)])]).astype(np.int64).tolist()
    tokens, known = sum(r["tokens"] for r in told), sum(r["known"] for r in told)
    if offsets[-1] >= 1 << 31:
        raise OverflowError(f"{offsets[-1]} words; words are numbered by 31 bits")
    trie = Trie(folder, bits, offsets, tokens, (tokens - known + 1) / (tokens + offsets[-1] + 1), [])

    def write_level1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                f = load(f"{folder}/words-{shard:05}")
                save(f"{folder}/level1-{shard:05}", own=code((f["n"] + 1) / (tokens + offsets[-1] + 1)), once=(f["n"] == 1).astype(np.uint8), **sequence(f["key"], 1 << (64 - bits), "nodes"))
            yield batch

    spark.createDataFrame([(r["shard"],) for r in told] or [(0,)], "shard int").where("true" if told else "false").mapInArrow(write_level1, "shard int").count()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows in cuts(batch.column("text")):
                piece = batch.slice(k, rows)
                data, offsets = utf8(piece.column("text"))
                starts, ends, first = words(data, offsets)
                ids = trie.numbers(word_hashes(data, starts, ends), mark=min_gram > 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(number, "doc_id bigint, ids array<int>").write.parquet(f"{folder}/ids.parquet")
    numbered = spark.read.parquet(f"{folder}/ids.parquet")

    def count_grams(level: int):
        bounds = np.array(trie.offsets[:-1] if level == 2 else trie.nodes[:-1]).astype(_U) << _U(32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, total = [], 0
            for batch in batches:
                for k, rows in pieces(batch.column(0)):
                    ids, start = flat(batch.column(0).slice(k, rows))
                    if len(ids) < level:
                        continue
                    context, last = ids[:-1], ids[1:]
                    # A word that stands once begins no n-gram that stays: as a context it leaves all to the shorter one. It follows its context once.
                    ok = (context >= 0) & (last != -1) & ~start[1:]
                    if level == 3:
                        node = trie.bigrams(trie.shard_of(np.where(ok, context, -1)), context, last)
                        context, last = node[:-1], ids[2:]
                        ok = (context >= 0) & (last != -1) & ~start[2:]
                        if min_gram == 2:  # the second bigram was pruned, so it stands once, and the trigram too
                            last = np.where(node[1:] < 0, ONCE, last)
                    last = np.where(last < -1, ONCE, last)
                    held.append((context[ok].astype(_U) << _U(32)) | last[ok].astype(_U))
                    total += len(held[-1])
                    if total > FLUSH:
                        yield from counted(held, bounds)
                        held, total = [], 0
            if held:
                yield from counted(held, bounds)
            release()

        return run

    def write_level(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, key, n in summed(batches):
                first = trie.offsets if level == 2 else trie.nodes
                contexts = first[shard + 1] - first[shard]
                context, word = (key >> _U(32)).astype(np.int64) - first[shard], key & _U(0xFFFFFFFF)
                keep, own, left = smoothed(context, word, n, contexts, min_gram)
                context, word = context[keep], word[keep]
                each = np.bincount(context, minlength=contexts)
                children = np.concatenate([[0], np.cumsum(each)])
                nodes = relative(children[context], each[context], word, trie.size)
                save(f"{folder}/level{level}-{shard:05}", own=own, left=left, **sequence(nodes, len(nodes) << fraction_bits(trie.size), "nodes"), **sequence(children, int(children[-1]) + 1, "pointers"))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([int(keep.sum())])], ["shard", "kept"])
                release()

        return run

    for level in (2, 3):
        rows = by_shard(numbered.select("ids").mapInArrow(count_grams(level), ROWS), shards)
        kept = {r["shard"]: r["kept"] for r in rows.mapInArrow(write_level(level), "shard int, kept bigint").collect()}
        if level == 2:
            trie.nodes = np.concatenate([[0], np.cumsum([kept.get(s, 0) for s in range(shards)])]).astype(np.int64).tolist()
            if trie.nodes[-1] >= 1 << 32:
                raise OverflowError(f"{trie.nodes[-1]} bigrams; contexts are numbered by 32 bits")
    return trie, numbered


def pieces(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of successive texts with about PIECE words: enough for each shard's share of a search to be worth its calls."""
    offsets = lists.offsets.to_numpy()
    at = 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, to - at
        at = to


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after the other, whether a text begins there)."""
    offsets = lists.offsets.to_numpy()
    ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
    start = np.zeros(len(ids) + 1, bool)
    start[offsets - offsets[0]] = True
    return ids, start[:-1]


def score(trie: Trie, numbered: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, mean_log_prob, perplexity) of the numbered texts, one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, rows in pieces(batch.column("ids")):
                piece = batch.slice(k, rows)
                ids, start = flat(piece.column("ids"))
                total = np.concatenate([[0.0], np.cumsum(np.log(trie.probabilities(ids, start)))])
                where = piece.column("ids").offsets.to_numpy()
                where = where - where[0]
                n, log_prob = np.diff(where), total[where[1:]] - total[where[:-1]]
                mean = log_prob / np.maximum(n, 1)
                perplexity = np.exp(np.minimum(-mean, 700))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(mean, mask=n == 0), pa.array(perplexity, mask=n == 0)], ["doc_id", "n_tokens", "mean_log_prob", "perplexity"])

    return numbered.mapInArrow(run, "doc_id bigint, n_tokens int, mean_log_prob double, perplexity double")


def scored(docs: DataFrame, min_word: int = MIN_WORD, min_gram: int = MIN_GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each row's doc_id, n_tokens, mean_log_prob (the natural logarithm of its probability, for each token) and perplexity under the trigram model of all rows' texts.

    Words are runs of characters other than ASCII white space. Null or empty texts: 0 tokens, the others null. Null doc_id: scored, with
    a null id. Repeated rows count in the model as often as they stand, and have the same score. Other columns play no part. An empty table gives an empty result.
    """
    return score(*train(docs, min_word, min_gram, shard_bytes))
