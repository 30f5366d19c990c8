"""License scans: a positional index of the rare words of licence templates (notices, headings, identifiers and whole texts).

A template of W words is found where at least ``coverage`` of them stand in order, so of any W - need + 1 of its words one is there. Its words of highest
inverse document frequency over all files, as many, are its postings. A file's words are looked up among them, from the rarest on; each posting says at what place the template would
begin, and such places are intersected with those of the template's other words: enough words have to agree on the place, up to a slack. What is left is verified by its mandatory phrases and an alignment.
So no word that is missing or misspelt hides a template as long as the others suffice.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.notices import NOTICES

COVERAGE = 0.7
_WORD = re.compile(r"[a-z0-9]+(?:[.][0-9]+)*")
Templates = Mapping[str, tuple[str, str, tuple[str, ...]]]


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def spotted(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words of a text, in characters."""
    if len(text.lower()) == len(text):
        return [(m.group(), m.start(), m.end()) for m in _WORD.finditer(text.lower())]
    return [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+(?:[.][0-9]+)*", text)]


def contains(window: list[str], phrase: list[str]) -> bool:
    return any(window[i : i + len(phrase)] == phrase for i in range(len(window) - len(phrase) + 1))


@dataclass
class Template:
    name: str
    license: str
    words: list[str]
    phrases: list[list[str]]
    coverage: float

    @property
    def need(self) -> int:
        """Words that must be there."""
        return max(1, math.ceil(self.coverage * len(self.words) - 1e-9))

    @property
    def slack(self) -> int:
        """How many places a word may be off."""
        return min(3 + len(self.words) // 20, len(self.words) // 2)

    def verified(self, own: list[str], place: int) -> tuple[int, int, int] | None:
        """(words in order, first, last place of one in the file) if the template stands at about that place of the file's words."""
        low, high = max(0, place - self.slack), min(len(own), place + len(self.words) + self.slack)
        window = own[low:high]
        if not all(contains(window, p) for p in self.phrases):
            return None
        pairs = alignment(self.words, own, place, self.slack)
        return (len(pairs), pairs[0][1], pairs[-1][1]) if len(pairs) >= self.need else None


def alignment(x: list[str], y: list[str], place: int, slack: int) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence of a template and a file's words, each up to ``slack`` off the template's place."""
    width = 2 * slack + 1
    best = [[0] * (width + 1) for _ in range(len(x) + 1)]  # by position in x, and how far y's is off
    for i in range(len(x) - 1, -1, -1):
        here, below = best[i], best[i + 1]
        for d in range(width - 1, -1, -1):
            j = place + i + d - slack
            skip = max(here[d + 1], below[d], below[d - 1] if d else 0)
            here[d] = max(below[d] + 1, skip) if 0 <= j < len(y) and x[i] == y[j] else skip
    out, i, d = [], 0, max(range(width), key=lambda k: (best[0][k], -k))
    while i < len(x) and best[i][d] > 0:
        j = place + i + d - slack
        if 0 <= j < len(y) and x[i] == y[j] and best[i][d] == best[i + 1][d] + 1:
            out.append((i, j))
            i += 1
        elif best[i][d] == best[i + 1][d]:
            i += 1
        elif best[i][d] == best[i][d + 1]:
            d += 1
        else:
            i, d = i + 1, d - 1
    return out


@dataclass
class Index:
    templates: list[Template]
    postings: dict[str, list[tuple[int, int]]]  # word: (template, position)
    idf: dict[str, float]

    @staticmethod
    def build(notices: Templates, idf: Mapping[str, float], coverage: float = COVERAGE) -> Index:
        """Each template's W - need + 1 positions whose words have the highest idf (ties: in the order of the words and positions)."""
        index = Index([Template(name, kind, tokens(text), [tokens(p) for p in phrases], coverage) for name, (kind, text, phrases) in notices.items()], defaultdict(list), {})
        for k, t in enumerate(index.templates):
            rarest = sorted(range(len(t.words)), key=lambda i: (-idf.get(t.words[i], 0.0), t.words[i], i))
            for i in rarest[: len(t.words) - t.need + 1]:
                index.postings[t.words[i]].append((k, i))
        index.postings = dict(index.postings)
        index.idf = {w: idf.get(w, 0.0) for w in index.postings}
        return index

    def places(self, own: list[str]) -> Iterator[tuple[Template, int]]:
        """Where templates may begin: the places near one that a posting tells, at which enough of the template's words can stand."""
        where: dict[str, list[int]] = defaultdict(list)
        for p, w in enumerate(own):
            if w in self.postings:
                where[w].append(p)
        told: dict[int, set[int]] = defaultdict(set)
        for w in sorted(where, key=lambda w: (-self.idf[w], w)):
            for k, at in self.postings[w]:
                told[k].update(p - at for p in where[w])
        for k, begins in told.items():
            t = self.templates[k]
            near = sorted({b + d for b in begins for d in range(-t.slack, t.slack + 1)})
            words = set(t.words)
            there = np.concatenate([[0], np.cumsum(np.fromiter((w in words for w in own), np.int64, len(own)))])
            for place in near:
                low, high = max(0, place - t.slack), min(len(own), place + len(t.words) + t.slack)
                if low < high and there[high] - there[low] >= t.need:
                    yield t, place

    def find(self, text: str, every: bool = False) -> list[tuple[str, int, int, float]]:
        """(licence, start, end, share of the template's words in order) of the templates in a text, in characters; of those that overlap, the one of most words that agree stays.
        ``every``: look at every place for every template, as a test of the index."""
        spots = spotted(text)
        own = [w for w, _, _ in spots]
        places = ((t, p) for t in self.templates for p in range(-len(t.words), len(own) + 1)) if every else self.places(own)
        found = set()
        for t, place in places:
            if at := t.verified(own, place):
                found.add((-at[0] * at[0] / len(t.words), at[1], at[2], t.license, t.name, at[0] / len(t.words)))
        kept: list[tuple[int, int, str, float]] = []
        for _, a, b, kind, _, share in sorted(found):
            if all(b < x or y < a for x, y, _, _ in kept):
                kept.append((a, b, kind, share))
        return [(kind, spots[a][1], spots[b][2], round(share, 4)) for a, b, kind, share in sorted(kept)]


def frequencies(docs: DataFrame, vocabulary: frozenset[str]) -> tuple[int, dict[str, int]]:
    """Files, and files with each word of the templates, over all files; as many numbers as the templates have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count[""] += 1
                if text:
                    count.update(vocabulary.intersection(_WORD.findall(text.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "files"])

    found = {r["word"]: r["files"] for r in docs.select("text").mapInArrow(run, "word string, files bigint").groupBy("word").agg(F.sum("files").alias("files")).collect()}
    return found.pop("", 0), found


def scan(docs: DataFrame, notices: Templates = NOTICES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, start, end, coverage) of each template found in each text, start and end in characters.

    A template is found where its mandatory phrases and at least ``coverage`` of its words stand in order, each up to its slack (3 words, and one more for each 20 of the template, at most half of it) off its place.
    Case and punctuation don't count. Two passes without a shuffle of texts. Null or empty texts: no rows. Null doc_id: rows with a null id.
    Repeated rows: repeated results. An empty table gives an empty result. Other columns play no part.
    """
    vocabulary = frozenset(w for _, t, _ in notices.values() for w in tokens(t))
    total, files = frequencies(docs, vocabulary)
    index = Index.build(notices, {w: float(np.log((total + 1) / (files.get(w, 0) + 1))) for w in vocabulary}, coverage)
    # A file is looked at more closely if it has the rarest word of a mandatory phrase of some template, and as many of its words as are needed.
    keys: dict[str, list[tuple[frozenset[str], int]]] = defaultdict(list)
    for t in index.templates:
        phrase = max(t.phrases or [t.words], key=lambda p: max(index.idf.get(w, 0.0) for w in p))
        distinct = Counter(t.words)
        spare = len(t.words) - t.need
        least = len(distinct) - sum(1 for n in np.cumsum(sorted(distinct.values())) if n <= spare)
        keys[max(phrase, key=lambda w: (float(np.log((total + 1) / (files.get(w, 0) + 1))), w))].append((frozenset(distinct), least))
    keyed = dict(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    have = vocabulary.intersection(_WORD.findall(text.lower()))
                    if any(len(words & have) >= least for w in have if w in keyed for words, least in keyed[w]):
                        out += [(doc_id, *f) for f in index.find(text)]
            if out:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "license", "start", "end", "coverage"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, license string, start int, end int, coverage double")
