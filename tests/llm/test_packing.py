import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import packing


def least_cost(sizes, penalties, length):
    n = len(sizes)
    best = [0.0] + [float("inf")] * n
    for i in range(1, n + 1):
        used = 0
        for j in range(i - 1, -1, -1):
            used += sizes[j]
            if used > length:
                break
            best[i] = min(best[i], best[j] + length - used + penalties[i - 1])
    return best[n]


def test_cut_against_quadratic_programming():
    rng = random.Random(2)
    for _ in range(300):
        n, length = rng.randint(1, 40), rng.randint(5, 30)
        sizes, penalties = [rng.randint(1, length) for _ in range(n)], [rng.choice([0, 0, 3, 20]) for _ in range(n)]
        ends = packing.cut(np.array(sizes), np.array(penalties, float), length)
        cost, at = 0, 0
        for e in ends:
            used = sum(sizes[at:e])
            assert used <= length
            cost += length - used + penalties[e - 1]
            at = e
        assert at == n and cost == pytest.approx(least_cost(sizes, penalties, length))
    assert packing.cut(np.zeros(0, int), np.zeros(0), 5) == []


def test_round_trip(spark, make):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() + rng.choice(["", "", "", ".", "!"]) for _ in range(rng.randint(1, 120))) + rng.choice(["", "\n"]) for _ in range(60)]
    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, " \n "), (1003, "no stop " * 4000), (5, "twice."), (5, "twice."), (None, "no id here. and more")]
    found = packing.pack(make(rows, extra=True), length=64, shard_docs=50).orderBy("shard", "window").collect()
    assert all(r.n_tokens + r.padding == 64 and r.n_tokens <= 64 for r in found)
    by_doc = {}
    source = {}
    for i, t in rows:
        source.setdefault(i, []).append(t)
    for r in found:
        assert r.text == "\n\n".join(source[s.doc_id][0][s.start : s.end] for s in r.segments)
        for s in r.segments:
            by_doc.setdefault(s.doc_id, []).append((s.start, s.end))
    assert set(by_doc) == {i for i, t in rows if t and t.split()}
    for i, parts in by_doc.items():
        words = [w for a, b in parts for w in source[i][0][a:b].split()]
        assert words == [w for t in source[i] for w in t.split()]
    order = [(r.shard, s.doc_id) for r in found for s in r.segments if s.doc_id is not None]
    assert order == sorted(order)
    total = sum(len(t.split()) + 1 for _, t in rows if t and t.split())
    assert sum(r.n_tokens for r in found) == total
    assert packing.pack(make([])).count() == 0


def test_pieces_end_at_sentences():
    sizes, penalty, text, start, end = packing.pieces(pa.array(["One two. Three four five\nsix", None, "x"], pa.large_string()), 10, 2.0, 9.0)
    assert sizes.tolist() == [2, 3, 2, 2] and penalty.tolist() == [2.0, 2.0, 0.0, 0.0] and text.tolist() == [0, 0, 0, 2]
    assert re.sub(r"\s", "", "One two.") == "Onetwo."


def test_shards_pass_in_stretches_and_null_ids_are_divided(make):
    rows = [(k, f"document {k} has some words. " * (1 + k % 4)) for k in range(60)] + [(None, f"no id {k}. " * 3) for k in range(200)]
    whole, parts = ([tuple(r) for r in packing.pack(make(rows), length=32, stretch_chars=c).select("shard", "window", "text", "n_tokens").collect()] for c in (1 << 30, 500))
    assert sorted(" ".join(t.split()) for *_, t, _ in whole) != sorted(" ".join(t.split()) for *_, t, _ in parts)
    words = lambda found: sorted(w for _, _, t, _ in found for w in t.split())
    assert words(whole) == words(parts) == sorted(w for _, t in rows for w in t.split())
    for found in (whole, parts):
        assert len({r[:2] for r in found}) == len(found)
        assert len({r[0] for r in found if r[0] < 0}) > 100 and {r[0] for r in found if r[0] >= 0} == {0}
    # Each stretch has the least cost of its own: documents of 500 characters or more, one after the other.
    ids, texts, size, expected = [], [], 0, []
    for i, t in rows[:60]:
        if size >= 500:
            expected += [b for _, b, _ in packing.windows(ids, texts, 32, packing.SENTENCE_CUT, packing.HARD_CUT)]
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    expected += [b for _, b, _ in packing.windows(ids, texts, 32, packing.SENTENCE_CUT, packing.HARD_CUT)]
    assert [t for _, _, t, _ in sorted(r for r in parts if r[0] == 0)] == expected
