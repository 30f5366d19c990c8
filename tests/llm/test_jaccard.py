import random

import numpy as np
import pytest

from pagewright.llm import jaccard


def sets(rows, n):
    out = {}
    for i, t in rows:
        w = (t or "").split()
        if i is not None and w:
            out.setdefault(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))), set()).add(i)
    return out


def brute(rows, n, t):
    nodes = [(s, sorted(ids)) for s, ids in sets(rows, n).items()]
    out = {(tuple(ids), tuple(ids), 1.0) for _, ids in nodes if len(ids) > 1}
    for k, (a, ia) in enumerate(nodes):
        for b, ib in nodes[k + 1 :]:
            j = len(a & b) / len(a | b)
            if j >= t - 1e-9 and len(set(ia) | set(ib)) > 1:
                out.add((*sorted((tuple(ia), tuple(ib))), round(j, 6)))
    return out


def corpus(seed, copies=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    shared = [word() for _ in range(30)]
    rows = []
    for k in range(120):
        w = [word() for _ in range(rng.randint(1, 80))]
        if k % 5 == 0:
            w = w[:10] + shared + w[10:]
        rows.append((k, " ".join(w)))
    base = [word() for _ in range(120)]
    for k in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 + k, " ".join(w)))
    return rows + [(2000, rows[3][1]), (2001, rows[3][1] + "\n"), (5, rows[5][1]), (6, "another text of this id"), (None, rows[3][1]), (3000, None), (3001, ""), (3002, " \n"), (3003, "a"), (3004, "a"), (3005, "long " * 30000)]


def linked(rows, n, t):
    links, root = {}, groups(rows, n, t)
    for a, b, _ in brute(rows, n, t):
        for x in a:
            for y in b:
                if x != y and (a != b or x < y):
                    links[x], links[y] = links.get(x, 0) + 1, links.get(y, 0) + 1
    return {(i, root[i], k) for i, k in links.items()}


@pytest.mark.parametrize("n, t", [(3, 0.7), (1, 0.5), (2, 0.9)])
def test_against_brute_force(make, n, t):
    rows = corpus(n)
    found = {tuple(r) for r in jaccard.join(make(rows, extra=True), n, t).select("doc_id", "class_id", "n_links").collect()}
    assert found == linked(rows, n, t)


def test_hot_grams_are_met_in_blocks(make, monkeypatch):
    rows = corpus(5, copies=70)
    monkeypatch.setattr(jaccard, "BLOCK_BITS", 3)
    found = {tuple(r) for r in jaccard.join(make(rows), 3, 0.6).select("doc_id", "class_id", "n_links").collect()}
    assert found == linked(rows, 3, 0.6)


def test_longer_prefixes_are_chosen_for_hot_grams():
    assert jaccard.choose(np.ones(100), 100, 0.7) == (1, 31)
    l, post = jaccard.choose(np.full(100, 50.0), 100, 0.7)
    assert l > 1 and post == 30 + l
    assert jaccard.choose(np.ones(1), 1, 0.7) == (1, 1)


def test_multi_match_prefixes_lose_nothing(make, monkeypatch):
    rows = corpus(9)
    rng = random.Random(1)

    def any_l(frequencies, size, t):
        need = int(np.ceil(t * size - 1e-9))
        l = rng.randint(1, min(6, need))
        return l, size - need + l

    monkeypatch.setattr(jaccard, "choose", any_l)
    found = {tuple(r) for r in jaccard.join(make(rows), 3, 0.7).select("doc_id", "class_id", "n_links").collect()}
    assert found == linked(rows, 3, 0.7)


def groups(rows, n, t):
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in brute(rows, n, t):
        for x in a:
            for y in b:
                r, s = root(x), root(y)
                parent[max(r, s)] = min(r, s)
    return {i: root(i) for i in parent}


def test_one_of_each(make):
    rows = [r for r in corpus(4) if r != (6, "another text of this id")]
    kept = jaccard.one_of_each(make(rows))
    root = groups(rows, 3, jaccard.THRESHOLD)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted({(i, t) for i, t in rows if i is None or root[i] == i}, key=repr)
    assert kept.columns == make(rows).columns


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(-50, 200), rng.randint(-50, 200)) for _ in range(130)] + [(k, k + 1) for k in range(500, 540)] + [(7, 7)]
    found = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        r, s = root(a), root(b)
        parent[max(r, s)] = min(r, s)
    assert found == {x: root(x) for x in parent if root(x) != x}


def test_empty(make):
    assert jaccard.join(make([])).count() == 0
    assert jaccard.one_of_each(make([])).count() == 0
    assert jaccard.join(make([(1, None), (2, "")])).count() == 0


def test_odd_column_names(make):
    df = make([(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, "e f g"), (4, "e f h"), (4, "other words")]).selectExpr("*", "1 as `a.b`", "2 as `c``d`", "3 as `Class_ID`")
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 4]


def test_candidates_that_strangers_share_far_behind_are_not_met():
    # Two sets of 100 grams that share one gram: similar sets have 75 in common, so the first of these is among the first 26 of either.
    info = lambda place, l=1, side=0, size=100: place * jaccard.PLACES // size | l << 8 | side << 16

    def pairs(*posted, t=0.6):
        group, node, size, told = (np.array(c, np.int64) for c in zip(*posted))
        return sorted((a, b, n) for x in jaccard.met(group, node, size, told, t) for a, b, n in zip(*(c.tolist() for c in x)))

    assert pairs((0, 7, 100, info(25)), (0, 3, 100, info(0))) == [(3, 7, 1)]
    assert pairs((0, 7, 100, info(26)), (0, 3, 100, info(0))) == []
    assert pairs((0, 7, 100, info(32, 8)), (0, 3, 100, info(0, 9))) == [(3, 7, 8)] and pairs((0, 7, 100, info(33, 8)), (0, 3, 100, info(0, 9))) == []
    # A smaller set needs its first gram; one that is too small is never met. Repeated postings count once, groups are apart, and so are equal sides.
    assert pairs((0, 7, 60, info(0)), (0, 3, 100, info(40))) == [(3, 7, 1)] and pairs((0, 7, 60, info(1)), (0, 3, 100, info(0))) == []
    assert pairs((0, 7, 59, info(0)), (0, 3, 100, info(0))) == []
    assert pairs((0, 1, 9, info(0)), (0, 2, 9, info(0)), (0, 1, 9, info(0)), (1, 1, 9, info(0)), (1, 4, 9, info(0))) == [(1, 2, 1), (1, 4, 1)]
    assert pairs((0, 1, 9, info(0, 1, 1)), (0, 2, 9, info(0, 1, 1)), (0, 3, 9, info(0, 1, 2))) == [(1, 3, 1), (2, 3, 1)]


def test_pairs_are_summed_whatever_their_hashes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-4, 4, (2, 500))
    x, y, need, times = jaccard.summed(a, b, np.full(500, 2, np.int32), np.ones(500, np.int32))
    assert {(i, j): n for i, j, n in zip(x.tolist(), y.tolist(), times.tolist())} == {(i, j): int(((a == i) & (b == j)).sum()) for i, j in zip(a.tolist(), b.tolist())} and set(need) == {2}


def test_groups_are_not_expanded_into_pairs(make, monkeypatch):
    rows = [r for r in corpus(6, copies=90) if r != (6, "another text of this id")]
    root = groups(rows, 3, 0.6)
    copies = [i for i, _ in rows if i is not None and 1000 <= i < 1090]
    assert len({root[i] for i in copies}) == 1
    for known in (jaccard.KNOWN, 0):
        monkeypatch.setattr(jaccard, "KNOWN", known)
        seen = []
        monkeypatch.setattr(jaccard, "verified", lambda d, nodes, pairs, *a, real=jaccard.__dict__["verified"]: seen.append(pairs.count()) or real(d, nodes, pairs, *a))
        ids, pairs = jaccard.spanning_nodes(make(rows), 3, 0.6)
        found = jaccard.linked(ids, pairs, "doc_id").collect()
        monkeypatch.undo()
        assert {r.doc_id: r.class_id for r in found} == {i: c for i, c, _ in linked(rows, 3, 0.6)}
        assert (sum(seen) < 400) == (known > 0)  # 90 copies have 4005 pairs


def test_links_within_groups_are_counted_without_candidates(make, monkeypatch):
    rows = corpus(11, copies=90) + [(1000, "once more " + corpus(11, copies=90)[121][1])]
    for known, nodes in ((jaccard.KNOWN, 1024), (jaccard.KNOWN, 16), (0, 1024)):
        monkeypatch.setattr(jaccard, "KNOWN", known)
        monkeypatch.setattr(jaccard, "GROUP_NODES", nodes)
        seen = []
        monkeypatch.setattr(jaccard, "candidates", lambda *a, real=jaccard.__dict__["candidates"]: seen.append(real(*a)) or seen[-1])
        found = {tuple(r) for r in jaccard.join(make(rows), 3, 0.6).select("doc_id", "class_id", "n_links").collect()}
        monkeypatch.undo()
        assert found == linked(rows, 3, 0.6)
        assert (seen[0].count() < 400) == (known > 0)  # 90 copies have 4005 pairs


@pytest.mark.parametrize("words", [30, 3000])
def test_grams_in_common(words):
    rng = np.random.default_rng(words)
    x, y = ([np.unique(rng.integers(0, words, rng.integers(0, 60))) for _ in range(k)] for k in (25, 40))
    entries = [(np.repeat(np.arange(len(s)), [len(g) for g in s]), np.concatenate(s)) for s in (x, y)]
    assert jaccard.common(*entries, (25, 40)).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
