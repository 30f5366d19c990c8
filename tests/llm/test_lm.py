import collections
import math
import random

import pyarrow as pa
import pytest

from pagewright.llm import lm


def brute(rows, min_word, min_gram):
    texts = [(t or "").split() for _, t in rows]
    one = collections.Counter(w for t in texts for w in t)
    n = sum(one.values())
    known = {w for w, c in one.items() if c >= min_word}
    unknown = (n - sum(one[w] for w in known) + 1) / (n + len(known) + 1)
    two = collections.Counter((a, b) for t in texts for a, b in zip(t, t[1:]) if a in known and b in known)
    kept2 = {g for g, c in two.items() if c >= min_gram}
    three = collections.Counter((a, b, c) for t in texts for a, b, c in zip(t, t[1:], t[2:]) if (a, b) in kept2 and c in known)
    kept3 = {g for g, c in three.items() if c >= min_gram}

    def smooth(counts, kept):
        total, kinds, own, left = collections.Counter(), collections.Counter(), {}, {}
        for g, c in counts.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        left = dict.fromkeys(total, 1.0)
        for g in kept:
            own[g] = counts[g] / (total[g[:-1]] + kinds[g[:-1]])
            left[g[:-1]] -= own[g]
        return own, left

    own2, left2 = smooth(two, kept2)
    own3, left3 = smooth(three, kept3)

    def p(t, i):
        q = (one[t[i]] + 1) / (n + len(known) + 1) if t[i] in known else unknown
        if i and t[i - 1] in known:
            q = own2.get((t[i - 1], t[i]), 0) + left2.get((t[i - 1],), 1) * q
        if i > 1 and (t[i - 2], t[i - 1]) in kept2:
            q = own3.get((t[i - 2], t[i - 1], t[i]), 0) + left3.get((t[i - 2], t[i - 1]), 1) * q
        return q

    return [sum(math.log(p(t, i)) for i in range(len(t))) for t in texts], known, kept2


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    pick = lambda: vocabulary[min(int(rng.expovariate(0.05)), 299)]
    rows = [(k, " ".join(pick() for _ in range(rng.randint(1, 60)))) for k in range(300)]
    return rows + [(900, None), (901, ""), (902, " \n"), (None, rows[1][1]), (3, rows[3][1]), (903, "never seen before"), (904, rows[5][1] + " " + "a b " * 8000)]


@pytest.mark.parametrize("min_word, min_gram, shard_bytes", [(2, 2, 1 << 30), (1, 1, 2000), (4, 2, 500)])
def test_against_brute_force(make, min_word, min_gram, shard_bytes):
    rows = corpus(min_word)
    trie, numbered = lm.train(make(rows, extra=True), min_word, min_gram, shard_bytes)
    expected, known, kept2 = brute(rows, min_word, min_gram)
    assert trie.size == len(known) and trie.tokens == sum(len((t or "").split()) for _, t in rows)
    got = sorted(((r.doc_id, r.n_tokens, r.mean_log_prob, r.perplexity) for r in lm.score(trie, numbered).collect()), key=lambda r: (repr(r[0]), r[1]))
    want = sorted(((i, len((t or "").split()), e) for (i, t), e in zip(rows, expected)), key=lambda r: (repr(r[0]), r[1]))
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and (g[2] == pytest.approx(w[2] / w[1], abs=1e-3) if w[1] else g[2] is None)
        assert g[3] is None if not w[1] else g[3] == pytest.approx(math.exp(min(-w[2] / w[1], 700)), rel=2e-3)
    assert sum(len(trie.successors(k)) for k in range(trie.size)) == len(kept2)


def test_pointers_as_numbers_and_as_they_lie_tell_the_same(make, monkeypatch):
    trie, numbered = lm.train(make(corpus(3)), 1, 2, 300)
    ids, start = lm.flat(pa.array([r.ids for r in numbered.collect()], pa.list_(pa.int32())))
    whole = trie.probabilities(ids, start)
    monkeypatch.setattr(lm, "DECODED_BYTES", 200)
    other = lm.Trie(trie.folder, trie.bits, trie.offsets, trie.tokens, trie.unknown, trie.nodes)
    assert (other.probabilities(ids, start) == whole).all()
    kinds = {"plain" in f for f in other._files.values() if f and "pointers" in f}
    assert kinds == {True, False} and trie.bits > 1


def test_empty(make):
    assert lm.scored(make([])).count() == 0
    assert [(r.n_tokens, r.mean_log_prob, r.perplexity) for r in lm.scored(make([(1, None)])).collect()] == [(0, None, None)]


@pytest.mark.parametrize("min_gram, shard_bytes", [(2, 1 << 30), (2, 500), (3, 2000)])
def test_words_that_stand_once_are_counted_whole(make, min_gram, shard_bytes):
    rows = corpus(1) + [(1000 + k, f"only{k} here{k} stands {rng} once{k}") for k, rng in enumerate("abcdabcd" * 4)]
    trie, numbered = lm.train(make(rows), 1, min_gram, shard_bytes)
    expected, known, _ = brute(rows, 1, min_gram)
    assert trie.size == len(known)
    got = sorted((repr(r.doc_id), r.n_tokens, r.mean_log_prob) for r in lm.score(trie, numbered).collect())
    for g, w in zip(got, sorted((repr(i), len((t or "").split()), e) for (i, t), e in zip(rows, expected))):
        assert g[:2] == w[:2] and (g[2] == pytest.approx(w[2] / w[1], abs=1e-3) if w[1] else g[2] is None)


def test_junk_of_rare_words_scores_worse_than_running_text(make):
    rows = corpus(5)[:300] + [(2000 + k, " ".join(f"os{k}q{j}***" for j in range(30))) for k in range(20)]
    perplexity = {r.doc_id: r.perplexity for r in lm.scored(make(rows)).collect()}
    assert min(p for i, p in perplexity.items() if i >= 2000) > max(p for i, p in perplexity.items() if i < 300)
