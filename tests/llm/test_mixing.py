import hashlib
import math

import pytest
from pyspark.sql import functions as F

from pagewright.llm import mixing


def brute(rows, weights, default, share, tiers, seed=17, short=0.5):
    h = lambda i: int(hashlib.md5(f"{'null' if i is None else i}:{seed}".encode()).hexdigest()[:15], 16)
    n = lambda t: len((t or "").split())
    sources = {r[2] for r in rows}
    w = {s: weights.get(s, default) for s in sources}
    total, whole = sum(n(r[1]) for r in rows), sum(w.values())
    own = {s: sum(n(r[1]) for r in rows if r[2] == s) for s in sources}
    rate = min((own[s] / w[s] for s in sources if w[s] > 0 and not own[s] < short * total * w[s] / whole), default=0)
    out = []
    for i, t, s in rows:
        used = sum(n(r[1]) for r in rows if r[2] == s and h(r[0]) <= h(i))
        fits = [k for k, part in enumerate(tiers) if used <= math.floor(part * math.floor(share * rate * w[s] + 1e-6))]
        if fits:
            out.append((i, t, s, n(t), fits[0]))
    return sorted(out, key=repr)


ROWS = [(k, "w " * (k % 23), f"s{k % 3 if k % 7 else 0}") for k in range(400)] + [(7, "again and again", "s0"), (7, "again and again", "s0"), (None, "a b", "s1"), (None, None, "s2"), (900, "", None), (901, "long " * 20000, "s1"), (902, "in null source", None)]


@pytest.mark.parametrize("weights, default, share, tiers", [({}, 1.0, 1.0, (0.25, 0.5, 1.0)), ({"s0": 5.0, "s1": 0.0}, 1.0, 0.9, (1.0,)), ({"s2": 3.0}, 0.5, 0.4, (0.1, 1.0))])
def test_against_brute_force(make, weights, default, share, tiers):
    out = mixing.mix(make(ROWS, extra=True).drop("mix_tier"), weights, default, share, tiers)
    got = sorted(((r.doc_id, r.text, r.source, r.mix_tokens, r.mix_tier) for r in out.collect()), key=repr)
    assert got == brute(ROWS, weights, default, share, tiers)


def test_a_corpus_at_its_target_stays_whole_and_only_a_surplus_goes(make):
    even = [(k, "one two three", f"s{k % 5}") for k in range(100)]
    assert mixing.mix(make(even)).count() == 100
    # 60, 30, 5 and 5 % of the tokens: the small two are short and stay whole, the others come to the same.
    skewed = [(k, "one two three", "a" if k < 60 else "b" if k < 90 else "c" if k < 95 else "d") for k in range(100)]
    kept = {r.source: r.n for r in mixing.mix(make(skewed)).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert kept == {"a": 30, "b": 30, "c": 5, "d": 5}
    told = {r.source: (r.tokens, r.target, r.short) for r in mixing.report(make(skewed)).collect()}
    assert told == {"a": (180, 90, False), "b": (90, 90, False), "c": (15, 90, True), "d": (15, 90, True)}


def test_odd_names_and_many_sources(make, monkeypatch):
    df = make(ROWS).selectExpr("*", "1 as `a.b`", "2 as `c``d`", "3 as `MIX_TIER`", "4 as `_text`")
    expected = brute(ROWS, {}, 1.0, 1.0, (0.25, 0.5, 1.0))
    for most in (20_000, 1):  # thresholds broadcast, and joined
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        out = mixing.mix(df)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "c`d", "_text", "mix_tokens", "mix_tier"]
        assert sorted(((r.doc_id, r.text, r.source, r.mix_tokens, r.mix_tier) for r in out.collect()), key=repr) == expected


def test_texts_are_not_shuffled(make, capsys):
    mixing.mix(make(ROWS)).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(source" not in plan


def test_empty(make):
    assert mixing.mix(make([])).count() == 0
