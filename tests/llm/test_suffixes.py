import random

import pytest

from pagewright.llm import suffixes


def brute(rows, least):
    where = {}
    texts = {}
    for i, t in rows:
        if i is not None and t:
            w = t.split()
            texts.setdefault(i, []).append(w)
            for k in range(len(w) - least + 1):
                where.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = set()
    for i, parts in texts.items():
        for w in parts:
            at = [k for k in range(len(w) - least + 1) if len(where[tuple(w[k : k + least])]) > 1]
            for x, k in enumerate(at):
                if x == 0 or k > at[x - 1] + least:
                    start = k
                if x + 1 == len(at) or at[x + 1] > k + least:
                    out.add((i, start, k + least - start, min(where[tuple(w[start : start + least])])))
    return out


def test_covers_are_difference_covers():
    for period, cover in suffixes.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("least", [1, 5, 12, 50])
def test_against_brute_force(make, least):
    rng = random.Random(least)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passages = [[word() for _ in range(least + d)] for d in (-1, 0, 1, 7, 60)]
    rows = []
    for k in range(80):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += [word() for _ in range(rng.randint(0, 50))] + (rng.choice(passages) if rng.random() < 0.5 else [])
        rows.append((k, (" " if k % 2 else "\n").join(w)))
    rows += [(500, rows[0][1]), (None, rows[1][1]), (501, None), (502, ""), (503, "again " * 3000), (504, "within within " * 400)]
    found = suffixes.passages(make(rows, extra=True), least).collect()
    assert {(r.doc_id, r.first_word, r.n_words, r.first_doc) for r in found} == brute(rows, least)
    text = dict((i, t) for i, t in rows if i is not None)
    for r in found:
        assert text[r.doc_id][r.start : r.end].split() == text[r.doc_id].split()[r.first_word : r.first_word + r.n_words]


def test_repeated_rows_are_one_document(make):
    long = " ".join(f"w{k}" for k in range(80))
    assert suffixes.passages(make([(1, long), (1, long)])).count() == 0
    assert suffixes.passages(make([])).count() == 0
    got = suffixes.passages(make([(1, long), (2, long), (1, long)])).collect()
    assert {(r.doc_id, r.n_words, r.first_doc) for r in got} == {(1, 80, 1), (2, 80, 1)}
