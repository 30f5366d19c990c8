import numpy as np
import pyarrow as pa

from pagewright.llm.columns import characters, cuts, gram_hashes, long_gram_hashes, utf8, word_hashes, words
from pagewright.llm.eliasfano import EliasFano

TEXTS = ["a b a", None, "", "  ", "naïve  café\nnaïve", "a b a c", "x" * 5000 + " a b a"]


def test_words_and_hashes():
    data, offsets = utf8(pa.array(TEXTS))
    starts, ends, first = words(data, offsets)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert found == [w for t in TEXTS if t for w in t.split()]
    assert np.diff(first).tolist() == [len(t.split()) if t else 0 for t in TEXTS]
    h = word_hashes(data, starts, ends)
    by_word = dict(zip(found, h))
    assert [by_word[w] for w in found] == h.tolist() and len(set(by_word.values())) == len(by_word)
    for f in (gram_hashes, long_gram_hashes):
        g = f(h, 3)
        grams = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
        assert len({*zip(grams, g.tolist())}) == len(set(grams)) == len(set(g.tolist()))
    assert len(gram_hashes(h[:2], 3)) == len(long_gram_hashes(h[:2], 3)) == 0
    assert characters(data)[-1] == sum(len(t or "") for t in TEXTS)


def test_cuts_cover_all_rows():
    column = pa.array(TEXTS * 7)
    for size in (1, 10, 6000, 1 << 30):
        parts = list(cuts(column, size))
        assert [r for a, n in parts for r in range(a, a + n)] == list(range(len(column)))
    assert list(cuts(pa.array([], pa.string()))) == []


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (1, 100), (1000, 1 << 20), (5000, 1 << 60), (1000, 1000), (300, 10**8), (700, 3)):
        values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
        e = EliasFano.build(values, universe)
        assert (e.values() == values).all()
        if len(values) > 1:
            a, b = e.pair(np.arange(len(values) - 1))
            assert (a == values[:-1]).all() and (b == values[1:]).all()
        assert (e.get(np.arange(n)) == values).all()
        x = np.concatenate([values, rng.integers(0, universe, 500).astype(np.uint64)])
        at = np.searchsorted(values, x)
        expected = [int(i) if i < n and values[i] == v else -1 for i, v in zip(at, x)]
        assert e.find(x).tolist() == expected
