import random

import numpy as np
import pytest

from pagewright.llm import pii


@pytest.fixture(scope="module")
def model():
    return pii.default_model()


def test_gradients_by_differences():
    r = random.Random(1)
    m = pii.Tagger.start(3)
    for k in pii.Tagger.NAMES:
        setattr(m, k, getattr(m, k).astype(np.float64))
    ids, gold = np.zeros((12, 3), np.int64), np.zeros((12, 3), np.int64)
    for b in range(3):
        text, labels = pii.labelled_text(r, 12)
        ids[:, b], gold[:, b] = pii.encode(text), 0
    gold[3:6, 0] = 2
    _, grads = m.gradients(ids, gold)
    for name in pii.Tagger.NAMES:
        w = getattr(m, name)
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        old = w[at]
        values = []
        for step in (1e-2, -1e-2):
            w[at] = old + step
            values.append(m.gradients(ids, gold)[0])
        w[at] = old
        assert grads[name][at] == pytest.approx((values[0] - values[1]) / 2e-2, rel=0.05, abs=2e-4)


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    m = pii.Tagger.start(1)
    m.transitions = rng.normal(0, 1, (pii.K, pii.K)).astype(np.float32)
    e = rng.normal(0, 2, (4, pii.K, 3)).astype(np.float32)
    m.emissions = lambda ids: e.copy()
    best = m.decode(np.zeros((4, 3), np.int64))
    score = lambda p, b: sum(e[t, p[t], b] for t in range(4)) + sum(m.transitions[p[t], p[t + 1]] for t in range(3))
    allowed = lambda p: all(a == b or a == 0 or b == 0 for a, b in zip(p, p[1:]))
    for b in range(3):
        top = max((p for p in itertools.product(range(pii.K), repeat=4) if allowed(p)), key=lambda p: score(p, b))
        assert score(best[:, b], b) == pytest.approx(score(top, b), abs=1e-4)


def test_held_out_accuracy(model):
    r = random.Random(99)
    right = found = gold_n = 0
    for _ in range(150):
        text, labels = pii.labelled_text(r, 700)
        cut = np.r_[0, np.flatnonzero(np.diff(labels)) + 1, len(labels)]
        gold = {(int(a), int(b), pii.KINDS[labels[a]]) for a, b in zip(cut, cut[1:]) if labels[a] and 70 < a and b < 630}
        gold = {g for g in gold if pii.accepted(g[2], text[g[0] : g[1]])}
        got = {s for s in pii.spans(model, [text])[0] if 70 < s[0] and s[1] < 630}
        right, found, gold_n = right + len(gold & got), found + len(got), gold_n + len(gold)
    assert right / gold_n > 0.97 and right / found > 0.97


def test_long_texts_and_window_edges(model):
    r = random.Random(4)
    filler = " ".join(pii.word(r) for _ in range(9000))
    places = [400, 440, 470, 500, 511, 512, 900, 20000, len(filler) - 1]
    text, at = filler, []
    for p in sorted(places, reverse=True):
        text = text[:p] + " someone.77@mail3.example.com " + text[p:]
    found = pii.spans(model, [text])[0]
    assert sum(text[a:b].endswith("77@mail3.example.com") for a, b, _ in found) >= len(places) - 1
    assert at == []


def test_redact_cases(spark, make, model):
    rows = [(1, None), (2, ""), (3, "write to ann.lee@mail.example.org or +1 (312) 555-0199 please"), (3, "write to ann.lee@mail.example.org or +1 (312) 555-0199 please"), (None, "the order 1234567890123456 came at 12:30 on 2021-03-04"), (4, "plain words only " * 200)]
    out = pii.redact(make(rows, extra=True), model)
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert len(got) == 5 and out.count() == 6
    assert got[1, None].pii_spans is None and got[2, ""].pii_spans == []
    three = next(r for k, r in got.items() if k[0] == 3)
    assert three.text == "write to [EMAIL] or [PHONE] please" and [s.kind for s in three.pii_spans] == ["EMAIL", "PHONE"]
    assert got[None, rows[4][1]].pii_spans == [] and got[4, rows[5][1]].pii_spans == []
    assert pii.redact(make([]), model).count() == 0
    plain = pii.anonymise(make(rows), model)
    assert plain.columns == make(rows).columns
    assert {r.n_chars for r in plain.where("doc_id = 3").collect()} == {len("write to [EMAIL] or [PHONE] please")}


def test_verification():
    assert pii.accepted("CARD", "4111 1111 1111 1111") and not pii.accepted("CARD", "4111111111111112") and not pii.accepted("CARD", "0000000000000000")
    assert pii.accepted("IP", "10.0.0.255") and not pii.accepted("IP", "10.0.0.256") and not pii.accepted("IP", "1.2.3")
    assert pii.reconcile("a x@y.org b", [(2, 5, 1), (4, 9, 1)]) == [(2, 9, "EMAIL")]


def slow_best(m, ids):
    """Viterbi over one window, state by state, without the search's bounds."""
    e = m.emissions(np.array(ids)[:, None])[:, :, 0].astype(np.float64)
    move = (m.transitions + pii._ALLOWED).astype(np.float64)
    score, back = e[0], []
    for row in e[1:]:
        all_ = score[:, None] + move
        back.append(all_.argmax(axis=0))
        score = all_.max(axis=0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def slow_spans(m, text):
    """Each window on its own; of its spans those whose middle is nearer to its middle than to that of any other window that holds it."""
    stride = pii.WINDOW - pii.OVERLAP
    windows = [(s, min(s + pii.WINDOW, len(text))) for s in range(0, max(1, len(text) - pii.OVERLAP), stride)]
    found = []
    for k, (s, z) in enumerate(windows):
        path = slow_best(m, pii.encode(text[s:z]).astype(int)) + [0]
        a = 0
        for i in range(1, len(path)):
            if path[i] != path[a]:
                middle = s + (a + i) / 2
                low = s if k == 0 else s + pii.OVERLAP / 2
                high = z if k == len(windows) - 1 else s + pii.WINDOW - pii.OVERLAP / 2
                if path[a] and low <= middle < high + (k == len(windows) - 1):
                    found.append((s + a, s + i, path[a]))
                a = i
    return pii.reconcile(text, found)


def test_windows_against_brute_force(model):
    r = random.Random(21)
    texts = [pii.labelled_text(r, n)[0] for n in (1, 40, 511, 512, 513, 575, 576, 900, 961, 2500)] + ["123-45-6789", "+1 (312) 555-0199", ""]
    assert pii.spans(model, texts) == [slow_spans(model, t) if t else [] for t in texts]


def test_the_bound_leaves_out_no_window():
    rng = np.random.default_rng(5)
    for seed in range(60):
        m = pii.Tagger.start(seed)
        m.transitions = rng.normal(0, 1, (pii.K, pii.K)).astype(np.float32)
        e = rng.normal(-1, 1, (5, pii.K, 40)).astype(np.float32)
        m.emissions = lambda ids, e=e: e[:, :, : ids.shape[1]].copy()
        best = m.decode(np.zeros((5, 40), np.int64))
        for b in range(40):
            m.emissions = lambda ids, e=e, b=b: e[:, :, b : b + 1].copy()
            assert best[:, b].tolist() == slow_best(m, [0] * 5)


def test_forms_that_must_be_found(model):
    for text, span in (("my ssn is 123-45-6789", (10, 21, "ID")), ("call 0049 30 1234567", (5, 20, "PHONE")), ("from 10.0.0.1 to here", (5, 13, "IP"))):
        assert pii.spans(model, [text]) == [[span]]


def test_odd_column_names(make, model):
    rows = [(1, "write to ann.lee@mail.example.org please")]
    df = make(rows).selectExpr("*", "1 as `a.b`", "2 as `c``d`", "'x' as `PII_Spans`", "'y' as c0")
    out = pii.redact(df, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "c`d", "c0", "pii_spans"] and out.first().text == "write to [EMAIL] please"
    plain = pii.anonymise(df, model)
    assert plain.columns == df.columns and tuple(plain.first()) == (1, "write to [EMAIL] please", "en", "s", 23, 1, 2, "x", "y")
