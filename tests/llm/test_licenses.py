import random

import pytest

from pagewright.llm import licenses
from pagewright.llm.notices import NOTICES

FILLER = "Lorem the of this license is a software in any way "


def test_finds_all_and_only_notices(make):
    rows = [(1, None), (2, ""), (3, FILLER * 3000), (None, "Released under the MIT License.")]
    expected = {(None, "MIT")}
    for k, (name, text, _) in enumerate(NOTICES.values()):
        rows.append((100 + k, FILLER * (k % 3) + text + " " + FILLER))
        rows.append((400 + k, f"/* {text.upper()} */"))
        expected |= {(100 + k, name), (400 + k, name)}
    rows.append((300, FILLER * 2000 + "All rights reserved. " + FILLER * 2000 + "Licensed under the Apache License, Version 2.0. x All rights reserved."))
    expected |= {(300, "Proprietary"), (300, "Apache-2.0")}
    rows += [(301, "Licensed under the Apache Licence"), (302, "all the rights of theirs are reserved"), (303, "the MIT group has a driving License"), (304, "Licensed under CC BY 5.0.")]
    found = licenses.scan(make(rows, extra=True)).collect()
    assert {(r.doc_id, r.license) for r in found} == expected
    assert sum(r.doc_id == 300 for r in found) == 3


def test_overlapping_versions(make):
    rows = [(1, "This work is licensed under the GNU Lesser General Public License, version 3."), (2, "Licensed under CC BY-NC-SA 4.0."), (3, "Licensed under CC BY 4.0 and BY-NC.")]
    assert {(r.doc_id, r.license) for r in licenses.scan(make(rows)).collect()} == {(1, "LGPL-3.0"), (2, "CC-BY-NC-SA-4.0"), (3, "CC-BY-4.0")}


def test_positions_and_repeats(make):
    text = "é x Released under the MIT License. y"
    found = licenses.scan(make([(1, text), (1, text)])).collect()
    assert len(found) == 2 and all(text[r.start : r.end] == "Released under the MIT License" and r.coverage == 1.0 for r in found)
    assert licenses.scan(make([])).count() == 0


def test_idf_is_of_all_files(make):
    total, files = licenses.frequencies(make([(k, "mit" if k % 2 else None) for k in range(10)]), frozenset({"mit", "gnu"}))
    assert total == 10 and files == {"mit": 5}


def test_words_outside_the_phrases_may_be_missing(make):
    rows = [(k, FILLER) for k in range(5)] + [(10, f"{FILLER} under the MIT License {FILLER}"), (11, "the MIT License."), (12, "are licensed under the GNU General Public License, version 3")]
    text = NOTICES["MIT grant"][1].replace("to any person obtaining a ", "")
    found = {(r.doc_id, r.license) for r in licenses.scan(make([*rows, (13, text)])).collect()}
    assert found == {(10, "MIT"), (11, "MIT"), (12, "GPL-3.0"), (13, "MIT")}


def test_headings_identifiers_and_whole_texts(make):
    whole = NOTICES["BSD-3-Clause text"][1]
    rows = [(1, "MIT License\n\nCopyright (c) 2020 Someone"), (2, "// SPDX-License-Identifier: Apache-2.0\nint x;"), (3, "# SPDX-License-Identifier: GPL-2.0-or-later"), (4, f"x {whole} y"), (5, whole.replace("Redistributions", "Redistributionen")), (6, "SPDX-License-Identifier: No-Such")]
    found = {(r.doc_id, r.license) for r in licenses.scan(make(rows)).collect()}
    assert found == {(1, "MIT"), (2, "Apache-2.0"), (3, "GPL-2.0-or-later"), (4, "BSD-3-Clause"), (5, "BSD")} or found == {(1, "MIT"), (2, "Apache-2.0"), (3, "GPL-2.0-or-later"), (4, "BSD-3-Clause"), (5, "BSD-3-Clause")}


def damaged(rng, text):
    words = text.split()
    for _ in range(rng.choice((0, 1, 2, len(words) // 5))):
        k = rng.randrange(len(words))
        words[k : k + rng.choice((0, 1, 1))] = rng.choice(([], ["other"], [words[rng.randrange(len(words))]]))
    return " ".join(words)


def plain_lcs(x, y, place, slack):
    best = {}
    for i in range(len(x), -1, -1):
        for j in range(len(y), -1, -1):
            at = best.get((i + 1, j), 0), best.get((i, j + 1), 0)
            best[i, j] = max(*at, best.get((i + 1, j + 1), 0) + 1 if i < len(x) and j < len(y) and x[i] == y[j] and abs(j - i - place) <= slack else 0)
    return best[0, 0]


def test_alignment_against_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        place, slack = rng.randint(-4, 10), rng.randint(0, 4)
        pairs = licenses.alignment(x, y, place, slack)
        assert all(x[i] == y[j] and abs(j - i - place) <= slack for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        assert len(pairs) == plain_lcs(x, y, place, slack)


@pytest.mark.parametrize("seed", range(3))
def test_query_against_every_place(make, seed):
    rng = random.Random(seed)
    texts = [t for _, t, _ in NOTICES.values()]
    few = {k: v for k, v in NOTICES.items() if len(v[1]) < 250 or k in ("MIT text", "Apache-2.0 header")}
    rows = []
    for k in range(40):
        parts = [" ".join(rng.choice(FILLER.split()) for _ in range(rng.randint(0, 30))), damaged(rng, rng.choice(texts)), rng.choice(("", damaged(rng, rng.choice(texts)))), FILLER]
        rng.shuffle(parts)
        rows.append((k, " ".join(parts)))
    found = sorted(tuple(r) for r in licenses.scan(make(rows), few).collect())
    vocabulary = frozenset(w for _, t, _ in few.values() for w in licenses.tokens(t))
    index = licenses.Index.build(few, dict.fromkeys(vocabulary, 1.0))
    assert found == sorted((i, *f) for i, t in rows for f in index.find(t, every=True)) and len(found) > 10
