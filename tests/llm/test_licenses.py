import random

from decant.llm import licenses


def plain(text):
    """Every place where a template's words stand without a difference."""
    spans = [m.span() for m in licenses.TOKEN.finditer(text or "")]
    words = [text[a:b].lower() for a, b in spans]
    out = set()
    for t in licenses.templates():
        for i in range(len(words) - len(t.words) + 1):
            if words[i : i + len(t.words)] == t.words:
                out.add((t.license, spans[i][0], spans[i + len(t.words) - 1][1]))
    # a notice inside a longer one is part of it
    return {x for x in out if not any(y != x and y[1] <= x[1] and x[2] <= y[2] and (y[2] - y[1]) > (x[2] - x[1]) for y in out)}


def test_exact_notices_equal_brute_force(make, prose):
    rng, rows = random.Random(4), []
    for i in range(250):
        parts = [prose(i, rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(licenses.TEMPLATES)[2], prose(rng.randint(0, 999), rng.randint(1, 60))]
        rows.append((i, rng.choice(["\n", " "]).join(parts)))
    got = {}
    for r in licenses.scan(make(rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.license, r.start, r.end))
        assert r.differences == 0 and r.saved > 0
    for i, t in rows:
        assert got.get(i, set()) == plain(t), (i, t)


def test_wording_decides(make):
    long = licenses.TEMPLATES[20][2]
    rows = [(1, "Licensed under CC BY 4.0."), (2, "licensed UNDER cc by-nc-sa 4.0"), (3, "Licensed under CC BY 3.0."), (4, long.replace("any person", "each person")), (5, long.replace("sublicense", "lend")),
            (6, "the license fee and the public domain"), (7, "This work is licensed under the GNU Lesser General Public License, version 3."), (8, None), (9, ""), (10, "All rights reserved. " * 3), (None, "All rights reserved."), (11, "x " * 50_000 + "Released under the MIT License." + " y" * 50_000)]
    got = {}
    for r in licenses.scan(make(rows + rows[:1])).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.differences))
    assert got == {1: [("CC-BY-4.0", 0)] * 2, 2: [("CC-BY-NC-SA-4.0", 0)], 4: [("MIT", 1)], 7: [("LGPL-3.0", 0)], 10: [("LicenseRef-reserved", 0)] * 3, None: [("LicenseRef-reserved", 0)], 11: [("MIT", 0)]}
    assert licenses.scan(make([])).collect() == []


def test_short_notices_among_many_anchors(make, prose):
    """Every short notice is found where the text speaks of a license every 30 words."""
    words, rows = prose(5, 2000).split(), []
    words[::30] = ["license"] * len(words[::30])
    short = [x for x in licenses.TEMPLATES if len(x[2].split()) <= 20]
    for i in range(8 * len(short)):
        at = 7 + 241 * (i % 8)
        rows.append((i, " ".join([*words[:at], short[i // 8][2], *words[at:]])))
    got = {r.doc_id: (r.license, r.start, r.end) for r in licenses.scan(make(rows)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert {got[i]} == plain(t), (i, got[i])


def test_wrapped_notices(make):
    """Lines may break and comment marks may stand between any two words."""
    rows = [(i, x[2].replace(" ", gap)) for i, x in enumerate(licenses.TEMPLATES) for gap in ("\n", "  ", "\n * ")]
    got = [(r.doc_id, r.license, r.differences) for r in licenses.scan(make(rows)).collect()]
    assert sorted(got) == [(i, licenses.TEMPLATES[i][0], 0) for i, _ in rows]


def test_whole_texts_and_tags(make, prose):
    rows = [(i, "\n".join([prose(i, 30), x[2], prose(i + 1, 30)])) for i, x in enumerate(licenses.whole())]
    tags = ["// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: GPL-2.0+.", "/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */", "# spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0\nint x"]
    got = sorted((r.doc_id, r.license, r.template, r.start, r.differences) for r in licenses.scan(make(rows + [(100 + i, t) for i, t in enumerate(tags)])).collect())
    n = len(licenses.TEMPLATES)
    assert [(i, x, k, d) for i, x, k, _, d in got[: len(rows)]] == [(i, x[0], n + i, 0) for i, x in enumerate(licenses.whole())]
    assert [(i, x, k) for i, x, k, _, _ in got[len(rows) :]] == [(100, "MIT", -1), (101, "GPL-2.0+", -1), (102, "(MIT OR Apache-2.0) AND BSD-3-Clause", -1), (103, "GPL-2.0-only WITH Classpath-exception-2.0", -1)]


def test_compression_decides_between_findings_that_overlap():
    """The longer template stands there with other words; the shorter one says what is there and saves more bytes."""
    rng = random.Random(8)
    words = ["license", *("%08x" % rng.getrandbits(32) for _ in range(39))]
    text = list(words)
    for i in (6, 12, 18, 24):
        text[i] = "%024x" % rng.getrandbits(96)
    rows = [("Long", "license", " ".join(words)), ("Near", "license", " ".join(text[:39]))]
    scanner = licenses.Scanner(rows)
    assert [(f[0], f[5]) for f in licenses.Scanner(rows[:1])(" ".join(text))] == [("Long", 4)]
    assert [(f[0], f[5]) for f in scanner(" ".join(text))] == [("Near", 0)]
