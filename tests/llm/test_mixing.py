import hashlib
import math
import re

import pytest

from decant.llm import mixing


def plain(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    names = sorted({r[3] for r in rows if r[3] is not None}) + ([None] if any(r[3] is None for r in rows) else [])
    own = {s: sum(z for z, r in zip(size, rows) if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left = {}, 1.5 * sum(own.values())
    free = set(names)
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        full = {s for s in free if 2 * own[s] <= level * weight[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * own[s]
            left -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    out = []
    for z, r in zip(size, rows):
        rate = target[r[3]] / own[r[3]] if own[r[3]] else 0
        name = str(r[0]) if r[0] is not None else "t" + hashlib.md5((r[1] or "").encode()).hexdigest()
        u = int(hashlib.md5(f"6:{name}".encode()).hexdigest()[:13], 16) / 16**13
        out.append((r[0], z, own[r[3]], target[r[3]], z * (math.floor(rate) + (u < rate - math.floor(rate)))))
    return out


def test_against_plain(make, prose):
    rows = [(i, prose(i, 1 + i * 7 % 60), None, ["a", "B", "é", None, "hot", "hot", "hot", "zero"][i % 8]) for i in range(400)]
    rows = [(i, None if s == "zero" else t, x, s) for i, t, x, s in rows] + [(None, "one two", None, "a"), (None, None, None, None), (3, "", None, "B"), (5, rows[5][1], None, "hot")]
    got = [tuple(r) for r in mixing.mix(make(rows)).drop("copies").collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    for a, b in zip(sorted(got, key=key), sorted(plain(rows), key=key), strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and a[3] == pytest.approx(b[3])
    total = {}
    for _, size, own, target, taken in got:
        assert taken <= 2 * size
        t = total.setdefault((own, target), [0, 0])
        t[0] += taken
    assert all(abs(t[0] - target) <= 0.25 * target + 100 for (own, target), t in total.items())


def test_repeat_keeps_columns_and_counts(make, prose):
    d = make([(i, prose(i, 30), "en", f"s{i % 4}") for i in range(80)])
    taken = {r.doc_id: r.copies for r in mixing.mix(d).collect()}
    out = mixing.repeat(d)
    assert out.columns == d.columns
    seen = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert seen == {k: n for k, n in taken.items() if n}


def test_empty_and_wordless(make):
    assert mixing.mix(make([])).collect() == []
    got = mixing.mix(make([(1, None, None, None), (2, " \n", None, "a")])).collect()
    assert all(r.size == r.taken == 0 and r.target == 0.0 for r in got)
