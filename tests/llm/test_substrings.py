import hashlib

from decant.llm import substrings


def plain(rows):
    first = {}
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for k, w in words:
        for i in range(len(w) - 49):
            if k is not None:
                t = tuple(w[i : i + 50])
                first[t] = min(k, first.get(t, k))
    out = []
    for k, w in words:
        cut = set()
        for i in range(len(w) - 49):
            if k is not None and first[tuple(w[i : i + 50])] < k:
                cut.update(range(i, i + 50))
        out.append((k, len(w), len(cut), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in cut)).hexdigest()))
    return sorted(out, key=str)


def check(make, rows):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.strip(make(rows)).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_against_plain(make, prose):
    passages = [prose(50 + i, 40 + i * 7) for i in range(12)]
    rows = []
    for i in range(160):
        parts = [prose(1000 + i, 20 + i % 40), passages[i % 12], prose(2000 + i, i % 30), passages[(i * 5) % 12], prose(3000 + i % 9, 60)]
        rows.append((500 - i, "\n".join(parts)))
    rows += [(1000 + i, rows[i][1]) for i in range(10)]
    rows += [(2000 + i, " ".join(w if j % 90 else "edit" for j, w in enumerate(rows[i][1].split()))) for i in range(20)]
    check(make, rows)


def test_runs_of_one_word_and_periods(make):
    rows = [(1, "of " * 60), (2, "of " * 300 + "x " + "of " * 49), (3, "a b " * 80), (4, "b a " * 200), (5, "x y z " * 40 + "of " * 55), (6, ("a b c d e f g h " * 9 + "| ") * 6), (7, ("a b c d e f g h " * 9 + "! ") * 3)]
    check(make, rows)


def test_edges(make, prose):
    t = prose(1, 50)
    check(make, [(1, t), (2, t), (2, t), (None, t), (3, None), (4, ""), (5, t + " more"), (6, t.rsplit(" ", 1)[0]), (0, t.upper()), (7, prose(4, 30_000)), (8, "é \x0b" + prose(4, 200))])
    assert substrings.strip(make([])).collect() == []
