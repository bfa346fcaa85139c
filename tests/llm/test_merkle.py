import hashlib
import random
import zlib

import pytest

from decant.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """Root and the path of every leaf, straight from the definition."""
    paths, groups, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        up, over = [], []
        for at in range(0, len(level), 3):
            run = level[at : at + 3]
            for s in range(len(run)):
                for i in groups[at + s]:
                    paths[i].append((run[:s], run[s + 1 :]))
            up.append(h(*run))
            over.append(sum(groups[at : at + 3], []))
        level, groups = up, over
    return level[0], paths


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subroots, out = [], []
    for name in names:
        own = sorted(((r, leaf((r[0], r[3], r[2], r[4], r[1]))) for r in by[name]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        root, paths = tree([x for _, x in own])
        subroots.append(root)
        out.append([(r, x, root, p) for (r, x), p in zip(own, paths)])
    root, over = tree(subroots)
    rows = []
    for part, more in zip(out, over):
        for r, x, sub, path in part:
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            folded = leaf((r[0], r[3], r[2], r[4], text))
            for left, right in path + more:
                folded = h(*left, folded, *right)
            rows.append((r[0], x, sub, root, h(*[d for left, right in path + more for d in left + right]), folded, folded == root))
    return rows


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", *[f"'x' as {c}" for c in ("key", "tree", "pos", "digest", "leaf", "block", "part", "changed", "path", "subroot", "f0")])


def check(spark, rows, **how):
    got = merkle.manifest(docs(spark, rows), **how)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 81, 200])
def test_sizes(n):
    digests = [h(str(i)) for i in range(n)]
    root, paths = tree(digests)
    runs = merkle.forward(digests, True)
    assert merkle.top(digests, True) == root
    own = merkle.backward(runs, "")
    assert own == ["".join(f"{''.join(left)}:{''.join(right)};" for left, right in p) for p in paths]
    assert all(merkle.fold(d, p) == root for d, p in zip(digests, own))
    assert merkle.fold(h("x"), own[-1]) != root or n == 0


def test_odd_rows(spark):
    rows = [(1, "a\nb", "en", "s", 3), (1, "a\nb", "en", "s", 3), (1, None, None, "s", None), (None, "x\ny", "en", "s", 1), (None, "", None, None, 0), (-5, "é日\n", "日", "é", 9), (7, "\n", "de", "a", 1), (8, "x", "de", "B", 1), (9, "-", "", "", 0), (10, "k\n" * 9000, "en", "+", 4)]
    check(spark, rows)
    check(spark, rows[:1])


def test_many_blocks(spark):
    r = random.Random(5)
    hot = [(i * 3, f"t{i}\n{i}", "en", "hot", i) for i in range(600)]
    rest = [(10_000 + i, None if i % 7 == 0 else f"w{i}\n", None, f"s{r.randrange(40)}", i) for i in range(400)]
    rest += [(30_000 + i, "q", "en", f"exact{s}", 1) for s, n in (("a", 9), ("b", 10), ("c", 81), ("d", 82)) for i in range(n)]
    rows = hot + rest
    r.shuffle(rows)
    check(spark, rows, height=2)


def test_paths_and_empty(spark):
    rows = [(i, f"x{i}", "en", "s", 1) for i in range(5)]
    got = merkle.manifest(docs(spark, rows), with_path=True).collect()
    assert all(merkle.fold(r.leaf, r.path) == r.root and merkle.proof(r.path) == r.proof_sha256 for r in got)
    assert merkle.manifest(docs(spark, [])).collect() == []
