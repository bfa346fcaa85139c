import itertools

import numpy as np
import pyarrow as pa
import pytest

from decant.llm import minhash


def plain(rows, width, percent):
    def items(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [items(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    best = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            best[find(i)] = min(k, best.get(find(i), k))
    return sorted(((k, len(s), best.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str), len({find(i) for i in range(len(rows))})


@pytest.fixture(scope="module")
def rows(prose):
    """Chains and stars of near copies around the threshold, exact copies, short and empty texts."""
    out, number = [], 900
    for g in range(12):
        words = prose(g, 150 + 20 * g).split()
        for c in range(9):
            w = list(words)
            for e in range(c if g % 2 else 2):
                w[(e * 31 + c * (17 if g % 3 else 5)) % len(w)] = f"edit{g}x{c}x{e}"
            out.append((number, " ".join(w)))
            number -= 1
    out += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo "), (6, "two one"), (7, "Z z z z z z z z"), (8, "z z z z z"), (None, out[0][1]), (None, None), (9, out[5][1]), (9, out[5][1]), (9, "another text under the same key as before"), (10, prose(77, 30_000))]
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_components(make, rows, width):
    got = minhash.near_duplicates(make(rows), width=width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain(rows, width, 80)[0]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_deduplicate(make, rows):
    d = make(rows)
    out = minhash.deduplicate(d)
    assert out.columns == d.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len(kept) == plain(rows, 5, 80)[1]
    assert sum(k == 9 for k, _ in kept) == 2  # that key names two groups
    assert set(kept) <= set(rows) and {(1, None), (2, ""), (3, " \n"), (None, None)} <= set(kept)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8, 1.0):
        n, errors = 3000, []
        for _ in range(30):
            common = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            own = [rng.integers(0, 2**63, n - len(common), dtype=np.uint64) for _ in range(2)]
            a, b = (np.unique(np.concatenate([common, o])) for o in own)
            true = len(common) / (2 * n - len(common))
            sig = [minhash.packed(minhash.minima(minhash.mix(x))) for x in (a, b)]
            errors.append(float(minhash.estimate(sig[0], sig[1])) - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_hot_group_returns_one_row_a_document(make, prose):
    base = prose(5, 200).split()
    many = [(i, " ".join([*base[: i % 190], f"w{i}", *base[i % 190 + 1 :]])) for i in range(1500)]
    got = minhash.near_duplicates(make(many, clash=False), width=5).collect()
    assert len(got) == 1500 and {r.component_id for r in got} == {0}


def test_empty(make):
    assert minhash.near_duplicates(make([])).collect() == []
    assert minhash.deduplicate(make([])).collect() == []


def test_one_row_of_each_group_stays(make, prose):
    """Keys that are null or stand on several rows are told apart by their texts; all others by the key alone."""
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [
        (5, a), (9, a + " tail"), (None, a),  # a group whose least key is 5
        (None, b), (None, b), (None, b + " tail"),  # a group without a key
        (7, c), (7, c), (7, prose(4, 60)), (7, "")  # one key on several texts
    ] + [(20, None), (20, None), (None, ""), (21, "...")]
    key = lambda r: (str(r[0]), str(r[1]))
    got = sorted(((r.doc_id, r.text) for r in minhash.deduplicate(make(rows)).collect()), key=key)
    nameless = [r for r in got if r[0] is None and r[1]]
    assert len(nameless) == 1 and nameless[0][1] in (b, b + " tail")
    rest = [r for r in got if r not in nameless]
    assert rest == sorted([(5, a), (7, c), (7, prose(4, 60)), (7, ""), (20, None), (20, None), (None, ""), (21, "...")], key=key)
    assert minhash.deduplicate(make(rows)).columns == make(rows).columns
    assert minhash.deduplicate(make([])).collect() == []


def test_words_of_a_batch_are_hashed_once(monkeypatch):
    texts = ["A b a", None, "", " \n ", "  x\x0bB\tÉ é\x0c", "a"]
    seen = []
    hashed = minhash.xxhash.xxh64_intdigest
    monkeypatch.setattr(minhash.xxhash, "xxh64_intdigest", lambda w: seen.append(w) or hashed(w))
    got = minhash.word_hashes(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    assert [w.tolist() for w in got] == [[hashed(w) for w in (t or "").encode().lower().split()] for t in texts]
    assert len(seen) == len(set(seen))
