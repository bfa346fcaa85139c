import zlib

import numpy as np
import pytest

from decant.llm import langid


@pytest.fixture(scope="module")
def rows():
    """Four invented languages with their own syllables and shared ones."""
    syllables = {"xa": "ka lo mi ne ru", "xb": "stra schi ung keit en", "xc": "ção ñe óla é que", "xd": "привет да нет мир я"}
    shared, rng, out = "a ta in", np.random.default_rng(3), []
    for i in range(600):
        lang = list(syllables)[i % 4]
        pool = syllables[lang].split() * 2 + shared.split()
        out.append((i, " ".join("".join(rng.choice(pool, rng.integers(1, 4))) for _ in range(rng.integers(6, 60))), lang if i % 11 else None))
    return out


def test_held_out_accuracy(make, rows):
    odd = [(9001, None, "xa"), (9002, "123 !?", "xb"), (9003, "", None), (None, rows[0][1], None), (5, *rows[5][1:])]
    got = langid.identify(make(rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (9001, 9002, 9003))
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [i for i, *_ in rows if by[i].held_out]
    assert len(held) > 100
    assert np.mean([by[i].lang_pred == ["xa", "xb", "xc", "xd"][i % 4] for i in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_never_learned(make, rows):
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else k) for i, t, k in rows]
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(make(rows)).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(make(swapped)).collect()}
    assert a == b


def test_scores_equal_the_kernel(make, rows):
    """The folded product is the landmark kernel times the regression."""
    g = langid.Grams()
    texts = [(k, np.sort(g.of(t))) for _, t, k in rows[:80] if k]
    m = langid.fit(texts)
    for _, t, _ in rows[80:90]:
        x = set(g.of(t).tolist())
        linear = sum(m.weights[np.searchsorted(m.codes, c)] for c in x if c in set(m.codes.tolist())) / len(x) ** 0.5 + m.bias
        seen = np.isin(m.codes, list(x)).astype(np.float32)
        assert np.allclose(linear, seen @ m.weights / len(x) ** 0.5 + m.bias, atol=1e-3)


def test_grams_are_the_distinct_ones(prose):
    g = langid.Grams()
    for t in ["", "a", "Ab  c!!", "é" * 50, prose(3, 20_000)]:
        s = []
        for c in t.lower():
            v = int(langid._TABLE[ord(c)])
            if not (v == 32 and s and s[-1] == 32):
                s.append(v)
        n = langid._SYMBOLS
        want = set(s) | {a * n + b + n for a, b in zip(s, s[1:])} | {(a * n + b) * n + c + n + n * n for a, b, c in zip(s, s[1:], s[2:])}
        got = g.of(t).tolist()
        assert len(got) == len(set(got)) and set(got) == want


def test_no_labels_and_empty(make):
    assert [r.lang_pred for r in langid.identify(make([(0, "abc", None)])).collect()] == ["und"]
    assert langid.identify(make([])).collect() == []


@pytest.mark.parametrize("languages", [200, 400])
def test_every_one_of_many_languages(make, languages):
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    pools = ["".join(rng.choice(letters, 3)) for _ in range(6 * languages)]
    rows = []
    for i in range(12 * languages):
        k = i % languages
        pool = pools[6 * k : 6 * k + 6]
        rows.append((None if i % 10 == 9 else i, " ".join("".join(rng.choice(pool, rng.integers(1, 4))) for _ in range(60)), f"l{k:03d}"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(make(rows)).collect() if r.doc_id is not None and r.held_out}
    right = [0] * languages
    seen = [0] * languages
    for i, said in got.items():
        seen[i % languages] += 1
        right[i % languages] += said == f"l{i % languages:03d}"
    assert sum(right) >= 0.95 * sum(seen)
    assert sum(right[128:]) >= 0.95 * sum(seen[128:])


def test_rows_without_a_key_are_drawn_one_by_one(make, rows):
    nameless = [(None, t, k) for _, t, k in rows]
    texts = langid.sample(make(nameless), "doc_id", "text", "lang")
    assert len({x[1].tobytes() for x in texts}) > 100


def test_least_score_counts_the_whole_held_out_fold(make, rows, monkeypatch):
    """Nothing is drawn: the score is that of all held-out labels, however few a sample may hold."""
    docs = make(rows)
    model = langid.train(docs)
    monkeypatch.setattr(langid, "sample", None)
    held = [r for r in langid.predict(docs, model, keep_docs=True).filter((langid.fold(langid.F.col("doc_id")) == 1) & langid.F.col("lang").isin(model.languages)).collect()]
    right = sorted(r.score for r in held if r.lang_pred == r.lang)
    assert len(right) >= langid.RELIABLE * len(held)
    least = langid.least_score(docs, model)
    assert right[int((1 - langid.ADMIT) * (len(right) - 1))] - 1.1 / langid.STEPS <= least <= right[int((1 - langid.ADMIT) * (len(right) - 1))]
