import math
import re
from collections import Counter

from decant.llm import rules

W = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    w = W.findall(text or "")
    k = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if k[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts(make, prose):
    texts = [None, "", " \n\t", "a", "é😀 b\x0bc", "x y z\nx y z\n\n  \nx y z", "# * $ % & | < >", "a b " * 500, "one two three four five six " * 2, "Of " * 37, prose(1, 3000) + "\n" + prose(1, 40) + " # x"]
    texts += [prose(i % 3, 5 + i * 13 % 90) + "\n" + prose(i, 7) + "\n" + prose(i % 2, 12) for i in range(60)]
    got = {r.doc_id: r for r in rules.judge(make([(i, t, "en") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(t), t
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_divergence_keeps_prose_and_drops_noise(make, prose):
    rows = [(i, prose(i, 120), ["en", "fr", None, "rare"][min(i % 40, 3) if i % 40 else 3]) for i in range(400)]
    noise = [(1000, " ".join(f"{w}$$$%%%" for w in prose(3, 100).split()), "en"), (1001, " ".join(str(k * 7919) for k in range(100)), "fr"), (1002, "ok $$$", "en")]
    got = {r.doc_id: r for r in rules.judge(make(rows + noise + rows[:3])).collect()}
    assert all(got[i].kept for i, *_ in rows if not got[i].base_failed)
    assert not got[1000].kept and not got[1001].kept
    assert got[1002].chars_js is None and got[1002].words_js is None


def test_distance(spark):
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.75, 0.25], [0.25, 0.75])], "p array<double>, q array<double>")
    got = [r[0] for r in d.select(rules.distance("p", "q")).collect()]
    half = 0.75 * math.log2(0.75 / 0.5) + 0.25 * math.log2(0.25 / 0.5)
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, [1.0, 0.0, math.sqrt(half)], strict=True))


def test_empty(make):
    assert rules.judge(make([])).collect() == []


def test_every_language_has_its_own_reference(make, prose):
    """A small language without spaces is held against itself, and its verdicts do not change when others grow."""
    page = lambda i: "。 ".join("".join(chr(0x4E00 + (i * 131 + j * 17 + k * 7) % 3000) for k in range(12)) for j in range(60))
    small = [(i, page(i), "zh") for i in range(8)] + [(20, page(20), "yy"), (21, page(21), None)]
    big = [(100 + i, prose(i, 400), ["en", None][i % 2]) for i in range(200)]
    got = {r.doc_id: r for r in rules.judge(make(small + big)).collect()}
    assert all(got[i].kept and got[i].chars_js is not None for i, *_ in small)
    alone = {r.doc_id: r for r in rules.judge(make(small)).collect()}
    assert all(alone[i] == got[i] for i in range(8))


def test_texts_without_common_words_fail(make, prose):
    """Also where the common words are long."""
    long = lambda t: " ".join(w * 5 if len(w) == 2 else w for w in t.split())
    salad = " ".join("".join("aeiou"[(k >> s) % 5] + "vwxz"[(k >> s) % 4] for s in (0, 2, 4, 6)) + str(k % 3) * (k % 40 == 0) for k in range(0, 2400, 7))
    rows = [(i, prose(i, 200), "en") for i in range(100)] + [(100 + i, long(prose(i, 200)), "ag") for i in range(100)]
    got = {r.doc_id: r for r in rules.judge(make(rows + [(1000, salad, "en"), (1001, salad, "ag")])).collect()}
    assert all(got[i].kept for i, *_ in rows if not got[i].base_failed)
    for i in (1000, 1001):
        assert got[i].chars_js < rules.FAR_CHARS and got[i].words_js < rules.FAR_WORDS and not got[i].base_failed and not got[i].kept


def verdicts(rows):
    """All of it once more in plain loops: histograms, common words, references, distances, guards."""
    import unicodedata

    def classes(text):
        c = Counter()
        for ch in text:
            kind = unicodedata.category(ch)
            if ch in " \t\n\x0b\x0c\r":
                c["space"] += 1
            elif kind in ("Ll", "Lu"):
                c["lower" if kind == "Ll" else "upper"] += 1
            elif ch in "0123456789":
                c["digit"] += 1
            elif ch in "#*$%&|<>":
                c["symbol"] += 1
            else:
                c["other"] += 1
        return [c[k] for k in rules.CLASSES]

    def js(p, q):
        d = 0.0
        for x, y in zip(p, q):
            d += (x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0)
        return math.sqrt(max(d / 2, 0))

    share = lambda v, n: [x / max(n, 1) for x in v]
    free = lambda p: [p[2], p[4], p[0] + p[1] + p[3] + p[5]]
    common, chars, words = {}, Counter(), {}
    for lang in {r[2] for r in rows if r[2]}:
        n = Counter(w for r in rows if r[2] == lang for w in W.findall(r[1] or ""))
        common[lang] = sorted(n, key=lambda w: (-n[w], w.encode()))[: rules.COMMON]
    def histogram(lang, ws):
        c = Counter(ws)
        own = [c[w] for w in common.get(lang, [])]
        return own + [0] * (rules.COMMON - len(own)) + [len(ws) - sum(own)]
    facts = [(r[0], r[2], classes(r[1] or ""), W.findall(r[1] or ""), plain(r[1])) for r in rows]
    total = lambda vs: [sum(v) for v in zip(*vs)]
    everything = total([f[2] for f in facts])
    out = {}
    for key, lang, cs, ws, base in facts:
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        ref = total([f[2] for f in facts if f[1] == lang]) if lang else None
        chars_js = words_js = None
        if sum(cs) >= rules.LEAST_CHARS:
            if ref and sum(ref) >= rules.ENOUGH * rules.LEAST_CHARS:
                chars_js = js(share(cs, sum(cs)), share(ref, sum(ref)))
            elif sum(everything) >= rules.ENOUGH * rules.LEAST_CHARS:
                chars_js = js(free(share(cs, sum(cs))), free(share(everything, sum(everything))))
        few = False
        if lang:
            ref = total([histogram(lang, f[3]) for f in facts if f[1] == lang])
            if sum(ref) >= rules.ENOUGH * rules.LEAST_WORDS:
                own = histogram(lang, ws)
                if len(ws) >= rules.LEAST_WORDS:
                    words_js = js(share(own, len(ws)), share(ref, sum(ref)))
                expected = len(ws) * (1 - ref[-1] / sum(ref))
                few = expected >= rules.EXPECTED and len(ws) - own[-1] < rules.FEW * expected
        far = (chars_js or 0) > rules.FAR_CHARS or (words_js or 0) > rules.FAR_WORDS or few
        out[key] = (failed, not failed and not far, chars_js, words_js)
    return out


def test_verdicts_by_plain_loops(make, prose):
    salad = " ".join("".join("aeiou"[(k >> s) % 5] + "vwxz"[(k >> s) % 4] for s in (0, 2, 4, 6)) for k in range(0, 2400, 7))
    rows = [(i, prose(i % 70, 8 + i * 13 % 200), ["en", "fr", None, ""][i % 4 if i % 9 else 3]) for i in range(240)]
    rows += [(1000, salad, "en"), (1001, "1 2 3 " * 200, "fr"), (1002, None, "en"), (1003, "", None), (1004, "Aa $# é1 " * 60, "zz"), (1005, prose(3, 300).upper(), "en"), (1006, " ".join(f"{w}$$$%%%" for w in prose(5, 100).split()), "en")]
    want = verdicts(rows)
    for r in rules.judge(make(rows)).collect():
        failed, kept, chars_js, words_js = want[r.doc_id]
        assert (r.base_failed, r.kept) == (failed, kept), r
        for got, x in ((r.chars_js, chars_js), (r.words_js, words_js)):
            assert (got is None) == (x is None) and (x is None or math.isclose(got, x, abs_tol=1e-9)), r
    assert not want[1000][1] and not want[1006][1] and any(v[1] for v in want.values())
