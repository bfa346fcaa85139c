import hashlib
import random
import re

from decant.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, rx in BASE.items():
        for m in re.finditer(rx, text or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_plain_patterns(make):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "é", "@", ".", " ", "-", "+", "(", "1", "23", "456", "0", "_", "x@y.z", "4539578763621486", "10.0.0.1", "\n", "😀"]) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a@b.co_x@y.org", "1.2.3.4.5.6.7.8", "256.1.1.1 000255.1.1.1", "4539 5787 6362 1486 45395787636214861", "+1 (017) 555-7713 +++1 2", "", None, "x@" * 30]
    got = {r.doc_id: r for r in pii.report(make(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = plain(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w.startswith(k + ":") for w in want) for k in BASE]
        assert set(want) <= set(filter(None, got[i].spans.split(",")))


def test_added_kinds_and_context(make):
    got = [r.spans for r in pii.report(make([(1, "IBAN GB82 WEST 1234 5698 7654 32 ok"), (2, "iban GB82 WEST 1234 5698 7654 33"), (3, "my SSN is 123-45-6789"), (4, "part 123-45-6789 of the stock")])).orderBy("doc_id").collect()]
    assert got == ["iban:5:32", "", "ssn:10:21", ""]
    near = pii.find(make([(1, "call +1 614 555 8001"), (2, "see +1 614 555 8001")])).orderBy("doc_id").collect()
    assert near[0].spans[0].score > near[1].spans[0].score


def test_redact(make):
    d = make([(1, "é write a@b.de or +1 614 555 8001, 10.0.0.1!"), (2, None), (3, "clean"), (4, "4539578763621486@x.org z"), (3, "clean")])
    out = pii.redact(d)
    assert out.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.text is not None) == [
        (1, "é write <EMAIL> or <PHONE>, <IP>!"), (3, "clean"), (3, "clean"), (4, "<EMAIL> z")]


def test_long_runs_are_linear(make):
    n = 400_000
    rows = [(1, "a" * n), (2, "1" * n), (3, "+1" + " " * n), (4, "a@" + "b." * (n // 2) + "c"), (5, "1 " * (n // 2))]
    got = {r.doc_id: r for r in pii.report(make(rows)).collect()}
    assert [got[i].n_email for i in range(1, 6)] == [0, 0, 0, 1, 0]
    assert pii.report(make([])).collect() == []


def test_iban_ends_where_its_country_says(make):
    iban = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE89370400440532013000", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    texts = [f"{before}{x}{behind}" for x in iban for before in ("IBAN ", "account ", "é AT10 2024 ") for behind in (" BIC COBADEFFXXX", " ON 3 May", " 100 EUR", " A B C 1 2 3", ", x", "")]
    texts += ["DE89370400440532013000 GB82 WEST 1234 5698 7654 32 END", "DE89370400440532013000X", "GB82 WEST 1234 5698 7654 33 BIC"]
    got = {r.doc_id: r.spans for r in pii.report(make(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts[:-3]):
        x = next(x for x in iban if x in t)
        assert f"iban:{t.index(x)}:{t.index(x) + len(x)}" in got[i].split(","), (t, got[i])
        assert got[i].count("iban") == 1
    assert got[len(texts) - 3].endswith("iban:0:22,iban:23:50") and "iban" not in got[len(texts) - 2] + got[len(texts) - 1]
    out = pii.redact(make([(1, "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX")])).first()
    assert out.text == "IBAN <IBAN> BIC COBADEFFXXX"


def test_patterns_look_for_their_first_characters_first():
    """Without a word to look for in the whole text, a place is given up at its first characters, before any alternative is tried."""
    for k in pii.KINDS:
        assert k.hint != "true" or k.pattern.startswith("(?=["), k.name
