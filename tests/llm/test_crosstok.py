import bisect
import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from decant.llm import crosstok
from decant.llm.bytebpe import alphabet


class Brute:
    """Both libraries on whole texts, and every pair of tokens compared."""

    def __init__(self):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        self.back = {c: b for b, c in alphabet().items()}

    def tokens(self, text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        a = [(i, bytes(self.back[ord(c)] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        same = b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
        return (a, b) if same else ([], [])

    def groups(self, text):
        a, b = self.tokens(text)

        def ends(tokens):
            at, out = 0, []
            for i, x in tokens:
                at += len(x)
                out.append((i, at))
            return out

        ea, eb = ends(a), ends(b)
        both = sorted({e for _, e in ea} & {e for _, e in eb})
        out = [([], []) for _ in both]
        for side, ends_ in enumerate((ea, eb)):
            for i, x in ends_:
                out[bisect.bisect_left(both, x)][side].append(i)
        links = [(i, j) for i, x in ea for j, y in eb if x == y] if len(ea) * len(eb) < 1e4 else [(g[0][-1], g[1][-1]) for g in out]
        return len(a), len(b), out, links

    def corpus(self, rows):
        facts = [(k, *self.groups(t)) for k, t in rows]
        count = Counter(x for f in facts for x in f[4])
        best = Counter()
        for (_, b), n in count.items():
            best[b] = max(best[b], n)
        out = []
        for k, n_a, n_b, groups, links in facts:
            text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
            sha = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
            out.append((k, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha))
        return out


@pytest.fixture(scope="module")
def brute():
    return Brute()


@pytest.fixture(scope="module")
def own():
    return crosstok.Aligner(*crosstok.defaults(None, None, None))


LETTERS = st.one_of(st.characters(codec="utf-8"), st.sampled_from("   \n\t\r's1.aéß日Ж\x00\x1c\x85　▁<>|"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=50))
def test_groups_as_both_libraries_have_them(brute, own, text):
    n_a, n_b, groups, _ = brute.groups(text)
    got = own.texts([text])[0]
    if not n_a:
        assert got is None
    else:
        assert got[:3] == (n_a, n_b, len(groups))
        assert got[3] == ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)


def test_every_plain_character(brute, own):
    for at in range(0, 0x11000, 128):
        chars = [chr(c) for c in range(at, at + 128) if not 0xD800 <= c < 0xE000]
        for text in ("".join(f"a{c}1 {c} {c}{c}b" for c in chars if not crosstok.ODD.search(c)), " ".join(chars)):
            n_a, n_b, groups, _ = brute.groups(text)
            got = own.texts([text])[0]
            assert (got[:3] if got else (0, 0, 0)) == (n_a, n_b, len(groups)), hex(at)


ODD = ["", None, " ", "  ", "a ▁b", "<|endoftext|> x", "<s> </s>", "x\n y", "\n\n  a  b ", "½ 日本語 naïve", "\x00", "\u088f odd", "<0x41>", "é" * 40]


@pytest.mark.parametrize("heavy", [3, crosstok.HEAVY])
def test_documents(make, prose, brute, heavy):
    rows = [(i, prose(i % 25, 1 + i * 37 % 300)) for i in range(50)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(7, prose(3, 40)), (7, prose(3, 40)), (None, "a b"), (None, None), (200, prose(9, 5000))]
    got = crosstok.score(make(rows), heavy=heavy)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute.corpus(rows)))


def test_groups_as_text(make, brute):
    rows = [(1, "hello world"), (2, None)]
    got = {r.doc_id: r for r in crosstok.align(make(rows), with_groups=True).withColumnRenamed("key", "doc_id").collect()}
    text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in brute.groups("hello world")[2])
    assert got[1].groups == text and got[2].groups == "" and got[2].groups_sha256 == ""


def test_empty_table(make):
    assert crosstok.score(make([])).collect() == []


def test_without_ranks(brute, own):
    """A vocabulary whose merges are not its ids in order is encoded by its own library."""
    fast, own.fast = own.fast, None
    try:
        got = own.texts(["it's a  naïve test\n\n x"])[0]
    finally:
        own.fast = fast
    assert fast is not None and got[3] == own.texts(["it's a  naïve test\n\n x"])[0][3]
