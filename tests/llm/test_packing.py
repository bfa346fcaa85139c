import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from decant.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_uses_everything_and_fits(h):
    used = {}
    patterns = packing.plan(h, 40)
    for parts, n in patterns:
        assert sum(parts) <= 40 and n > 0
        for p in parts:
            used[p] = used.get(p, 0) + n
    assert used == h
    bins = sum(n for _, n in patterns)
    assert bins >= -(-sum(k * v for k, v in h.items()) // 40)


def test_plan_takes_exact_singles_pairs_and_triples():
    assert packing.plan({30: 2, 10: 2}, 40) == [((30, 10), 2)]
    assert packing.plan({25: 3, 9: 3, 6: 3}, 40) == [((25, 9, 6), 3)]
    assert sum(n for p, n in packing.plan({22: 5, 12: 5, 4: 5, 2: 5}, 40) if sum(p) == 40) == 5


def test_round_trip(make, prose):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_path())
    odd = ["½ × naïve ÀÉß œuvre 'q' a--b 12.5% 日本 語　x", " Σας <|startoftext|>x it's é", "a\tb\r\n\x0b c <|endoftext|>"]
    rows = [(i, prose(i, 1 + i * 37 % 400)) for i in range(60)] + [(100, None), (101, ""), (102, prose(9, 6000)), (5, prose(5, 186)), (None, "a b")] + [(200 + i, t) for i, t in enumerate(odd)]
    packed = packing.pack(make(rows), capacity=512, with_ids=True)
    got = packed.collect()
    text = {}
    for r in rows:
        text.setdefault(r[0], []).append(np.append(whole.encode(r[1] or "", add_special_tokens=False).ids, 0).astype("<u4"))
    where = {}
    for r in got:
        where.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = np.frombuffer(r.ids, dtype="<u2").astype("<u4")
        assert len(ids) == r.length <= 512 and zlib.crc32(ids.tobytes()) == r.ids_crc32
        assert any((t[r.start : r.start + r.length] == ids).all() for t in text[r.doc_id] if len(t) >= r.start + r.length)
    for parts in where.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(r.length for r in got) == sum(len(x) for t in text.values() for x in t)
    assert len(where) <= -(-sum(r.length for r in got) // 512) + 2
    s = packing.sequences(packed).collect()
    assert len(s) == len(where) and all(len(x.ids) == 2 * x.n_tokens for x in s)
    assert packing.pack(make([])).collect() == []
