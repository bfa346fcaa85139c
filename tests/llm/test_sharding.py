import zlib
from collections import Counter

import pytest

from decant.llm import sharding


def test_growth_slots_and_sizes(make):
    rows = [(i, f"text {i} é") for i in range(3000)] + [(None, None), (None, "a"), (7, "other"), (7, "other"), (8, "")]
    got = sharding.shard(make(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.shard < 40 and r.law == "key"
        assert r.grown_shard in (r.shard, 40)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert min(map(len, by.values())) > 40 and max(map(len, by.values())) < 120
    assert 40 < sum(r.grown_shard == 40 for r in got) < 120
    text = {r[0]: r[1] for r in rows[:3000] if r[0] not in (7, 8)}
    for r in got:
        if r.doc_id in text:
            raw = text[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert sorted((r.size, r.text_crc32) for r in got if r.doc_id is None) == sorted([(16, 0), (17, zlib.crc32(b"a"))])
    again = {(r.doc_id, r.text_crc32): r.shard for r in sharding.shard(make(rows[::-1]).repartition(7)).collect()}
    assert all(again[r.doc_id, r.text_crc32] == r.shard for r in got)


def test_weights_move_rows_only_towards_what_grew(make):
    d = make([(i, "t") for i in range(4000)])
    one = {r.doc_id: r.shard for r in sharding.shard(d, shards=16).collect()}
    two = {r.doc_id: r.shard for r in sharding.shard(d, shards=16, weights={5: 3.0}).collect()}
    moved = [(one[k], two[k]) for k in one if one[k] != two[k]]
    # region 0 holds shards 0-7, rack 1 holds 4-7: rows enter that region and rack, and elsewhere nothing moves
    assert moved and all(b < 8 for _, b in moved)
    assert all(4 <= b < 8 for a, b in moved if a < 8) and all(b == 5 for a, b in moved if 4 <= a < 8)
    share = Counter(two.values())
    assert share[5] > 2 * share[9]
    assert not any(s == 3 for s in (r.shard for r in sharding.shard(d, shards=16, weights={3: 0.0}).collect()))
    with pytest.raises(ValueError):
        sharding.tree(8, 3, 8)


def test_empty(make):
    assert sharding.shard(make([])).collect() == []


def test_descent_by_plain_loops(spark, make):
    """Every draw once more, with the same hash from another library."""
    import math
    import struct

    import xxhash

    def h(key, depth, node):
        seed = 42
        if key is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", key), seed)
        return xxhash.xxh64_intdigest(struct.pack("<i", node), xxhash.xxh64_intdigest(struct.pack("<i", depth), seed))

    def walk(key, levels):
        at = 0
        for depth, nodes in enumerate(levels):
            at = min((-math.log(((h(key, depth, n) >> 12) + 0.5) / 2**52) / w, n) for up, n, w in nodes if up == at)[1]
        return at

    weights = {3: 4.0, 7: 0.0, 20: 0.5}
    keys = [None, 0, -1, 2**63 - 1, *range(1, 400, 3)]
    now = sharding.tree(40, weights=weights)
    more = [[*a, *b] for a, b in zip(now, sharding._one_more(40, 4, 8))]
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(make([(k, "x") for k in keys]), weights=weights).collect()}
    assert got == {k: (walk(k, now), walk(k, more)) for k in keys}
