import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASH = ["key", "cls", "n", "t", "w", "g", "h", "r", "u", "k", "doc", "size", "spans", "words", "bands", "shard", "_b", "_key", "_t", "rank", "length", "offset", "copies", "target", "component", "common"]


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, clash=True):
        full = [(*r, *[None] * (4 - len(r)), None) for r in rows]
        d = spark.createDataFrame(full, SCHEMA)
        return d.selectExpr("*", *[f"'x' as {c}" for c in CLASH]) if clash else d
    return build


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented prose: words of a small vocabulary, by seed and length."""
    def text(seed, n):
        x, out = seed * 7919 + 17, []
        for _ in range(n):
            x = (x * 1103515245 + 12345) % (1 << 31)
            out.append("".join("bcdfglmnprst"[(x >> s) % 12] + "aeiou"[(x >> (s + 3)) % 5] for s in (5, 11, 17)[: 1 + x % 3]))
        return " ".join(out)
    return text
