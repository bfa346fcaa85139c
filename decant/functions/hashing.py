"""Deterministic hashes used for sampling, splitting and ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the seed every published sample was drawn with.
SEED = 20261006


def joined(*parts) -> Column:
    return F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def rank_key(*parts, seed: int = SEED) -> Column:
    """sha1 of ``seed:part:...`` as a hex sort key."""
    return F.sha1(joined(seed, *parts))


def hex_int(key: Column, digits: int = 8) -> Column:
    """Leading hex digits of a sha1 key as a bigint."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


def stable_seed(source, key, seed: int = SEED) -> Column:
    return hex_int(rank_key(source, key, seed=seed)) % F.lit(2147483648)


def uniform(*parts, seed: int = SEED) -> Column:
    """Hash-derived number in [0, 1)."""
    return hex_int(rank_key(*parts, seed=seed)) / F.lit(4294967296.0)


def rank_text(*parts: str, seed: int = SEED) -> str:
    """``rank_key`` as SQL text over SQL expressions, for use inside lambdas."""
    return f"sha1(concat_ws(':', '{seed}', {', '.join(parts)}))"


def numeric_or_crc(ident: Column) -> Column:
    """Numeric ids as they are, other ids by crc32."""
    return F.coalesce(ident.try_cast("bigint"), F.crc32(ident.cast("string")))


def int_text(*parts: str) -> str:
    """Leading 32 bits of the sort key as SQL text."""
    return f"cast(conv(substr({rank_text(*parts)}, 1, 8), 16, 10) as bigint)"


def uniform_text(*parts: str) -> str:
    return f"({int_text(*parts)} / 4294967296D)"


def pick_text(array: str, *parts: str) -> str:
    """One element of an array, chosen by hash."""
    return f"get({array}, cast({int_text(*parts)} % size({array}) as int))"


def shuffled_text(array: str, *salt: str) -> str:
    """An array of strings in hash order."""
    return f"transform(array_sort(transform({array}, e -> struct({rank_text(*salt, 'e')} as h, e as e))), s -> s.e)"


#: Rounds of the keyed permutation.
ROUNDS = 24


def permuted_text(x: str, n: str, key: str) -> str:
    """Place of ``x`` in a permutation of 0 to ``n - 1`` fixed by the text ``key``, as SQL text; arithmetic, no sort.

    Swap-or-not: every round pairs x with (k - x) mod n and swaps the pair or not, by one hash bit of the larger of both.
    Either is its own inverse, so each round, and all of them, are a permutation whatever n is.
    """
    k = f"cast(conv(substr(sha1(concat_ws(':', {key}, r)), 1, 8), 16, 10) as bigint)"
    bit = f"substr(sha1(concat_ws(':', {key}, r, greatest(x, y))), 1, 1) >= '8'"
    step = f"transform(array(pmod({k} - x, {n})), y -> if({bit}, y, x))[0]"
    return f"aggregate(sequence(0, {ROUNDS - 1}), cast({x} as bigint), (x, r) -> {step})"


def permuted_sql(x: str, n: str, key: str) -> str:
    """The same for the checking engine."""
    y = f"((('0x' || substr(sha1({key} || ':' || r), 1, 8))::BIGINT - x) % {n} + {n}) % {n}"
    bit = f"substr(sha1({key} || ':' || r || ':' || greatest(x, {y})), 1, 1) >= '8'"
    return f"list_reduce(list_prepend(({x})::BIGINT, range(0, {ROUNDS})), lambda x, r: CASE WHEN {bit} THEN {y} ELSE x END)"
