"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Everything is built-in expressions. Spark gives the matches of a pattern and the pieces between them; the lengths of
both give every position. Patterns start only where a match can start, look ahead for its first characters before anything
else, and use possessive repeats, so that long runs of letters or digits cost one pass and no stack. They find the same matches as the plain patterns in their comments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters on either side of a span that are searched for context words.
NEAR = 40
#: Spans with a lower score are not reported.
LEAST = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: str  # SQL over the match ``w`` (and its digits)
    score: float
    context: str
    bonus: float
    hint: str = "true"  # SQL over the text ``t``: false only where nothing can match
    ahead: int = 0  # characters that a match takes, if it sees the span (its first group) ahead; 0 if the span is the match


_DIGITS = "regexp_replace(w, '[^0-9]', '')"
_LUHN = f"""(length({_DIGITS}) between 13 and 19 and aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + element_at(
    array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9), cast(substr(reverse({_DIGITS}), i, 1) as int) + 1 + 10 * (i % 2))) % 10 = 0)"""
_TIGHT = "replace(w, ' ', '')"
_MOD97 = f"""(length({_TIGHT}) between 15 and 34 and aggregate(split(concat(substr({_TIGHT}, 5), substr({_TIGHT}, 1, 4)), ''), 0, (s, c) ->
    case when c = '' then s when c between '0' and '9' then (s * 10 + cast(c as int)) % 97 else (s * 100 + ascii(c) - 55) % 97 end) = 1)"""

#: Characters of an IBAN by country. A match is its first four characters and sees the rest ahead, so that one which
#: fails hides none behind it.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_FIXED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items())
_IBAN = rf"(?=[A-Z]{{2}}[0-9]{{2}})(?<![A-Za-z0-9])(?=((?:{_IBAN_FIXED}|(?!{'|'.join(_IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+)(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"

#: In the order in which spans are listed. The first four are the base kinds, reported whatever stands near them.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.9, "mail|contact|write|reach", 0.1, "contains(t, '@')"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?=[0-9])(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "forall(split(w, '[.]'), x -> coalesce(try_cast(x as bigint) <= 255, false))", 0.6, "address|server|host|login|ip", 0.3),
    # [0-9]([\x20-]?[0-9])+, of which only runs of 13 digits and more are taken up
    Kind("card", r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+", _LUHN, 0.8, "card|visa|credit|debit|payment|carte|karte|tarjeta", 0.2),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15", 0.6, "phone|call|tel|fax|mobile", 0.3, "contains(t, '+')"),
    # [A-Z]{2}[0-9]{2}(\x20?[A-Z0-9])+ of the length of its country; other countries take up whatever follows, up to 34
    Kind("iban", _IBAN, _MOD97, 0.9, "iban|bank|account|konto|compte|cuenta", 0.1, ahead=4),
    Kind("ssn", r"(?=[0-9]{3}-)(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "substr(w, 1, 3) not in ('000', '666') and substr(w, 1, 1) != '9'", 0.3, "ssn|social security|tax id", 0.5),
)
BASE = tuple(k.name for k in KINDS[:4])


def _spans(k: Kind) -> str:
    """SQL over ``t``: spans of one kind in order. ``m`` holds the matches, ``p`` the pieces around them."""
    kind = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    rx = "'" + k.pattern.replace("\\", "\\\\") + "'"
    taken, behind = (str(k.ahead), f"substr(p[i + 1], length(m[i]) - {k.ahead} + 1)") if k.ahead else ("length(m[i])", "p[i + 1]")
    near = f"concat_ws(' ', right(p[i], {NEAR}), left({behind}, {NEAR}))"
    score = f"{k.score}D + if(lower({near}) rlike '{k.context}', {k.bonus}D, 0D)"
    start = "a.at + length(p[i])"
    span = f"named_struct('kind', '{k.name}', 'start', {start}, 'end', {start} + length(m[i]), 'score', {score})"
    valid = f"exists(array(m[i]), w -> {k.valid})"
    found = f"""aggregate(sequence(0, size(m) - 1), named_struct('at', 0L, 'out', cast(array() as {kind})),
        (a, i) -> named_struct('at', {start} + {taken}, 'out', if({valid}, concat(a.out, array({span})), a.out)), a -> a.out)"""
    none = f"cast(array() as {kind})"
    return f"""if({k.hint}, get(transform(array(regexp_extract_all(t, {rx}, {int(k.ahead > 0)})), m -> if(size(m) = 0, {none},
        get(transform(array(split(t, {rx}, -1)), p -> filter({found}, s -> s.score >= {LEAST}D)), 0))), 0), {none})"""


def find(docs: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """Add (or replace) ``name``: spans (kind, start, end, score) in code points, by kind as listed in ``KINDS``, then start.

    Null texts are empty and have no spans. A match that fails its check is dropped and not tried again shorter
    (an IBAN has the length of its country). Spans of different kinds may overlap. Works row by row: repeated rows get the same spans, empty input gives no
    rows, no other column is read.
    """
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(docs[text], F.lit("")).alias("t"))
    found = F.concat(*[F.expr(_spans(k)) for k in KINDS])
    return d.select("doc", found.alias(name)).select(*[f"doc.{c}" for c in docs.columns if c != name], name)


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the checksum of their spans, and all spans of each document."""
    d = find(docs.select(key, text), text, "_spans").withColumn("_base", F.filter("_spans", lambda s: s["kind"].isin(*BASE)))

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return d.select(key, *[count(k) for k in BASE], F.sha2(written(F.col("_base")).cast("binary"), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind, ``<EMAIL>``; overlapping spans take the name of the first."""
    d = find(docs.withColumn("_t", F.col(text)), "_t", "_spans")
    out = """if(size(_spans) = 0, _t, aggregate(array_sort(_spans, (x, y) -> case when x.start != y.start then cast(sign(x.start - y.start) as int) else cast(sign(y.end - x.end) as int) end),
        named_struct('at', 0L, 'out', cast(array() as array<string>)),
        (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', if(s.start < a.at, a.out,
            concat(a.out, array(substr(_t, cast(a.at + 1 as int), cast(s.start - a.at as int)), concat('<', upper(s.kind), '>'))))),
        a -> array_join(concat(a.out, array(substr(_t, cast(a.at + 1 as int)))), '')))"""
    return d.withColumn(text, F.expr(out)).select(*docs.columns)


def _duck(kind: str, rx: str, valid: str) -> str:
    at = "coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, '{kind}' AS kind, s, s + length(w) AS e FROM (
        SELECT doc_id, m[i] AS w, regexp_replace(m[i], '[^0-9]', '', 'g') AS d, ({at})::BIGINT AS s
        FROM (SELECT doc_id, regexp_extract_all(t, '{rx}') AS m, regexp_split_to_array(t, '{rx}') AS p FROM t WHERE regexp_matches(t, '{rx}')), unnest(range(1, len(m) + 1)) AS u(i)) WHERE {valid}"""


_LUHN_DUCK = """length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j:
    CASE WHEN j % 2 = 1 THEN reverse(d)[j]::INT ELSE (reverse(d)[j]::INT * 2) // 10 + (reverse(d)[j]::INT * 2) % 10 END)) % 10 = 0"""
#: The same on DuckDB, with the plain patterns. The two added kinds are left to the brute-force test; the tables have none of them.
SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_duck("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")}
  UNION ALL {_duck("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(w, '.'), lambda x: x::HUGEINT)) <= 255")}
  UNION ALL {_duck("card", r"[0-9](?:[ -]?[0-9])+", _LUHN_DUCK)}
  UNION ALL {_duck("phone", r"\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 9 AND 15")}),
g AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY list_position(['email', 'ip', 'card', 'phone'], kind), s) AS spans,
  count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone
  FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)
"""
