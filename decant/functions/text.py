"""Text clean-up as SQL text over a SQL expression; parameters cover scripts and terminators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from decant.functions.dist import let

# Patterns that define the cleaned text.
BLANKS = r"[ \\t\\u3000]{2,}|[\\t\\u3000]"  # runs of blanks and lone odd blanks; a lone space needs no work
EMPTY_BRACKETS = r"[（(][\\s、,，・;；:：]*[）)]"
KANA = r"[\\u3040-\\u30ff]"
JAPANESE = r"[\\u3040-\\u30ff\\u3400-\\u9fff]"
SENTENCE_END = r"[。.!?！？\\n]"
CANNOT = r"unable|cannot|can't|can not|apolog|sorry|not able|don't have"
TOOL_OPEN, TOOL_CLOSE = "<TOOLCALL>", "</TOOLCALL>"
ELLIPSIS = "…"


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "\\'") + "'"


def once(x: str, body: Callable[[str], str]) -> str:
    """Use ``x`` several times but evaluate it once; a plain column needs no binding."""
    return body(x) if x.isidentifier() else let(x, body)


def strip(x: str) -> str:
    return rf"btrim({x}, ' \t\n\r\u000B\u000C')"


def squeeze(x: str) -> str:
    """Runs of blanks and odd blanks as one space; a plain search tells most texts, which have none, from the rest."""
    some = lambda v: rf"contains({v}, '  ') or contains({v}, '\t') or contains({v}, '\u3000')"
    return once(x, lambda v: f"if({some(v)}, regexp_replace({v}, '{BLANKS}', ' '), {v})")


def newlines(x: str) -> str:
    return rf"replace(replace({x}, '\r\n', '\n'), '\r', '\n')"


def sanitize(x: str) -> str:
    """Break chat-template markers, normalise newlines, squeeze blanks, trim."""
    return strip(squeeze(newlines(f"replace(replace({x}, '<|', '< |'), '|>', '| >')")))


def one_line(x: str) -> str:
    """Whitespace runs become one space."""
    return rf"trim(regexp_replace({x}, '\\s+', ' '))"


def clip(x: str, n: int, tail: int = 0) -> str:
    """At most ``n`` characters: head and an ellipsis, plus the last ``tail`` characters when asked."""
    end = lambda v: f", right({v}, {tail})" if tail > 0 else ""
    return once(x, lambda v: f"if(length({v}) <= {n}, {v}, concat(left({v}, {n - tail - 1}), '{ELLIPSIS}'{end(v)}))")


def language(x: str, rules: Sequence[tuple[str, str]] = ((KANA, "ja"),), default: str = "en") -> str:
    """First rule whose character class occurs anywhere in the text."""
    arms = lambda v: " ".join(f"when {v} rlike '{p}' then '{lang}'" for p, lang in rules)
    return once(x, lambda v: f"case {arms(v)} else '{default}' end")


def paragraphs(x: str, terminator: str = "。", script: str = JAPANESE, min_share: float = 0.3, short: int = 40) -> str:
    """Cleaned body lines: no empty brackets, no headings, no lines mostly in another script."""
    lines = rf"transform(split(replace({x}, '\r', '\n'), '\n'), l -> " + strip(squeeze(f"regexp_replace(l, '{EMPTY_BRACKETS}', '')")) + ")"
    in_script = f"length(regexp_replace(s, '[^{script[1:-1]}]+', ''))"
    keep = f"s <> '' and (contains(s, {q(terminator)}) or length(s) >= {short}) and {in_script} >= {min_share} * length(s)"
    return f"filter({lines}, s -> {keep})"


def cut_at_newline(x: str, limit: int) -> str:
    """At most ``limit`` characters, cut at the last newline before the limit when there is one."""
    head = f"left({x}, {limit})"
    cut = let(rf"{limit} - instr(reverse({head}), '\n')", lambda p: f"if({p} > 0 and {p} < {limit}, left({x}, {p}), {head})")
    return f"if(length({x}) <= {limit}, {x}, {cut})"


def sentences(x: str) -> str:
    parts = rf"transform(split({x}, '(?<={SENTENCE_END})\\s*'), s -> {strip('s')})"
    return f"filter({parts}, s -> s <> '')"


def tool_line(x: str, desc_max: int = 110, shown: int = 6, raw_max: int = 160) -> str:
    """One-line summary of a JSON tool description; text that does not parse is clipped instead."""
    names = f"coalesce(json_object_keys(get_json_object({x}, '$.parameters.properties')), cast(array() as array<string>))"
    req = (f"coalesce(from_json(get_json_object({x}, '$.parameters.required'), 'array<string>'), "
           f"from_json(get_json_object({x}, '$.required'), 'array<string>'), cast(array() as array<string>))")
    shown_names = let(req, lambda r: f"array_join(transform(slice({names}, 1, {shown}), p -> if(array_contains({r}, p), concat(p, '*'), p)), ', ')")
    more = f"if(size({names}) > {shown}, '{ELLIPSIS}', '')"
    desc = let(one_line(f"coalesce(get_json_object({x}, '$.description'), '')"), lambda d: clip(d, desc_max))
    ok = f"concat('- ', coalesce(get_json_object({x}, '$.name'), '?'), '(', {shown_names}, {more}, '): ', {desc})"
    bad = f"concat('- ', {let(one_line(x), lambda t: clip(t, raw_max))})"
    return f"if(get_json_object({x}, '$') is not null and startswith(ltrim({x}), '{{'), {ok}, {bad})"


def tool_context(tools: str, request: str, block_max: int = 550, request_max: int = 400) -> str:
    block = let(rf"array_join(transform({tools}, t -> {tool_line('t')}), '\n')", lambda b: clip(b, block_max))
    ask = let(one_line(request), lambda r: clip(r, request_max))
    return sanitize(rf"concat('Available tools:\n', {block}, '\nUser request: ', {ask})")


def toolcall(x: str) -> str:
    """Any spelling of a tool call in the one ``<TOOLCALL>[...]</TOOLCALL>`` form."""
    t = strip(x)
    arms = (f"case when startswith(t, '{TOOL_OPEN}') then t when startswith(t, '[') and get_json_object(t, '$') is not null "
            f"then concat('{TOOL_OPEN}', t, '{TOOL_CLOSE}') else concat('{TOOL_OPEN}[', t, ']{TOOL_CLOSE}') end")
    return f"element_at(transform(array({t}), t -> {arms}), 1)"


def response_type(x: str) -> str:
    return (f"case when startswith(ltrim({x}), '{TOOL_OPEN}') then 'tool_call' when left({x}, 240) rlike {q('(?i)' + CANNOT)} "
            f"then 'cannot_answer' when contains({x}, '?') then 'request_for_info' else 'direct' end")
