"""Rules are written in Python regex syntax; these helpers state the same pattern for the JVM regex engine.

Everything works on the parse tree of Python's own regex parser, so escapes, classes and groups are read as Python reads
them. Groups become plain numbered groups; names are resolved to numbers.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as sre, _parser

_CATEGORY = {sre.CATEGORY_DIGIT: r"\d", sre.CATEGORY_NOT_DIGIT: r"\D", sre.CATEGORY_SPACE: r"\s", sre.CATEGORY_NOT_SPACE: r"\S",
             sre.CATEGORY_WORD: r"\w", sre.CATEGORY_NOT_WORD: r"\W"}
_PLACE = {sre.AT_BEGINNING: "^", sre.AT_BEGINNING_STRING: r"\A", sre.AT_BOUNDARY: r"\b", sre.AT_NON_BOUNDARY: r"\B", sre.AT_END: "$", sre.AT_END_STRING: r"\z"}
_REPEAT = {sre.MAX_REPEAT: "", sre.MIN_REPEAT: "?", sre.POSSESSIVE_REPEAT: "+"}
_SINGLE = (sre.LITERAL, sre.NOT_LITERAL, sre.ANY, sre.IN, sre.SUBPATTERN)
_FLAGS = ((re.IGNORECASE, "iu"), (re.MULTILINE, "m"), (re.DOTALL, "s"))


def _symbol(code: int) -> str:
    ch = chr(code)
    return ch if ch.isalnum() or ch == "_" else f"\\x{{{code:x}}}"


def _flag_letters(flags: int) -> str:
    return "".join(letters for flag, letters in _FLAGS if flags & flag)


def _one(op, arg) -> str:
    if op is sre.LITERAL:
        return _symbol(arg)
    if op is sre.NOT_LITERAL:
        return f"[^{_symbol(arg)}]"
    if op is sre.ANY:
        return "."
    if op is sre.IN:
        negated = arg[0][0] is sre.NEGATE
        return f"[{'^' * negated}{''.join(map(_member, arg[negated:]))}]"
    if op is sre.AT:
        return _PLACE[arg]
    if op is sre.BRANCH:
        return f"(?:{'|'.join(map(_sequence, arg[1]))})"
    if op is sre.SUBPATTERN:
        group, add, drop, body = arg
        switched = _flag_letters(add) + (f"-{_flag_letters(drop)}" if _flag_letters(drop) else "")
        inner = f"(?{switched}:{_sequence(body)})" if switched else _sequence(body)
        return f"({inner})" if group is not None else f"(?:{inner})"
    if op in _REPEAT:
        least, most, body = arg
        bound = "" if most is sre.MAXREPEAT else most
        times = {(0, ""): "*", (1, ""): "+", (0, 1): "?"}.get((least, bound), f"{{{least},{bound}}}")
        inner = _sequence(body)
        return (inner if len(body) == 1 and body[0][0] in _SINGLE else f"(?:{inner})") + times + _REPEAT[op]
    if op is sre.ATOMIC_GROUP:
        return f"(?>{_sequence(arg)})"
    if op is sre.GROUPREF:
        return f"(?:\\{arg})"
    if op in (sre.ASSERT, sre.ASSERT_NOT):
        return f"(?{'<' if arg[0] < 0 else ''}{'=' if op is sre.ASSERT else '!'}{_sequence(arg[1])})"
    raise ValueError(f"{str(op).lower()} has no counterpart in the JVM's regex engine")


def _member(item) -> str:
    op, arg = item
    if op is sre.LITERAL:
        return _symbol(arg)
    if op is sre.RANGE:
        return f"{_symbol(arg[0])}-{_symbol(arg[1])}"
    return _CATEGORY[arg]


def _sequence(items) -> str:
    return "".join(_one(op, arg) for op, arg in items)


@lru_cache(maxsize=4096)
def jvm_pattern(pattern: str, ignore_case: bool = False) -> str:
    """Python pattern -> Java pattern: '.' stops at newline only, \\w \\d \\s \\b are Unicode classes."""
    tree = _parser.parse(pattern)
    flags = _flag_letters(tree.state.flags | (re.IGNORECASE if ignore_case else 0))
    body = _sequence(tree)
    classes = any(c in body for c in (r"\w", r"\W", r"\d", r"\D", r"\s", r"\S", r"\b", r"\B"))
    return f"(?d{'U' if classes else ''}{flags}){body}"


def jvm_replacement(replacement: str, pattern: str | None = None) -> str:
    """Python replacement template -> Java replacement; names are resolved with the pattern, literal signs are escaped."""
    parsed = _parser.parse_template(replacement, re.compile(pattern if pattern is not None else "()" * 99))
    out, after_group = [], False
    for part in parsed:
        if isinstance(part, int):
            out.append(f"${part}")
            after_group = True
            continue
        for i, ch in enumerate(part):
            # a digit right behind a group number would be read as part of it
            out.append("\\" + ch if ch in "$\\" or (i == 0 and after_group and ch.isdigit()) else ch)
        after_group = after_group and not part
    return "".join(out)


def _runs(items, runs: list[str]) -> None:
    """Literal runs that every match contains; the last entry is still open."""
    for op, arg in items:
        if op is sre.LITERAL:
            runs[-1] += chr(arg)
        elif op is sre.SUBPATTERN and not arg[1] & re.IGNORECASE:
            _runs(arg[3], runs)
        elif op in _REPEAT and arg[0] >= 1:
            _runs(arg[2], runs)
            if (arg[0], arg[1]) != (1, 1):
                runs.append("")
        elif op is not sre.AT:
            runs.append("")


@lru_cache(maxsize=4096)
def required_literal(pattern: str) -> str:
    """Longest literal run every match of the pattern must contain ('' when none is certain).

    Used as a byte-level `contains` test in front of the regex: it can only skip rows that cannot match.
    """
    tree = _parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        return ""
    runs = [""]
    _runs(tree, runs)
    return max(runs, key=len)
