"""Cutting source text into tokens, with comments taken out by the rules of the file's extension."""

from __future__ import annotations

import re

#: Comment styles by extension: '#' to the end of the line, or // and /* */ (fixed values).
HASH = frozenset("py pyi sh bash yml yaml ini cfg toml rb r pl conf mk".split())
SLASH = frozenset("js jsx mjs cjs ts tsx java go c h cc cpp cxx hpp cs kt swift scala rs php css scss".split())

_STRING = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_STRIP = {
    "#": re.compile(rf"({_STRING})|(?<![^\s;(,])#[^\n]*"),
    "/": re.compile(rf"({_STRING}|`(?:[^`\\]|\\.)*`)|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S),
}
_WORD = r"[A-Za-z_][\w$]*|\d[\w.]*|[^\W\d][\w$]*"
TOKEN = re.compile(rf"{_WORD}|{_STRING}|[^\s\w]")


def extension(path: str | None) -> str:
    name = (path or "").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def without_comments(code: str, ext: str) -> str:
    style = "#" if ext in HASH else "/" if ext in SLASH else ""
    if not style:
        return code
    return _STRIP[style].sub(lambda m: m.group(1) or " ", code)


# blanks are skipped within a match: sought from each of them, every alternative would be tried there; a comment or the end leaves the group empty
_ALL = {
    "": re.compile(rf"\s*+(?:({TOKEN.pattern})|\Z)"),
    "#": re.compile(rf"\s*+(?:({_WORD}|{_STRING}|[^\s\w#]|(?<=[^\s;(,])#|#(?![^\n]))|#[^\n]+|\Z)"),
    "/": re.compile(rf"\s*+(?:({_WORD}|{_STRING}|`(?:[^`\\]|\\.)*`|[^\s\w/]|/(?![/*]))|//[^\n]*|/\*.*?(?:\*/|\Z)|\Z)", re.S),
}


def tokens(code: str, ext: str) -> list[str]:
    """Tokens of a code in order, without comments, in one pass: a comment is matched where it begins, outside strings."""
    style = "#" if ext in HASH else "/" if ext in SLASH else ""
    found = _ALL[style].findall(code)
    if style == "/" and "`" in code:  # a template is read as the tokens it holds
        for k in reversed([i for i, t in enumerate(found) if len(t) > 1 and t[0] == "`"]):
            found[k : k + 1] = TOKEN.findall(found[k])
    return list(filter(None, found))
